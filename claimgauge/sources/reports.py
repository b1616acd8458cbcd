"""Report tables as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_reports(reports: dict[str, DataFrame], path: str) -> dict[str, str]:
    """Each table as JSON lines in a folder of its name; null fields are kept."""
    written = {}
    for name, df in reports.items():
        written[name] = f"{path}/{name}.json"
        df.write.mode("overwrite").option("ignoreNullFields", False).json(written[name])
    return written
