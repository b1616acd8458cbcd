"""Claims that arrive as files, routed to valid and rejected rows as a stream.

Each of the two sinks is a query of its own over the same files, with its own checkpoint: the checkpoint says which
files a query has taken, and the sink's log which of its output files count. A query that is started again from its
checkpoint goes on where it ended, and adds no row twice, also after a failure in the middle of a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from claimgauge.operators.validation import route_valid_rows

SINKS = ("valid", "rejected")


def _routed(spark: SparkSession, source: str, schema: StructType, files_per_batch: int) -> DataFrame:
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return route_valid_rows(arriving)


def route_arrived(spark: SparkSession, source: str, target: str, schema: StructType, files_per_batch: int = 1000) -> None:
    """Route all files that have arrived in ``source`` and were not routed before; returns when that is done.

    ``target`` gets ``valid`` (the claims' columns), ``rejected`` (with ``failed_rules``) and both checkpoints.
    """
    failed = F.size("failed_rules") > 0
    rows = {
        "valid": _routed(spark, source, schema, files_per_batch).where(~failed).drop("failed_rules"),
        "rejected": _routed(spark, source, schema, files_per_batch).where(failed),
    }
    running = [
        rows[sink]
        .writeStream.format("parquet")
        .option("path", f"{target}/{sink}")
        .option("checkpointLocation", f"{target}/checkpoints/{sink}")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
        for sink in SINKS
    ]
    for query in running:
        query.awaitTermination()


def load_routed(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    """What both sinks hold."""
    return {sink: spark.read.parquet(f"{target}/{sink}") for sink in SINKS}
