"""Claims and feature tables as parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimgauge.operators.stages import compiled_methods
from claimgauge.schema import CLAIMS


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """Any parquet table; Spark reports a missing or unreadable path itself."""
    return spark.read.parquet(path)


def load_claims(spark: SparkSession, path: str) -> DataFrame:
    """A claims table with the columns that its files have, known ones first and in their canonical types.

    Missing columns stay missing and others are kept, so that the checks of a table see what is there.
    """
    stored = spark.read.parquet(path)
    known = [
        F.col(field.name) if stored.schema[field.name].dataType == field.dataType else F.col(field.name).cast(field.dataType)
        for field in CLAIMS
        if field.name in stored.columns
    ]
    return stored.select(*known, *[f"`{name}`" for name in stored.columns if name not in CLAIMS.names])


def save_table(df: DataFrame, path: str) -> str:
    with compiled_methods(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return path


def save_claims(claims: DataFrame, path: str) -> str:
    return save_table(claims, path)


def write_features(features: dict[str, DataFrame], path: str) -> dict[str, str]:
    """The enriched claims and one table per feature set, by name, under one folder."""
    written = {}
    for name, df in features.items():
        table = "enriched_claims" if name == "claims" else f"{name}_features"
        written[name] = save_table(df, f"{path}/{table}.parquet")
    return written
