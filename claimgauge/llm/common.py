"""What several of the operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from claimgauge.operators.stages import scratch_path

#: White space between words, as a Java pattern and as characters.
SPACES = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def store(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: a later step never repeats what lies before."""
    path = scratch_path(df.sparkSession, f"llm-{label}")
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own under the shared folder, for archives written by tasks."""
    return scratch_path(spark, f"llm-{label}")


def lower_ascii(word: Column) -> Column:
    """A-Z lower-cased, everything else as it is; meant for words, most of which are ASCII."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Words between white space, in order; empty for null."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed != "", F.split(trimmed, SPACES)).otherwise(F.array().cast("array<string>"))


def row_identity(df: DataFrame, label: str) -> DataFrame:
    """The stored table with ``part`` and ``pos``: every row's partition and its place in it.

    Both are fixed when the table is written, so later steps agree on them whatever is retried.
    """
    return store(df.withColumns({"part": F.spark_partition_id(), "pos": F.monotonically_increasing_id()}), label)


def unique_name() -> str:
    return uuid.uuid4().hex


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per application.

    They are served by the driver, so that a cluster needs no copy of its own.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(), f"{os.path.basename(top)}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
