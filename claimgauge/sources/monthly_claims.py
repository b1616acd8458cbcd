"""Claims laid out by month of service, so that questions about a period read only its months.

A folder per month, files sorted by procedure code. Rows are dealt to tasks by ranges of month, code and claim, so a
month that holds a third of all claims is written by as many tasks as it needs, and small months share one. Saving
replaces the months that the given claims hold and leaves the others; a batch saved twice is there once.

Claims that are derived row by row from narrower ones are best dealt as those (:func:`deal_by_month`) and derived by the
tasks that write them (:func:`write_months`): only the narrow rows are shuffled and sorted.

Months are kept and read many times, so they are compressed more tightly than by default.

Claims without a date of service have a folder of their own, which no period reads. An empty table changes nothing.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from claimgauge.operators.stages import compiled_methods
from claimgauge.sources.claims import load_claims

#: The column of the folders: the first day of the month.
MONTH = "service_month"
#: A third smaller than Spark's default for claims by month, for about the same time.
COMPRESSION = "zstd"


def month_of(day: Column) -> Column:
    return F.trunc(day, "MM").cast("date")


def deal_by_month(rows: DataFrame, spread_by: str) -> DataFrame:
    """Rows with a ``service_date`` and a ``procedure_code``, and their month: dealt by ranges of month, code and the
    column ``spread_by``, in that order within each partition."""
    if MONTH in rows.columns:
        raise ValueError(f"the column {MONTH} is made from service_date; drop it first")
    order = (MONTH, "procedure_code", spread_by)
    return rows.withColumn(MONTH, month_of(F.col("service_date"))).repartitionByRange(*order).sortWithinPartitions(*order)


def write_months(dealt: DataFrame, path: str) -> str:
    """Write dealt claims, with their month, into the months, in place of what these held before."""
    with compiled_methods(dealt.sparkSession):
        writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", COMPRESSION)
        writer.partitionBy(MONTH).parquet(path)
    return path


def save_claims_by_month(claims: DataFrame, path: str) -> str:
    """Write the claims into their months, in place of what these months held before."""
    return write_months(deal_by_month(claims, "claim_id"), path)


def load_claims_by_month(spark: SparkSession, path: str) -> DataFrame:
    """The claims with their month as the last column, which filters and joins on months prune by."""
    claims = load_claims(spark, path)
    return claims.withColumn(MONTH, F.col(MONTH).cast("date")) if dict(claims.dtypes)[MONTH] != "date" else claims


def in_months(claims: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Leave out the months without a day from ``start`` to before ``end``; claims without months stay as they are."""
    if MONTH not in claims.columns:
        return claims
    return claims.where((F.col(MONTH) >= F.lit(start.replace(day=1))) & (F.col(MONTH) < F.lit(end)))


def in_months_of(claims: DataFrame, windows: DataFrame) -> DataFrame:
    """Leave out the months that no window (``start_date`` to before ``end_date``) touches, by dynamic pruning.

    There are no more months than the calendar has, so they are broadcast; the scan reads only their folders.
    """
    if MONTH not in claims.columns:
        return claims
    days = windows.where(F.col("start_date") < F.col("end_date"))
    touched = F.sequence(month_of(F.col("start_date")), month_of(F.date_sub("end_date", 1)), F.expr("INTERVAL 1 MONTH"))
    months = days.select(F.explode(touched).alias(MONTH)).distinct()
    return claims.join(F.broadcast(months), MONTH, "left_semi").select(claims.columns)
