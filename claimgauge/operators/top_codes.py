"""The most frequent values of each group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from claimgauge.functions.codes import diagnosis_list


def top_counted(counted: DataFrame, keys: list[str], code: str, n: str, k: int, name: str) -> DataFrame:
    """``name``: the k highest counts per group as ``array<struct<code,count>>``.

    ``counted`` holds one row per group and code. Equal counts are ordered by code. The rank
    filter is applied before the shuffle as well, and k bounds what is collected per group.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(n), code))
    return (
        counted.withColumn("place", place)
        .where(F.col("place") <= k)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("place", F.col(code).alias("code"), F.col(n).alias("count")))).alias("top"))
        .select(
            *keys,
            F.transform("top", lambda x: F.struct(x["code"].alias("code"), x["count"].alias("count"))).alias(name),
        )
    )


def top_k_codes(df: DataFrame, keys: list[str], k: int = 5, name: str = "top_diagnosis_codes") -> DataFrame:
    """The k most frequent diagnosis codes of each group.

    Codes are exploded and counted with map-side sums; no group is ever gathered. Unreadable
    code lists are skipped.
    """
    counted = (
        df.select(*keys, F.explode(diagnosis_list(F.col("diagnosis_codes"))).alias("code"))
        .where(F.col("code").isNotNull())
        .groupBy(*keys, "code")
        .agg(F.count("*").alias("n_code"))
    )
    return top_counted(counted, keys, "code", "n_code", k, name)
