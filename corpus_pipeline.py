"""From raw documents to packed training sequences, stage by stage.

Every stage takes all documents that its predecessor kept, read back from a stored table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimgauge.llm.common import ship_package, store
from claimgauge.llm.decontaminate import decontamination_stage
from claimgauge.llm.language_id import language_stage
from claimgauge.llm.packing import packing_stage
from claimgauge.llm.quality_rules import quality_stage
from claimgauge.llm.simhash_dedup import dedup_stage
from claimgauge.operators.stages import all_but_last_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("near_duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Tokenizers and trained models have no SQL counterpart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with all_but_last_stage(spark):
            docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
