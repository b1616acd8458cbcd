"""Policy seeds, documents and rules on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimgauge.operators.policy_docs import parse_policy_docs
from claimgauge.schema import POLICY_RULE
from claimgauge.sources.claims import save_table


def write_policy_seeds(seeds: DataFrame, path: str) -> tuple[str, str]:
    """Parquet, with the top diagnosis codes as JSON text, and JSON lines, with them as a list."""
    parquet, jsonl = f"{path}/policy_seeds.parquet", f"{path}/policy_seeds.jsonl"
    save_table(seeds.withColumn("top_diagnosis_codes", F.to_json("top_diagnosis_codes")), parquet)
    seeds.write.mode("overwrite").json(jsonl)
    return parquet, jsonl


def write_policy_docs(docs: DataFrame, path: str) -> str:
    """Documents as a table of ``file_name, md``."""
    return save_table(docs, path)


def export_policy_files(docs: DataFrame, folder: str) -> str:
    """One Markdown file per document, in a folder of its own that bears the document's name.

    Spark writes the files, so the folder may lie in any store.
    """
    named = docs.select(F.col("md").alias("value"), F.regexp_replace("file_name", r"\.md$", "").alias("document"))
    named.repartition("document").write.mode("overwrite").partitionBy("document").option("lineSep", "\0").text(folder)
    return folder


def read_policy_files(spark: SparkSession, folder: str) -> DataFrame:
    """``file_name, md`` of every Markdown file in a folder, or of every document's folder as exported there."""
    files = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True)
    name, path = F.col("_metadata.file_name"), F.col("_metadata.file_path")
    exported = F.url_decode(F.regexp_extract(path, "/document=([^/]*)/[^/]*$", 1))
    named = files.select(
        F.when(exported != "", F.concat(exported, F.lit(".md"))).when(name.endswith(".md"), name).alias("file_name"),
        F.rtrim(F.col("value"), F.lit("\0")).alias("md"),
    )
    return named.where("file_name IS NOT NULL")


def parse_policies_dir(spark: SparkSession, folder: str, output: str) -> str:
    """Rules of all Markdown files in a folder, as JSON lines in file-name order."""
    rules = parse_policy_docs(read_policy_files(spark, folder))
    return write_policy_rules(rules, output)


def write_policy_rules(rules: DataFrame, output: str) -> str:
    rules.orderBy("source_file").write.mode("overwrite").json(output)
    return output


def load_policy_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from JSON lines; blank lines are skipped."""
    return spark.read.schema(POLICY_RULE).json(path)
