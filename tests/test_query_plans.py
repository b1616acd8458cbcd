"""What the catalog's queries read and how they deal it, over the driver tables."""

import os
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql.classic.dataframe import DataFrame

from catalog import queries
from claimgauge.operators import validation
from claimgauge.operators.stages import LONGEST_COMPILED_METHOD
from test_catalog import SF_DIR

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


def derived(df):
    return any(name.endswith("lineitem.parquet") for name in df.inputFiles())


def test_batches_of_a_feature_state_are_stored(spark, monkeypatch):
    given, append = [], queries.feature_state.append_to_state
    monkeypatch.setattr(queries.feature_state, "append_to_state", lambda s, root, batch, name: (given.append(batch), append(s, root, batch, name)))
    queries.QUERIES["appended_service_category_features"](spark, SF_DIR)
    assert len(given) == 2 and not any(map(derived, given))


def test_claims_of_key_metrics_and_providers_are_stored(spark, monkeypatch):
    given, provider_features = [], queries.features.provider_features
    monkeypatch.setattr(queries.features, "provider_features", lambda claims: (given.append(claims), provider_features(claims))[1])
    metrics = queries.QUERIES["report_key_metrics"](spark, SF_DIR)
    assert len(given) == 1 and not derived(given[0]) and not derived(metrics)


@pytest.mark.parametrize("name", ["load_claims_by_month", "window_filter_by_month", "policy_impact_by_month"])
def test_claims_by_month_are_dealt_as_lines(spark, monkeypatch, name):
    """Both saves deal order lines with a month and a code, not whole claims."""
    dealt, deal = [], DataFrame.repartitionByRange
    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda df, *order: (dealt.append(df.columns), deal(df, *order))[1])
    queries.QUERIES[name](spark, SF_DIR)
    assert len(dealt) == 2 and all(len(columns) <= 11 for columns in dealt)


@pytest.mark.parametrize("name", ["load_claims_by_month", "window_filter_by_month", "policy_impact_by_month"])
def test_lines_of_claims_by_month_are_compressed_tightly(spark, monkeypatch, name):
    stored, materialize = {}, queries.materialize
    monkeypatch.setattr(queries, "materialize", lambda df, label, *args: stored.setdefault(label, materialize(df, label, *args)))
    queries.QUERIES[name](spark, SF_DIR)
    files = [file.removeprefix("file://") for file in stored["lines"].inputFiles()]
    groups = [pq.ParquetFile(file).metadata.row_group(0) for file in files]
    assert {group.column(i).compression for group in groups for i in range(group.num_columns)} == {"ZSTD"}


def test_arriving_files_grow_with_the_claims(spark, monkeypatch):
    """A lot is not dealt to a fixed number of tasks: eight partitions of claims arrive as eight files."""
    order_claims, routed, batches = queries.order_claims, queries.routing.route_arrived, []

    def route(session, source, *args, **kwargs):
        batches.append((len(session.read.parquet(source).inputFiles()), kwargs.get("files_per_batch")))
        routed(session, source, *args, **kwargs)

    monkeypatch.setattr(queries, "order_claims", lambda *args: order_claims(*args).repartition(8))
    monkeypatch.setattr(queries.routing, "route_arrived", route)
    found = queries.QUERIES["route_arriving_claims"](spark, SF_DIR)
    assert batches == [(8, 6), (16, 6), (16, None)]
    assert found.count() == order_claims(spark, SF_DIR).count()


LIMIT = "spark.sql.codegen.hugeMethodLimit"


@pytest.mark.parametrize("name", ["write_features_claims", "write_reports_validate_issues", "route_arriving_claims"])
def test_whole_claims_are_written_by_compiled_methods(spark, monkeypatch, name):
    """Tagged or damaged claims make one method of more than 8000 bytes, which would be interpreted."""
    wide, parquet = [], DataFrameWriter.parquet

    def write(writer, *args, **kwargs):
        if len(writer._df.columns) >= len(queries.order_claims(spark, SF_DIR).columns):
            wide.append(int(spark.conf.get(LIMIT)))
        return parquet(writer, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", write)
    queries.QUERIES[name](spark, SF_DIR)
    assert wide and set(wide) == {LONGEST_COMPILED_METHOD}
    assert spark.conf.get(LIMIT, None) is None


def test_a_scan_of_derived_claims_is_one_compiled_method(spark, capsys):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        validation.scan(queries.order_claims(spark, SF_DIR)).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)
    assert sizes and max(map(int, sizes)) <= LONGEST_COMPILED_METHOD
