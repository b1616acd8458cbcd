"""Intermediate tables: where they go, and which of them stay."""

import os
from types import SimpleNamespace

import pytest

from claimgauge.operators import stages


def session(settings, master="local[2]", application="app-test"):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: settings.get(key, default)),
        sparkContext=SimpleNamespace(master=master, applicationId=application),
    )


def test_a_local_session_without_setting_gets_one_folder():
    folder = stages.shared_folder(session({}))
    assert os.path.isdir(folder) and stages.shared_folder(session({})) == folder
    assert stages.shared_folder(session({"spark.checkpoint.dir": "/shared"})) == "/shared"


def test_a_cluster_needs_the_setting():
    try:
        stages.shared_folder(session({}, "spark://host:7077"))
    except ValueError as error:
        assert "spark.checkpoint.dir" in str(error)
    else:
        raise AssertionError("no error")


def test_the_last_stage_stays(spark):
    kept = stages.materialize(spark.range(3), "kept")
    with stages.all_but_last_stage(spark):
        inner = stages.materialize(spark.range(4), "inner")
        result = stages.materialize(inner.where("id > 1"), "result")
    assert kept.count() == 3 and result.count() == 2
    name = inner.inputFiles()[0].removeprefix("file://")
    assert not os.path.exists(name)


def test_limit_of_the_session_stays(spark, monkeypatch):
    limit = "spark.sql.codegen.hugeMethodLimit"
    with pytest.raises(ZeroDivisionError), stages.compiled_methods(spark):
        assert spark.conf.get(limit) == "8000"
        1 / 0
    assert spark.conf.get(limit, None) is None
    spark.conf.set(limit, "4000")
    try:
        with stages.compiled_methods(spark):
            assert spark.conf.get(limit) == "4000"
        assert spark.conf.get(limit) == "4000"
    finally:
        spark.conf.unset(limit)
