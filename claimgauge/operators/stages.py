"""Stage boundaries: intermediate tables that several later steps read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: HotSpot never compiles a longer method, in bytes: it stays interpreted, several times slower.
LONGEST_COMPILED_METHOD = 8000
#: Paths handed out per application and not removed yet.
_HANDED_OUT: dict[str, list[str]] = {}
#: Folders of local sessions without a setting, per application.
_OWN_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, which executors share.

    Only a local session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors can reach")
    application = spark.sparkContext.applicationId
    if application not in _OWN_FOLDERS:
        _OWN_FOLDERS[application] = tempfile.mkdtemp(prefix="claimgauge-")
    return _OWN_FOLDERS[application]


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/claimgauge/{label}-{uuid.uuid4().hex}"
    _HANDED_OUT.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside have no generated method that is too long to be compiled.

    A projection of many columns may exceed that length as one method; Spark then generates several short ones instead.
    A limit that the session sets itself stays, and no setting is left behind.
    """
    limit = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(limit, None) is not None:
        yield
        return
    spark.conf.set(limit, str(LONGEST_COMPILED_METHOD))
    try:
        yield
    finally:
        spark.conf.unset(limit)


def materialize(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the table that was written; this runs a job.

    Later steps start from stored files, so a lost executor costs them nothing that lies before
    this point, and the optimizer knows the real size of the table. The table stays until
    :func:`release_stages`, or the end of the :func:`owned_stages` that it was made in.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with compiled_methods(spark):
        df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def release_stages(spark: SparkSession, first: int = 0) -> None:
    """Remove intermediate tables of this application, from the ``first`` one handed out.

    DataFrames that read them can no longer be run.
    """
    paths = _HANDED_OUT.get(spark.sparkContext.applicationId, [])
    configuration = spark._jsc.hadoopConfiguration()
    while len(paths) > first:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(configuration).delete(path, True)


@contextmanager
def owned_stages(spark: SparkSession) -> Iterator[None]:
    """Remove the intermediate tables that are made inside when it ends, also after an error."""
    first = len(_HANDED_OUT.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release_stages(spark, first)


@contextmanager
def all_but_last_stage(spark: SparkSession) -> Iterator[None]:
    """Remove the intermediate tables that are made inside, but for the last one, which is the result."""
    application = spark.sparkContext.applicationId
    first = len(_HANDED_OUT.get(application, []))
    yield
    made = _HANDED_OUT.get(application, [])
    last = made.pop() if len(made) > first else None
    release_stages(spark, first)
    if last:
        made.append(last)
