"""One Markdown file per policy, written by tasks and made visible by one commit.

Tasks write every document under a name of its own in a hidden folder beside the visible files. When all tasks have
ended, the commit moves, of the documents with equal names, the last in key order to its visible name; an abort
removes what was written. So a task that fails or runs twice leaves no file, and visible files are always whole. Only the
writing runs in Python; documents are rendered by built-in functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimgauge.operators.policy_docs import KEYS, policy_file_name, policy_markdown

#: Folder for files that are not committed yet; Spark's readers skip names that begin like this.
HIDDEN = "_writing"


def _store_of(uri: str):
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def policy_file_source():
    """The data source ``policy_files`` for rows of key columns, ``file_name`` and ``md``.

    Its classes are made here, so that they travel with the plan and executors need no copy of this package.
    """
    from dataclasses import dataclass

    from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

    hidden, n_keys, open_store = HIDDEN, len(KEYS), _store_of

    @dataclass
    class Written(WriterCommitMessage):
        """``(file name, keys, hidden path)`` of every document of a task."""

        files: list

    class PolicyFileWriter(DataSourceWriter):
        def __init__(self, folder: str):
            import uuid

            self.folder, self.run = folder.rstrip("/"), uuid.uuid4().hex
            # Made once, on the driver: a task that outlives an abort finds no folder to write into.
            store, _, place = self._hidden()
            store.create_dir(place, recursive=True)

        def _hidden(self):
            store, base = open_store(self.folder)
            return store, base, f"{base}/{hidden}-{self.run}"

        def write(self, iterator):
            import uuid

            store, _, place = self._hidden()
            files = []
            for row in iterator:
                *keys, name, text = row
                path = f"{place}/{uuid.uuid4().hex}"
                with store.open_output_stream(path) as out:
                    out.write(text.encode())
                files.append((name, ["" if key is None else str(key) for key in keys[:n_keys]], path))
            return Written(files)

        def commit(self, messages):
            store, base, place = self._hidden()
            chosen = {}
            for message in messages:
                for name, keys, path in message.files if message else ():
                    if name not in chosen or chosen[name][0] <= keys:
                        chosen[name] = keys, path
            for name, (_, path) in sorted(chosen.items()):
                store.move(path, f"{base}/{name}")
            self._remove(store, place)

        def abort(self, messages):
            store, _, place = self._hidden()
            self._remove(store, place)

        @staticmethod
        def _remove(store, place):
            if store.get_file_info(place).type.name == "Directory":
                store.delete_dir(place)

    class PolicyFiles(DataSource):
        @classmethod
        def name(cls):
            return "policy_files"

        def writer(self, schema, overwrite):
            return PolicyFileWriter(self.options["path"])

    return PolicyFiles


def write_policy_files(seeds: DataFrame, folder: str) -> list[str]:
    """One ``POL_*.md`` per seed in the folder; returns the names, sorted.

    Of seeds whose names collide the last in key order stays; files of other names stay as they are.
    """
    spark = seeds.sparkSession
    spark.dataSource.register(policy_file_source())
    docs = seeds.select(*KEYS, policy_file_name().alias("file_name"), policy_markdown().alias("md"))
    # The names do not depend on what the folder held before.
    names = docs.agg(F.sort_array(F.collect_set("file_name"))).first()[0]
    store, base = _store_of(folder)
    store.create_dir(base, recursive=True)
    docs.write.format("policy_files").mode("append").option("path", folder).save()
    return names


def read_written_files(spark: SparkSession, folder: str) -> DataFrame:
    """``file_name, md`` of the folder's own Markdown files."""
    files = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("md"))
