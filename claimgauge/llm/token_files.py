"""Token ids in binary files: one zstandard frame per document, a dictionary shared by all.

A file holds, little-endian:

    magic "CGTOKENS", version (u32), bytes per id (u32), SHA-256 of the dictionary (32 bytes)
    one zstandard frame per document: its ids
    per document: doc_id (i64), 1 if it has an id (u32), ids (u64), first byte of the frame (u64)
    number of documents (u64), first byte of that index (u64), magic

so that any document can be read alone: the index entry gives the frame, the dictionary's hash its key.
The dictionary is trained on the serialized ids of a bounded sample and lies beside the files.

Documents are written in ascending id, null ids first and equal ids by text hash. A null text is an
empty text, which is its end id alone. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame, Window, functions as F, types as T

from claimgauge.llm.common import new_folder, store, unique_name
from claimgauge.llm.shared_files import make_folder, read_range, read_whole, train_dictionary, writing
from claimgauge.llm.tokens import encoder

MAGIC = b"CGTOKENS"
VERSION = 1
END_ID = 2
#: Sample of the dictionary: documents with the smallest hashes, and most bytes of each.
SAMPLE_ROWS, SAMPLE_BYTES = 1000, 4096
DICTIONARY_BYTES = 32_768
#: A file is closed when it has reached so many bytes.
FILE_BYTES = 64 << 20
LEVEL = 3
#: Words that a worker remembers; with nothing else beside it in the worker, more than the encoder's own default.
CACHED_WORDS = 600_000

_HEAD = struct.Struct("<8sII32s")
_ENTRY = np.dtype([("doc_id", "<i8"), ("has_id", "<u4"), ("n_ids", "<u8"), ("at", "<u8")])
_TAIL = struct.Struct("<QQ8s")


class TokenFileWriter:
    """Writes one file; documents come in order."""

    def __init__(self, out, width: int, dictionary: bytes):
        self.out, self.entries, self.at = out, [], _HEAD.size
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True)
        out.write(_HEAD.pack(MAGIC, VERSION, width, hashlib.sha256(dictionary).digest()))

    def add(self, doc_id: int | None, data: bytes, n_ids: int) -> None:
        frame = self.compressor.compress(data)
        self.out.write(frame)
        self.entries.append((doc_id or 0, doc_id is not None, n_ids, self.at))
        self.at += len(frame)

    def close(self) -> None:
        self.out.write(np.array(self.entries, _ENTRY).tobytes())
        self.out.write(_TAIL.pack(len(self.entries), self.at, MAGIC))


class TokenFile:
    """Reads a file's bytes, checking the marks, the dictionary's hash and every length."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, version, width, hashed = _HEAD.unpack_from(data)
        n, index, tail = _TAIL.unpack_from(data, len(data) - _TAIL.size)
        if magic != MAGIC or tail != MAGIC or version != VERSION or width not in (2, 4):
            raise ValueError("not a token file")
        if hashed != hashlib.sha256(dictionary).digest():
            raise ValueError("the file was written with another dictionary")
        if index + n * _ENTRY.itemsize + _TAIL.size != len(data):
            raise ValueError("the index does not fit the file")
        self.data, self.dtype = data, np.dtype(f"<u{width}")
        self.entries = np.frombuffer(data, _ENTRY, n, index)
        self.ends = np.append(self.entries["at"][1:], index) if n else self.entries["at"]
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.decompressor = zstandard.ZstdDecompressor(dict_data=shared)

    def __len__(self) -> int:
        return len(self.entries)

    def doc_id(self, i: int) -> int | None:
        return int(self.entries["doc_id"][i]) if self.entries["has_id"][i] else None

    def ids(self, i: int) -> np.ndarray:
        frame = self.data[int(self.entries["at"][i]) : int(self.ends[i])]
        ids = np.frombuffer(self.decompressor.decompress(frame), self.dtype)
        if len(ids) != self.entries["n_ids"][i]:
            raise ValueError("a frame has another number of ids than the index says")
        return ids


def read_document(path: str, size: int, i: int, dictionary: bytes) -> np.ndarray:
    """The ids of document ``i`` of a file of ``size`` bytes, reading only the index entry and the frame."""
    n, index, _ = _TAIL.unpack(read_range(path, size - _TAIL.size, _TAIL.size))
    width = _HEAD.unpack(read_range(path, 0, _HEAD.size))[2]
    both = np.frombuffer(read_range(path, index + i * _ENTRY.itemsize, (2 if i + 1 < n else 1) * _ENTRY.itemsize), _ENTRY)
    end = int(both["at"][1]) if i + 1 < n else index
    frame = read_range(path, int(both["at"][0]), end - int(both["at"][0]))
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return np.frombuffer(zstandard.ZstdDecompressor(dict_data=shared).decompress(frame), f"<u{width}")


def id_dictionary(docs: DataFrame, path: str, sample_rows: int = SAMPLE_ROWS) -> bytes:
    """A dictionary trained on the serialized ids of a bounded, fixed sample of documents."""
    import pyarrow as pa

    hashes = docs.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(sample_rows).collect()
    last = hashes[-1]["h"] if hashes else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [encoder(path, CACHED_WORDS).encode(text or "")[:SAMPLE_BYTES] for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary())], ["data"])

    sample = docs.where(F.xxhash64("doc_id") <= last).select("text").limit(sample_rows)
    return train_dictionary(sorted(bytes(r["data"]) for r in sample.mapInArrow(run, "data binary").collect()), DICTIONARY_BYTES)


def write_token_files(docs: DataFrame, path: str, folder: str) -> DataFrame:
    """Write all documents in ascending id; returns ``part, shard, path, n_docs, n_ids`` of every file, stored."""
    import pyarrow as pa
    from pyspark import TaskContext

    source = docs.select("doc_id", "text")
    dictionary = id_dictionary(source, path)
    make_folder(folder)
    with writing(f"{folder}/dictionary") as out:
        out.write(dictionary)
    ordered = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    schema = T._parse_datatype_string("part int, shard int, path string, n_docs long, n_ids long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path, CACHED_WORDS)
        end = END_ID.to_bytes(tokens.width, "little")
        part = TaskContext.get().partitionId()

        def rows():
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield doc_id, tokens.encode(text.as_py() or "") + end

        found, waiting = [], rows()
        row = next(waiting, None)
        while row is not None:
            name = f"{folder}/tokens-{part:05d}-{len(found):05d}-{unique_name()}"
            n_ids = 0
            with writing(name) as out:
                writer = TokenFileWriter(out, tokens.width, dictionary)
                while row is not None and writer.at < FILE_BYTES:
                    n = len(row[1]) // tokens.width
                    writer.add(row[0], row[1], n)
                    n_ids += n
                    row = next(waiting, None)
                writer.close()
            found.append((part, len(found), name, len(writer.entries), n_ids))
        if found:
            columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return store(ordered.mapInArrow(run, schema), "token-files")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """Per document, in file order: ``doc_id, start, n_tokens, ids_crc32`` from the files' own contents."""
    import pyarrow as pa

    dictionary = read_whole(f"{folder}/dictionary")
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = TokenFile(read_whole(path), dictionary)
                out = []
                for i in range(len(file)):
                    ids = file.ids(i)
                    out.append((file.doc_id(i), base, len(ids), zlib.crc32(ids.astype("<u4"))))
                    base += len(ids)
                columns = [pa.array(c, pa.int64()) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    # A number that is given is not merged: as many tasks as files.
    spread = placed.repartition(max(1, files.count()), "path")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = new_folder(spark, "token-archive")
    return read_token_files(write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), folder), folder)
