"""WARC archives in zstandard: a dictionary in the leading skippable frame, one frame per record.

Writing: every page becomes a ``response`` record, or a ``revisit`` of the page with the smallest id that
has the same payload of at least ``MIN_PAYLOAD`` bytes. A revisit holds headers only. Which payloads
repeat is found on digests alone; pages are written where they are read, into files of bounded size.

Reading: the dictionary comes from the archive itself; then frame after frame is decoded to one record
each, whose headers, block length, payload length and payload digest are checked. Anything that does not
fit raises an error.

A null page is an empty payload. Pages without an id are responses, and nothing refers to them; of several rows
with the smallest id of a payload each is a response. Other columns are not read. An empty table gives
no records.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import struct
import uuid
from collections.abc import Iterator

import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from claimgauge.llm.common import new_folder, store, unique_name
from claimgauge.llm.shared_files import make_folder, read_whole, train_dictionary, writing

#: Smallest payload that is deduplicated.
MIN_PAYLOAD = 100
#: Sample of the dictionary: pages with the smallest id hashes, and most bytes of each.
SAMPLE_ROWS, SAMPLE_BYTES = 500, 8192
DICTIONARY_BYTES = 32_768
FILE_BYTES = 64 << 20
LEVEL = 3

# The skippable frame that holds a dictionary, zstandard's frame mark, WARC names.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_MARK = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_FRAME = struct.Struct("<II")
#: The same date in all records: a page has none of its own.
_DATE = dt.datetime(2000, 1, 1, tzinfo=dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"


def _line(value: str) -> str:
    """A header value without line ends or other control characters."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id, url, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One WARC record with its block: the payload, or nothing for a revisit."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, url)),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", _line(url or "")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        headers.append(("WARC-Page-ID", str(page_id)))
    if revisit:
        headers += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To-Page-ID", str(refers_to))]
    head = b"".join(f"{name}: {value}\r\n".encode() for name, value in headers)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The headers by lower-case name and the block of a whole record, checked."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not mark or first != VERSION:
        raise ValueError("not a WARC record")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name.lower().decode() in headers:
            raise ValueError("a bad header line")
        headers[name.lower().decode()] = value.strip().decode()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"a record without {name}")
    if headers["warc-type"] not in ("response", "revisit"):
        raise ValueError("an unknown record type")
    block, tail = rest[:-4], rest[-4:]
    if tail != b"\r\n\r\n" or len(block) != int(headers["content-length"]):
        raise ValueError("the block has another length than the header says")
    digest = headers.get("warc-payload-digest", "")
    if headers["warc-type"] == "response":
        if digest != f"sha256:{hashlib.sha256(block).hexdigest()}" or int(headers["warc-payload-length"]) != len(block):
            raise ValueError("the payload does not fit its digest or length")
    elif block or "warc-refers-to-page-id" not in headers:
        raise ValueError("a revisit without what it refers to")
    return {"headers": headers, "block": block}


def archive_head(dictionary: bytes) -> bytes:
    return _FRAME.pack(DICTIONARY_FRAME, len(dictionary)) + dictionary


def frame_length(view: memoryview) -> int:
    """Bytes of the leading zstandard frame: its header, its blocks, and a checksum if it has one."""
    at = zstandard.frame_header_size(view)
    last = False
    while not last:
        if at + 3 > len(view):
            raise ValueError("a frame ends early")
        mark = int.from_bytes(view[at : at + 3], "little")
        last, kind, size = mark & 1, mark >> 1 & 3, mark >> 3
        at += 3 + (1 if kind == 1 else size)
    return at + 4 * zstandard.get_frame_parameters(view).has_checksum


def read_archive(data: bytes) -> Iterator[dict]:
    """The records of an archive, one per frame."""
    if len(data) < _FRAME.size:
        raise ValueError("not a zstandard archive")
    mark, size = _FRAME.unpack_from(data)
    if mark != DICTIONARY_FRAME or _FRAME.size + size > len(data):
        raise ValueError("no dictionary in the leading frame")
    dictionary = data[_FRAME.size : _FRAME.size + size]
    if dictionary[:4] == ZSTD_MARK:
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    opened = zstandard.ZstdDecompressor(dict_data=shared)
    at, view = _FRAME.size + size, memoryview(data)
    while at < len(data):
        if data[at : at + 4] != ZSTD_MARK:
            raise ValueError("not a frame where one should begin")
        frame = view[at : at + frame_length(view[at:])]
        expected = zstandard.frame_content_size(frame)
        if expected < 0:
            raise ValueError("a frame without its content size")
        content = opened.decompress(frame)
        if len(content) != expected:
            raise ValueError("a frame ends early")
        at += len(frame)
        yield parse_record(content)


def page_dictionary(pages: DataFrame, sample_rows: int = SAMPLE_ROWS) -> bytes:
    """A dictionary trained on records of a bounded, fixed sample of pages."""
    hashes = pages.select(F.xxhash64("page_id").alias("h")).orderBy("h").limit(sample_rows).collect()
    last = hashes[-1]["h"] if hashes else 0
    rows = pages.where(F.xxhash64("page_id") <= last).select("page_id", "url", F.substring("html", 1, SAMPLE_BYTES).alias("html"))
    samples = []
    for row in rows.limit(sample_rows).collect():
        payload = (row["html"] or "").encode()
        samples.append(record(row["page_id"], row["url"], payload, hashlib.sha256(payload).hexdigest()))
    return train_dictionary(sorted(samples), DICTIONARY_BYTES)


def with_references(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, refers_to``: the smallest id of an equal payload, null for a first one."""
    payload = F.coalesce("html", F.lit(""))
    narrow = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size"))
    firsts = store(
        narrow.where(F.col("size") >= MIN_PAYLOAD)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1 AND first_id IS NOT NULL")
        .drop("n"),
        "repeated-payloads",
    )
    # Only ids meet the digests, of which one may belong to any share of the pages; payloads are joined by page.
    later = narrow.join(firsts, "digest").where("page_id > first_id").select("page_id", "digest", F.col("first_id").alias("refers_to"))
    later = store(later.distinct(), "revisits")
    whole = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("digest"))
    return whole.join(later, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages as records; returns the ``path`` and number of records of every archive, stored."""
    import pyarrow as pa
    from pyspark import TaskContext

    source = with_references(pages)
    dictionary = page_dictionary(pages.select("page_id", "url", "html"))
    make_folder(folder)
    schema = T._parse_datatype_string("path string, n_records long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True)
        part = TaskContext.get().partitionId()

        def rows():
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist())

        found, waiting = [], rows()
        row = next(waiting, None)
        while row is not None:
            name = f"{folder}/pages-{part:05d}-{len(found):05d}-{unique_name()}.warc.zst"
            n, size = 0, 0
            with writing(name) as out:
                out.write(archive_head(dictionary))
                while row is not None and size < FILE_BYTES:
                    page_id, url, html, refers_to = row
                    payload = (html.as_py() or "").encode()
                    frame = compressor.compress(record(page_id, url, payload, hashlib.sha256(payload).hexdigest(), refers_to))
                    out.write(frame)
                    n, size = n + 1, size + len(frame)
                    row = next(waiting, None)
            found.append((name, n))
        if found:
            names, counts = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], schema.names)

    return store(source.mapInArrow(run, schema), "archives")


def read_warc(files: DataFrame) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload`` of every record."""
    import pyarrow as pa

    schema = T._parse_datatype_string(
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    )

    def number(value: str | None) -> int | None:
        return None if value is None else int(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)

        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, size, n = [], 0, 0
                for found in read_archive(read_whole(path)):
                    h = found["headers"]
                    rows.append(
                        (number(h.get("warc-page-id")), h.get("warc-target-uri"), int(h["warc-payload-length"]), h["warc-payload-digest"].removeprefix("sha256:"),
                         h["warc-type"], number(h.get("warc-refers-to-page-id")), found["block"])
                    )
                    n, size = n + 1, size + len(found["block"])
                    if size > 8 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)
                if n != expected:
                    raise ValueError(f"{path} holds {n} records instead of {expected}")

    # A number that is given is not merged: as many tasks as files.
    return files.select("path", "n_records").repartition(max(1, files.count()), "path").mapInArrow(run, schema)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    records = read_warc(write_warc(pages, new_folder(spark, "warc")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
