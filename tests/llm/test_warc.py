"""WARC archives: round trips and damaged files."""

import hashlib

import pytest
import zstandard

from claimgauge.llm import warc


def archive(records, dictionary=b""):
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    compressor = zstandard.ZstdCompressor(dict_data=shared)
    return warc.archive_head(dictionary) + b"".join(compressor.compress(r) for r in records)


def one(payload=b"text", **changes):
    return warc.record(1, "http://a/b", payload, hashlib.sha256(payload).hexdigest(), **changes)


def test_records_come_back():
    for dictionary in (b"", b"WARC-Type: response and so on"):
        found = list(warc.read_archive(archive([one(), one(b""), one(b"x" * 200, refers_to=0)], dictionary)))
        assert [f["headers"]["warc-type"] for f in found] == ["response", "response", "revisit"]
        assert [f["block"] for f in found] == [b"text", b"", b""]
    packed = zstandard.ZstdCompressor().compress(b"WARC-Type: response and so on")
    data = warc.archive_head(packed) + archive([one()], b"WARC-Type: response and so on")[8 + 29 :]
    assert next(warc.read_archive(data))["block"] == b"text"


def test_odd_urls_stay_one_header_line():
    data = warc.record(2, "http://a/\r\nWARC-Type: x\x00", b"p", hashlib.sha256(b"p").hexdigest())
    assert warc.parse_record(data)["headers"]["warc-target-uri"] == "http://a/%0D%0AWARC-Type: x%00"


@pytest.mark.parametrize(
    "bad",
    [
        b"",
        b"12345678",
        archive([one()])[8:],
        archive([one()])[:-3],
        archive([one()]) + b"xxxx",
        archive([one().replace(b"WARC/1.1", b"WARC/0.9")]),
        archive([one().replace(b"Content-Length: 4", b"Content-Length: 5")]),
        archive([one().replace(b"text\r\n", b"tExt\r\n")]),
        archive([one().replace(b"WARC-Date", b"No-Date")]),
        archive([one(refers_to=0).replace(b"WARC-Refers-To-Page-ID", b"X-Other")]),
    ],
)
def test_damaged_archives_are_refused(bad):
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.read_archive(bad))


def test_round_trip_of_pages(spark, tmp_path):
    long, short = "<p>é long page</p>" * 20, "short"
    rows = [(5, "u5", long), (3, "u3", long), (3, "u3b", long), (9, None, long), (1, "u1", short), (2, "u2", short), (4, "u4", None),
            (None, "none", long), (6, "u6", ""), (7, "u7", "x" * 100), (8, "u8", "x" * 100), (10, "big", "<b>" * 300000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, size int").repartition(3)
    got = warc.read_warc(warc.write_warc(pages, f"file://{tmp_path}/warc")).collect()
    expected = []
    for page_id, url, html in rows:
        payload = (html or "").encode()
        same = [i for i, _, h in rows if h == html and i is not None]
        refers = min(same) if len(payload) >= 100 and page_id is not None and page_id > min(same) else None
        expected.append((page_id, len(payload), hashlib.sha256(payload).hexdigest(), "response" if refers is None else "revisit", refers))
    mine = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
    assert sorted(mine, key=repr) == sorted(expected, key=repr)
    assert all(r.payload == (dict((i, h) for i, _, h in rows)[r.page_id] or "").encode() for r in got if r.record_type == "response")


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(warc.write_warc(pages, f"file://{tmp_path}/none")).count() == 0
