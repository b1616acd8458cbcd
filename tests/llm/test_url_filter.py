"""URL rules and the listed URLs behind the Bloom filter."""

import pytest
from pyspark.sql import functions as F

from claimgauge.llm import url_filter as uf

CASES = [
    ("https://Example.ORG/es/1", "example.org", "/es/1", "example.org/es/", "block"),
    ("https://a.example.org/en/12?x#y", "a.example.org", "/en/12", "example.org/en/1", "block"),
    ("https://a.example.org/en/2", "a.example.org", "/en/2", "org/", "allow"),
    ("https://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"),
    ("https://example.org", "example.org", "", None, "allow"),
    ("http://x.com/fr/1", "x.com", "/fr/1", "com/fr/", "allow"),
    ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
    ("http://x.com/en/://org/", "x.com", "/en/://org/", None, "allow"),
    ("http://ÀB.net?q=/es/", "Àb.net", "", None, "allow"),
    ("no address", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("x\n://net.org/\npath", "net.org", "/\npath", "org/", "allow"),
    ("http://listed.net/en/5.html#top", "listed.net", "/en/5.html", None, "block"),
    ("https://LISTED.net:443/en/5/?utm_source=feed", "listed.net:443", "/en/5/", None, "block"),
    ("https://listed.net/en/5?page=2", "listed.net", "/en/5", None, "allow"),
    ("https://listed.net/en/5?page=2&ref=x", "listed.net", "/en/5", None, "allow"),
]


@pytest.mark.parametrize("blocks", [uf.BLOCKS, 1])
def test_verdicts(spark, blocks):
    rows = [(i, url, "x") for i, (url, *_) in enumerate(CASES)] + [(None, CASES[0][0], "x"), (3, CASES[3][0], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, key string")
    listed = spark.createDataFrame([("listed.net/en/5",), ("listed.net/en/5",), (None,), ("x.org/fr",)], "key string")
    got = uf.filter_urls(pages, listed, blocks=blocks).collect()
    expected = [(i, *case[1:]) for i, case in enumerate(CASES)] + [(None, *CASES[0][1:]), (3, *CASES[3][1:])]
    assert sorted([tuple(r)[:5] for r in got], key=repr) == sorted(expected, key=repr)


def test_the_filter_passes_every_listed_url_and_few_others(spark):
    listed = spark.range(5000).select(F.concat(F.lit("h.net/"), "id").alias("key"))
    urls = spark.range(10000).select(F.concat(F.lit("h.net/"), "id").alias("key"), "id")
    passed = uf.possible_hits(urls, listed, 1 << 10).where("possible").select("id").collect()
    inside = [r.id for r in passed if r.id < 5000]
    assert len(inside) == 5000 and len(passed) - 5000 < 500
    assert uf.bloom_filter(listed, 1 << 10).count() <= 1 << 10


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    listed = spark.createDataFrame([], "key string")
    assert uf.filter_urls(pages, listed).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    assert uf.filter_urls(one, listed).first().verdict == "allow"


def test_number_of_blocks_follows_the_list():
    assert uf.filter_blocks(0) == uf.BLOCKS and uf.filter_blocks(10**12) == uf.MOST_BLOCKS
    assert uf.BLOCKS < uf.filter_blocks(4_000_000) < uf.MOST_BLOCKS


def test_query_with_a_number_beyond_long(spark, tmp_path):
    urls = ["http://a.com/en/99999999999999999999", "http://a.net/en/7", None]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(7, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.page_id: r.verdict for r in uf.op6_url_filter(spark, str(tmp_path)).collect()}
    assert got == {0: "allow", 1: "block", 2: "allow"}
