"""URL filters: rules by host and path, then a list of URLs behind a blocked Bloom filter.

A rule such as ``example.org/es/`` fits its host and all subdomains if the path starts with its own; the
longest fitting rule decides. URLs without a rule are looked up in a list of canonical URLs. The list
is hashed into a blocked Bloom filter of a fixed size: every entry sets one bit in each of the four
words of one block. Only that filter is broadcast, whatever the length of the list. URLs whose bits are
all set go to an exact hash join with the list, which removes the false positives; it is salted, so that
one URL may hold any share of the pages. All of it is built-in expressions.

A null url, or one without ``://``, has an empty host and path, fits no rule and is never listed. Repeated rows are
judged each by itself; ids may be null. Other columns are not read. Empty tables give empty results.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, functions as F

from claimgauge.llm.common import LOWER, UPPER, store

#: Blocks of four 64-bit words: 2 MB, under one percent false positives up to some 1.5 million listed URLs.
BLOCKS, MOST_BLOCKS = 1 << 16, 1 << 20
#: Listed addresses that a block should hold.
BLOCK_KEYS = 16
WORDS = 4
#: Copies of the list for the exact join; the pages of one URL are spread over so many tasks.
SALTS = 8

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclasses.dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host and path, the same for addresses that lead to one page; null without a host.

    Scheme, fragment, tracking parameters, default ports, ``.html`` and a last slash make no difference.
    """
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    params = F.array_sort(
        F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"))
    )
    host = F.regexp_replace(url_host(url), ":(80|443)$", "")
    path = F.regexp_replace(url_path(url), r"(/index)?(\.html?)?/*$", "")
    whole = F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))
    return F.when(host != "", whole)


def _fits(rule: UrlRule) -> Column:
    host = F.col("host")
    return ((host == rule.host) | host.endswith("." + rule.host)) & F.col("path").startswith(rule.path)


def _longest_rule(rules: tuple[UrlRule, ...], field: str) -> Column:
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        chosen = F.when(_fits(rule), F.lit(getattr(rule, field))).otherwise(chosen)
    return chosen


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bit(key: Column, word: int) -> Column:
    """Which bit of a word the key sets: six bits of a second hash."""
    second = F.xxhash64(key, F.lit("bits"))
    return F.shiftrightunsigned(second, 6 * word).bitwiseAND(F.lit(63)).cast("int")


def bloom_filter(listed: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """``block, w0 .. w3`` of the distinct ``key``; at most ``blocks`` rows."""
    bits = [F.expr(f"shiftleft(1L, b{i})").alias(f"w{i}") for i in range(WORDS)]
    keyed = listed.select(_block(F.col("key"), blocks).alias("block"), *[_bit(F.col("key"), i).alias(f"b{i}") for i in range(WORDS)])
    return keyed.select("block", *bits).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def possible_hits(urls: DataFrame, listed: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """``urls`` with ``possible``: whether the filter has all bits of ``key``."""
    probed = urls.withColumn("block", _block(F.col("key"), blocks)).join(F.broadcast(bloom_filter(listed, blocks)), "block", "left")
    every = F.lit(True)
    for i in range(WORDS):
        every = every & (F.expr(f"shiftrightunsigned(w{i}, bit{i})").bitwiseAND(F.lit(1)) == 1)
    probed = probed.withColumns({f"bit{i}": _bit(F.col("key"), i) for i in range(WORDS)})
    return probed.withColumn("possible", F.coalesce(every & F.col("key").isNotNull(), F.lit(False))).select(*urls.columns, "possible")


def filter_blocks(n_listed: int) -> int:
    """Blocks for so many keys: enough for ``BLOCK_KEYS`` in each, within ``BLOCKS`` and ``MOST_BLOCKS``."""
    return min(MOST_BLOCKS, max(BLOCKS, 1 << (n_listed // BLOCK_KEYS).bit_length()))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: tuple[UrlRule, ...] = RULES, blocks: int | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, listed`` of every page; ``listed`` has canonical URLs as ``key``."""
    listed = store(listed.where("key IS NOT NULL").select("key").distinct(), "listed-urls")
    blocks = blocks or filter_blocks(listed.count())
    parts = pages.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    ruled = parts.select(
        "page_id", "host", "path", canonical(F.col("url")).alias("key"),
        _longest_rule(rules, "name").alias("rule"), _longest_rule(rules, "verdict").alias("ruled"),
    )
    probed = possible_hits(ruled, listed, blocks)
    ask = F.col("possible") & F.col("rule").isNull()
    rest = probed.where(~ask).withColumn("listed", F.lit(False))
    salted = listed.select(F.col("key").alias("listed_key"), F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("listed_salt"))
    asked = probed.where(ask).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    on = (F.col("key") == F.col("listed_key")) & (F.col("salt") == F.col("listed_salt"))
    checked = asked.join(salted, on, "left").withColumn("listed", F.col("listed_key").isNotNull()).select(*rest.columns)
    verdict = F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow"))
    return rest.union(checked).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed")


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """The list holds the addresses of pages made from documents that are labelled toxic."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select("doc_id")
    of_doc = F.regexp_extract(url_path(F.col("url")), r"^/[a-z]+/([0-9]+)", 1)
    listed = (
        pages.where(of_doc != "")
        .select(canonical(F.col("url")).alias("key"), of_doc.try_cast("long").alias("doc_id"))
        .join(labels, "doc_id", "left_semi")
        .select("key")
    )
    return filter_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = r"""
WITH p AS (
  SELECT page_id, url,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages
), k AS (
  SELECT *, list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1, 's'), '&'),
                lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS params,
         TRY_CAST(nullif(regexp_extract(path, '^/[a-z]+/([0-9]+)', 1), '') AS BIGINT) AS doc_id
  FROM p
), c AS (
  SELECT *, CASE WHEN regexp_replace(host, ':(80|443)$', '') <> '' THEN regexp_replace(host, ':(80|443)$', '')
         || regexp_replace(path, '(/index)?(\.html?)?/*$', '') || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS key
  FROM k
), listed AS (SELECT DISTINCT key FROM c WHERE key IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
), r AS (
  SELECT *, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                 WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
                 WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
                 WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM c
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN listed.key IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN listed ON r.key = listed.key
"""
