"""Exact URL filtering by a cascade of Bloom filters, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depdelver.session import cut, drop_cut

#: (verdict, host, path): a rule fits its host and all subdomains, for paths that start with its own.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Bits that one level of one chunk of the keys may take: a megabyte.
MAX_BITS = 1 << 23
#: False positives of a level; a level has as many as the next one encodes.
RATE = 0.03
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first ``://``, up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The text of the longest rule that fits and its verdict, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


@dataclass
class Level:
    """One Bloom filter: its words as a table of one row, its bits, its hash functions."""

    words: DataFrame
    bits: int
    hashes: int

    def has(self, key: Column, salt: int) -> Column:
        return holds(self.words.scalar(), key, salt, self.bits, self.hashes)


def holds(words: Column, key: Column, salt: int, bits: int, hashes: int) -> Column:
    """Whether a filter's words have all bits of ``key`` set."""
    found = F.lit(True)
    for at in positions(key, salt, bits, hashes):
        word = F.get(words, F.shiftright(at, 6).cast("int"))
        found = found & (word.bitwiseAND(one_bit(at)) != 0)
    return found


def one_bit(at: Column) -> Column:
    """A word with the bit of position ``at`` set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63).cast("long")).cast("int"))


def positions(key: Column, salt: int, bits: int, hashes: int) -> list[Column]:
    m = F.lit(bits).cast("long")
    a, b = F.pmod(F.xxhash64(key, F.lit(salt)), m), F.pmod(F.xxhash64(key, F.lit(~salt)), m)
    return [F.pmod(a + b * F.lit(i).cast("long"), m) for i in range(hashes)]


def build_level(keys: DataFrame, n: int, salt: int) -> Level:
    """The filter of the ``n`` rows of ``keys``; words are merged before they are shuffled."""
    spark = keys.sparkSession
    bits = 64 * max(1, ceil(-n * log(RATE) / log(2) ** 2 / 64))
    hashes = max(1, round(bits / n * log(2)))
    at = F.explode(F.array(*positions(F.col("key"), salt, bits, hashes))).alias("at")
    words = keys.select(at).select(F.shiftright("at", 6).alias("i"), one_bit(F.col("at")).alias("w"))
    zeros = spark.range(bits // 64).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("w"))
    dense = words.groupBy("i").agg(F.bit_or("w").alias("w")).unionByName(zeros).groupBy("i").agg(F.bit_or("w").alias("w"))
    return Level(cut(dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("words"))), bits, hashes)


def build_cascade(keys: DataFrame) -> list[Level]:
    """Levels for a table of distinct ``key`` with ``listed``: level 0 encodes the listed keys, each
    next one those keys of the other kind that the level before wrongly has, until none is left.
    """
    levels: list[Level] = []
    alive, inside = keys, True  # inside: the level to build encodes listed keys
    while n := alive.where(F.col("listed") == inside).count():
        levels.append(build_level(alive.where(F.col("listed") == inside), n, len(levels)))
        wrong = levels[-1].has(F.col("key"), len(levels) - 1)
        left = cut(alive.where((F.col("listed") == inside) | wrong))
        if alive is not keys:
            drop_cut(alive)
        alive, inside = left, not inside
    return levels


def member(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed: the first level that lacks it decides."""
    return decided([x.has(key, i) for i, x in enumerate(levels)])


def decided(has: list[Column]) -> Column:
    """Whether a key is listed, by which levels have it: the first one that lacks it decides."""
    found = F.lit(len(has) % 2 == 1)
    for i in reversed(range(len(has))):
        found = F.when(~has[i], F.lit(i % 2 == 1)).otherwise(found)
    return found


def with_chunked_membership(df: DataFrame, key: str, universe: DataFrame, name: str, chunks: int) -> DataFrame:
    """``with_membership`` by one cascade a chunk, all built at once: a few jobs a level, and one
    pass over ``df``, however many chunks there are.

    Filters are rows of a table, one a chunk; rows and filters are dealt by chunk. It is filters that
    are joined, of a megabyte a level at most, never keys; a chunk with many rows is split by
    adaptive execution.
    """
    spark = df.sparkSession
    chunk = lambda k: F.pmod(F.xxhash64(k, F.lit(-7)), F.lit(chunks)).cast("long")
    alive, inside = universe.select("key", "listed", chunk(F.col("key")).alias("chunk")), True
    filters, sizes = None, []
    while most := alive.where(F.col("listed") == inside).groupBy("chunk").count().agg(F.max("count")).head()[0]:
        level = len(sizes)
        bits = 64 * max(1, ceil(-most * log(RATE) / log(2) ** 2 / 64))
        hashes = max(1, round(bits / most * log(2)))
        at = F.explode(F.array(*positions(F.col("key"), level, bits, hashes))).alias("at")
        words = alive.where(F.col("listed") == inside).select("chunk", at).select("chunk", F.shiftright("at", 6).alias("i"), one_bit(F.col("at")).alias("w"))
        n = bits // 64
        zeros = spark.range(chunks * n).select((F.col("id") / n).cast("long").alias("chunk"), (F.col("id") % n).alias("i"), F.lit(0).cast("long").alias("w"))
        dense = words.groupBy("chunk", "i").agg(F.bit_or("w").alias("w")).unionByName(zeros).groupBy("chunk", "i").agg(F.bit_or("w").alias("w"))
        table = dense.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias(f"w{level}"))
        table = cut(table)
        wrong = holds(F.col(f"w{level}"), F.col("key"), level, bits, hashes)
        left = cut(alive.join(table.hint("shuffle_hash"), "chunk").where((F.col("listed") == inside) | wrong).select("key", "listed", "chunk"))
        if level:
            drop_cut(alive)
        alive, inside = left, not inside
        filters = table if filters is None else filters.join(table, "chunk")
        sizes.append((bits, hashes))
    filters = cut(filters.withColumnRenamed("chunk", "__chunk"))
    rows = df.withColumn("__chunk", chunk(F.col(key))).join(filters.hint("shuffle_hash"), "__chunk")
    found = decided([holds(F.col(f"w{i}"), F.col(key), i, *size) for i, size in enumerate(sizes)])
    return rows.select(*[F.col(c) for c in df.columns], found.alias(name))


def with_membership(df: DataFrame, key: str, universe: DataFrame, name: str = "listed") -> DataFrame:
    """Adds ``name``: whether ``key`` is listed in ``universe`` (``key``, ``listed``), which has every key.

    The cascade answers without a join of keys and, over the universe it was built from, without error.
    Its bits grow with the listed keys: beyond a megabyte a level, keys are dealt by hash into as
    many chunks as keep each level within that, with one cascade a chunk.
    """
    n = universe.where("listed").count()
    chunks = max(1, ceil(n * -log(RATE) / log(2) ** 2 / MAX_BITS))
    if chunks > 1:
        return with_chunked_membership(df, key, universe, name, chunks)
    return df.withColumn(name, member(F.col(key), build_cascade(universe)))


def filter_urls(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", rules: list[tuple[str, str, str]] = RULES, listed: Column | None = None) -> DataFrame:
    """The verdict on every url: page_id, host, path, key, rule, listed, verdict (allow or block).

    The longest rule that fits decides; else the url's key, host and path, is blocked if it is
    listed. ``listed`` is a condition on ``url``: a key is listed if it is true of any of its urls
    (by default, that a tracking parameter is in the query). Null urls, and those without
    ``://``, have an empty host and path and an empty key, which is judged like any other.
    Repeated rows each get a verdict; other columns are not read; an empty table gives no rows.
    """
    u = F.col("url")
    listed = F.coalesce(u.rlike(r"[?&](utm_[a-z]+|ref)="), F.lit(False)) if listed is None else listed
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    rows = rows.select("page_id", host(u).alias("host"), path(u).alias("path"), listed.alias("__mark"))
    rows = rows.withColumn("key", F.concat("host", "path"))
    universe = cut(rows.groupBy("key").agg(F.max("__mark").alias("listed")))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    out = with_membership(rows.drop("__mark").withColumns({"rule": rule, "__verdict": verdict}), "key", universe)
    return out.withColumn("verdict", F.coalesce("__verdict", F.when(F.col("listed"), "block").otherwise("allow"))).drop("__verdict")


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         coalesce(regexp_matches(url, '[?&](utm_[a-z]+|ref)='), false) AS mark
  FROM pages
), k AS (SELECT host || path AS key, bool_or(mark) AS listed FROM p GROUP BY 1),
rules(kind, h, q) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
f AS (
  SELECT p.page_id, p.host, p.path, k.listed, r.h || r.q AS rule, r.kind,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.h || r.q) DESC NULLS LAST) AS nth
  FROM p JOIN k ON k.key = p.host || p.path
  LEFT JOIN rules r ON (p.host = r.h OR suffix(p.host, '.' || r.h)) AND prefix(p.path, r.q)
)
SELECT page_id, host, path, rule, coalesce(kind, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict FROM f WHERE nth = 1
"""
