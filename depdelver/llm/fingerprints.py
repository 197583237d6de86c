"""Document fingerprints: SimHash by grouped sums, and search within a Hamming radius by permuted block tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depdelver.llm.rows import column
from depdelver.session import cut

#: Differing bits up to which fingerprints count as near, and blocks of bits of which all but so many are equal then.
RADIUS, BLOCKS = 3, 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"
#: Two counters of 32 bits in a long.
LANES = 0x1_0000_0001


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case."""
    bare = F.btrim(F.translate(text, UPPER, LOWER), F.lit(SPACE))
    return F.when(bare != "", F.split(bare, r"[ \t\n\x0B\f\r]+")).otherwise(F.array().cast("array<string>"))


def term_hash(term: Column) -> Column:
    """The first 64 bits of a term's md5."""
    return F.conv(F.substring(F.md5(term), 1, 16), 16, -10).cast("long")


def simhash(rows: DataFrame, keys: list[str], text: str = "text", weight: Callable[[Column], Column] | None = None) -> DataFrame:
    """(keys, fingerprint): the SimHash of each row's text, as a long; ``keys`` tell rows apart.

    A text's terms are its words, each with the next one, and the last one alone. Every occurrence
    votes by its term's hash: for the bits that are set, and against the other ones, with
    ``weight`` (of the term; a whole number of 1 or more, by default 1, so that a term weighs as
    often as it occurs); a bit is set with more votes for it than against it. Without words, or
    where the text is null, no bit is set. The sums of votes of a text stay below 2**32.

    Texts are split and summed where they are; 32 counters, two bits in each, move for a text.
    """
    key = F.struct(*[column(c) for c in keys]).alias("key")  # no name of a key can clash with another one
    split = rows.select(key, words(F.coalesce(column(text), F.lit(""))).alias("w"))
    terms = split.select("key", F.inline_outer(F.arrays_zip(F.col("w").alias("x"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("y"))))
    term = F.concat_ws(" ", "x", "y")
    w = F.when(F.col("x").isNull(), 0).otherwise(1 if weight is None else weight(term)).cast("long")
    hashed = terms.select("key", w.alias("w"), term_hash(term).alias("h"))
    votes = [F.sum(F.col("w") * F.shiftright("h", i).bitwiseAND(F.lit(LANES))).alias(f"s{i}") for i in range(32)]
    summed = hashed.groupBy("key").agg(F.sum("w").alias("n"), *votes)
    low = [2 * F.col(f"s{i}").bitwiseAND(F.lit(0xFFFFFFFF)) for i in range(32)]
    high = [2 * F.shiftrightunsigned(F.col(f"s{i}"), 32) for i in range(32)]
    bits = [F.when(v > F.col("n"), F.lit(_signed(1 << i))).otherwise(F.lit(0).cast("long")) for i, v in enumerate([*low, *high])]
    return summed.select("key.*", reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fingerprint"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def digits(fingerprint: Column) -> Column:
    """A fingerprint as 16 hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bits."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def tables(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Masks of the block tables: fingerprints that differ in ``radius`` bits or fewer are equal under one of them, as
    all but ``radius`` of the ``blocks`` blocks of bits are free of a difference."""
    if not 0 <= radius < blocks <= 64:
        raise ValueError("a table needs more blocks than bits may differ")
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    each = [(1 << b) - (1 << a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [_signed(sum(c)) for c in combinations(each, blocks - radius)]


def within(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, fingerprint, distance): of every fingerprint ``query`` in ``queries``, the distinct ``fingerprint`` values of
    ``prints`` that differ from it in ``radius`` bits at most, itself included if it is there. Nulls find nothing.

    One table for each choice of blocks: the chosen blocks, permuted to the front, are the key
    of an equi-join. What agrees in several tables is taken from the first of them. More blocks
    make longer keys, so fewer chance meetings, and more tables.
    """
    masks = tables(radius, blocks)
    deal = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("f").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])).alias("x")
    side = lambda df, c, to: df.select(F.col(c).alias("f")).where("f IS NOT NULL").distinct().select(F.col("f").alias(to), deal).select(to, "x.t", "x.k")
    a, b = side(queries, "query", "query").alias("a"), side(prints, "fingerprint", "fingerprint").alias("b")
    differ = F.col("query").bitwiseXOR(F.col("fingerprint"))
    first = reduce(lambda later, im: F.when(differ.bitwiseAND(F.lit(im[1])) == 0, im[0]).otherwise(later), reversed(list(enumerate(masks))), F.lit(-1))
    met = (F.col("a.t") == F.col("b.t")) & (F.col("a.k") == F.col("b.k")) & (F.bit_count(differ) <= radius) & (first == F.col("a.t"))
    return a.join(b, met).select("query", "fingerprint", F.bit_count(differ).alias("distance"))


def ring(docs: DataFrame) -> DataFrame:
    """(rid, before, k) for rows (rid, doc_id, h, n): each row's number, that of the row before it in the order of doc_id, h
    and rid (nulls last; before the first one is the last one), and a quarter of that row's ``n``.

    Rows are dealt by range and sorted, which is written; a window over each part then looks
    one row back, and the parts' last rows are handed on, one row a part.
    """
    keys = [F.col("doc_id").asc_nulls_last(), F.col("h"), F.col("rid")]
    order = cut(docs.repartitionByRange(*keys).sortWithinPartitions(*keys).select("rid", "n", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    last = order.groupBy("part").agg(F.max_by(F.struct("rid", "n"), "at").alias("last"))
    parts = Window.orderBy("part")
    every = last.select(F.max_by("last", "part").alias("end"))  # one row
    handed = last.select("part", F.lag("last").over(parts).alias("before")).join(F.broadcast(every)).select("part", F.coalesce("before", "end").alias("border"))
    inside = order.select("rid", "part", F.lag(F.struct("rid", "n")).over(Window.partitionBy("part").orderBy("at")).alias("before"))
    found = inside.join(handed, "part").select("rid", F.coalesce("before", "border").alias("b"))
    return cut(found.select("rid", F.col("b.rid").alias("before"), F.floor(F.col("b.n") / 4).cast("long").alias("k")))


def edited(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, text, edited, after, next_id) for rows (rid, doc_id, text): the text with its last quarter (rounded
    down) replaced by as many characters from the begin of the next row's text, or all of them; number and id of that row.

    The next row is that of :func:`ring`, with equal ids in the order of their texts' hashes. Texts
    move by their number, once for both joins; of the next text, no more than is taken.
    """
    order = ring(docs.select("rid", "doc_id", F.xxhash64("text").alias("h"), F.length("text").cast("long").alias("n")))
    given = docs.join(order, "rid").select(F.col("before").alias("rid"), F.substring("text", F.lit(1), F.col("k").cast("int")).alias("head"), F.col("rid").alias("after"), F.col("doc_id").alias("next_id"))
    n = F.length("text")
    kept = F.substring("text", F.lit(1), (n - F.floor(n / 4)).cast("int"))
    return docs.join(given, "rid").select("rid", "doc_id", "text", F.concat(kept, "head").alias("edited"), "after", "next_id")


def op13_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Beside the contract's columns, next_id, and near_docs: for every hundredth doc_id, how many other rows' fingerprints are within RADIUS bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = edited(docs)
    keys = ["rid", "doc_id", "n", "after", "next_id"]
    both = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t"), F.lit("").alias("sha")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t"), F.sha2("edited", 256).alias("sha")))).alias("x")
    rows = texts.withColumn("n", F.length("text").cast("long")).select(*keys, both).select(*keys, "x.*")
    prints = simhash(rows, [*keys, "kind", "sha"], "t")
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    table = cut(prints.groupBy(*keys).agg(of(0, "fingerprint").alias("f"), of(1, "fingerprint").alias("e"), of(1, "sha").alias("sha")))
    asked = table.where(F.col("doc_id") % 100 == 0)
    counts = table.groupBy(F.col("f").alias("fingerprint")).agg(F.count("*").alias("rows"))
    near = within(asked.select(F.col("f").alias("query")), counts).join(counts, "fingerprint").groupBy("query").agg((F.sum("rows") - 1).alias("near_docs"))
    found = asked.select("rid", F.col("f").alias("query")).join(near, "query").select("rid", "near_docs")
    after = table.select(F.col("rid").alias("after"), F.col("f").alias("next"))
    rows = table.join(after, "after").join(found, "rid", "left")
    return rows.select(
        "doc_id",
        F.col("n").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        digits(F.col("f")).alias("fingerprint"),
        digits(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("e")).alias("near_edited"),
        likeness(F.col("f"), F.col("next")).alias("near_next"),
        "next_id",
        "near_docs",
    )


def _sql() -> str:
    space = r"[ \t\n\x0B\f\r]+"
    bare = f"regexp_replace(regexp_replace(translate(t, '{UPPER}', '{LOWER}'), '^{space}', ''), '{space}$', '')"
    ones = ", ".join(f"2 * sum((h >> {i}) & 1) > count(h) AS b{i}" for i in range(64))
    value = " || ".join(f"('0123456789abcdef'[1 + {' + '.join(f'CASE WHEN b{4 * d + j} THEN {1 << j} ELSE 0 END' for j in range(4))}])" for d in reversed(range(16)))
    number = " + ".join(f"CASE WHEN b{i} THEN {1 << i}::UBIGINT ELSE 0::UBIGINT END" for i in range(64))
    return f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, coalesce(text, '')) AS rn, doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents
), e AS MATERIALIZED (
  SELECT a.*, b.rn AS after, b.doc_id AS next_id, left(a.t, a.n - a.n // 4) || left(b.t, a.n // 4) AS edited FROM d a JOIN d b ON b.rn = a.rn % (SELECT count(*) FROM d) + 1
), w AS MATERIALIZED (
  SELECT rn, kind, CASE WHEN x = '' THEN [] ELSE regexp_split_to_array(x, '{space}') END AS w
  FROM (SELECT rn, kind, {bare} AS x FROM (SELECT rn, 0 AS kind, t FROM d UNION ALL SELECT rn, 1, edited FROM e))
), h AS (
  SELECT rn, kind, ('0x' || md5(term)[1:16])::UBIGINT AS h
  FROM (SELECT rn, kind, unnest(list_transform(w, lambda x, i: CASE WHEN i < len(w) THEN x || ' ' || w[i + 1] ELSE x END)) AS term FROM w)
), v AS (SELECT rn, kind, {ones} FROM h GROUP BY rn, kind),
f AS MATERIALIZED (
  SELECT w.rn, w.kind, coalesce(v.hex, '0000000000000000') AS hex, coalesce(v.f, 0::UBIGINT) AS f
  FROM w LEFT JOIN (SELECT rn, kind, {value} AS hex, {number} AS f FROM v) v ON v.rn = w.rn AND v.kind = w.kind
), q AS (
  SELECT a.rn, count(*) - 1 AS near_docs FROM f a JOIN d ON d.rn = a.rn AND d.doc_id % 100 = 0 JOIN f b ON b.kind = 0 AND bit_count(xor(a.f, b.f)) <= {RADIUS}
  WHERE a.kind = 0 GROUP BY a.rn
)
SELECT e.doc_id, e.n AS n_chars, sha256(e.edited) AS edited_sha256, a.hex AS fingerprint, b.hex AS edited_fingerprint,
  1.0::DOUBLE - bit_count(xor(a.f, b.f)) / 64.0::DOUBLE AS near_edited, 1.0::DOUBLE - bit_count(xor(a.f, c.f)) / 64.0::DOUBLE AS near_next, e.next_id, q.near_docs
FROM e JOIN f a ON a.rn = e.rn AND a.kind = 0 JOIN f b ON b.rn = e.rn AND b.kind = 1 JOIN f c ON c.rn = e.after AND c.kind = 0 LEFT JOIN q ON q.rn = e.rn
"""


SQL = _sql()
