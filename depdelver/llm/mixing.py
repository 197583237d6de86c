"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depdelver.session import cut

#: Words, and their number in a text.
WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096
#: Tables of sources up to this many rows are sent to every executor.
BROADCAST_ROWS = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked_weights(sources: DataFrame, source: str, weights: list[int]) -> DataFrame:
    """Adds ``weight``: the weights in turn, along the sources by code point with null last.

    The rank comes from a range partitioning and one count a partition; no task sees all sources.
    """
    spark = sources.sparkSession
    parts = max(1, min(64, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ranged = cut(sources.repartitionByRange(parts, F.col(source).asc_nulls_last()).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect()  # at most 64 rows
    before, seen = F.lit(0).cast("long"), 0
    for row in counts:
        before = F.when(F.col("__part") == row["__part"], F.lit(seen).cast("long")).otherwise(before)
        seen += row["n"]
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(F.col(source).asc_nulls_last())) + before
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    return ranged.withColumn("weight", weight.cast("long")).drop("__part")


def water_fill(sources: DataFrame, max_epochs: int) -> DataFrame:
    """Adds ``target`` (double) to a table with ``source_size`` and ``weight``.

    The state is one level, words per unit of weight: sources whose share at this level is over
    ``max_epochs`` times their size stay at that cap, the rest share what is left; the level
    only rises, so this ends after as many rounds as there are distinct caps at most.
    """
    cap = F.col("source_size") * F.lit(max_epochs)
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).head()[0]
    left, free, level = total, 0, 0.0
    rounds = 0
    while True:
        at = F.lit(float(left)) / F.lit(float(free)) * F.col("weight") if free else F.lit(0.0)
        full = (at >= cap) if rounds else F.lit(False)
        row = sources.agg(F.sum(F.when(full, cap)).alias("caps"), F.sum(F.when(~full, F.col("weight"))).alias("free")).head()
        now = (total - (row["caps"] or 0), row["free"] or 0)
        if rounds and now == (left, free) or not now[1]:
            left, free = now
            break
        left, free, rounds = *now, rounds + 1
    if not free:
        return sources.withColumn("target", cap.cast("double"))
    level = F.lit(float(left)) / F.lit(float(free)) * F.col("weight")
    return sources.withColumn("target", F.when(level >= cap, cap.cast("double")).otherwise(level))


def mix_sources(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: list[int] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """How many words of every document the mix takes.

    The sources share the words of all documents by weight, none beyond ``max_epochs`` times its
    size. A source takes each document ``floor(target / size)`` times whole; the rest of its
    target is a fractional repetition over the documents in the order of a seeded hash: whole
    documents until the next one does not fit, of which the missing first words are taken. So a
    source's taken words differ from its target by less than one word.

    Rows: doc_id, size, source_size, target, taken, reps (whole repetitions), part (words of the
    fractional one). Null texts and empty ones have size 0 and take nothing; a null source is a
    source; a null doc_id is hashed as an empty one; repeated rows count as so many documents;
    other columns are not read, so their names cannot clash. An empty table gives no rows.

    Sums by source and by (source, hash bucket) are made before rows move; only documents of the
    one bucket in which a source's fraction ends, about one in 4096, are put in order.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    rows = cut(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), h.alias("h"))
        .withColumn("bucket", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))
    )
    buckets = cut(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    sizes = buckets.groupBy("source").agg(F.sum("words").alias("source_size"))
    table = water_fill(cut(ranked_weights(sizes, "source", list(weights))), max_epochs)
    whole = F.floor("target").cast("long")
    table = (
        table.withColumn("reps", F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", whole - F.col("reps") * F.col("source_size"))
    )
    # The bucket where the fraction ends, and the words before it.
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = buckets.withColumn("before", F.coalesce(F.sum("words").over(along), F.lit(0)).cast("long"))
    ends = (
        sums.alias("b").join(table.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
        .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
        .select("b.source", F.col("bucket").alias("end_bucket"), (F.col("rest") - F.col("before")).alias("end_rest"))
    )
    t, e = table.alias("t"), ends.alias("e")
    state = cut(t.join(e, F.col("t.source").eqNullSafe(F.col("e.source")), "left").select("t.*", "end_bucket", "end_rest"))
    small = state.count() <= BROADCAST_ROWS
    d, s = rows.alias("d"), (F.broadcast(state) if small else state).alias("s")
    joined = d.join(s, F.col("d.source").eqNullSafe(F.col("s.source"))).select(
        "d.doc_id", "d.source", "d.size", "d.h", "d.bucket", "s.source_size", "s.target", "s.reps", "s.end_bucket", "s.end_rest"
    )
    out = ["doc_id", "source", "size", "source_size", "target", "reps"]
    # A rest of 0 ends before the first bucket that has words.
    sure = joined.where(F.col("end_bucket").isNull() | (F.col("bucket") != F.col("end_bucket")))
    part = F.when(F.col("bucket") < F.col("end_bucket"), F.col("size")).otherwise(0)
    sure = sure.select(*out, part.cast("long").alias("part"))
    by_hash = Window.partitionBy("source").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = joined.where(F.col("bucket") == F.col("end_bucket")).withColumn("prior", F.coalesce(F.sum("size").over(by_hash), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("end_rest") - F.col("prior")))
    edge = edge.select(*out, part.cast("long").alias("part"))
    return sure.unionByName(edge).select("*", (F.col("reps") * F.col("size") + F.col("part")).alias("taken"))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight
  FROM d GROUP BY source
), r AS (  -- in the order in which a rising level reaches the caps
  SELECT *, coalesce(sum(3 * source_size) OVER w, 0) AS caps_before, sum(weight) OVER v AS weight_left
  FROM s WINDOW w AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                v AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), lv AS (
  SELECT CAST(sum(source_size) OVER () - caps_before AS DOUBLE) AS left_words, CAST(weight_left AS DOUBLE) AS free_weight,
         3.0 * source_size / weight AS ratio, row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS k
  FROM r
), l AS (
  SELECT left_words, free_weight FROM lv WHERE left_words / free_weight < ratio ORDER BY k LIMIT 1
), t AS (
  SELECT s.*, CASE WHEN l.left_words IS NULL OR l.left_words / l.free_weight * s.weight >= 3 * s.source_size
                   THEN CAST(3 * s.source_size AS DOUBLE) ELSE l.left_words / l.free_weight * s.weight END AS target
  FROM s LEFT JOIN l ON true
), u AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS reps FROM t
), c AS (
  SELECT d.*, u.source_size, u.target, u.reps, CAST(floor(u.target) AS BIGINT) - u.reps * u.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
)
SELECT doc_id, size, source_size, target,
       CAST(reps * size + greatest(0, least(size, rest - prior)) AS BIGINT) AS taken
FROM c
"""
