"""Covers and agree sets as tables: containment by joins, and induction without a driver.

Sets are BIGINTs of up to 63 attributes, or arrays of such words (``bits.words``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depdelver.functions import bits
from depdelver.session import cut, drop_cut


def least(mask: Column) -> Column:
    """The least attribute of a set as a set; of the empty one, nothing."""
    return F.when(mask == 0, F.lit(0).cast("long")).otherwise(mask.bitwiseAND(-mask))


def members(mask: Column) -> Column:
    """Each attribute of a set as a set, and the empty set."""
    each = F.transform(F.sequence(F.lit(0), F.lit(bits.WORD - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    return F.array_append(F.filter(each, lambda b: mask.bitwiseAND(b) != 0), F.lit(0).cast("long"))


def subsets(asked: DataFrame, stored: DataFrame, by: list[str] | None = None, proper: bool = False) -> DataFrame:
    """(by, q, lhs): for each asked set ``q`` its subsets among the stored ``lhs``, of equal ``by``.

    An equi-join: what is inside of a set has its least attribute there, so a stored set is met
    under that attribute, and an asked one under each of its own.
    """
    by = by or []
    a = asked.select(*by, "q", F.explode(members(F.col("q"))).alias("bit")).alias("a")
    b = stored.select(*by, "lhs", least(F.col("lhs")).alias("bit")).alias("b")
    met = F.col("a.bit") == F.col("b.bit")
    for c in by:
        met = met & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    met = met & bits.subset(F.col("lhs"), F.col("q"))
    if proper:
        met = met & (F.col("lhs") != F.col("q"))
    return a.join(b, met).select(*[F.col(f"a.{c}").alias(c) for c in by], "q", "lhs")


def minimal(sets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of the sets ``lhs``, those that have no other one of equal ``by`` inside."""
    by = by or []
    larger = subsets(sets.select(*by, F.col("lhs").alias("q")), sets, by, proper=True).select(*by, F.col("q").alias("lhs")).distinct()
    return sets.join(larger, [*by, "lhs"], "left_anti")


def initial(spark, n: int) -> DataFrame:
    """The covers (rhs, lhs) of ``n`` attributes that are not constant: every other attribute by itself."""
    pairs = spark.range(n).select(F.col("id").cast("int").alias("rhs")).join(spark.range(n).select(F.col("id").cast("int").alias("i")), F.col("rhs") != F.col("i"))
    return pairs.select("rhs", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i")).alias("lhs"))


def induce(covers: DataFrame, non_fds: DataFrame, n: int, limit: int | None = None) -> DataFrame:
    """The covers (rhs, lhs) after all ``non_fds`` (rhs, lhs), the minimal sets that are in none of these and have a set of the cover inside.

    In rounds, each over plain tables: a set inside some non-dependencies is extended by each
    attribute outside of the largest of them, as all that holds above it has one of these. What
    has a set inside that holds is not looked at again; of what holds, the minimal sets are the
    cover. Rounds are as many as attributes at most. ``limit``: sets of more attributes are given up.
    """
    covers, non_fds = covers.select("rhs", "lhs").distinct(), cut(non_fds.select("rhs", F.col("lhs").alias("q")).distinct())
    open_, holds = cut(covers), None
    while open_.head(1):
        inside = cut(subsets(non_fds, open_, ["rhs"]).groupBy("rhs", "lhs").agg(F.max(F.struct(F.bit_count("q").alias("k"), "q")).alias("x")).select("rhs", "lhs", "x.q"))
        now = open_.join(inside, ["rhs", "lhs"], "left_anti")
        held = cut(now if holds is None else holds.unionByName(now))
        outside = F.explode(F.array(*[F.lit(i) for i in range(n)])).alias("i")
        wider = inside.select("rhs", "lhs", "q", outside).where((F.col("i") != F.col("rhs")) & ~bits.has(F.col("q"), F.col("i")))
        new = wider.select("rhs", F.col("lhs").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i"))).alias("lhs")).distinct()
        if limit is not None:
            new = new.where(F.bit_count("lhs") <= limit)
        above = subsets(new.select("rhs", F.col("lhs").alias("q")), held, ["rhs"]).select("rhs", F.col("q").alias("lhs")).distinct()
        after = cut(new.join(above, ["rhs", "lhs"], "left_anti"))
        for old in (open_, inside, *([] if holds is None else [holds])):
            drop_cut(old)
        open_, holds = after, held
    return minimal(holds, ["rhs"]) if holds is not None else open_


# -- Sets of any number of attributes ------------------------------------------------------------


def inside(a: Column, b: Column, n: int) -> Column:
    """Whether the set of words ``a`` is a subset of ``b``, of ``n`` attributes."""
    out = F.lit(True)
    for w in range(-(-n // bits.WORD)):
        out = out & bits.subset(F.get(a, w), F.get(b, w))
    return out


def attributes(words: Column, n: int) -> Column:
    """The attributes of a set of words as an array of numbers."""
    return F.filter(F.array(*[F.when(bits.has(F.get(words, i // bits.WORD), i % bits.WORD), F.lit(i)) for i in range(n)]), lambda i: i.isNotNull())


def maximal_words(found: DataFrame, n: int) -> DataFrame:
    """Of the sets ``words`` of ``n`` attributes, those inside no other one.

    Inverted lists: a set looks for larger ones in the list of its rarest attribute only, which
    all of them have, and is in the lists of all its own.
    """
    sets = cut(found.select("words").distinct().withColumn("i", attributes(F.col("words"), n)))
    counts = {r["i"]: r["k"] for r in sets.select(F.explode("i").alias("i")).groupBy("i").agg(F.count("*").alias("k")).collect()}  # a row an attribute
    rank = F.array(*[F.lit(counts.get(i, 0)).cast("long") for i in range(n)])
    rarest = F.array_min(F.transform("i", lambda i: F.struct(F.element_at(rank, i + 1).alias("k"), i.alias("i"))))
    a = sets.select("words", F.coalesce(rarest["i"], F.lit(-1)).alias("key"), F.size("i").alias("size")).alias("a")
    b = sets.select("words", F.explode(F.array_append("i", F.lit(-1))).alias("key"), F.size("i").alias("size")).alias("b")
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.size") < F.col("b.size")) & inside(F.col("a.words"), F.col("b.words"), n)
    return a.join(b, met, "left_anti").select("words")
