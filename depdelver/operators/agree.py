"""Agree sets: which attributes pairs of records have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depdelver.functions import bits
from depdelver.operators.lattice import least, members
from depdelver.operators.partitions import matches, name, window_by


def neighbours(df: DataFrame, attribute: str, order: list[str], rid: str, distance: int = 1, null_equals_null: bool = True) -> DataFrame:
    """Pairs (a, b) of records that share a value and lie ``distance`` apart in its cluster.

    The cluster's order puts records with equal neighbouring attributes side by side, so that
    their agree sets are large. A cluster is one window; ``sample.agree_sets`` takes some of any size.
    """
    rows = df if null_equals_null else df.where(name(attribute).isNotNull())
    record = F.struct(*[name(c) for c in order])
    b = F.lead(record, distance).over(window_by(attribute, order, rid))
    return rows.select(record.alias("a"), b.alias("b")).where("b IS NOT NULL")


def sample(df: DataFrame, attribute: str, order: list[str], rid: str, distance: int = 1, null_equals_null: bool = True) -> DataFrame:
    """(words, pairs): the distinct agree sets of ``neighbours`` and how many pairs have each."""
    pairs = neighbours(df, attribute, order, rid, distance, null_equals_null)
    return pairs.select(bits.words(matches("a", "b", order, null_equals_null)).alias("words")).groupBy("words").agg(F.count("*").alias("pairs"))


def masks(pairs: DataFrame, columns: list[str], null_equals_null: bool = True) -> DataFrame:
    """The agree set of each pair as one BIGINT, for up to 63 attributes."""
    return pairs.select(bits.set_of(matches("a", "b", columns, null_equals_null)).alias("mask"))


def unseen(found: DataFrame, seen: DataFrame) -> DataFrame:
    """Agree sets that were not seen before: an exact filter."""
    return found.join(seen, found.columns, "left_anti")


def merge_seen(a: DataFrame, b: DataFrame) -> DataFrame:
    """The union of two tables of agree sets."""
    return a.unionByName(b).distinct()


def maximal(found: DataFrame, mask: str = "mask") -> DataFrame:
    """Agree sets that are inside no other one.

    Each set is compared with the larger ones only that have its least attribute.
    """
    return _maximal(found.select(mask).distinct(), mask, [])


def maximal_by_rhs(non_fds: DataFrame) -> DataFrame:
    """Of the non-dependencies (lhs, rhs), those inside no other one of the same right-hand side."""
    return _maximal(non_fds.distinct(), "lhs", ["rhs"])


def _maximal(sets: DataFrame, mask: str, by: list[str]) -> DataFrame:
    """An equi-join: a set that contains another one has all its attributes, so also its least."""
    x = F.col(mask)
    small = sets.select(*by, mask, least(x).alias("bit"))
    large = sets.select(*by, x.alias("outer"), F.explode(members(x)).alias("bit"))
    a, b = small.alias("a"), large.alias("b")
    same = F.col("a.bit") == F.col("b.bit")
    for c in by:
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(b, same & bits.subset(F.col(f"a.{mask}"), F.col("b.outer")) & (F.col(f"a.{mask}") != F.col("b.outer")), "left_anti").select(*[F.col(c) for c in sets.columns])


def non_fds(found: DataFrame, n: int, open_rhs: list[int] | None = None, mask: str = "mask") -> DataFrame:
    """(lhs, rhs) for every attribute outside an agree set; with ``open_rhs``, for these only."""
    rhs = F.explode(F.array(*[F.lit(i) for i in (range(n) if open_rhs is None else open_rhs)])).alias("rhs")
    return found.select(F.col(mask).alias("lhs"), rhs).where(~bits.has(F.col("lhs"), F.col("rhs")))


def by_rhs(found: DataFrame) -> DataFrame:
    """Non-dependencies of each right-hand side, the largest left-hand sides first."""
    ordered = F.array_sort(F.collect_set(F.struct((-bits.cardinality(F.col("lhs"))).alias("k"), "lhs")))
    return found.groupBy("rhs").agg(F.transform(ordered, lambda x: x["lhs"]).alias("lhss"))


def largest(found: DataFrame, k: int, mask: str = "mask") -> DataFrame:
    """The k largest agree sets, ties to smaller masks."""
    return found.orderBy(bits.cardinality(F.col(mask)).desc(), mask).limit(k)


def above_average(found: DataFrame, mask: str = "mask") -> DataFrame:
    """Agree sets of more attributes than the mean."""
    mean = found.agg(F.avg(bits.cardinality(F.col(mask))).alias("mean"))
    return found.join(F.broadcast(mean)).where(bits.cardinality(F.col(mask)) > F.col("mean")).drop("mean")  # mean is one row


def lookup(df: DataFrame, pairs: DataFrame, columns: list[str], rid: str) -> DataFrame:
    """The records (a, b) of pairs of row ids (x, y)."""
    record = df.select(name(rid).alias("r"), F.struct(*[name(c) for c in columns]).alias("s"))
    a, b = record.select(F.col("r").alias("x"), F.col("s").alias("a")), record.select(F.col("r").alias("y"), F.col("s").alias("b"))
    return pairs.join(a, "x").join(b, "y").select("x", "y", "a", "b")
