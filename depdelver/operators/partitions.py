"""Position lists (stripped partitions), dictionary codes and attribute statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def check_types(df: DataFrame) -> None:
    """Maps have no equality and calendar intervals no order, so that no dependency on them is defined."""

    def has_map(t: T.DataType) -> bool:
        if isinstance(t, T.ArrayType):
            return has_map(t.elementType)
        if isinstance(t, T.StructType):
            return any(has_map(f.dataType) for f in t.fields)
        return isinstance(t, (T.MapType, T.VariantType, T.CalendarIntervalType))

    if bad := [f.name for f in df.schema.fields if has_map(f.dataType)]:
        raise TypeError(f"columns {bad} are maps, variants or calendar intervals, which cannot be compared")


def name(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")


def with_rid(df: DataFrame, rid: str = "__rid") -> DataFrame:
    """Adds a row number that is unique, not dense; write the result before it is used twice."""
    return df.withColumn(rid, F.monotonically_increasing_id())


def positive_zero(df: DataFrame, c: str) -> Column:
    """The column, with 0.0 for -0.0, which equals it but is another text."""
    kind = df.schema[c].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return name(c) + F.lit(0.0).cast(kind)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
        return F.transform(name(c), lambda x: x + F.lit(0.0).cast(kind.elementType))
    return name(c)


def long_form(df: DataFrame, columns: list[str], rid: str, null_equals_null: bool = True) -> DataFrame:
    """(attr, val, rid), one row a cell; with null unlike null, nulls are left out.

    A value is its text, where -0.0 is 0.0; a null that equals others is kept apart from every text.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("attr"), positive_zero(df, c).cast("string").alias("val")) for c in columns])
    out = df.select(name(rid).alias("rid"), F.explode(cells).alias("x")).select("x.attr", "x.val", "rid")
    return out if null_equals_null else out.where("val IS NOT NULL")


def clusters(df: DataFrame, columns: list[str], rid: str, null_equals_null: bool = True) -> DataFrame:
    """Stripped partitions: (attr, val, positions) for every value of two rows or more."""
    cells = long_form(df, columns, rid, null_equals_null)
    return cells.groupBy("attr", "val").agg(F.array_sort(F.collect_list("rid")).alias("positions")).where(F.size("positions") > 1)


def cluster_stats(df: DataFrame, columns: list[str], null_equals_null: bool = True) -> DataFrame:
    """(attr, clusters, records): stripped clusters of each attribute and the rows in them.

    Positions are not gathered: each attribute is one aggregate of its typed column, counted before it is shuffled.
    """
    out = None
    for c in columns:
        rows = df if null_equals_null else df.where(name(c).isNotNull())
        sizes = rows.groupBy(name(c)).agg(F.count("*").alias("k")).where("k > 1")
        part = sizes.agg(F.count("*").alias("clusters"), F.coalesce(F.sum("k"), F.lit(0)).alias("records")).select(F.lit(c).alias("attr"), "clusters", "records")
        out = part if out is None else out.unionByName(part)
    return out


def distinct_counts(df: DataFrame, columns: list[str], null_equals_null: bool = True) -> DataFrame:
    """(attr, values): rows less those in clusters, plus the clusters."""
    n = df.select(F.count("*").alias("n"))
    stats = cluster_stats(df, columns, null_equals_null)
    return stats.join(F.broadcast(n)).select("attr", (F.col("n") - F.col("records") + F.col("clusters")).alias("values"))  # n is one row


def attribute_order(df: DataFrame, columns: list[str], null_equals_null: bool = True) -> list[str]:
    """The attributes by descending number of values, ties in the order of the schema."""
    found = {r["attr"]: r["values"] for r in distinct_counts(df, columns, null_equals_null).collect()}  # a row an attribute
    return sorted(columns, key=lambda c: -found[c])


def intersect(df: DataFrame, columns: list[str], rid: str) -> DataFrame:
    """The stripped partition of several attributes together: their values, positions and size."""
    grouped = df.groupBy(*[name(c) for c in columns]).agg(F.array_sort(F.collect_list(name(rid))).alias("positions"))
    return grouped.where(F.size("positions") > 1).withColumn("size", F.size("positions"))


def coded(df: DataFrame, columns: list[str], rid: str, null_equals_null: bool = True) -> DataFrame:
    """Dictionary-coded records: (rid, c...) with the least rid of a value's rows, or -1 if it occurs once.

    An attribute is one aggregation and one join; a value in a third of all rows is split by
    adaptive execution, as both sides are plain shuffles of the join.
    """
    out = df.select(name(rid), *[name(c) for c in columns])
    for c in columns:
        firsts = df.groupBy(name(c).alias("__v")).agg(F.min(name(rid)).alias("__m"), F.count("*").alias("__k"))
        joined = out.join(firsts, name(c).eqNullSafe(F.col("__v")), "left")
        alone = (F.col("__k") == 1) | (F.lit(False) if null_equals_null else name(c).isNull())
        code = F.when(alone, F.lit(-1)).otherwise(F.col("__m")).cast("long")
        out = joined.select(name(rid), *[code.alias(c) if x == c else name(x) for x in columns])
    return out


def unique(columns: list[str]) -> Column:
    """Whether any of a coded record's values occurs once, so that it matches no other record."""
    out = F.lit(False)
    for c in columns:
        out = out | (name(c) == -1)
    return out


def equal(a: Column, b: Column, null_equals_null: bool = True) -> Column:
    """Whether two values agree."""
    return a.eqNullSafe(b) if null_equals_null else F.coalesce(a == b, F.lit(False))


def matches(a: str, b: str, columns: list[str], null_equals_null: bool = True) -> list[Column]:
    """For records in struct columns ``a`` and ``b``, whether they agree in each attribute."""
    return [equal(F.col(f"{a}.`{c}`"), F.col(f"{b}.`{c}`"), null_equals_null) for c in columns]


def constant(c: str, null_equals_null: bool = True) -> Column:
    """Aggregate: whether no two rows differ in ``c``."""
    n, k = F.count("*"), F.count(name(c))
    same = (k == n) & (F.min(name(c)) == F.max(name(c)))
    none = (k == 0) if null_equals_null else F.lit(False)
    return (n <= 1) | F.coalesce(same, F.lit(False)) | none


def window_by(attribute: str, order: list[str], rid: str) -> Window:
    """Rows of one value, by the next attribute, then the one before (around the end), then rid."""
    at = order.index(attribute)
    near = [order[(at + 1) % len(order)], order[at - 1]]
    return Window.partitionBy(name(attribute)).orderBy(*[name(c) for c in dict.fromkeys(near) if c != attribute], name(rid))
