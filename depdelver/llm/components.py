"""Connected components over an edge table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depdelver.session import cut, drop_cut


#: Edges that one task handles; tables of fewer partitions' worth are written in fewer files.
ROWS = 200_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b, both long): comp is its component's least node.

    Large-star and small-star rounds in turn: each node hands its larger neighbours, then itself
    and its smaller ones, to the least neighbour. Every round is a grouped minimum, a join and a
    distinct, each over plain tables, so that a hub's rows are split; rounds grow with the
    logarithm of the longest path, and end when no node is both a leader and led. Nothing is
    collected but counts.
    """
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    now = cut(edges.select(hi, lo).where("hi <> lo").distinct())
    most = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = now.count()

    def fitted(df: DataFrame) -> DataFrame:
        parts = max(1, -(-2 * n // ROWS))
        return df.coalesce(parts) if parts < most else df

    while n:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        first = cut(fitted(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))))
        large = cut(fitted(both.join(first, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()))
        drop_cut(first)
        least = cut(fitted(large.groupBy("u").agg(F.min("v").alias("m"))))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        new = cut(fitted(moved.unionByName(least.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct()))
        drop_cut(least)
        drop_cut(large)
        drop_cut(now)
        now = new
        n, led = now.agg(F.count("*"), F.count_distinct("hi")).head()
        if n == led and not now.join(now.select(F.col("lo").alias("leader")), F.col("hi") == F.col("leader"), "left_semi").head(1):
            break
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("comp")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("comp")).unionByName(roots)
