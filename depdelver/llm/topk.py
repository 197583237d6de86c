"""Exact top-k search by inner product: distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A wave of queries that is sent to the executors has about this many rows and at most so many bytes.
WAVE_ROWS, WAVE_BYTES = 3000, 16 << 20
BINS = 256
#: Scores that are made at once.
CELLS = 2_000_000
LONG = (1 << 63) - 1


def matrix(lists: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * x) of every component as double; shorter vectors are filled up with zeros."""
    lengths = np.asarray(lists.value_lengths(), np.int64)
    values = np.floor(scale * np.asarray(lists.flatten(), np.float64))
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return out


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products as int64: in doubles where that is exact, else in Python's integers, held within a long."""
    d = min(q.shape[1], c.shape[1])
    q, c = q[:, :d], c[:, :d]
    if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(d, 1) < 2.0**53:
        return (q @ c.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(q) @ whole(c).T, -LONG - 1, LONG).astype(np.int64)


def candidates(batches: Iterator[pa.RecordBatch], n_queries: int, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    step = max(1, CELLS // max(1, n_queries))
    for batch in batches:
        for at in range(0, len(batch), step):
            part = batch.slice(at, step)
            yield np.asarray(part.column(0), np.int64), matrix(part.column(1), scale)


def histograms(wave, lo: np.ndarray, width: np.ndarray, scale: float):
    """Counts of the scores of each query in BINS bins of its own width from ``lo``; scores above go to the last one + 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = wave.value
        counts = np.zeros(len(ids) * (BINS + 1), np.int64)
        row = np.arange(len(ids))[:, None] * (BINS + 1)
        for own, c in candidates(batches, len(ids), scale):
            s = products(q, c)
            keep = (s >= lo[:, None]) & (ids[:, None] != own)
            a, b = np.nonzero(keep)
            at = np.minimum((s[a, b] - lo[a]) // width[a], BINS) + row[a, 0]
            counts += np.bincount(at, minlength=len(counts))
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found // (BINS + 1), pa.int32()), pa.array(found % (BINS + 1), pa.int32()), pa.array(counts[found])], ["q", "bin", "n"])

    return run


def best(ids: np.ndarray, rows: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of rows (query, score, id), the k best of each query."""
    q, s, i = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((i, -s, q))
    q, s, i = q[order], s[order], i[order]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return [q[keep], s[keep], i[keep]]


def above(wave, lo: np.ndarray, k: int, scale: float):
    """The scores from each query's ``lo`` on, the k best of each partition at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = wave.value
        kept = [np.empty(0, np.int64)] * 3
        for own, c in candidates(batches, len(ids), scale):
            s = products(q, c)
            a, b = np.nonzero((s >= lo[:, None]) & (ids[:, None] != own))
            if len(a):
                kept = best(ids, [kept, [a, s[a, b], own[b]]], k)
        yield pa.RecordBatch.from_arrays([pa.array(ids[kept[0]]), pa.array(kept[2]), pa.array(kept[1])], ["query_id", "vec_id", "score"])

    return run


def search_wave(base: DataFrame, ids: np.ndarray, q: np.ndarray, bound: float, k: int, scale: float) -> DataFrame:
    """The k best of ``base`` for a wave of queries; ``bound``: the largest norm in ``base``."""
    wave = base.sparkSession.sparkContext.broadcast((ids, q))
    most = np.minimum(np.linalg.norm(q, axis=1) * bound * (1 + 1e-9) + 1, float(1 << 62)).astype(np.int64)
    lo, hi = -most, most + 1
    if bound * np.linalg.norm(q, axis=1).max(initial=0) >= 2.0**61:  # sums that may not fit: no bins, each partition's k best
        lo, hi = np.full(len(ids), -LONG - 1), np.full(len(ids), -LONG)
    open_ = hi - lo > 1
    while open_.any():
        width = np.maximum(1, -(-(hi - lo) // BINS))
        start = np.where(open_, lo, np.iinfo(np.int64).max >> 1)
        counts = base.mapInArrow(histograms(wave, start, width, scale), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q").orderBy(F.col("bin").desc())
        # The highest bin down to which there are k scores; without one, all scores are wanted.
        at = counts.withColumn("sum", F.sum("n").over(down)).where(F.col("sum") >= k)
        rows = at.groupBy("q").agg(F.max(F.struct("bin", "n")).alias("x")).select("q", "x.*").toArrow()  # a row a query of the wave
        done = open_.copy()
        qs, bins, ns = (rows.column(i).to_numpy() for i in range(3))
        lo[qs] = lo[qs] + bins * width[qs]
        hi[qs] = lo[qs] + width[qs]
        done[qs] = (width[qs] == 1) | (ns <= 4 * k)
        open_ &= ~done  # fewer scores than k: all of them
    found = base.mapInArrow(above(wave, lo, k, scale), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(base: DataFrame, queries: DataFrame, k: int = 5, *, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256.0) -> DataFrame:
    """The ``k`` rows of ``base`` with the highest inner product for every query, ties to smaller ids.

    Components count as floor(scale * x). Vectors that are null, or hold a null, a NaN or an
    infinity, and rows without an id take no part; where lengths differ, missing components are
    zeros; a query never finds rows of its own id. A repeated row of ``base`` is found as often
    as it is there; a repeated query id is asked once, with its smallest vector. Fewer than k
    candidates are all returned; empty tables give no rows. Other columns are not read.

    The queries are dealt by hash into waves of bounded size. For each wave every score is made
    and counted into one histogram a query; the bin that holds the k-th score is divided again,
    until it is a single score or few have it; then a last pass emits the scores from there on,
    of which each partition sends k at most for a query, and ranks them. No pass moves scores.
    Scores are held within a long. Vectors so long that a score may not fit (a product of norms
    of 2**61 or more) leave no room for bins: each partition then sends its k best at once.
    """
    def rows(df: DataFrame) -> DataFrame:
        v = F.col(embedding)
        bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
        return df.where(F.col(vec_id).isNotNull() & v.isNotNull() & ~bad).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))

    base, asked = rows(base), rows(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(F.abs(x.cast("double")) * scale + 1, F.lit(2)))
    stats = base.agg(F.max(square).alias("s")).head()
    n, width = asked.agg(F.count("*"), F.max(F.size("v"))).head()
    bound = (stats["s"] or 0.0) ** 0.5
    if not n:
        return base.sparkSession.createDataFrame([], "query_id long, vec_id long, score long, rank int")
    waves = max(ceil(n / WAVE_ROWS), ceil(n * 8 * max(width, 1) / WAVE_BYTES))
    out = None
    for w in range(waves):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == w).toArrow()  # bounded: see WAVE_ROWS
        if not own.num_rows:
            continue
        own = own.combine_chunks()
        ids = own.column("vec_id").to_numpy().astype(np.int64)
        q = matrix(own.column("v").combine_chunks(), scale)
        part = search_wave(base, ids, q, bound, k, scale)
        out = part if out is None else out.unionByName(part)
    return out


def op1_topk(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, rows.where(F.col("vec_id") % 50 == 0), 5).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
