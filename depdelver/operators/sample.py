"""Agree sets of neighbours in clusters of any size: rows sorted by ranges, compared where they lie."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depdelver.functions import bits
from depdelver.operators.validate import without
from depdelver.session import cut, drop_cut

#: Bytes of agree sets seen before that are sent to the tasks; more are told apart by the caller.
SEEN_BYTES = 32 << 20
#: Distinct agree sets that a task holds.
HELD = 200_000
#: Codes of the rows, once for each attribute that they are sorted by, of one sort.
SORTED = 400_000_000

FOUND = "kind int, w int, words array<long>, pairs long, part int, at long, k long, codes array<long>"
_FOUND = pa.schema([("kind", pa.int32()), ("w", pa.int32()), ("words", pa.list_(pa.int64())), ("pairs", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("k", pa.int64()), ("codes", pa.list_(pa.int64()))])
SET, EDGE, SIZE = 0, 1, 2


def agree_sets(rows: DataFrame, n: int, wanted: list[tuple[int, int]], seen: set[int] | None = None, count: int = 0) -> DataFrame:
    """(w, words, pairs): for the w-th (attribute, distance) of ``wanted``, the distinct agree sets of rows that share a
    value and lie so far apart in its cluster, and how many pairs have each; words null: pairs with a set of ``seen``.

    ``rows``: coded rows of ``n`` attributes. A cluster is ordered by the next attribute, the one before
    (around the end), nulls first, and rid. All that is wanted is one sort by ranges of (w, value, neighbours, rid), so that
    a value of most rows is in many tasks; each compares its rows, drops sets that were
    seen, and hands on its first and last rows, which meet those of the other tasks by their place.
    ``count``: how many rows there are; if those of all that is wanted have more than SORTED codes, they are sorted one after
    the other, some attributes or some of the values of one at a time, so that the files of one sort are on disk.
    """
    most = max(1, SORTED // n)
    at_once = max(1, most // max(1, count))
    slices = -(-count // most)
    if len(wanted) <= at_once and slices <= 1:
        return _agree_sets(rows, n, wanted, seen)
    found = []
    for first in range(0, len(wanted), at_once):
        for part in range(slices):
            some = rows if slices == 1 else rows.where(F.pmod(F.col(f"c{wanted[first][0]}").cast("long"), F.lit(slices)) == part)
            own = _agree_sets(some, n, wanted[first : first + at_once], seen)
            found.append(cut(own.withColumn("w", F.col("w") + first)))
            drop_cut(own._made)
    out = found[0].sparkSession.read.schema(found[0].schema).parquet(*[x._cut_path for x in found])
    return out.groupBy("w", "words").agg(F.sum("pairs").alias("pairs"))


def _agree_sets(rows: DataFrame, n: int, wanted: list[tuple[int, int]], seen: set[int] | None) -> DataFrame:
    spark = rows.sparkSession
    dealt = [F.when(without(F.col("alone"), [a]), F.struct(F.lit(w).alias("w"), *[F.greatest(F.col(f"c{i}").cast("long"), F.lit(-1)).alias(f"k{j}") for j, i in enumerate((a, (a + 1) % n, (a - 1) % n))])) for w, (a, _) in enumerate(wanted)]
    codes = [f"c{i}" for i in range(n)]
    cells = rows.select(F.explode(F.array(*dealt)).alias("x"), "rid", *codes).where("x IS NOT NULL").select("x.*", "rid", *codes)
    order = ["w", "k0", "k1", "k2", "rid"]
    width = -(-n // 8)
    known = frozenset(m.to_bytes(width, "little") for m in seen or ()) if len(seen or ()) * (width + 64) <= SEEN_BYTES else frozenset()
    held = spark.sparkContext.broadcast(known)
    distances = [d for _, d in wanted]
    # Written: what it is made from is sorted by sampled ranges, once.
    found = cut(cells.repartitionByRange(*order).sortWithinPartitions(*order).select("w", "k0", *codes).mapInArrow(_compare(n, distances, held), FOUND))
    parts = found.where(F.col("kind") == SIZE).select("part", (F.sum("at").over(Window.orderBy("part")) - F.col("at")).alias("before"))  # a row a task
    edges = found.where(F.col("kind") == EDGE).join(F.broadcast(parts), "part").select("w", "part", "k", "codes", (F.col("at") + F.col("before")).alias("place"))
    x, y = edges.alias("x"), edges.alias("y")
    far = F.element_at(F.array(*[F.lit(d).cast("long") for d in distances]), F.col("x.w") + 1)
    met = x.join(y, (F.col("x.w") == F.col("y.w")) & (F.col("x.k") == F.col("y.k")) & (F.col("x.place") + far == F.col("y.place")) & (F.col("x.part") < F.col("y.part")))
    across = met.select(F.col("x.w").alias("w"), bits.words([F.get("x.codes", F.lit(i)) == F.get("y.codes", F.lit(i)) for i in range(n)]).alias("words"), F.lit(1).cast("long").alias("pairs"))
    if known:
        across = across.mapInArrow(_unseen(n, held), "w int, words array<long>, pairs long")
    every = found.where(F.col("kind") == SET).select("w", "words", "pairs").unionByName(across)
    out = every.groupBy("w", "words").agg(F.sum("pairs").alias("pairs"))
    out._made = found
    return out


def _words(packed: bytes, n: int) -> list[int]:
    mask = int.from_bytes(packed, "little")
    return [mask >> at & (1 << bits.WORD) - 1 for at in range(0, n, bits.WORD)]


def _compare(n: int, distances: list[int], held):
    most = max(distances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), held.value
        sets: dict[tuple[int, bytes], int] = {}
        old = [0] * len(distances)
        block, first, total = np.empty((0, n + 2), np.int64), np.empty((0, n + 2), np.int64), 0

        def emit(last: bool) -> pa.RecordBatch:
            out = [(SET, w, _words(m, n), k, None, None, None, None) for (w, m), k in sets.items()]
            if last:
                out += [(SET, w, None, k, None, None, None, None) for w, k in enumerate(old) if k]
                edges = {at: row for at, row in enumerate(first.tolist())} | {total - len(block) + i: row for i, row in enumerate(block.tolist())}
                out += [(EDGE, row[0], None, None, part, at, row[1], row[2:]) for at, row in edges.items()]
                out.append((SIZE, None, None, None, part, total, None, None))
            sets.clear()
            columns = zip(*out, strict=True) if out else [[]] * len(_FOUND)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)

        for batch in batches:
            if not len(batch):
                continue
            new = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            first = np.concatenate([first, new[: most - len(first)]]) if len(first) < most else first
            carried = len(block)
            block, total = np.concatenate([block, new]), total + len(new)
            for w in np.unique(new[:, 0]).tolist():
                d = distances[w]
                j = np.flatnonzero(block[:, 0] == w)
                j = j[(j >= carried) & (j >= d)]
                j = j[(block[j - d, 0] == w) & (block[j - d, 1] == block[j, 1])]
                if len(j):
                    packed = np.packbits(block[j - d, 2:] == block[j, 2:], axis=1, bitorder="little")
                    rows = np.ascontiguousarray(packed).view(np.dtype((np.void, packed.shape[1]))).ravel()
                    for m, k in zip(*(x.tolist() for x in np.unique(rows, return_counts=True)), strict=True):
                        if m in seen:
                            old[w] += k
                        else:
                            sets[w, m] = sets.get((w, m), 0) + k
            block = block[-most:]
            if len(sets) > HELD:
                yield emit(False)
        if total:
            yield emit(True)

    return run


def _unseen(n: int, held):
    width = -(-n // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, words, pairs = (c.to_pylist() for c in batch.columns)
            words = [None if bits.from_words(x).to_bytes(width, "little") in held.value else x for x in words]
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.int32()), pa.array(words, pa.list_(pa.int64())), pa.array(pairs, pa.int64())], ["w", "words", "pairs"])

    return run
