"""N-gram count tables, partitioned by hash, joined to the n-grams of blocks of documents.

A block is some consecutive documents of a task. Its distinct n-grams with their counts are
dealt by hash to the parts of the count table; a part sums them over all blocks and looks up
the total of every n-gram of every block; these totals meet the block's texts again. So a hot
n-gram costs a part one entry a block, never one a document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depdelver.llm.rows import column
from depdelver.llm.textops import U, as_bytes, pack, pack_sorted, slices, squeeze, unpack, unpack_sorted, unsqueeze

#: Text of a block of documents, and n-grams of a part of the count table.
BLOCK_BYTES, PART = 8 << 20, 2_000_000
#: Bits of an n-gram's hash that are kept.
KEPT = 58

PACKED = "part int, block long, keys binary, counts binary, ids array<long>, texts binary"
_SCHEMA = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("ids", pa.list_(pa.int64())), ("texts", pa.binary())])

#: Of some texts: the hashes of their n-grams, KEPT bits of each, and the text of each.
Grams = Callable[[list[bytes | None]], tuple[np.ndarray, np.ndarray]]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list]]:
    """Consecutive documents (id, text, row number), BLOCK_BYTES of text or so at a time: number of the first, ids, texts."""
    ids, texts, size, first = [], [], 0, 0
    for batch in slices(batches):
        for i, t, row in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            if ids and size + len(t or b"") > BLOCK_BYTES:
                yield first, ids, texts
                ids, texts, size = [], [], 0
            if not ids:
                first = row
            ids.append(i)
            texts.append(t)
            size += len(t or b"") + 8
    if ids:
        yield first, ids, texts


def _row(part: int, block: int, keys=None, counts=None, ids=None, texts=None) -> tuple:
    return part, block, keys, counts, ids, texts


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _deal(grams: Grams, bits: int):
    """The distinct n-grams of each block with their counts, dealt by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, texts in blocks(batches):
            keys, counts = np.unique(grams(texts)[0], return_counts=True)
            cuts = np.searchsorted(keys >> U(KEPT - bits), np.arange((1 << bits) + 1))
            if rows := [_row(p, block, pack_sorted(keys[a:b]), pack(counts[a:b])) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]:
                yield _batch(rows)

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, ids, texts in blocks(batches):
        yield _batch([_row(-1, block, pack(np.array([len(t or b"") for t in texts])), None, ids, squeeze(b"".join([t or b"" for t in texts])))])


def _count_and_join(table: pa.Table) -> pa.Table:
    """Of a part: the count table, and by block the totals of the block's n-grams, in their order."""
    keys = [unpack_sorted(k) for k in table.column("keys").to_pylist()]
    counts = np.concatenate([unpack(c) for c in table.column("counts").to_pylist()]).astype(np.int64)
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    n_grams, totals = ordered[first], np.add.reduceat(counts[order], first)  # the count table
    del every, order, ordered
    parts, at = table.column("part").to_pylist(), table.column("block").to_pylist()
    return pa.Table.from_batches([_batch([_row(p, b, None, pack(totals[np.searchsorted(n_grams, k)])) for p, b, k in zip(parts, at, keys, strict=True)])])


class Block:
    """A block's documents, its n-grams, and how often each is there in the corpus.

    ``gram``, ``doc``: the n-grams by hash and, of one hash, by document, with ``order`` their
    places as ``grams`` gave them; ``total``: the corpus' count of each.
    """

    def __init__(self, table: pa.Table, grams: Grams):
        held = table.column("part").to_numpy()
        at = int(np.flatnonzero(held == -1)[0])
        self.first = table.column("block")[at].as_py()
        self.ids = table.column("ids")[at].as_py()
        raw = unsqueeze(table.column("texts")[at].as_py())
        cuts = np.cumsum(np.append(0, unpack(table.column("keys")[at].as_py()))).astype(np.int64)
        self.texts = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        gram, doc = grams(self.texts)
        self.order = np.argsort(gram, kind="stable")  # documents stay in order
        self.gram, self.doc = gram[self.order], doc[self.order]
        blobs = table.column("counts").to_pylist()
        totals = np.concatenate([np.empty(0, np.uint64), *[unpack(blobs[i]) for i in np.argsort(held, kind="stable").tolist() if held[i] >= 0]]).astype(np.int64)
        self.total = totals[np.cumsum(np.append(True, self.gram[1:] != self.gram[:-1])[: len(self.gram)]) - 1]

    def own(self) -> np.ndarray:
        """How often each n-gram is in its own document."""
        new = np.append(True, (self.gram[1:] != self.gram[:-1]) | (self.doc[1:] != self.doc[:-1]))[: len(self.gram)]
        first = np.flatnonzero(new)
        return np.repeat(np.diff(np.append(first, len(new))), np.diff(np.append(first, len(new))))


def with_totals(docs: DataFrame, doc_id: str, text: str, grams: Grams, per_byte: float, use: Callable[[Block], pa.Table], schema: str) -> DataFrame:
    """``use`` of every block of ``docs``; ``per_byte``: n-grams in a byte of text, about.

    Rows are numbered by monotonically_increasing_id, so ``docs`` should be a table or another
    deterministic plan. Texts move once, compressed.
    """
    rows = docs.select(column(doc_id).cast("long"), column(text), F.monotonically_increasing_id())
    size = docs.agg(F.coalesce(F.sum(F.octet_length(column(text))), F.lit(0))).head()[0]
    bits = max(0, ceil(log2(max(1, size * per_byte / PART))))
    counted = rows.mapInArrow(_deal(grams, bits), PACKED).groupBy("part").applyInArrow(_count_and_join, PACKED)
    return counted.unionByName(rows.mapInArrow(_texts, PACKED)).groupBy("block").applyInArrow(lambda table: use(Block(table, grams)), schema)
