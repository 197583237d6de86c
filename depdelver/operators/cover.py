"""The positive cover of one right-hand side: its minimal left-hand sides so far."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa

from depdelver.functions import bits

#: Bytes of a node of the index with one entry, as sys.getsizeof has it, and of its key.
NODE = sys.getsizeof({0: None}) + sys.getsizeof(0)
#: Covers times agree sets from which covers are specialized by tasks.
IN_TASKS = 20_000


class SubsetIndex:
    """Sets by the least attribute, then the next one and so on: nested maps, a set at its last attribute.

    A question about the subsets of a set only follows attributes that are in it, so it looks at
    a small part of what is stored.
    """

    __slots__ = ("root",)

    def __init__(self):
        self.root: dict = {}

    def add(self, members: tuple[int, ...]) -> None:
        node = self.root
        for b in members:
            node = node.setdefault(b, {})
        node[-1] = True

    def remove(self, members: tuple[int, ...]) -> None:
        path, node = [], self.root
        for b in members:
            path.append((node, b))
            node = node[b]
        del node[-1]
        for above, b in reversed(path):
            if above[b]:
                break
            del above[b]

    def has_subset(self, mask: int) -> bool:
        stack = [self.root]
        while stack:
            node = stack.pop()
            if -1 in node:
                return True
            stack += [below for b, below in node.items() if mask >> b & 1]
        return False

    def has_subset_with(self, mask: int, b: int) -> bool:
        """Whether a subset of ``mask`` that has the attribute ``b`` is stored."""
        stack = [self.root]
        while stack:
            for a, below in stack.pop().items():
                if a < b:
                    if a >= 0 and mask >> a & 1:
                        stack.append(below)
                elif a == b and self._any(below, mask):
                    return True
        return False

    @staticmethod
    def _any(node: dict, mask: int) -> bool:
        stack = [node]
        while stack:
            node = stack.pop()
            if -1 in node:
                return True
            stack += [below for b, below in node.items() if mask >> b & 1]
        return False

    def subsets(self, mask: int) -> list[int]:
        out, stack = [], [(self.root, 0)]
        while stack:
            node, found = stack.pop()
            for b, below in node.items():
                if b < 0:
                    out.append(found)
                elif mask >> b & 1:
                    stack.append((below, found | 1 << b))
        return out


class Cover:
    """A set of left-hand sides (bit vectors as integers), none of which contains another one.

    Those not announced yet wait in the order of their arrival.
    """

    def __init__(self, rhs: int, n: int, lhss: Iterable[int] | None = None, limit: int | None = None):
        """By default the cover of a non-constant attribute: every other attribute by itself."""
        self.rhs, self.n, self.limit = rhs, n, limit
        self.known: set[int] = set()
        self._index: SubsetIndex | None = SubsetIndex()
        self.waiting: dict[int, None] = {}
        for lhs in [1 << b for b in range(n) if b != rhs] if lhss is None else lhss:
            self.add(lhs)

    @property
    def index(self) -> SubsetIndex:
        if self._index is None:  # made when it is asked for
            self._index = SubsetIndex()
            for lhs in self.known:
                self._index.add(tuple(bits.iterate(lhs)))
        return self._index

    def replace(self, done: list[int], waiting: list[int]) -> None:
        """Takes other left-hand sides for those that are stored."""
        self.known, self.waiting, self._index = {*done, *waiting}, dict.fromkeys(waiting), None

    def __len__(self) -> int:
        return len(self.known)

    def bytes(self) -> int:
        """Memory of the sets, the index and the queue, about: measured tables, and a node of the index for each attribute of a set."""
        nodes = sum(x.bit_count() for x in self.known) + 1 if self._index is not None else 0
        whole = sys.getsizeof(1 << self.n)
        return sys.getsizeof(self.known) + sys.getsizeof(self.waiting) + whole * len(self.known) + nodes * NODE

    def __contains__(self, lhs: int) -> bool:
        return lhs in self.known

    def __iter__(self):
        return iter(sorted(self.known))

    def generalizations(self, mask: int) -> list[int]:
        """All stored subsets of ``mask``, itself included."""
        return sorted(self.index.subsets(mask))

    def has_generalization(self, mask: int) -> bool:
        return self.index.has_subset(mask)

    def add(self, lhs: int) -> None:
        if lhs in self.known:
            return
        self.known.add(lhs)
        self.index.add(tuple(bits.iterate(lhs)))
        self.waiting[lhs] = None

    def remove(self, lhs: int) -> None:
        self.known.remove(lhs)
        self.index.remove(tuple(bits.iterate(lhs)))
        self.waiting.pop(lhs, None)

    def has_waiting(self) -> bool:
        return bool(self.waiting)

    def announce(self, k: int) -> list[int]:
        """The next ``k`` left-hand sides that were not announced before."""
        out = list(self.waiting)[:k]
        for lhs in out:
            del self.waiting[lhs]
        return out

    def trim(self, size: int) -> None:
        """Gives up left-hand sides of more than ``size`` attributes, now and later."""
        for lhs in [x for x in self.known if x.bit_count() > size]:
            self.remove(lhs)
        self.limit = size if self.limit is None else min(size, self.limit)

    def specialize(self, non_fd: int) -> int:
        """``non_fd`` does not determine the right-hand side, so none of its subsets does: each is
        replaced by its minimal extensions with one attribute from outside. Returns how many went.
        """
        gone = self.index.subsets(non_fd)
        for lhs in gone:
            self.remove(lhs)
        outside = [b for b in range(self.n) if b != self.rhs and not non_fd >> b & 1]
        for lhs in sorted(gone):
            if self.limit is not None and lhs.bit_count() >= self.limit:
                continue
            for b in outside:
                # What is stored has nothing inside non_fd any more, so a subset of the extension has b.
                new = lhs | 1 << b
                if not self.index.has_subset_with(new, b):
                    self.add(new)
        return len(gone)


def _packed(masks: Iterable[int], width: int) -> bytes:
    return b"".join(m.to_bytes(width, "little") for m in masks)


def _unpacked(raw: bytes, width: int) -> list[int]:
    return [int.from_bytes(raw[i : i + width], "little") for i in range(0, len(raw), width)]


def specialize_all(spark, covers: list[Cover], non_fds: list[int]) -> None:
    """``specialize`` of every cover by every one of ``non_fds`` that is without its right-hand side.

    Covers do not depend on each other: where there is much to do, each is one task, which gets
    its left-hand sides and returns the new ones; these are what the driver holds anyway.
    """
    if len(covers) * len(non_fds) < IN_TASKS:
        for cover in covers:
            for m in non_fds:
                if not m >> cover.rhs & 1:
                    cover.specialize(m)
        return
    width = -(-covers[0].n // 8)
    state = [(c.rhs, c.n, c.limit, _packed((x for x in c.known if x not in c.waiting), width), _packed(c.waiting, width)) for c in covers]
    held = spark.sparkContext.broadcast((state, _packed(non_fds, width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, raw = held.value
        found = _unpacked(raw, width)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                rhs, n, limit, done, waiting = state[i]
                cover = restored(rhs, n, limit, _unpacked(done, width), _unpacked(waiting, width))
                for m in found:
                    if not m >> rhs & 1:
                        cover.specialize(m)
                left = _packed((x for x in cover.known if x not in cover.waiting), width)
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([left]), pa.array([_packed(cover.waiting, width)])], ["cover", "done", "waiting"])

    rows = spark.range(0, len(covers), 1, len(covers)).mapInArrow(run, "cover long, done binary, waiting binary").toArrow()
    held.unpersist()
    for i, done, waiting in zip(*(rows.column(k).to_pylist() for k in range(3)), strict=True):
        covers[i].replace(_unpacked(done, width), _unpacked(waiting, width))


def restored(rhs: int, n: int, limit: int | None, done: list[int], waiting: list[int]) -> Cover:
    cover = Cover(rhs, n, [*done, *waiting], limit)
    cover.waiting = dict.fromkeys(waiting)
    return cover


def prune_subsets(masks: Iterable[int], rhs: int) -> list[int]:
    """Of agree sets without ``rhs``, those inside no other one, the largest first."""
    out: list[int] = []
    for m in sorted({m for m in masks if not m >> rhs & 1}, key=lambda m: (-m.bit_count(), m)):
        if not any(bits.is_subset(m, k) for k in out):
            out.append(m)
    return out
