"""Exact validation of candidate dependencies, with the agree sets that refute the invalid ones."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depdelver.functions import bits
from depdelver.operators.codes import encode
from depdelver.operators.partitions import name
from depdelver.session import freed

#: Attributes of the prefixes whose partitions a task keeps, and bytes of those.
PREFIX, CACHE_BYTES = 3, 256 << 20


# -- Many left-hand sides by one aggregation ------------------------------------------------------

#: Shares of the clusters, in SHARES parts, that candidates meet one after the other: 1, then 15.
SHARES, FIRST = 16, 1
#: Rows, once for each set that they are grouped by, of one exchange.
GROUPED = 32_000_000


def without(alone: Column, members: list[int]) -> Column:
    """Whether none of some attributes has a value that no other row has; else the row is in no cluster of them."""
    out = F.lit(True)
    words: dict[int, int] = {}
    for i in members:
        words[i // bits.WORD] = words.get(i // bits.WORD, 0) | 1 << i % bits.WORD
    for w, mask in words.items():
        out = out & (F.get(alone, w).bitwiseAND(F.lit(mask)) == 0)
    return out


def share(members: list[int]) -> Column:
    """The part of all clusters of some attributes, of SHARES parts, that a row's cluster is in."""
    mixed = F.lit(0).cast("long")
    for j, i in enumerate(members):
        mixed = mixed + F.col(f"c{i}").cast("long") * F.lit(31**j % 1_000_003)
    return F.pmod(mixed, F.lit(SHARES))


@dataclass(frozen=True)
class Layout:
    """Where the codes of each attribute are in a row's words: (word, shift, bits)."""

    places: list[tuple[int, int, int]]

    @staticmethod
    def of(n: int, widths: list[int] | None = None) -> Layout:
        """Codes side by side, as many as a word of 63 bits has room for; by themselves where ``widths`` are not known."""
        places, word, used = [], -1, 64
        for width in widths or [64] * n:
            if used + width > bits.WORD:
                word, used = word + 1, 0
            places.append((word, used, width))
            used += width
        return Layout(places)

    def mask(self, i: int) -> int:
        """The bits of an attribute, as a BIGINT."""
        _, shift, width = self.places[i]
        return -1 if width > bits.WORD else ((1 << width) - 1) << shift

    def words(self, members: list[int] | None = None) -> list[Column]:
        """The words with the codes of all attributes, or those that have some of ``members``, with their codes only."""
        by: dict[int, Column] = {}
        for i in range(len(self.places)) if members is None else members:
            word, shift, _ = self.places[i]
            code = F.col(f"c{i}").cast("long")
            code = F.shiftleft(code, shift) if shift else code
            by[word] = by[word].bitwiseOR(code) if word in by else code
        return [by[w] for w in sorted(by)]


def expanded(tables: list[tuple[DataFrame, list[tuple[int, list[int]]]]], kept: list[str | Column], shares: range = range(SHARES), layout: Layout | None = None) -> DataFrame:
    """(s, key, columns ``kept``): every row once for each of the sets (s, attributes) of its table, unless it is in no
    cluster of it, or in one outside of ``shares``. The key has the codes of the set, by ``layout`` if there is one."""
    out = None
    every = len(shares) == SHARES
    for table, sets in tables:
        one = lambda s, m: F.when(without(F.col("alone"), m) & (F.lit(True) if every or not m else share(m).between(shares[0], shares[-1])), F.struct(F.lit(s).alias("s"), F.array(*([F.col(f"c{i}").cast("long") for i in m] if layout is None else layout.words(m))).cast("array<long>").alias("key")))
        named = table.select(F.explode(F.array(*[one(s, m) for s, m in sets])).alias("x"), *kept).where("x IS NOT NULL")
        part = named.select("x.s", "x.key", *[c for c in named.columns if c != "x"])
        out = part if out is None else out.unionByName(part)
    return out


def violations(tables: list[tuple[DataFrame, list[tuple[int, list[int]]]]], rhs: dict[int, list[int]], n: int, shares: range = range(SHARES), widths: list[int] | None = None) -> DataFrame:
    """(s, found): of each set that does not determine all its right-hand sides, for each attribute, the words of the
    largest agree set of a cluster with two values of it (null: it is none of these).

    ``tables``: coded rows and the sets (number, attributes) that are asked of them. One exchange,
    whatever the number of sets: rows are dealt by set and cluster, the bits that all of them and that any of them
    have merged before. Codes are the same throughout a cluster where these bits are, and lie side by side in
    words (``widths``: the bits of each attribute's codes). In a cluster with two values of A, some two rows agree on all attributes
    that are the same throughout and differ in A; that set refutes more than the candidate.
    """
    layout = Layout.of(n, widths)
    codes = [w.alias(f"p{j}") for j, w in enumerate(layout.words())]
    stats = [f(F.col(f"p{j}")).alias(f"{k}{j}") for j in range(len(codes)) for k, f in (("a", F.bit_and), ("b", F.bit_or))]
    groups = expanded(tables, codes, shares, layout).groupBy("s", "key").agg(*stats)
    flags = [F.col(f"a{w}").bitwiseXOR(F.col(f"b{w}")).bitwiseAND(F.lit(layout.mask(i)).cast("long")) == 0 for i, (w, _, _) in enumerate(layout.places)]
    words = bits.words(flags)
    masks = F.array(*[F.array(*[F.lit(bits.of(rhs.get(s, ())) >> bits.WORD * w & (1 << bits.WORD) - 1).cast("long") for w in range(-(-n // bits.WORD))]) for s in range(max(rhs) + 1)])
    open_ = F.transform(F.arrays_zip(words.alias("w"), F.element_at(masks, F.col("s") + 1).alias("m")), lambda x: x["m"].bitwiseAND(F.bitwise_not(x["w"])))
    shown = groups.select("s", words.alias("w"), open_.alias("o")).where(F.exists("o", lambda x: x != 0))
    size = F.aggregate("w", F.lit(0), lambda a, w: a + F.bit_count(w))
    differs = lambda i: F.get("o", i // bits.WORD).bitwiseAND(bits.one(i % bits.WORD)) != 0
    best = [F.max(F.when(differs(i), F.struct("size", "w"))).alias(f"x{i}") for i in range(n)]
    return shown.select("s", "w", "o", size.alias("size")).groupBy("s").agg(*best).select("s", F.array(*[F.col(f"x{i}.w") for i in range(n)]).alias("found"))


def by_groups(rows: DataFrame, candidates: dict[int, list[int]], n: int, tables: dict[int, DataFrame] | None = None, stages: bool = False, widths: list[int] | None = None, sizes: dict[int, int] | None = None) -> list[tuple[int, int, int]]:
    """The invalid ones of ``candidates`` (left-hand side: right-hand sides) as (lhs, rhs, agree set), over coded rows of ``n`` attributes.

    All left-hand sides are one scan (of each table) and one exchange; a row for each that is
    invalid reaches the driver. ``tables``: for a left-hand side, the rows that are in clusters of a
    part of it, which are all that matter. ``stages``: candidates first meet a share of their
    clusters, and only those without a violation there meet the other ones. ``sizes``: rows of the table of each
    left-hand side; where they are more than GROUPED together, there are several exchanges one after the other, each
    of some left-hand sides, or some shares of the clusters of one, and its files go before the next one.
    """
    lhss, out = list(candidates), []
    left = {s: candidates[x] for s, x in enumerate(lhss)}
    for shares in (range(FIRST), range(FIRST, SHARES)) if stages else (range(SHARES),):
        for some, part in _jobs({s: (sizes or {}).get(lhss[s], 0) if lhss[s] else 0 for s in left}, shares):
            by: dict[int, tuple[DataFrame, list]] = {}
            open_ = {s: left[s] for s in some if left[s]}
            for s in open_:
                table = (tables or {}).get(lhss[s], rows)
                by.setdefault(id(table), (table, []))[1].append((s, bits.members(lhss[s])))
            if not by:
                continue
            with freed(rows.sparkSession):
                found = violations(list(by.values()), open_, n, part, widths).collect()
            for row in found:
                s = row["s"]
                refuted = [(lhss[s], a, bits.from_words(w)) for a, w in enumerate(row["found"]) if w is not None and a in left[s]]
                out += refuted
                left[s] = [a for a in left[s] if a not in {a for _, a, _ in refuted}]
        # A set without attributes has one cluster, which is in every share.
        left = {s: rhs for s, rhs in left.items() if rhs and lhss[s]}
    return out


def _jobs(sizes: dict[int, int], shares: range) -> Iterator[tuple[list[int], range]]:
    """The sets (number: rows) and the shares of their clusters that are grouped at once."""
    some, total = [], 0
    for s, size in sorted(sizes.items(), key=lambda x: x[1]):
        own = size * len(shares) // SHARES
        if own > GROUPED:  # a set by itself
            width = max(1, GROUPED * SHARES // size)
            for first in range(shares.start, shares.stop, width):
                yield [s], range(first, min(first + width, shares.stop))
            continue
        if some and total + own > GROUPED:
            yield some, shares
            some, total = [], 0
        some, total = [*some, s], total + own
    if some:
        yield some, shares


def valid_flags(df: DataFrame, candidates: list[tuple[list[str], str]], null_equals_null: bool = True, ranked: bool = False) -> DataFrame:
    """(lhs, rhs, valid, share) for a list of candidates by name: all left-hand sides by one scan and one exchange.

    share: the first of the SHARES parts of clusters with a violation, null for a valid candidate;
    with ``ranked``, clusters are dealt by the ranks of their values.
    """
    at = {c: i for i, c in enumerate(df.columns)}
    sets = list(dict.fromkeys(tuple(at[c] for c in lhs) for lhs, _ in candidates))
    asked = df.sparkSession.createDataFrame([(sets.index(tuple(at[c] for c in lhs)), ",".join(lhs), rhs, at[rhs]) for lhs, rhs in candidates], "s int, lhs string, rhs string, a int")
    rows = encode(df, null_equals_null, ordered=False, ranked=ranked).rows
    n = len(df.columns)
    parts = [(s, list(m)) for s, m in enumerate(sets)]
    keyed = expanded([(rows, parts)], [f"c{i}" for i in range(n)])
    # The key has the codes of the set's attributes in their order, so it tells the share.
    mixed = F.pmod(F.aggregate(F.transform("key", lambda x, i: x * F.element_at(F.array(*[F.lit(31**j % 1_000_003) for j in range(max(1, n))]), i + 1)), F.lit(0).cast("long"), lambda x, y: x + y), F.lit(SHARES))
    groups = keyed.groupBy("s", "key").agg(*[f(F.col(f"c{i}")).alias(f"{k}{i}") for i in range(n) for k, f in (("a", F.min), ("b", F.max))])
    found = groups.select("s", mixed.alias("share"), F.explode(F.array(*[F.when(F.col(f"a{i}") != F.col(f"b{i}"), i) for i in range(n)])).alias("a")).where("a IS NOT NULL").groupBy("s", "a").agg(F.min("share").alias("share"))
    return asked.join(found, ["s", "a"], "left").select("lhs", "rhs", F.col("share").isNull().alias("valid"), "share")


def violating_pairs(df: DataFrame, lhs: list[str], rhs: str, rid: str) -> DataFrame:
    """For every value of ``lhs`` with two values of ``rhs``: a row of the least and one of the greatest."""
    k = F.struct(name(rhs), name(rid))
    groups = df.groupBy(*[name(c) for c in lhs]).agg(F.min(k).alias("a"), F.max(k).alias("b"))
    return groups.where(~F.col(f"a.`{rhs}`").eqNullSafe(F.col(f"b.`{rhs}`"))).select(*[name(c) for c in lhs], F.col(f"a.`{rid}`").alias("first"), F.col(f"b.`{rid}`").alias("second"))


# -- Dictionary codes on every executor --------------------------------------------------------


def size_of_values(df: DataFrame, n: int) -> int:
    """Bytes of all values of ``n`` rows: measured, for columns whose values have no fixed size."""
    fixed, total = 0, F.lit(0).cast("long")
    for c in df.columns:
        kind = df.schema[c].dataType
        if isinstance(kind, (T.NumericType, T.BooleanType, T.DatetimeType, T.DayTimeIntervalType, T.YearMonthIntervalType)):
            fixed += 16
        elif isinstance(kind, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(name(c)), F.lit(0))
        else:
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(name(c)))), F.lit(0))
    measured = df.agg(F.coalesce(F.sum(total), F.lit(0))).head()[0] if fixed < 16 * len(df.columns) else 0
    return n * fixed + measured


def codes(df: DataFrame, null_equals_null: bool = True) -> np.ndarray:
    """int32 codes [row, attribute], equal where values agree; to be called behind a check of the size.

    Structs and arrays are coded by the executors; plain values are coded here, which is quicker
    for the few that may be broadcast.
    """
    if any(isinstance(f.dataType, (T.ArrayType, T.StructType)) for f in df.schema.fields):
        return encode(df, null_equals_null, ordered=False).matrix()
    out = []
    for c in df.columns:
        kind = df.schema[c].dataType
        zero = F.lit(0.0).cast(kind) if isinstance(kind, (T.FloatType, T.DoubleType)) else None
        out.append((name(c) if zero is None else name(c) + zero).alias(c))  # -0.0 is 0.0
    table = df.select(*out).toArrow()
    matrix = np.empty((table.num_rows, len(df.columns)), np.int32, order="F")
    for i in range(len(df.columns)):
        column = pc.dictionary_encode(table.column(i).combine_chunks(), null_encoding="encode")
        matrix[:, i] = column.indices.to_numpy(zero_copy_only=False) if table.num_rows else 0
        if not null_equals_null and table.num_rows:
            null = np.asarray(table.column(i).combine_chunks().is_null())
            matrix[null, i] = len(column.dictionary) + np.arange(int(null.sum()))
    return matrix


@dataclass
class Partition:
    """Rows of clusters of two or more, cluster by cluster, and the cluster of each."""

    rows: np.ndarray
    group: np.ndarray


def refine(p: Partition, column: np.ndarray) -> Partition:
    """Each cluster divided by another attribute, without those of one row."""
    key = p.group.astype(np.int64) * (int(column.max(initial=0)) + 1) + column[p.rows]
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.empty(len(key), bool)
    new[:1] = True
    np.not_equal(key[1:], key[:-1], out=new[1:])
    # A row of a cluster of one begins it, and the next row begins another one.
    keep = ~(new & np.append(new[1:], True)[: len(new)])
    return Partition(p.rows[order[keep]], np.cumsum(new[keep]) - 1)


def everything(n: int) -> Partition:
    return Partition(np.arange(n), np.zeros(n, np.int64))


class Refuter:
    """Tests candidates on coded rows; keeps the partitions of common prefixes, the latest ones, up to a size."""

    def __init__(self, matrix: np.ndarray, prefix: int = PREFIX, size: int = CACHE_BYTES):
        self.columns = self.matrix = matrix  # column by column, as it was broadcast
        self.prefix, self.size = prefix, size
        self.cache: OrderedDict[tuple, Partition] = OrderedDict()
        self.held = 0

    def partition(self, lhs: list[int]) -> Partition:
        head = tuple(lhs[: self.prefix])
        k = next((k for k in range(len(head), 0, -1) if head[:k] in self.cache), 0)
        p = self.cache[head[:k]] if k else everything(len(self.matrix))
        for i in range(k, len(lhs)):
            p = refine(p, self.columns[:, lhs[i]])
            if i < self.prefix:
                self.cache[tuple(lhs[: i + 1])] = p
                self.held += p.rows.nbytes + p.group.nbytes
                while self.held > self.size and self.cache:
                    _, old = self.cache.popitem(last=False)
                    self.held -= old.rows.nbytes + old.group.nbytes
        return p

    def refute(self, lhs: list[int], rhs: list[int]) -> list[tuple[int, int]]:
        """(rhs, agree set) for every right-hand side that does not depend on ``lhs``."""
        p = self.partition(lhs)
        out = []
        if not len(p.rows):
            return out
        head = p.rows[np.searchsorted(p.group, p.group)]
        for a in rhs:
            column = self.columns[:, a]
            bad = column[p.rows] != column[head]
            at = int(bad.argmax())
            if bad[at]:
                out.append((a, bits.of(np.flatnonzero(self.matrix[p.rows[at]] == self.matrix[head[at]]).tolist())))
        return out


def agree_sets(matrix: np.ndarray, attribute: int, distance: int) -> tuple[set[int], int]:
    """Distinct agree sets of rows that share a value and lie ``distance`` apart, in the order of
    the next attribute and the one before; and how many such pairs there are."""
    n = matrix.shape[1]
    order = np.lexsort((matrix[:, attribute - 1], matrix[:, (attribute + 1) % n], matrix[:, attribute]))
    a, b = matrix[order[:-distance]], matrix[order[distance:]]
    same = (a == b)[a[:, attribute] == b[:, attribute]]
    packed = np.unique(np.packbits(same, axis=1, bitorder="little"), axis=0) if len(same) else same
    return {int.from_bytes(x.tobytes(), "little") for x in packed}, len(same)


def _to_bytes(mask: int) -> bytes:
    return mask.to_bytes(max(1, (mask.bit_length() + 7) // 8), "little")


def by_broadcast(spark, matrix, candidates: dict[int, list[int]], prefix: int = PREFIX, cache_bytes: int = CACHE_BYTES) -> list[tuple[int, int, int]]:
    """Like ``by_groups``, with the candidates dealt over tasks that hold the coded rows.

    ``matrix``: a broadcast variable of ``codes``. Candidates that begin with the same
    attributes stay together, so that a task refines their partitions once.
    """
    ordered = sorted(candidates.items(), key=lambda x: bits.members(x[0]))
    tasks = max(1, min(len(ordered) // 4, 4 * spark.sparkContext.defaultParallelism))
    step = -(-len(ordered) // tasks)
    asked = spark.sparkContext.broadcast([[(bits.members(x), _to_bytes(x), rhs) for x, rhs in ordered[at : at + step]] for at in range(0, len(ordered), step)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column(0).to_pylist():
                refuter = Refuter(matrix.value, prefix, cache_bytes)
                rows = [(x, a, _to_bytes(m)) for members, x, rhs in asked.value[task] for a, m in refuter.refute(members, rhs)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.int32(), pa.binary()))], ["lhs", "rhs", "found"])

    n = -(-len(ordered) // step)
    found = spark.range(0, n, 1, n).mapInArrow(run, "lhs binary, rhs int, found binary").toArrow()
    asked.unpersist()
    return [(int.from_bytes(x, "little"), a, int.from_bytes(m, "little")) for x, a, m in zip(*(found.column(k).to_pylist() for k in range(3)), strict=True)]


def sample_broadcast(spark, matrix, attributes: list[tuple[int, int]]) -> dict[int, tuple[set[int], int]]:
    """Agree sets of (attribute, distance) pairs and how many pairs were compared, one task for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, d in (attributes[k] for k in batch.column(0).to_pylist()):
                found, pairs = agree_sets(matrix.value, a, d)
                rows = [None, *map(_to_bytes, sorted(found))]
                yield pa.RecordBatch.from_arrays([pa.array([a] * len(rows), pa.int32()), pa.array(rows, pa.binary()), pa.array([pairs] + [0] * len(found), pa.int64())], ["a", "m", "pairs"])

    out: dict[int, tuple[set[int], int]] = {a: (set(), 0) for a, _ in attributes}
    found = spark.range(0, len(attributes), 1, len(attributes)).mapInArrow(run, "a int, m binary, pairs long").toArrow()
    for a, m, pairs in zip(*(c.to_pylist() for c in found.columns), strict=True):
        out[a] = (out[a][0], pairs) if m is None else out[a]
        if m is not None:
            out[a][0].add(int.from_bytes(m, "little"))
    return out
