"""Dictionary codes: a relation as whole numbers that are equal where its typed values are.

Codes are made and joined by executors; of the values, nothing reaches the driver but counts.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depdelver.functions import bits
from depdelver.operators.partitions import name
from depdelver.session import cut, drop_cut

#: Size of an attribute's values and codes up to which they are sent to all executors for the join.
SENT = 8 << 20
#: Attributes from which rows meet one small dictionary cell by cell instead of attribute by attribute.
WIDE = 24
#: Rows from which each shuffled join is written, so that one shuffle is on disk at a time, and attributes that are sent for one table.
STEPS, TOGETHER = 1_000_000, 12
#: What numbers rows of a partition below, in monotonically_increasing_id.
_WITHIN = (1 << 33) - 1


@dataclass
class Encoded:
    """``rows``: rid, the codes c0, c1, ... of the attributes, and alone, the set (words) of those whose value no other row has.

    ``attributes``: the names, c0's first; ``distinct``: how many values each has; ``constants``:
    names of attributes, in no column, that no two rows differ in; ``n``: how many rows there are; ``widths``: bits that
    the codes of each attribute need; ``made``: tables that only ``rows`` is made from.
    """

    rows: DataFrame
    attributes: list[str]
    distinct: list[int]
    constants: list[str]
    n: int
    widths: list[int]
    made: list[DataFrame] = field(default_factory=list)

    def code(self, i: int) -> Column:
        return F.col(f"c{i}")

    def matrix(self) -> np.ndarray:
        """Codes as int32 [row, attribute]; to be called behind a check of the size."""
        table = self.rows.select(*[f"c{i}" for i in range(len(self.attributes))]).toArrow()
        out = np.empty((table.num_rows, len(self.attributes)), np.int32, order="F")
        for i in range(len(self.attributes)):
            codes = table.column(i).to_numpy()
            single = codes < 0  # nulls that are unlike each other
            codes = np.where(single, self.distinct[i] + np.cumsum(single), codes) if single.any() else codes
            out[:, i] = codes
        return out


@dataclass
class Cells:
    """How cells are told: (attr, v0, v1, ...), a slot for each type of attribute, null but for the cell's own."""

    cells: Column
    kinds: list[str]
    slot: list[int | None]

    @property
    def slots(self) -> list[str]:
        return [f"v{k}" for k in range(len(self.kinds))]


def cells_of(df: DataFrame, left: Collection[int] | None = None) -> Cells:
    """The cells of the attributes ``left`` (by default, of all)."""
    left = range(len(df.columns)) if left is None else left
    types = {f.dataType.simpleString(): f.dataType for i, f in enumerate(df.schema.fields) if i in left}
    kinds = list(types)
    slot = [kinds.index(f.dataType.simpleString()) if i in left else None for i, f in enumerate(df.schema.fields)]
    one = lambda i, c: F.struct(F.lit(i).alias("attr"), *[(name(c) if slot[i] == k else F.lit(None)).cast(types[t]).alias(f"v{k}") for k, t in enumerate(kinds)])
    return Cells(F.inline(F.array(*[one(i, c) for i, c in enumerate(df.columns) if i in left])), kinds, slot)


def dictionary(df: DataFrame, ranked: bool = True, left: Collection[int] | None = None) -> tuple[DataFrame, list[dict], DataFrame]:
    """(attr, slots, rows, code): every value of every attribute (of ``left``), how many rows have it, and its number among the
    attribute's values, from 0; of each attribute its values, those of one row, rows, rows with null, and bytes; and the table of the values.

    All attributes are one aggregation. ``ranked``: numbers are ranks, nulls first; the values are
    then sorted by ranges. A number is that inside a part, plus what the attribute has in the
    parts before, which is a row a part and attribute.
    """
    columns, cells = df.columns, cells_of(df, left)
    slots, kinds = cells.slots, cells.kinds
    values = df.select(cells.cells).groupBy("attr", *slots).agg(F.count("*").alias("rows"))
    order = ["attr", *slots] if ranked else ["attr"]
    values = (values.repartitionByRange(*order) if ranked else values).sortWithinPartitions(*order)
    size = sum((F.coalesce(F.octet_length(F.col(s) if t in ("string", "binary") else F.col(s).cast("string")), F.lit(0)) for s, t in zip(slots, kinds, strict=True)), F.lit(0))
    null = reduce(lambda a, b: a & b, [F.col(s).isNull() for s in slots])
    at = F.monotonically_increasing_id()
    table = cut(values.select("attr", *slots, "rows", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit(_WITHIN)).alias("within")))
    found = table.groupBy("attr", "part").agg(F.min("within").alias("first"), F.count("*").alias("n"), F.count_if(F.col("rows") == 1).alias("single"), F.sum("rows").alias("rows"), F.sum(F.when(null, F.col("rows")).otherwise(0)).alias("nulls"), F.sum(size + 16).alias("bytes"))
    stats = [{"values": 0, "single": 0, "rows": 0, "nulls": 0, "bytes": 0} for _ in columns]
    shift = []
    for r in sorted(found.collect(), key=lambda r: (r["attr"], r["part"])):  # a row an attribute and part
        own = stats[r["attr"]]
        shift.append((r["attr"], r["part"], own["values"] - r["first"]))
        for k in ("single", "rows", "nulls", "bytes"):
            own[k] += r[k]
        own["values"] += r["n"]
    shifts = df.sparkSession.createDataFrame(shift, "attr int, part long, shift long")
    coded = table.join(F.broadcast(shifts), ["attr", "part"])  # as many rows as were just collected
    return coded.select("attr", *slots, "rows", (F.col("within") + F.col("shift")).alias("code")), stats, table


def spans(df: DataFrame) -> tuple[int, dict[int, tuple[int, int, int]]]:
    """How many rows there are, and of attributes of whole numbers that lie close enough to be codes: the least, the greatest, and the nulls."""
    whole = [i for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))]
    each = [f(name(df.columns[i])).alias(f"{k}{i}") for i in whole for k, f in (("a", F.min), ("b", F.max), ("n", F.count))]
    r = df.agg(F.count("*").alias("n"), *each).head()  # one row
    found = {i: (r[f"a{i}"] or 0, r[f"b{i}"] or 0, r["n"] - r[f"n{i}"]) for i in whole}
    return r["n"], {i: x for i, x in found.items() if x[1] - x[0] < (1 << 31) - 2}


def encode(df: DataFrame, null_equals_null: bool = True, rid: Column | None = None, ordered: bool = True, ranked: bool = False, spread: bool = False, own: bool = False) -> Encoded:
    """Codes of all attributes: numbers of their values among the attribute's distinct ones, from 0.

    Values are compared as what they are, structs and arrays too: NaN equals NaN, -0.0 equals 0.0.
    With nulls unlike each other, a null's code is negative and its own. ``rid``: a row's number
    (by default one that no other row has, which nulls unlike each other need). ``ordered``: the attribute with the most values comes first and
    constants are left out; else all are there, in the order of the schema. ``ranked``: codes are
    ranks, nulls first. ``spread``: deal the rows over all cores first, for a small file, which is one task
    otherwise. ``own``: the code of a whole number is its distance from the least one (nulls first), which needs no join; of its
    values that no other row has, few may then be unmarked in alone, and without ``ordered`` all are, and
    ``distinct`` is a bound. The rows are a plan; write them before they are read twice.

    Each attribute is a join with its part of the dictionary, which is sent to the executors or, if it is larger
    than SENT bytes, shuffled; a value in a third of all rows is split by adaptive execution. From STEPS
    rows on, what a shuffled join gives is written before the next one. Rows
    of WIDE attributes or more meet the dictionary cell by cell, by one join; from STEPS rows on, TOGETHER attributes at a time.
    """
    columns = df.columns
    df = df.repartition(df.sparkSession.sparkContext.defaultParallelism) if spread else df
    rows_there, whole = spans(df) if own else (0, {})
    left = [i for i in range(len(columns)) if ordered or i not in whole]
    slot = cells_of(df, left).slot
    values, stats, table = dictionary(df, ranked, left) if left else (None, [{}] * len(columns), None)
    n = rows_there if own else stats[0]["rows"] if columns else 0
    # With nulls unlike each other, each is a value by itself.
    unlike = lambda s: s["values"] if null_equals_null or not s["nulls"] else s["values"] - 1 + s["nulls"]
    distinct = [unlike(s) if i in left else min(n, whole[i][1] - whole[i][0] + 1 + whole[i][2]) for i, s in enumerate(stats)]
    constants = [c for c, k in zip(columns, distinct, strict=True) if k <= 1 or n <= 1] if ordered else []
    at = [i for i, c in enumerate(columns) if c not in constants]
    at = sorted(at, key=lambda i: -distinct[i]) if ordered else at
    number = (F.monotonically_increasing_id() if rid is None else rid.cast("long")).alias("rid")
    kind = "int" if n < 1 << 31 and null_equals_null else "long"
    # Marks of the values that are alone are worth a join if these are many, but not all.
    whole = {i: x for i, x in whole.items() if i not in left or 4 * stats[i]["single"] <= n or stats[i]["single"] == n}
    joined = [(k, i) for k, i in enumerate(at) if i not in whole]
    widths = [64 if not null_equals_null else max(1, (whole[i][1] - whole[i][0] + 1).bit_length() if i in whole else stats[i]["values"].bit_length()) for i in at]

    def coded(null: Column, code: Column, single: Column) -> tuple[Column, Column]:
        """Code and whether the value is alone."""
        code = code.cast(kind)
        return (code, single) if null_equals_null else (F.when(null, -1 - F.col("rid")).otherwise(code), single | null)

    def of_whole(i: int, v: Column) -> tuple[Column, Column]:
        least, _, nulls = whole[i]
        code = F.when(v.isNull(), F.lit(0)).otherwise(v.cast("long") - F.lit(least) + F.lit(int(nulls > 0)))
        return coded(v.isNull(), code, F.lit(i in left and 0 < stats[i]["single"] == n))

    made: list[DataFrame] = [] if table is None else [table]

    def step(rows: DataFrame, last: list[DataFrame]) -> DataFrame:
        """``rows`` as a table; the one before goes."""
        out = cut(rows)
        for x in last:
            drop_cut(x)
        last[:] = [out]
        return out

    if len(joined) >= WIDE and len(joined) == len(at) and n < STEPS:
        small = sum(s["bytes"] for s in stats) <= SENT
        rows = _by_cells(df, number, F.broadcast(values) if small else values, at, lambda null, code, many: coded(null, code, many == 1))
    else:
        rows, last, waits, bytes_ = df.select(number, *[name(columns[i]).alias(f"v{k}") for k, i in enumerate(at)]), [], 0, 0
        whole_at = {k: i for k, i in enumerate(at) if i in whole}
        rows = rows.select("rid", *[f"v{k}" for k, _ in joined], *[x.alias(f"{t}{k}") for k, i in whole_at.items() for t, x in zip("ca", of_whole(i, F.col(f"v{k}")), strict=True)])
        done = list(whole_at)
        # What is sent comes first, so that rows are small when they are shuffled.
        for m, (k, i) in enumerate(order := sorted(joined, key=lambda x: stats[x[1]]["bytes"])):
            sent = stats[i]["bytes"] <= SENT
            if n >= STEPS and (waits >= TOGETHER or bytes_ > 4 * SENT or not sent and bytes_ < 0):
                rows, waits, bytes_ = step(rows, last), 0, 0
            own_values = values.where(F.col("attr") == i).select(F.col(f"v{slot[i]}").alias("value"), F.col("rows").alias("many"), "code")
            rows = rows.join(F.broadcast(own_values) if sent else own_values, F.col(f"v{k}").eqNullSafe(F.col("value")))
            code, single = coded(F.col(f"v{k}").isNull(), F.col("code"), F.col("many") == 1)
            rows = rows.select("rid", *[f"v{j}" for j, _ in order[m + 1 :]], *[f"{t}{j}" for j in done for t in "ca"], code.alias(f"c{k}"), single.alias(f"a{k}"))
            done.append(k)
            waits, bytes_ = (waits + 1, bytes_ + stats[i]["bytes"]) if sent else (0, -1)
        made += last
    alone = bits.words([F.col(f"a{k}") for k in range(len(at))]) if at else F.array().cast("array<long>")
    return Encoded(rows.select("rid", *[f"c{k}" for k in range(len(at))], alone.alias("alone")), [columns[i] for i in at], [distinct[i] for i in at], constants, n, [*widths], made)


def _by_cells(df: DataFrame, number: Column, values: DataFrame, at: list[int], coded) -> DataFrame:
    """(rid, c0, ..., a0, ...): one join of all cells with the dictionary, and one aggregation that puts rows together again."""
    df = df.select(F.monotonically_increasing_id().alias("row"), number, *[name(c).alias(f"x{i}") for i, c in enumerate(df.columns)])  # before a row is many cells
    cells = cells_of(df.drop("row", "rid"))
    own, met = values.select(F.col("attr").alias("of"), *[F.col(v).alias(f"d{v}") for v in cells.slots], "rows", "code"), F.col("attr") == F.col("of")
    for v in cells.slots:
        met = met & F.col(v).eqNullSafe(F.col(f"d{v}"))
    code, single = coded(reduce(lambda a, b: a & b, [F.col(v).isNull() for v in cells.slots]), F.col("code"), F.col("rows"))
    joined = df.select("row", "rid", cells.cells).join(own, met)
    held = joined.groupBy("row", "rid").agg(F.map_from_entries(F.collect_list(F.struct("attr", F.struct(code.alias("c"), single.alias("a"))))).alias("x"))
    get = lambda i: F.element_at("x", F.lit(i))
    return held.select("rid", *[get(i)["c"].alias(f"c{k}") for k, i in enumerate(at)], *[get(i)["a"].alias(f"a{k}") for k, i in enumerate(at)])


def written(e: Encoded) -> Encoded:
    """With the rows as a table; what they are made from goes."""
    rows = cut(e.rows)
    for x in e.made:
        drop_cut(x)
    return Encoded(rows, e.attributes, e.distinct, e.constants, e.n, e.widths)
