"""Attribute sets: bit vectors as Python integers on the driver and as BIGINT columns in Spark.

A set of up to 63 attributes is one BIGINT; of more, it is an array of such words (``words``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 63


# -- Python integers -------------------------------------------------------------------------


def of(indices: Iterable[int]) -> int:
    return reduce(lambda m, i: m | 1 << i, indices, 0)


def members(mask: int) -> list[int]:
    return list(iterate(mask))


def iterate(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def is_subset(a: int, b: int) -> bool:
    return a & b == a


def flip(mask: int, i: int) -> int:
    return mask ^ 1 << i


def put(mask: int, i: int, value: bool = True) -> int:
    return mask | 1 << i if value else mask & ~(1 << i)


def put_range(mask: int, start: int, end: int) -> int:
    """With the bits from ``start`` up to, but without, ``end``."""
    return mask | ((1 << end) - 1) & ~((1 << start) - 1)


def get(mask: int, i: int) -> bool:
    return bool(mask >> i & 1)


def next_set(mask: int, start: int) -> int:
    """The first set bit from ``start`` on, or -1."""
    rest = mask >> start
    return start + (rest & -rest).bit_length() - 1 if rest else -1


def next_clear(mask: int, start: int) -> int:
    return next_set(~mask, start)


def previous_set(mask: int, start: int) -> int:
    """The last set bit up to ``start``, or -1."""
    return (mask & (1 << start + 1) - 1).bit_length() - 1


def previous_clear(mask: int, start: int) -> int:
    return previous_set(~mask & (1 << start + 1) - 1, start)


def render(mask: int, names: list[str]) -> str:
    return ", ".join(names[i] for i in iterate(mask))


# -- Columns ---------------------------------------------------------------------------------


def one(i: int) -> Column:
    return F.lit(1 << i).cast("long")


def intersection(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def union(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def symmetric_difference(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def difference(a: Column, b: Column) -> Column:
    return a.bitwiseAND(F.bitwise_not(b))


def intersects(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b) != 0


def subset(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b) == a


def cardinality(a: Column) -> Column:
    return F.bit_count(a)


def has(a: Column, i: int | Column) -> Column:
    return F.getbit(a, F.lit(i) if isinstance(i, int) else i) == 1


def set_of(flags: Iterable[Column]) -> Column:
    """The set of the attributes whose flag is true; null flags count as false."""
    bits = [F.when(f, one(i)).otherwise(F.lit(0).cast("long")) for i, f in enumerate(flags)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def words(flags: list[Column]) -> Column:
    """``set_of`` for any number of attributes, 63 in a word."""
    return F.array(*[set_of(flags[i : i + WORD]) for i in range(0, len(flags), WORD)])


def from_words(values: Iterable[int]) -> int:
    return sum(w << WORD * i for i, w in enumerate(values))


def indices(a: Column, n: int) -> Column:
    """The attributes of a set as an array."""
    return F.filter(F.array(*[F.lit(i) for i in range(n)]), lambda i: F.getbit(a, i) == 1)


def names_of(a: Column, names: list[str], sep: str = ",") -> Column:
    """The names of a set's attributes, joined."""
    return F.array_join(F.filter(F.array(*[F.when(has(a, i), F.lit(n)) for i, n in enumerate(names)]), lambda x: x.isNotNull()), sep)
