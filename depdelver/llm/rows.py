"""A user's rows beside an operator's own columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column(name: str) -> Column:
    """The column of that name, whatever is in the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that no name of theirs can clash with another one."""
    return F.struct(*[column(c) for c in df.columns])


def unpacked(df: DataFrame, row: str = "row") -> DataFrame:
    """The rows that were packed by :func:`whole`, as they were."""
    return df.select(f"{row}.*")
