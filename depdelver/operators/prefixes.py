"""Tables of the rows in clusters of some attributes, which left-hand sides that begin with these need only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depdelver.operators.metrics import worth_caching
from depdelver.operators.validate import GROUPED, Layout, expanded
from depdelver.session import cut, drop_cut, size_of

Prefix = tuple[int, ...]


@dataclass
class Table:
    """``rows``: None if the prefix is not worth a table of its own; then what it begins with has the rows."""

    rows: DataFrame | None
    records: int
    clusters: int
    bytes: int = 0
    reads: int = 0


class PrefixTables:
    """Tables by prefix, made many at once, and given up by reads and bytes.

    A row alone in its cluster of some attributes agrees with no row on any set that has them. A
    table is written if clusters get smaller by it (``metrics.worth_caching``) and it has half the
    rows or fewer of the table it is picked from. Beyond ``budget`` bytes, as they are on disk, the
    tables with the fewest reads go, of those the largest first, and are not made again.
    """

    def __init__(self, rows: DataFrame, n: int, records: int, budget: int, widths: list[int] | None = None):
        self.n, self.budget, self.layout = n, budget, Layout.of(n, widths)
        self.tables: dict[Prefix, Table] = {(): Table(rows, records, 1)}
        self.black: set[Prefix] = set()
        self.columns = ["rid", *[f"c{i}" for i in range(n)], "alone"]

    def held(self, prefix: Prefix) -> Prefix:
        """The longest beginning of ``prefix`` that has a table."""
        while prefix not in self.tables or self.tables[prefix].rows is None:
            prefix = prefix[:-1]
        return prefix

    def known(self, prefix: Prefix) -> Table:
        """What is known of the longest beginning of ``prefix`` that was looked at."""
        while prefix not in self.tables:
            prefix = prefix[:-1]
        return self.tables[prefix]

    def read(self, members: Prefix, longest: int) -> DataFrame | None:
        """The rows that a left-hand side needs, or None if no two rows agree on it."""
        if not self.known(members[:longest]).records:
            return None
        at = self.tables[self.held(members[:longest])]
        at.reads += 1
        return at.rows

    def make(self, wanted: list[Prefix]) -> None:
        """Tables of several prefixes by one aggregation, which counts clusters, and one join, which picks rows; of so
        many at once that GROUPED rows are in an exchange, or of one."""
        wanted = [p for p in wanted if p not in self.tables and p not in self.black and self.known(p).records]
        some, total = [], 0
        for p in wanted:
            own = self.tables[self.held(p)].records
            if some and total + own > GROUPED:
                self._make(some)
                some, total = [], 0
            some, total = [*some, p], total + own
        if some:
            self._make(some)

    def _make(self, wanted: list[Prefix]) -> None:
        by: dict[Prefix, list[tuple[int, list[int]]]] = {}
        for s, p in enumerate(wanted):
            by.setdefault(self.held(p), []).append((s, list(p)))
        tables = [(self.tables[p].rows, sets) for p, sets in by.items()]
        sizes = cut(expanded(tables, [], layout=self.layout).groupBy("s", "key").agg(F.count("*").alias("k")).where("k > 1"))
        found = {r["s"]: r for r in sizes.groupBy("s").agg(F.count("*").alias("clusters"), F.sum("k").alias("records")).collect()}  # a row a prefix
        keep = []
        for s, p in enumerate(wanted):
            records, clusters = (found[s]["records"], found[s]["clusters"]) if s in found else (0, 0)
            before, parent = self.known(p), self.tables[self.held(p)]
            self.tables[p] = Table(None, records, clusters)
            if records and 2 * records <= parent.records and _worth(before, self.tables[p]):
                keep.append(s)
        if keep:
            picked = [(rows, [x for x in sets if x[0] in keep]) for rows, sets in tables]
            rows = expanded([x for x in picked if x[1]], self.columns, layout=self.layout).join(sizes.where(F.col("s").isin(keep)), ["s", "key"], "left_semi")
            every = cut(rows.select(F.col("s").alias("set"), *self.columns), by="set")
            for s in keep:
                t = self.tables[wanted[s]]
                t.rows = every.where(F.col("set") == s).select(*self.columns)
                t.rows._cut_path = f"{every._cut_path}/set={s}"
                t.bytes = size_of(t.rows)
        drop_cut(sizes)
        self.evict()

    def evict(self) -> None:
        while sum(t.bytes for t in self.tables.values()) > self.budget:
            p = min((p for p, t in self.tables.items() if t.bytes), key=lambda p: (self.tables[p].reads, -self.tables[p].bytes))
            drop_cut(self.tables[p].rows)
            self.tables[p].rows, self.tables[p].bytes = None, 0
            self.black.add(p)

    def close(self) -> None:
        for t in self.tables.values():
            if t.bytes:
                drop_cut(t.rows)


def _worth(before: Table, after: Table) -> bool:
    return worth_caching(before.records, before.clusters, after.records, after.clusters)
