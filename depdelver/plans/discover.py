"""Discovery of all minimal functional dependencies."""

from __future__ import annotations

import heapq
import json
import logging
import sys
import time
from dataclasses import dataclass, field, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depdelver.config import BROADCAST_BYTES, FDConfig
from depdelver.functions import bits
from depdelver.operators import validate
from depdelver.operators.codes import Encoded, encode, written
from depdelver.operators.cover import Cover, specialize_all
from depdelver.operators.partitions import check_types, name
from depdelver.operators.prefixes import PrefixTables
from depdelver.operators.sample import agree_sets
from depdelver.session import cut, drop_cut, exists

log = logging.getLogger(__name__)
SCHEMA = "relation string, lhs array<string>, rhs string"
#: Rows up to which a relation is dealt over all cores, as it may be a file of one split.
SPREAD = 4_000_000


@dataclass
class Metrics:
    """What a run did."""

    rows: int = 0
    strategy: str = ""
    order: list[str] = field(default_factory=list)
    samples: int = 0
    comparisons: int = 0
    jobs: int = 0
    candidates: int = 0
    invalid: int = 0
    fds: int = 0
    milliseconds: int = 0
    max_lhs_size: int | None = None
    most_bytes: int = 0
    resumed: int = 0


def result(spark: SparkSession, fds: list[tuple[list[str], str]], relation: str) -> DataFrame:
    table = pa.table({"relation": pa.array([relation] * len(fds), pa.string()), "lhs": pa.array([x for x, _ in fds], pa.list_(pa.string())), "rhs": pa.array([a for _, a in fds], pa.string())})
    return spark.createDataFrame(table, SCHEMA)


def discover_fds(df: DataFrame, config: FDConfig | None = None, metrics: Metrics | None = None, **options) -> DataFrame:
    """All minimal, non-trivial dependencies of ``df``: relation, lhs (names, in the order of the
    schema) and rhs.

    A constant attribute depends on the empty set and on nothing else; so does every attribute of
    a relation of at most one row. A relation of fewer than two attributes has no result. The
    answer is exact, and the same for every strategy: samples of row pairs only refute candidates,
    and what is left is validated on all rows.
    """
    config = replace(config or FDConfig(), **options)
    metrics = Metrics() if metrics is None else metrics
    spark, began = df.sparkSession, time.monotonic()
    if len(set(df.columns)) < len(df.columns):
        raise ValueError("attributes need different names")
    if len(df.columns) < 2:
        log.warning("%s has fewer than two attributes: no dependencies", config.relation)
        return result(spark, [], config.relation)
    check_types(df)
    if config.row_limit > 0:
        df = cut(df.limit(config.row_limit))
    if config.strategy == "cube":
        if not config.null_equals_null:
            raise ValueError("the cube strategy takes null as equal to null")
        out = cut(cube_fds(df, config))
        metrics.strategy, metrics.rows, metrics.fds = "cube", df.count(), out.count()
        metrics.order, metrics.milliseconds = list(df.columns), int(1000 * (time.monotonic() - began))
        return out
    found = _search(df, config, metrics)
    metrics.fds, metrics.milliseconds = len(found), int(1000 * (time.monotonic() - began))
    log.info("%s: found %d dependencies in %d ms", config.relation, metrics.fds, metrics.milliseconds)
    return result(spark, found, config.relation)


def _search(df: DataFrame, config: FDConfig, metrics: Metrics) -> list[tuple[list[str], str]]:
    columns = df.columns
    metrics.rows = n = df.count()
    if small := _small(df, n, config):
        matrix = validate.codes(df, config.null_equals_null)
        distinct = [int(x) + 1 for x in matrix.max(axis=0, initial=-1)]  # codes are dense
        constants = [c for c, k in zip(columns, distinct, strict=True) if k <= 1 or n <= 1]
        # The most distinct attributes come first, so that partitions get small soon.
        at = sorted((i for i, c in enumerate(columns) if c not in constants), key=lambda i: -distinct[i])
        order = [columns[i] for i in at]
    else:
        coded = encode(df, config.null_equals_null, spread=n <= SPREAD, own=True)
        order, constants = coded.attributes, coded.constants
        at = [columns.index(c) for c in order]
    metrics.order = order
    out: list[tuple[list[str], str]] = [([], c) for c in (columns if n <= 1 else constants)]
    if len(order) > 1 and n > 1:
        engine = Broadcast(df.sparkSession, np.asfortranarray(matrix[:, at]), config) if small else Groups(written(coded), config)
        metrics.strategy = type(engine).__name__
        try:
            named = lambda cover: [([columns[k] for k in sorted(at[i] for i in bits.iterate(lhs))], order[cover.rhs]) for lhs in cover]
            finals = Finals(df.sparkSession, config, order, named)
            out += finals.before
            for cover in _induce(engine, df.sparkSession, len(order), config, metrics, finals):
                out += named(cover)
        finally:
            engine.close()
    return out


class Finals:
    """The results of right-hand sides that are final, in a folder, if one is named: relation, lhs, rhs, and a mark of those that are complete."""

    def __init__(self, spark: SparkSession, config: FDConfig, order: list[str], named):
        self.spark, self.config, self.order, self.named = spark, config, order, named
        self.done: set[int] = set()
        self.before: list[tuple[list[str], str]] = []
        if config.results and exists(spark, config.results):
            kept = spark.read.schema(f"{SCHEMA}, run string").parquet(config.results).where((F.col("relation") == config.relation) & (F.col("run") == self.run))
            rows = kept.toArrow().to_pylist()  # what this run returns anyway
            self.done = {order.index(r["rhs"]) for r in rows if r["lhs"] is None}
            self.before = [(r["lhs"], r["rhs"]) for r in rows if r["lhs"] is not None and order.index(r["rhs"]) in self.done]

    @property
    def run(self) -> str:
        """Results are taken up by a run over the same attributes with the same options only."""
        c = self.config
        return json.dumps([self.order, c.max_lhs_size, c.row_limit, c.null_equals_null])

    def append(self, covers: list[Cover], limit: int | None) -> None:
        """Those of ``covers`` that were not appended before, by one job; a right-hand side's rows and its mark are one file."""
        new = [c for c in covers if c.rhs not in self.done]
        self.done |= {c.rhs for c in new}
        if not self.config.results or not new or limit != self.config.lhs_limit:  # what was given up is not taken up again
            return
        rows = [x for c in new for x in (*self.named(c), (None, self.order[c.rhs]))]
        table = result(self.spark, rows, self.config.relation).withColumn("run", F.lit(self.run))
        table.coalesce(1).write.mode("append").parquet(self.config.results)


def _small(df: DataFrame, n: int, config: FDConfig) -> bool:
    """Codes are broadcast only if they, and the values they are made from, are found to be small."""
    if config.strategy == "group":
        return False
    most = BROADCAST_BYTES if config.broadcast_bytes is None else config.broadcast_bytes
    if n * len(df.columns) * 4 <= most and validate.size_of_values(df, n) <= 2 * most:
        return True
    if config.strategy == "broadcast":
        if config.broadcast_bytes is not None:
            raise ValueError(f"the relation is larger than broadcast_bytes = {config.broadcast_bytes}: take strategy group")
        log.warning("%s is too large to be broadcast: its rows are grouped", config.relation)
    return False


class Broadcast:
    """Coded rows on every executor, candidates dealt over tasks."""

    def __init__(self, spark: SparkSession, matrix: np.ndarray, config: FDConfig):
        self.spark, self.config = spark, config
        self.matrix = spark.sparkContext.broadcast(matrix)
        self.per_job = config.candidates_per_job
        self.attributes = list(range(matrix.shape[1]))

    def sample(self, wanted: list[tuple[int, int]], seen: set[int]) -> dict[int, tuple[set[int], int]]:
        """By attribute: agree sets, and how many pairs were compared."""
        return validate.sample_broadcast(self.spark, self.matrix, wanted)

    def refute(self, candidates: dict[int, list[int]]) -> list[tuple[int, int, int]]:
        return validate.by_broadcast(self.spark, self.matrix, candidates, self.config.pli_cache_prefix, self.config.pli_cache_bytes)

    def close(self) -> None:
        self.matrix.unpersist()


class Groups:
    """Coded rows as a table; all left-hand sides of a job are one aggregation over it, or over the
    rows in clusters of what they begin with (``prefixes.PrefixTables``). The path for large tables."""

    #: Left-hand sides of a job that start alike, from which their rows are written for them, and
    #: rows of a table from which that, and a first look at a share of the clusters, is worth the jobs.
    ALIKE, STRIP, STAGES = 3, 100_000, 1_000_000

    def __init__(self, coded: Encoded, config: FDConfig):
        self.coded, self.config, self.n = coded, config, len(coded.attributes)
        self.per_job = config.sets_per_job
        self.attributes = list(range(self.n))
        self.prefixes = PrefixTables(coded.rows, self.n, coded.n, config.pli_cache_table_bytes, coded.widths)

    def sample(self, wanted: list[tuple[int, int]], seen: set[int]) -> dict[int, tuple[set[int], int]]:
        out: dict[int, tuple[set[int], int]] = {a: (set(), 0) for a, _ in wanted}
        for r in agree_sets(self.coded.rows, self.n, wanted, seen, self.coded.n).collect():  # distinct agree sets that are new
            a = wanted[r["w"]][0]
            out[a] = (out[a][0] if r["words"] is None else out[a][0] | {bits.from_words(r["words"])}, out[a][1] + r["pairs"])
        return out

    def refute(self, candidates: dict[int, list[int]]) -> list[tuple[int, int, int]]:
        members = {x: tuple(bits.members(x)) for x in candidates}
        longest = self.config.pli_cache_prefix
        for k in range(2, longest + 1):  # the rows alone in an attribute by itself are marked
            alike: dict[tuple[int, ...], int] = {}
            for m in members.values():
                if len(m) >= k:
                    alike[m[:k]] = alike.get(m[:k], 0) + 1
            self.prefixes.make([p for p, many in alike.items() if many >= self.ALIKE and self.prefixes.tables[self.prefixes.held(p)].records >= self.STRIP])
        tables = {x: self.prefixes.read(m, longest) for x, m in members.items()}
        # Nothing agrees on one without rows: all that it is asked for is true.
        asked = {x: rhs for x, rhs in candidates.items() if tables[x] is not None}
        sizes = {x: self.prefixes.tables[self.prefixes.held(members[x][:longest])].records for x in asked}
        return validate.by_groups(self.coded.rows, asked, self.n, tables, self.coded.n >= self.STAGES, self.coded.widths, sizes)

    def close(self) -> None:
        self.prefixes.close()
        drop_cut(self.coded.rows)


def _induce(engine: Broadcast | Groups, spark: SparkSession, n: int, config: FDConfig, metrics: Metrics, finals: Finals) -> list[Cover]:
    """Samples and validates in turn until every cover's left-hand sides have been validated.

    A cover without one to validate is final: agree sets that come later are of rows that agree
    with it, as all rows do. It is appended to the results then.
    """
    limit = config.lhs_limit
    covers = [Cover(a, n, limit=limit) for a in range(n) if a not in finals.done]
    metrics.resumed = n - len(covers)
    seen: set[int] = set()
    # Attributes by the agree sets that their last sample added, for each pair it compared.
    queue: list[tuple[float, int, int]] = []

    def learn(masks: set[int]) -> int:
        new = sorted(masks - seen, key=lambda m: (-m.bit_count(), m))
        seen.update(new)
        specialize_all(spark, covers, new)
        guard()
        return len(new)

    def held() -> int:
        """Bytes of covers and of agree sets seen."""
        return sum(c.bytes() for c in covers) + sys.getsizeof(seen) + len(seen) * sys.getsizeof(1 << n)

    def too_many() -> bool:
        if config.max_bytes is not None:
            metrics.most_bytes = max(metrics.most_bytes, now := held())
            if now > config.max_bytes:
                return True
        return config.max_candidates is not None and sum(map(len, covers)) > config.max_candidates

    def guard() -> None:
        nonlocal limit
        while too_many():
            limit = max((x.bit_count() for c in covers for x in c), default=1) - 1
            log.warning("too many candidates: left-hand sides have %d attributes at most from now on", limit)
            for c in covers:
                c.trim(limit)
            if limit < 1:
                break

    def sample(wanted: list[tuple[int, int]]) -> None:
        found = engine.sample(wanted, seen)
        fresh = {a: len(masks - seen) for a, (masks, _) in found.items()}
        metrics.samples += len(found)
        metrics.comparisons += sum(pairs for _, pairs in found.values())
        learn(set().union(*[masks for masks, _ in found.values()]))
        for a, d in wanted:
            heapq.heappush(queue, (-fresh[a] / max(1, found[a][1]), -d, a))

    if engine.attributes and covers:
        sample([(a, 1) for a in engine.attributes])
    while True:
        finals.append([c for c in covers if not c.has_waiting()], limit)
        if not any(c.has_waiting() for c in covers):
            break
        candidates: dict[int, list[int]] = {}
        count = 0
        for cover in covers:  # the same left-hand side answers for several right-hand sides
            for lhs in list(cover.waiting):
                if lhs in candidates or len(candidates) < engine.per_job:
                    candidates.setdefault(lhs, []).append(cover.rhs)
                    del cover.waiting[lhs]
                    count += 1
        refuted = engine.refute(candidates)
        metrics.jobs, metrics.candidates, metrics.invalid = metrics.jobs + 1, metrics.candidates + count, metrics.invalid + len(refuted)
        learn({m for _, _, m in refuted})
        valid = (count - len(refuted)) / max(1, count)
        if valid <= config.validation_threshold and queue and -queue[0][0] > 0:
            _, d, a = heapq.heappop(queue)
            sample([(a, 1 - d)])
    metrics.max_lhs_size = limit
    return covers


def cube_fds(df: DataFrame, config: FDConfig) -> DataFrame:
    """X determines A if and only if X has as many groups as X with A: all groups by one cube.

    For few attributes: every row is expanded once for each set of attributes (or, with a largest
    left-hand side of k, for the sets of up to k + 1).
    """
    columns = df.columns
    n = len(columns)
    full = (1 << n) - 1
    if n > 16:
        raise ValueError("the cube strategy is for 16 attributes at most")
    if not df.head(1):
        return result(df.sparkSession, [([], c) for c in columns], config.relation)
    most = n if config.lhs_limit is None else min(n, config.lhs_limit + 1)
    sets = [s for k in range(most + 1) for s in combinations(columns, k)]
    grouped = df.groupingSets([[name(c) for c in s] for s in sets], *[name(c) for c in columns]).agg(F.grouping_id().alias("g"))
    # grouping_id has the first attribute on top and 1 for what is left out.
    mask = F.lit(full).cast("long") - F.col("g")
    cards = cut(grouped.select(mask.alias("mask")).groupBy("mask").agg(F.count("*").alias("card")))
    bit = {c: 1 << n - 1 - i for i, c in enumerate(columns)}
    rhs = F.explode(F.array(*[F.struct(F.lit(b).cast("long").alias("bit"), F.lit(c).alias("rhs")) for c, b in bit.items()])).alias("r")
    x = cards.select("mask", "card", rhs).select("mask", "card", "r.*").where(F.col("mask").bitwiseAND(F.col("bit")) == 0)
    if config.lhs_limit is not None:
        x = x.where(F.bit_count("mask") <= config.lhs_limit)
    y = cards.select(F.col("mask").alias("both"), F.col("card").alias("card_both"))
    valid = cut(x.join(y, (F.col("both") == F.col("mask").bitwiseOR(F.col("bit"))) & (F.col("card") == F.col("card_both"))).select("mask", "rhs"))
    a, b = valid.alias("a"), valid.alias("b")
    smaller = (F.col("a.rhs") == F.col("b.rhs")) & bits.subset(F.col("b.mask"), F.col("a.mask")) & (F.col("a.mask") != F.col("b.mask"))
    minimal = a.join(b, smaller, "left_anti")
    lhs = F.filter(F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(m).cast("long")) != 0, F.lit(c)) for c, m in bit.items()]), lambda v: v.isNotNull())
    return minimal.select(F.lit(config.relation).alias("relation"), lhs.alias("lhs"), "rhs")
