import random
from pathlib import Path

import pytest
from brute import brute_fds
from fixtures import FIXTURES, bridges, relation

from depdelver.config import FDConfig
from depdelver.functions import bits
from depdelver.operators import prefixes, sample, validate
from depdelver.operators.codes import encode, written
from depdelver.operators.prefixes import PrefixTables
from depdelver.operators.validate import by_groups, violations
from depdelver.plans import discover
from depdelver.plans.discover import Broadcast, Groups, Metrics, discover_fds
from depdelver.sources.csv import CsvDescriptor

DATA = Path(__file__).parent / "data"


def frame(spark, columns, rows):
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))


def found(df, **options):
    rows = [(frozenset(r["lhs"]), r["rhs"]) for r in discover_fds(df, **options).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("key", FIXTURES)
def test_fixtures(spark, key):
    columns, rows, expected = relation(key)
    assert found(frame(spark, columns, rows), strategy="broadcast") == expected


@pytest.mark.parametrize("key", ["1", "12", "17", "20"])
@pytest.mark.parametrize("strategy", ["group", "cube"])
def test_fixtures_by_other_strategies(spark, key, strategy):
    columns, rows, expected = relation(key)
    assert found(frame(spark, columns, rows), strategy=strategy) == expected


def test_bridges(spark):
    df = CsvDescriptor(name="bridges", path=str(DATA), header=False).read(spark)
    assert df.columns == [f"column{i}" for i in range(1, 14)] and df.count() == 108
    assert found(df) == bridges()
    assert found(df, max_lhs_size=2) == {x for x in bridges() if len(x[0]) <= 2}


def table(seed):
    r = random.Random(seed)
    n, m = r.choice([0, 1, 2, 3, 7, 20]), r.randint(2, 5)
    values = [None, "", "a", "b", "1", "1.0"][: r.randint(2, 6)]
    return [f"c{i}" for i in range(m)], [tuple(r.choice(values) for _ in range(m)) for _ in range(n)]


@pytest.mark.parametrize("seed", range(10))
def test_random_tables(spark, seed):
    columns, rows = table(seed)
    df = frame(spark, columns, rows)
    for like in (True, False):
        assert found(df, strategy="broadcast", null_equals_null=like) == brute_fds(columns, rows, like)


@pytest.mark.parametrize("seed", range(20, 23))
def test_random_tables_by_groups(spark, seed):
    columns, rows = table(seed)
    df = frame(spark, columns, rows)
    for like in (True, False):
        assert found(df, strategy="group", null_equals_null=like, max_lhs_size=2) == brute_fds(columns, rows, like, 2)


@pytest.mark.parametrize("seed", range(30, 33))
def test_groups_by_rows_of_prefixes(spark, seed, monkeypatch):
    """The rows of clusters of prefixes give what all rows give; one value has most of the rows."""
    monkeypatch.setattr(Groups, "STRIP", 0)
    monkeypatch.setattr(Groups, "ALIKE", 1)
    monkeypatch.setattr(Groups, "STAGES", 0)
    r = random.Random(seed)
    columns = ["a", "b", "c", "d"]
    rows = [(str(i // 2) if i < 24 else str(i), "x" if r.random() < 0.9 else str(i), r.choice(["p", "q", None]), str(i % 7)) for i in range(40)]
    for like in (True, False):
        for budget in (1 << 30, 0):  # with none, every table is given up again
            assert found(frame(spark, columns, rows), strategy="group", null_equals_null=like, pli_cache_table_bytes=budget) == brute_fds(columns, rows, like)


def test_jobs_of_bounded_rows(monkeypatch):
    """Sets are grouped so many at once that the rows of an exchange are bounded, and one that is larger by shares of its clusters."""
    monkeypatch.setattr(validate, "GROUPED", 1000)
    sizes = {0: 300, 1: 5000, 2: 900, 3: 0, 4: 700}
    met = [(s, k) for some, part in validate._jobs(sizes, range(1, 16)) for s in some for k in part]
    assert sorted(met) == [(s, k) for s in sizes for k in range(1, 16)]
    assert all(sum(sizes[s] for s in some) * len(part) / 16 <= 1000 for some, part in validate._jobs(sizes, range(1, 16)))


@pytest.mark.parametrize("seed", range(40, 42))
def test_groups_in_bounded_jobs(spark, seed, monkeypatch):
    """Exchanges, sorts and prefix tables of few rows at once give what all rows at once give."""
    for x in (validate, prefixes):
        monkeypatch.setattr(x, "GROUPED", 60)
    monkeypatch.setattr(sample, "SORTED", 120)
    for k, v in (("STRIP", 0), ("ALIKE", 1), ("STAGES", 0)):
        monkeypatch.setattr(Groups, k, v)
    r = random.Random(seed)
    rows = [(i // 2, r.choice("xy"), r.choice(["p", "q", None]), i % 7 - 3) for i in range(40)]
    df = spark.createDataFrame(rows, "a long, b string, c string, d int")
    assert found(df, strategy="group") == brute_fds(df.columns, rows)


@pytest.mark.parametrize("strategy", ["auto", "group"])
def test_pairs_of_lineitem_in_bounded_exchanges(spark, monkeypatch, strategy):
    """No exchange has more rows than it may, and all left-hand sides of two attributes are validated."""
    monkeypatch.setattr(discover, "BROADCAST_BYTES", 1000)
    monkeypatch.setattr(validate, "GROUPED", 13_000)
    rows = lineitem(spark)
    asked, plain = [], validate.violations
    monkeypatch.setattr(validate, "violations", lambda tables, *x: (asked.append(sum(len(sets) for _, sets in tables)), plain(tables, *x))[1])
    metrics = Metrics()
    got = found(rows, strategy=strategy, max_lhs_size=2, metrics=metrics)
    assert metrics.strategy == "Groups" and len(asked) > metrics.jobs and max(asked) * rows.count() <= 13_000
    monkeypatch.setattr(discover, "BROADCAST_BYTES", 1 << 30)
    assert got == found(rows, strategy="broadcast", max_lhs_size=2)


def test_packed_codes_refute_alike(spark):
    """Codes side by side in words tell what codes by themselves tell."""
    coded = written(encode(lineitem(spark), own=True))
    n = len(coded.attributes)
    asked = {1 << i | 1 << j: [a for a in range(n) if a not in (i, j)] for i in range(0, n, 2) for j in range(i + 1, n, 3)}
    assert max(x for x, _, _ in validate.Layout.of(n, coded.widths).places) <= 2
    one, packed = (by_groups(coded.rows, asked, n, widths=x) for x in (None, coded.widths))
    assert sorted(one) == sorted(packed) and one


def test_broadcast_checks_the_size(spark):
    with pytest.raises(ValueError):
        discover_fds(frame(spark, ["a", "b"], [("x" * 50, "y")] * 5), strategy="broadcast", broadcast_bytes=100)


def test_broadcast_of_a_large_relation_is_grouped(spark, monkeypatch):
    """Beyond what may be broadcast, unless the caller named that bound, the whole job is done by groups."""
    monkeypatch.setattr(discover, "BROADCAST_BYTES", 100)
    columns, rows = ["a", "b", "c"], [(str(i // 2), "xy"[i % 2], str(i % 5)) for i in range(30)]
    metrics = Metrics()
    assert found(frame(spark, columns, rows), strategy="broadcast", metrics=metrics) == brute_fds(columns, rows)
    assert metrics.strategy == "Groups"


def test_typed_broadcast_of_a_large_relation(spark, monkeypatch):
    """Structs and arrays that are too large to be broadcast are grouped by what they are."""
    monkeypatch.setattr(discover, "BROADCAST_BYTES", 100)
    rows = [(i, (i % 5,), [-0.0 if i % 3 else 0.0], "xy"[i % 2]) for i in range(30)]
    df = spark.createDataFrame(rows, "k int, t struct<x:int>, v array<double>, s string")
    texts = [(k, t[0], "0.0", s) for k, t, _, s in rows]
    assert found(df, strategy="broadcast") == brute_fds(df.columns, texts)


def test_results_of_a_large_relation(spark, tmp_path, monkeypatch):
    """Right-hand sides are appended to the results where broadcast rows are too large, and taken from there again."""
    monkeypatch.setattr(discover, "BROADCAST_BYTES", 100)
    columns, rows = ["a", "b", "c"], [(str(i // 2), "xy"[i % 2], str(i % 5)) for i in range(30)]
    options, again = {"strategy": "broadcast", "results": str(tmp_path / "results")}, Metrics()
    expected = brute_fds(columns, rows)
    assert found(frame(spark, columns, rows), **options) == expected == found(frame(spark, columns, rows), metrics=again, **options)
    kept = spark.read.parquet(options["results"]).where("lhs IS NOT NULL").collect()
    assert {(frozenset(r["lhs"]), r["rhs"]) for r in kept} == expected and len(kept) == len(expected) and again.resumed == 3


def test_edges(spark):
    assert found(frame(spark, ["A", "B"], [("1", None)])) == {(frozenset(), "A"), (frozenset(), "B")}
    assert found(frame(spark, ["A"], [("1",), ("1",)])) == set()
    nulls = frame(spark, ["A", "B"], [(None, "1"), (None, "2")])
    assert found(nulls) == {(frozenset(), "A")}
    # Nulls unlike each other: A is a key, and B is one.
    assert found(nulls, null_equals_null=False) == {(frozenset("A"), "B"), (frozenset("B"), "A")}


def test_types(spark):
    df = spark.createDataFrame([([1.0, 2.0], -0.0, "x"), ([1.0, 2.0], 0.0, "x"), ([2.0], float("nan"), "y"), (None, float("nan"), "z")], "a array<double>, b double, c string")
    expected = {(frozenset("a"), "b"), (frozenset("a"), "c"), (frozenset("c"), "a"), (frozenset("c"), "b")}
    assert found(df, strategy="broadcast") == expected == found(df, strategy="group")
    for wrong in ("map(1, 2)", "make_interval(1)"):
        with pytest.raises(TypeError):
            discover_fds(spark.sql(f"SELECT {wrong} AS m, 1 AS x"))
    # Structs and arrays are compared by their values, not by a text of them.
    tight = spark.sql("SELECT named_struct('t', timestamp_micros(a)) AS a, b, c FROM VALUES (100L, 1, array(0.0D)), (200L, 2, array(-0.0D)), (100L, 1, array(1.0D)) AS t(a, b, c)")
    same = {(frozenset("a"), "b"), (frozenset("b"), "a")}
    assert found(tight, strategy="broadcast") == same == found(tight, strategy="group")


def test_wide_relation(spark):
    columns = [f"c{i}" for i in range(70)]
    rows = [tuple(str((r * (i + 3)) % (2 + i % 5)) if i < 66 else str(r // (i - 64)) for i in range(70)) for r in range(12)]
    df = frame(spark, columns, rows)
    expected = brute_fds(columns, rows, limit=1)
    assert found(df, strategy="broadcast", max_lhs_size=1) == expected
    few = df.select("c0", *[f"c{i}" for i in range(64, 70)])
    assert found(few, max_lhs_size=1) == {x for x in expected if x[0] <= set(few.columns) and x[1] in few.columns}
    # One aggregation, with agree sets of two words: what it refutes is what rows refute.
    asked = {1 << 3: [0, 68, 69], 1 << 69 | 1 << 1: [2, 65], 0: [5]}
    coded = written(encode(df, ordered=False)).rows
    for lhs, rhs, seen in by_groups(coded, asked, 70):
        assert bits.is_subset(lhs, seen) and not bits.get(seen, rhs)
        assert any(all(r[i] == s[i] for i in bits.members(seen)) and r[rhs] != s[rhs] for r in rows for s in rows)
    bad, staged = ({(lhs, a) for lhs, a, _ in by_groups(coded, asked, 70, stages=x)} for x in (False, True))
    at = lambda r, m: [r[i] for i in bits.members(m)]
    assert bad == staged == {(m, a) for m, xs in asked.items() for a in xs if any(at(r, m) == at(s, m) and r[a] != s[a] for r in rows for s in rows)}


def test_options(spark):
    columns, rows, expected = relation("10")
    df = frame(spark, columns, rows)
    metrics = Metrics()
    discover_fds(df, metrics=metrics)
    assert metrics.fds == len(expected) and metrics.rows == 7 and metrics.candidates >= len(expected)
    assert found(df, max_candidates=20) < expected
    assert found(df, row_limit=1) == {(frozenset(), c) for c in columns}
    with pytest.raises(TypeError):
        FDConfig(unknown=1)
    with pytest.raises(ValueError):
        FDConfig(strategy="none")


def test_every_dependency_is_minimal(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    rows = [tuple(r) for r in df.collect()]
    at = {c: i for i, c in enumerate(df.columns)}

    def holds(lhs, a):
        seen = {}
        return all(seen.setdefault(tuple(r[at[x]] for x in lhs), r[at[a]]) == r[at[a]] for r in rows)

    out = found(df, max_lhs_size=3)
    assert out
    for lhs, a in out:
        assert holds(lhs, a)
        assert not any(holds(lhs - {x}, a) for x in lhs)


def lineitem(spark):
    return spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")


def test_many_left_hand_sides_are_one_scan_and_one_exchange(spark):
    rows = written(encode(lineitem(spark), ordered=False)).rows
    sets = [(s, [i, (i + j) % 11]) for s, (i, j) in enumerate((i, j) for i in range(10) for j in (1, 2, 3))]
    plan = violations([(rows, sets)], {s: [(m[1] + 1) % 11] for s, m in sets}, 11)._jdf.queryExecution().executedPlan().toString()
    assert len(sets) == 30 and plan.count("FileScan parquet") == 1
    assert plan.count("Exchange hashpartitioning(s") == 2  # by set and cluster; and, a row a set and task, by set


def test_prefix_tables_hold_their_budget(spark):
    coded = written(encode(lineitem(spark)))
    kept = PrefixTables(coded.rows, len(coded.attributes), coded.n, 1 << 40)
    at = {c: i for i, c in enumerate(coded.attributes)}
    wanted = [tuple(sorted((at["l_partkey"], at[c]))) for c in ("l_quantity", "l_shipdate", "l_suppkey", "l_discount")]
    kept.make(wanted)
    rows = lineitem(spark).toPandas()
    for p in wanted:
        names = [coded.attributes[i] for i in p]
        inside = rows.groupby(names)[names[0]].transform("size") > 1
        t = kept.tables[p]
        assert t.records == int(inside.sum()) and t.clusters == len(rows[inside][names].drop_duplicates())
        if t.rows is not None:
            assert t.rows.count() == t.records and t.bytes > 0
    made = [p for p in wanted if kept.tables[p].rows is not None]
    assert len(made) >= 2
    for _ in range(3):
        kept.read(made[-1], 2)
    kept.budget = kept.tables[made[-1]].bytes  # room for the one that is read
    kept.evict()
    assert [p for p in made if kept.tables[p].rows is not None] == made[-1:] and kept.black == set(made[:-1])
    kept.make(made)
    assert kept.held(made[0]) == () and kept.tables[made[0]].records  # it is not made again, but what it told is known
    kept.close()


def test_sampling_counts_pairs(spark):
    metrics = Metrics()
    discover_fds(lineitem(spark).select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag"), strategy="group", metrics=metrics)
    one = Metrics()
    discover_fds(lineitem(spark).select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag"), strategy="broadcast", metrics=one)
    assert metrics.comparisons and one.comparisons and metrics.fds == one.fds


@pytest.mark.parametrize("strategy", ["broadcast", "group"])
def test_a_run_that_stops_goes_on(spark, tmp_path, monkeypatch, strategy):
    """Right-hand sides that were final when a run stopped are taken from its results, and are not validated again."""
    r = random.Random(3)
    columns, rows = ["a", "b", "c", "d", "e"], [(str(i // 2), r.choice("xy"), r.choice("pqrs"), str(i % 7), str(i % 5)) for i in range(60)]
    df = frame(spark, columns, rows)
    expected = brute_fds(columns, rows)
    engine = {"broadcast": Broadcast, "group": Groups}[strategy]
    refute, calls = engine.refute, []

    def stops(self, candidates):
        calls.append(candidates)
        if len(calls) > 1:
            raise KeyboardInterrupt
        return refute(self, candidates)

    options = {"strategy": strategy, "results": str(tmp_path / "results"), "candidates_per_job": 3, "sets_per_job": 3}
    monkeypatch.setattr(engine, "refute", stops)
    for _ in range(30):
        calls.clear()
        try:
            found(df, **options)
            break
        except KeyboardInterrupt:
            pass
        if (tmp_path / "results").exists():
            break
    monkeypatch.setattr(engine, "refute", refute)
    metrics = Metrics()
    assert found(df, metrics=metrics, **options) == expected
    again = Metrics()
    assert found(df, metrics=again, **options) == expected and again.candidates == 0 and again.resumed == 5
    other = Metrics()
    assert found(df, metrics=other, max_lhs_size=1, **options) == {x for x in expected if len(x[0]) <= 1} and other.resumed == 0


def test_guardian_by_bytes(spark):
    """Beyond the bytes, the largest left-hand sides go; what is left is the result up to the limit that is reported."""
    columns, rows, expected = relation("10")
    df = frame(spark, columns, rows)
    free, bound = Metrics(), Metrics()
    assert found(df, metrics=free, max_bytes=1 << 40) == expected and free.max_lhs_size is None
    few = found(df, metrics=bound, max_bytes=free.most_bytes * 2 // 3)
    assert bound.max_lhs_size is not None and few == {x for x in expected if len(x[0]) <= bound.max_lhs_size} and few != expected
