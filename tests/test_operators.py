import os
import random
import time
from itertools import combinations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from depdelver.__main__ import main
from depdelver.functions import bits
from depdelver.operators import agree, codes, cover, partitions, sample
from depdelver.operators.codes import encode, written
from depdelver.operators.cover import Cover, prune_subsets, specialize_all
from depdelver.operators.metrics import worth_caching
from depdelver.session import cut, settle
from depdelver.sources.csv import CsvDescriptor, debug_dump, render_line, render_values, write_text

MASKS = st.integers(0, (1 << 130) - 1)


@given(MASKS, MASKS, st.integers(0, 129), st.integers(0, 129))
def test_bits_are_sets(a, b, i, j):
    x, y = set(bits.members(a)), set(bits.members(b))
    assert bits.of(x) == a and bits.is_subset(a, b) == (x <= y) and bits.get(a, i) == (i in x)
    assert set(bits.members(bits.flip(a, i))) == x ^ {i} and set(bits.members(bits.put(a, i, False))) == x - {i}
    assert set(bits.members(bits.put_range(a, min(i, j), max(i, j)))) == x | set(range(min(i, j), max(i, j)))
    assert bits.next_set(a, i) == min((k for k in x if k >= i), default=-1)
    assert bits.previous_set(a, i) == max((k for k in x if k <= i), default=-1)
    assert bits.next_clear(a, i) == min(k for k in range(i, 200) if k not in x)
    assert bits.previous_clear(a, i) == max((k for k in range(i + 1) if k not in x), default=-1)


@pytest.mark.parametrize("n", [5, 70])
def test_cover_against_definition(n):
    r = random.Random(n)
    attributes = r.sample(range(n), 5)
    rhs, others = attributes[0], attributes[1:]
    cover = Cover(rhs, n, [bits.of([b]) for b in others])
    refuted = []
    for _ in range(12):
        non_fd = bits.of([b for b in others if r.random() < 0.6] + [b for b in range(n) if b not in attributes])
        refuted.append(non_fd)
        cover.specialize(non_fd)
    expected = []
    for m in sorted(range(1, 16), key=int.bit_count):
        lhs = bits.of([others[i] for i in bits.iterate(m)])
        if not any(bits.is_subset(lhs, x) for x in refuted) and not any(bits.is_subset(e, lhs) for e in expected):
            expected.append(lhs)
    assert set(cover) == set(expected)


def test_covers_by_tasks(spark, monkeypatch):
    """Covers specialized by tasks are those specialized one by one."""
    r = random.Random(3)
    sets = [r.randrange(1 << 70) | r.randrange(1 << 70) for _ in range(25)]
    some = lambda: [Cover(a, 70, [1 << b for b in range(0, 70, 9) if b != a], limit=4) for a in (0, 33, 69)]
    one, many = some(), some()
    specialize_all(spark, one, sets)
    many[1].announce(3)
    monkeypatch.setattr(cover, "IN_TASKS", 0)
    specialize_all(spark, many, sets)
    assert [set(c) for c in one] == [set(c) for c in many] and [set(c.waiting) for c in one] == [set(c.waiting) for c in many]
    assert all(c.has_generalization(x) and not c.has_generalization(0) for c in many for x in c)


def test_cover_store():
    cover = Cover(0, 4)
    assert set(cover) == {2, 4, 8} and cover.announce(2) == [2, 4] and cover.has_waiting() and cover.announce(9) == [8] and not cover.has_waiting()
    assert cover.has_generalization(6) and cover.generalizations(6) == [2, 4] and 2 in cover
    cover.remove(2)
    assert 2 not in cover and len(cover) == 2
    cover.add(10)
    cover.trim(1)
    assert set(cover) == {4, 8} and cover.limit == 1
    assert prune_subsets([0b0110, 0b0010, 0b1000, 0b0111], 0) == [0b0110, 0b1000]


def test_csv_options(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes(b'junk\r\na;b;c\r\n 1;"x;y";\r\n2;NULL;z\r\nshort;1\r\nlong;1;2;3\r\n3;"q\\"r";"caf\xe9"\r\n')
    made = CsvDescriptor(name="r", path=str(tmp_path), separator=";", skip_lines=1, charset="ISO-8859-1", null_string="NULL")
    df = made.read(spark)
    assert df.columns == ["a", "b", "c"] and df.count() == 3
    assert {tuple(r) for r in df.collect()} == {("1", "x;y", ""), ("2", None, "z"), ("3", 'q"r', "café")}
    with pytest.raises(ValueError):
        CsvDescriptor(name="r", path=str(tmp_path), separator=";", skip_lines=1, skip_differing_lines=False).read(spark)
    (tmp_path / "s.csv").write_text('a,b\n"1",2\n"x,y","3"\n')
    strict = CsvDescriptor(name="s", path=str(tmp_path), strict_quotes=True).read(spark)
    assert sorted(map(tuple, strict.collect())) == [("1", None), ("x,y", "3")]
    (tmp_path / "e.csv").write_text("")
    assert CsvDescriptor(name="e", path=str(tmp_path)).read(spark).columns == []


def test_text_sink_and_command_line(spark, tmp_path, capsys):
    fds = spark.createDataFrame([(["b", "a"], "c"), ([], "d")], "lhs array<string>, rhs string")
    assert {r[0] for r in fds.select(render_line(["a", "b", "c", "d"])).collect()} == {"[a, b] --> c", "[] --> d"}
    write_text(fds, str(tmp_path / "out"), ["a", "b", "c", "d"])
    assert (tmp_path / "out" / "c.txt").read_bytes() == b"[a, b] --> c\r\n" and (tmp_path / "out" / "d.txt").exists()
    write_text(fds.selectExpr("lhs", "'x/ y' AS rhs").limit(1), str(tmp_path / "out"), ["a", "b", "x/ y"])
    assert (tmp_path / "out" / "x%2F%20y.txt").read_text() == "[a, b] --> x/ y\n"
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,x\n")
    assert main(["--input-name", "t", "--input-path", str(tmp_path)]) == 0
    assert "[] --> b" in capsys.readouterr().out
    assert main(["--input-name", "t", "--input-path", str(tmp_path), "--strategy", "cube"]) == 0
    assert "\n1 dependencies in " in capsys.readouterr().out
    assert main(["--input-name", "t", "--input-path", str(tmp_path), "--output", str(tmp_path / "results")]) == 0
    assert (tmp_path / "results" / "t" / "b.txt").read_text() == "[] --> b\n"


@pytest.mark.parametrize(("size", "files"), [(None, 1), (400, 1), (400, 3), (120, 2)])
def test_csv_with_line_feeds_in_quotes(spark, tmp_path, size, files):
    """Records that go on in other splits of a file, with several splits of several files in a task or one in each."""
    import csv

    r = random.Random(1)
    fields = ["x", "a b", "", "two\nlines", "\n\n", 'say "so"', "a,b\nc", " lead", "three\nlines, with\n'all'", '"', "\n".join("long" * 20 for _ in range(4))]
    rows = [[str(i), *(r.choice(fields) for _ in range(2))] for i in range(60)]
    (tmp_path / "m").mkdir()
    for k in range(files):
        with open(tmp_path / "m" / f"{k}.csv", "w", newline="") as f:
            f.write('to "skip\n' * 2)
            csv.writer(f, lineterminator="\n").writerows([["a", "b\nb\n\n" + "b" * 99, "c"], *rows[k::files]])
    made = CsvDescriptor(name="m", path=str(tmp_path), ending="", escape='"', ignore_leading_whitespace=False, skip_lines=2)
    for open_cost in ("0", "4m"):
        spark.conf.set("spark.sql.files.openCostInBytes", open_cost)
        if size:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            df = made.read(spark)
            assert df.columns == ["a", "b\nb\n\n" + "b" * 99, "c"]
            got = sorted((tuple(x) for x in df.collect()), key=lambda x: int(x[0]))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert got == [tuple(v or None for v in x) for x in rows]


def test_csv_of_many_splits_is_few_tasks(spark, tmp_path):
    """Splits far smaller than a task may be are read many a task; their lines keep their numbers, and the records are whole."""
    rows = [(str(i), f"a\n{i}\nb" if i % 3 else "x") for i in range(900)]
    (tmp_path / "k.csv").write_text('n,t\n' + "".join(f'{n},"{t}"\n' for n, t in rows))
    made = CsvDescriptor(name="k", path=str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        lines = made._lines(spark)
        assert lines.select("start").distinct().count() > 80 and lines.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
        assert lines.select("at").distinct().count() == lines.count()
        assert sorted(map(tuple, made.read(spark).collect())) == sorted(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_quotes(spark, tmp_path):
    (tmp_path / "v.csv").write_text('a,b\n1,"x\ny"\n2,z\n5,in"side\n')
    assert sorted(map(tuple, CsvDescriptor(name="v", path=str(tmp_path)).read(spark).collect())) == [("1", "x\ny"), ("2", "z"), ("5", 'in"side')]
    (tmp_path / "o.csv").write_text('a,b\n1,"x\ny\n2,z\n')
    with pytest.raises(ValueError):
        CsvDescriptor(name="o", path=str(tmp_path)).read(spark)


@pytest.mark.parametrize("charset", ["UTF-16BE", "UTF-16LE"])
def test_csv_of_two_byte_characters(spark, tmp_path, charset):
    (tmp_path / "w.csv").write_bytes("a,b\né,日本\n1,x\n".encode(charset))
    df = CsvDescriptor(name="w", path=str(tmp_path), charset=charset).read(spark)
    assert df.columns == ["a", "b"] and sorted(map(tuple, df.collect())) == [("1", "x"), ("é", "日本")]
    with pytest.raises(ValueError):
        CsvDescriptor(name="w", path=str(tmp_path), charset="utf-16").read(spark)


def test_dump_and_values(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    assert [r[0] for r in df.orderBy("a").select(render_values(["a", "b"])).collect()] == ["[1, null]", "[2, x]"]
    debug_dump(df, str(tmp_path / "dump"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "dump")).collect()) == ['{"a":1}', '{"a":2,"b":"x"}']


def test_zeros_and_worth(spark):
    df = spark.createDataFrame([(0.0, [0.0]), (-0.0, [-0.0]), (1.0, [1.0])], "a double, b array<double>")
    assert {(r["attr"], r["values"]) for r in partitions.distinct_counts(df, ["a", "b"]).collect()} == {("a", 2), ("b", 2)}
    rows = df.withColumn("rid", F.monotonically_increasing_id())
    assert {(r["attr"], r["val"], len(r["positions"])) for r in partitions.clusters(rows, ["a", "b"], "rid").collect()} == {("a", "0.0", 2), ("b", "[0.0]", 2)}
    cases = [(100, 10, 50, 5, True), (0, 0, 0, 0, False), (100, 10, 0, 0, True), (100, 10, 100, 10, False), (100, 10, 98, 10, True), (1000, 500, 998, 500, False)]
    got = spark.createDataFrame(cases, "r long, c long, ra long, ca long, worth boolean").select(worth_caching(F.col("r"), F.col("c"), F.col("ra"), F.col("ca")), "worth").collect()
    assert all(a == b for a, b in got)


def test_settle_deletes_tables_on_the_way(spark):
    made = []

    def make():
        made.append(cut(spark.range(5)))
        return made[0].where("id > 2")

    out = settle(make)
    assert out.count() == 2 and not os.path.exists(made[0]._cut_path.removeprefix("file:")) and os.path.exists(out._cut_path.removeprefix("file:"))


def test_sampling_of_a_hot_value_by_several_tasks(spark):
    """Nine tenths of the rows have one value; all of its pairs are compared, by several tasks, whatever their borders are."""
    r = random.Random(6)
    rows = [(i, 0 if i < 450 else i % 5, r.randrange(4), r.randrange(3), r.choice([None, "x", "y"])) for i in range(500)]
    df = spark.createDataFrame(rows, "rid long, a int, b int, c int, d string")
    order = ["a", "b", "c", "d"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    try:
        for like in (True, False):
            coded = written(encode(df.select(*order, "rid"), like, F.col("rid"), ordered=False, ranked=True))
            plain = coded.rows.drop("c4")
            for d in (1, 2, 90):
                wanted = [(0, d), (2, 1)]
                got = {(x["w"], tuple(x["words"])): x["pairs"] for x in sample.agree_sets(plain, 4, wanted).collect()}
                expected = {}
                for w, (a, far) in enumerate(wanted):
                    for x in agree.sample(df, order[a], order, "rid", far, like).collect():
                        expected[w, tuple(x["words"])] = x["pairs"]
                assert got == expected
            seen = {bits.from_words(words) for (w, words), _ in list(got.items())[::2]}
            again = sample.agree_sets(plain, 4, wanted, seen).collect()
            fresh = {(x["w"], tuple(x["words"])): x["pairs"] for x in again if x["words"] is not None}
            assert fresh == {k: v for k, v in got.items() if bits.from_words(k[1]) not in seen}
            assert sum(x["pairs"] for x in again) == sum(got.values())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 2)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize(("sent", "wide"), [(8 << 20, 24), (0, 24), (8 << 20, 1)])
@pytest.mark.parametrize("like", [True, False])
def test_codes_are_equal_where_values_are(spark, monkeypatch, sent, wide, like):
    monkeypatch.setattr(codes, "SENT", sent)
    monkeypatch.setattr(codes, "WIDE", wide)
    r = random.Random(9)
    nan = float("nan")
    rows = [(i, r.choice([None, 1, 2]), r.choice([None, "", "x", "é"]), r.choice([None, 0.0, -0.0, nan]), r.choice([None, [0.0], [-0.0], [nan], []]), r.choice([None, (1,), (None,)]), 7, i, None) for i in range(60)]
    df = spark.createDataFrame(rows, "rid long, a int, b string, c double, d array<double>, e struct<x:int>, k int, u long, z int")
    plain = lambda v: [plain(x) for x in v] if isinstance(v, (list, tuple)) else "nan" if v != v else v + 0.0 if isinstance(v, float) else v
    for ordered in (True, False):
        e = codes.written(encode(df.drop("rid"), like, None, ordered=ordered, ranked=True))
        assert e.n == 60 and e.attributes[0] == ("u" if ordered else "a") and ("k" in e.attributes) != ordered
        assert e.constants == ((["k", "z"] if like else ["k"]) if ordered else [])
        at = {c: i for i, c in enumerate(e.attributes)}
        got = {x[f"c{at['u']}"]: x for x in e.rows.collect()}  # ranks of u are its values
        for c, i in at.items():
            values = [repr(plain(x[c])) if x[c] is not None else None for x in df.orderBy("rid").collect()]
            mine = [got[k][f"c{i}"] for k in range(60)]
            for x, y in combinations(range(60), 2):
                assert (mine[x] == mine[y]) == (values[x] == values[y] and (like or values[x] is not None))
            assert e.distinct[i] == len(set(mine))
            assert [got[k]["alone"][0] >> i & 1 for k in range(60)] == [int(mine.count(m) == 1) for m in mine]
        matrix = e.matrix()
        assert matrix.min() >= 0 and [len(set(x)) for x in matrix.T.tolist()] == e.distinct


def files_of_shuffles(spark):
    return sum(f.getName().startswith("shuffle_") for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))


def test_own_codes_need_no_shuffle(spark):
    """Whole numbers of many attributes are codes by themselves, equal and in order as their ranks are; no cell is dealt."""
    r = random.Random(4)
    rows = [(i, *(r.choice([None, -7, -3, 0, 5, 1000]) if k % 2 else r.randrange(-4, 9) >> k % 4 for k in range(30)), r.choice("xy")) for i in range(80)]
    df = spark.createDataFrame(rows, "rid long, " + ", ".join(f"w{k} int" for k in range(30)) + ", s string")
    plain, own = (encode(df.drop("rid"), rid=F.monotonically_increasing_id(), ordered=False, ranked=True, own=x) for x in (False, True))
    assert "hashpartitioning" not in own.rows._jdf.queryExecution().executedPlan().toString()
    a, b = ({x["rid"]: x for x in e.rows.collect()} for e in (plain, own))
    for k in range(31):
        pairs = sorted({(a[i][f"c{k}"], b[i][f"c{k}"]) for i in a})
        assert len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs) and [y for _, y in pairs] == sorted(y for _, y in pairs)
        assert 0 <= pairs[0][1] and pairs[-1][1] < 1 << own.widths[k] and own.distinct[k] >= len(pairs)


@pytest.mark.parametrize("like", [True, False])
def test_codes_one_shuffle_at_a_time(spark, monkeypatch, like):
    """Large dictionaries are joined one after the other; the codes are the same, and tables on the way are gone."""
    r = random.Random(5)
    df = spark.createDataFrame([(i, r.choice([None, *range(9)]), r.choice([None, "x", "y", str(i)]), r.random() if i % 3 else 0.5) for i in range(70)], "a long, b int, c string, d double")
    expected = encode(df, like, F.col("a"), ranked=True)
    want = {x["rid"]: (*x,) for x in expected.rows.collect()}
    monkeypatch.setattr(codes, "STEPS", 0)
    monkeypatch.setattr(codes, "SENT", 0)
    e = encode(df, like, F.col("a"), ranked=True)
    made = [x._cut_path for x in e.made]
    assert len(made) > 1 and e.attributes == expected.attributes
    assert {x["rid"]: (*x,) for x in written(e).rows.collect()} == want
    assert not any(os.path.exists(x.removeprefix("file:")) for x in made)


def test_shuffles_go_with_the_table_they_were_for(spark):
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before = files_of_shuffles(spark)
    cut(df)
    for _ in range(50):  # they go beside what runs
        if files_of_shuffles(spark) <= before:
            break
        time.sleep(0.1)
    assert files_of_shuffles(spark) <= before


def test_sampling_by_attributes_and_values(spark, monkeypatch):
    """Sorts of some attributes, or some values of one, find what one sort finds."""
    r = random.Random(8)
    rows = [(i, r.randrange(6), r.randrange(4), r.choice([None, "x", "y"])) for i in range(200)]
    df = spark.createDataFrame(rows, "rid long, a int, b int, c string")
    coded = written(encode(df.drop("rid"), rid=F.monotonically_increasing_id(), ordered=False, ranked=True, own=True))
    wanted = [(0, 1), (1, 3), (2, 1)]
    found = lambda **x: {(y["w"], y["words"] and tuple(y["words"])): y["pairs"] for y in sample.agree_sets(coded.rows, 3, wanted, {0b011}, **x).collect()}
    whole = found()
    for most in (1200, 180):  # two attributes at a time; four slices of the values of one
        monkeypatch.setattr(sample, "SORTED", most)
        assert found(count=200) == whole


def test_maximal_sets(spark):
    r = random.Random(2)
    masks = {r.randrange(1 << 12) & r.randrange(1 << 12) for _ in range(300)} | {0, 1 << 62}
    df = spark.createDataFrame([(m, i % 3) for i, m in enumerate(masks)], "lhs long, rhs int")
    got = {x[0] for x in agree.maximal(df.withColumnRenamed("lhs", "mask")).collect()}
    assert got == {m for m in masks if not any(m != k and m & k == m for k in masks)}
    rows = {tuple(x) for x in df.collect()}
    assert {tuple(x) for x in agree.maximal_by_rhs(df).collect()} == {(m, a) for m, a in rows if not any(b == a and m != k and m & k == m for k, b in rows)}
    assert agree.maximal(df.withColumnRenamed("lhs", "mask").limit(0)).count() == 0
