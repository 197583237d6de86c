import llm_brute as brute
import pytest

import corpus_pipeline
from depdelver.llm import language, registry
from depdelver.session import cut

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", registry.SQL)
def test_query_equals_sql(spark, sql, name):
    df = registry.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(map(str, got)) == sorted(map(str, sql.sql(f"SELECT {', '.join(columns)} FROM ({registry.SQL[name]})").fetchall()))


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.SQL])
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() > 0


@pytest.mark.parametrize("edge", [False, True])
def test_stages_against_brute_force(spark, table, edge):
    docs = table if edge else spark.read.parquet(f"{DIR}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)

    one = cut(stages["language"](spark, docs, DIR))
    kept = language.of_documents(docs, docs).where("keep").select("row.*")
    assert one.columns == docs.columns and rows(one) == rows(kept)
    if not edge:
        assert one.count() == docs.count()

    two = cut(stages["line_dedup"](spark, one, DIR))
    before = rows(one)
    assert two.columns == docs.columns and rows(two) == sorted(((i, t) for (i, _), t in zip(before, brute.dedup_lines(before), strict=True)), key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in two.collect() if r["text"].isascii())

    three = cut(stages["near_duplicates"](spark, two, DIR))
    before = sorted(rows(two), key=lambda r: (r[0] is None, r[0] or 0))
    found = brute.components([brute.shingles(t) for _, t in before])
    assert three.columns == docs.columns and len(rows(three)) == len({i for i, c in enumerate(found) if c == i})
    assert sorted((r[0] for r in rows(three)), key=str) == sorted((before[i][0] for i, c in enumerate(found) if c == i), key=str)

    four = cut(stages["decontamination"](spark, three, DIR))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    before = rows(three)
    clean = [r for r, (n, h, _) in zip(before, brute.contamination([t for _, t in before], items), strict=True) if not (h and 20 * h >= n)]
    assert four.columns == docs.columns and rows(four) == clean

    five = stages["mixing"](spark, four, DIR).collect()
    sizes = {}
    for r in four.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.words(r["text"]))
    goal = brute.targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in five:
        taken[r["source"]] += r["taken"]
        assert abs(r["target"] - goal[r["source"]]) < 1e-6
    assert len(five) == four.count() and all(abs(taken[s] - goal[s]) < 1 for s in sizes)


def test_run(spark):
    assert corpus_pipeline.run(spark, DIR).count() > 100
