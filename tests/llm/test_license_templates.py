import random

from depdelver.llm import licenses


def test_templates_sent_and_shuffled_are_found_alike(spark, edges, sample, monkeypatch):
    """Large templates beside the usual ones, and the way beyond BROADCAST_BYTES, give the same rows."""
    r = random.Random(1)
    words = [f"w{i}" for i in range(900)] + ["of", "the", "and"] * 60
    large = [(f"L{i}", " ".join(r.choice(words) for _ in range(1500))) for i in range(3)]
    notice = large[1][1].split()
    wrapped = "\n".join("# " + " ".join(notice[i : i + 9]) for i in range(0, len(notice), 9))
    more = sample.sparkSession.createDataFrame([(90_001, "prose before\n" + wrapped + "\nprose after", "en", "z", 1)], sample.schema)
    docs = sample.unionByName(edges).unionByName(more)
    rows = lambda t: sorted(map(str, licenses.scan(docs, templates=t).collect()))
    usual, both = rows(licenses.TEMPLATES), rows([*licenses.TEMPLATES, *large])
    assert set(usual) <= set(both) and [x for x in both if x not in usual] and all("doc_id=90001" in x for x in both if x not in usual)
    monkeypatch.setattr(licenses, "BROADCAST_BYTES", 0)
    assert rows([*licenses.TEMPLATES, *large]) == both


def test_bitmaps_lose_nothing(spark):
    terms = {f"{a} {b}" for a in range(60) for b in range(60)}
    df = spark.createDataFrame([(t,) for t in terms] + [(f"x{i}",) for i in range(5000)], "t string")
    kept = {x["t"] for x in df.where(licenses.maybe(licenses.bitmap(terms), df["t"])).collect()}
    assert terms <= kept and len(kept) < len(terms) + 100
