import numpy as np
import pytest

from depdelver.llm import licenses, topk, url_filter


def best(rows, asked, k, scale=256):
    good = [(i, [np.floor(scale * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    queries = {}
    for i, v in good:
        if i in asked:
            queries.setdefault(i, []).append(v)
    for q in sorted(queries):
        a = min(queries[q])
        scored = sorted((-int(sum(x * y for x, y in zip(a, b, strict=False))), i) for i, b in good if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


def test_topk_edges(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.integers(-2, 3, 4) / 2]) for i in range(60)]  # many ties
    rows += [(i, [1.0, 0.5, -0.5, 0.25]) for i in range(100, 160)] + [(100, [1.0, 0.5, -0.5, 0.25])]
    rows += [(None, [1.0] * 4), (200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan")] * 4), (203, [float("inf")] * 4), (204, []), (205, [9.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(5)
    asked = [0, 1, 50, 100, 200, 204, 205]
    got = topk.top_k(df, df.where(df.vec_id.isin(asked)), 5)
    assert sorted(tuple(x) for x in got.select("query_id", "rank", "vec_id", "score").collect()) == best(rows, asked, 5)


def test_topk_waves_and_few(spark, monkeypatch):
    monkeypatch.setattr(topk, "WAVE_ROWS", 7)
    rows = [(i, [float(i % 7), float(i % 3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df, df, 45).select("query_id", "rank", "vec_id", "score")
    assert sorted(map(tuple, got.collect())) == best(rows, range(40), 45)
    none = spark.createDataFrame([], df.schema)
    assert topk.top_k(none, none).count() == 0 and topk.top_k(df, none).count() == 0 and topk.top_k(none, df).count() == 0


def test_topk_large_values(spark):
    rows = [(i, [float(2.0**30 * (i % 5)), 3.0 * i, 1.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id < 3"), 4).select("query_id", "rank", "vec_id", "score")
    cap = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    scores = {(q, i): cap(sum(int(256 * x) * int(256 * y) for x, y in zip(rows[q][1], v, strict=True))) for q in range(3) for i, v in rows if i != q}
    assert {(r[0], r[2]): r[3] for r in got.collect()}.items() <= scores.items()


URLS = [
    None, "", "no scheme", "http://", "http://com/en/", "HTTP://WWW.Example.COM/en/7x?a", "https://example.com/en/8", "http://xcom/en/1", "http://a.net/de/8", "http://b.example.net/de/81#f",
    "http://org/es/", "http://org?/es/", "http://a.org/es", "x://y://z/en/", "http://q.com/EN/", "http://u.com/a?utm_source=1", "http://u.com/a", "http://u.com/a#ref=1", "a\nb://n.org/es/\nk?ref=2",
]


def verdicts(urls):
    import re

    parts = []
    for u in urls:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
        parts.append((host, path, bool(re.search(r"[?&](utm_[a-z]+|ref)=", u or ""))))
    listed = {h + p for h, p, mark in parts if mark}
    out = []
    for h, p, _ in parts:
        fits = [(len(rh + rp), rh + rp, kind) for kind, rh, rp in url_filter.RULES if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        rule = max(fits, default=None)
        out.append((h, p, rule and rule[1], rule[2] if rule else "block" if h + p in listed else "allow"))
    return out


@pytest.mark.parametrize("bits", [1 << 23, 64])
def test_url_filter(spark, monkeypatch, bits):
    monkeypatch.setattr(url_filter, "MAX_BITS", bits)  # so that keys are dealt into several chunks
    urls = URLS + [f"http://h{i}.net/p{'?ref=1' if i % 3 == 0 else ''}" for i in range(40 if bits == 64 else 400)]
    df = spark.createDataFrame([(i, u, "k", True) for i, u in enumerate(urls)], "page_id long, url string, key string, listed boolean")
    got = url_filter.filter_urls(df).orderBy("page_id").select("host", "path", "rule", "verdict").collect()
    assert [tuple(r) for r in got] == verdicts(urls)


def test_url_filter_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.filter_urls(df).count() == 0


def brute_licenses(rows):
    import re

    table = licenses._table(licenses.TEMPLATES)
    out = set()
    for i, t in rows:
        if t is None:
            continue
        units = {t, *t.split("\n"), *(s for line in t.split("\n") for s in re.split(licenses.SENTENCE, line))}
        lines = [w for line in t.split("\n") if (w := licenses.normal_words(line))]
        for _, _, g in table:  # pieces of a template, one other line between two of them at most
            good = [k for k, w in enumerate(lines) if 2 * len(licenses.bigrams(w) & set(g)) >= len(licenses.bigrams(w))]
            runs = []
            for k in good:
                if runs and k - runs[-1][-1] <= 2:
                    runs[-1].append(k)
                else:
                    runs.append([k])
            units |= {" ".join(x for k in run for x in lines[k]) for run in runs if len(run) > 1}
        for u in units:
            w = licenses.normal_words(u)
            b = licenses.bigrams(w)
            scored = [(200 * len(b & set(g)) / (len(b) + len(g)), -k, name, number, len(b & set(g)), len(b), len(g)) for k, (name, number, g) in enumerate(table)] if b else []
            if scored and max(scored)[0] >= licenses.PERCENT:
                out.add((i, *max(scored)[2:], " ".join(w)))
    return out


def test_wrapped_licenses(spark, tmp_path):
    import textwrap

    fill = lambda text, mark: "\n".join(mark + x for line in text.split("\n") for x in [*textwrap.wrap(line, 76), ""])
    code = "\n".join(f"def f{k}(x): return x + {k}  # adds some number to another one" for k in range(60))
    rows = []
    for k, (_, text) in enumerate(licenses.TEMPLATES):
        if len(text) > 400:
            rows += [(k, code + "\n" + fill(text, mark) + "\n" + code) for mark in ("", " * ", "# ")]
    mit = fill(licenses.TEMPLATES[4][1], "").split("\n")
    rows += [(100, "\n".join([code, *mit[:4], "a line that someone put between the others", *mit[4:], code])), (101, code)]
    rows += [(102, fill(licenses.TEMPLATES[4][1], "") + fill(licenses.TEMPLATES[7][1], "")), (None, code + "\n" + fill(licenses.TEMPLATES[7][1], "// "))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {tuple(r) for r in licenses.scan(df).collect()}
    assert got == brute_licenses(rows)
    names = {(r[0], r[1]) for r in got if r[4] >= 40}  # of whole notices
    assert names >= {(k, licenses.TEMPLATES[k][0]) for k, _ in rows if k is not None and k < 100} | {(100, "MIT"), (102, "MIT"), (102, "Apache-2.0"), (None, "Apache-2.0")}
    assert not any(r[0] == 101 for r in got)

    words = " ".join(f"term{k % 301} clause{k % 299}" for k in range(3000))
    (tmp_path / "Own-1.0").write_text(textwrap.fill(words, 70))
    own = licenses.full_texts(str(tmp_path))
    texts = spark.createDataFrame([(1, code + "\n" + textwrap.fill(words, 60)), (2, code)], "doc_id long, text string")
    found = licenses.scan(texts, templates=own).collect()
    assert {(r["doc_id"], r["license"], r["shared"] == r["template_size"]) for r in found} == {(1, "Own-1.0", True)} and any(r["size"] == r["template_size"] for r in found)


def test_licenses(spark, table, empty):
    mit = licenses.TEMPLATES[4][1]
    rows = [(100, mit), (101, "Some code\n\n" + mit.replace("Software", "Program", 2)), (102, "licensed under the apache license version 2.0"), (103, "License"), (104, mit.upper() + "\nALL RIGHTS RESERVED")]
    extra = spark.createDataFrame(rows, "doc_id long, text string")
    df = table.select("doc_id", "text").unionByName(extra).selectExpr("*", "1 AS k", "'x' AS license")
    expected = brute_licenses([(r[0], r[1]) for r in df.collect()])
    got = [tuple(r) for r in licenses.scan(df).collect()]
    assert set(got) == expected and len(got) == len(set(got)) and len(expected) >= 8
    assert licenses.scan(empty).count() == 0
