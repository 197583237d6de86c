import math
from collections import Counter

import llm_brute as brute
import pytest
from pyspark.sql import functions as F

from depdelver.llm import components, decontamination, jaccard_join, language, line_dedup, lm_score, mixing, ngram_counts, substring_dedup
from depdelver.session import cut


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def key(r):
    return str(r)


def clashing(df, *names):
    """The table with columns named like an operator's own, and one with a dot and one with a backtick."""
    return df.withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for n in (*names, "a.b", "c`d")})


def assert_same_rows(out, df, but=()):
    """All columns of ``out`` are those of ``df``, and its rows are there as they are, except for ``but``."""
    names = [c for c in df.columns if c not in but]
    assert out.columns == df.columns
    q = [F.col("`" + c.replace("`", "``") + "`") for c in names]
    left = Counter(map(str, df.select(*q).collect()))
    assert not Counter(map(str, out.select(*q).collect())) - left


# -- Line dedup --------------------------------------------------------------------------------


def test_line_dedup(table, empty):
    rows = rows_of(table)
    df = clashing(table, "key", "gone", "l", "row", "w", "first", "h1", "n", "__key", "__gone")
    assert_same_rows(line_dedup.dedup_lines(df), df, but=("text",))
    got = line_dedup.dedup_lines(df, report=True)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    assert sorted(rows_of(got), key=key) == sorted(((i, t) for (i, _), t in zip(rows, brute.dedup_lines(rows), strict=True)), key=key)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_keeps_first_of_overlapping(spark):
    df = spark.createDataFrame([(1, "a\na\na\na\na"), (2, "x\n \n\t\n \ny"), (3, "x\n \n\t\n \nz"), (4, "p\nq\nr"), (5, " p\nq \nr\ns")], "doc_id long, text string")
    rows = rows_of(df)
    got = dict(rows_of(line_dedup.dedup_lines(df)))
    assert got == {i: t for (i, _), t in zip(rows, brute.dedup_lines(rows), strict=True)}
    assert got[1] == "a\na\na" and got[4] == "p\nq\nr" and got[5] == "s"


def test_line_dedup_of_a_long_text(spark):
    """Time grows with the lines: a text of 200,000 of them, with a third repeated."""
    import time

    lines = [f"line {i}" for i in range(150_000)]
    text = "\n".join(lines + lines[:50_000])
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    began = time.monotonic()
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df, report=True).collect()}
    assert got[1]["n_lines"] == 200_000 and got[1]["n_removed"] == 50_000 and got[1]["text"] == "\n".join(lines) and got[2]["text"] == "short"
    assert time.monotonic() - began < 60


# -- Jaccard join ------------------------------------------------------------------------------


def expected_components(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sets = [brute.shingles(t) for _, t in rows]
    return sorted(((i, len(s), rows[c][0]) for (i, _), s, c in zip(rows, sets, brute.components(sets), strict=True)), key=key)


def near_copies(spark, n=120):
    import random

    r = random.Random(3)
    base = [f"w{r.randrange(400)}" for _ in range(90)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(i % 4):
            w[r.randrange(90)] = f"new{r.randrange(9999)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"u{r.randrange(300)}" for _ in range(r.randrange(1, 30))) + " " + " ".join(base[:20])) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("docs", [1024, 16])
def test_jaccard(spark, table, monkeypatch, docs):
    monkeypatch.setattr(jaccard_join, "DOCS", docs)  # small: groups are cut into blocks
    df = table.select("doc_id", "text").unionByName(near_copies(spark)).withColumn("n", F.lit("clash"))
    got = jaccard_join.jaccard_components(df)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()), key=key) == expected_components(rows_of(df))


def chains(n, pieces=8, words=40):
    """Documents of pieces that each are in one other document, and pairs that link among them: one large group."""
    import random

    r = random.Random(5)
    own = {}
    rows = []
    for i in range(n):
        parts = [own.setdefault((j, min(i, (i - 2**j) % n)), " ".join(f"c{r.randrange(10**7)}" for _ in range(words))) if (i // 2**j) % 2 else own.setdefault((j, i), " ".join(f"c{r.randrange(10**7)}" for _ in range(words))) for j in range(pieces)]
        rows.append((i, " ".join(parts)))
    return rows + [(n + i, rows[7 * i][1] + " a few more words") for i in range(n // 50)]


def test_jaccard_of_chains(spark, monkeypatch):
    """Groups of documents that share rare shingles but do not link are searched by the lists of these."""
    monkeypatch.setattr(jaccard_join, "DOCS", 16)
    df = spark.createDataFrame(chains(400), "doc_id long, text string").coalesce(2)
    searched = []
    plain = jaccard_join._search_tasks

    def counted(reps, tasks, percent):
        searched.append(tasks.distinct().count())
        return plain(reps, tasks, percent)

    monkeypatch.setattr(jaccard_join, "_search_tasks", counted)
    got = jaccard_join.jaccard_components(df)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()), key=key) == expected_components(rows_of(df))
    assert len(searched) == 2 and sum(searched) < 10 * 408  # blocks against blocks would be 50 * 408


def test_jaccard_boundary_and_empty(spark, empty):
    # Sets of 7 and 8 shingles that share 6 or 7: 6 of 9 is not enough, 75 of 100 is.
    w = [f"t{i}" for i in range(200)]
    df = spark.createDataFrame([(1, " ".join(w[:104])), (2, " ".join(w[:79])), (3, " ".join(w[:78])), (4, " ".join(w[100:150])), (5, "a b c"), (6, "A B C"), (7, "a b")], "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect())
    assert got == expected_components(rows_of(df)) and got[1][2] == 1
    assert jaccard_join.jaccard_components(empty).count() == 0 and jaccard_join.one_of_each(empty).columns == empty.columns


def test_one_of_each(table):
    df = clashing(table, "row", "number", "first_row", "n_shingles", "component_id", "rid", "tokens", "__row")
    kept = jaccard_join.one_of_each(df)
    assert_same_rows(kept, df)
    ids = [r[0] for r in rows_of(kept)]
    # 1 stands for 2, 3 and the longer one without id; 9 for 10; 12 is there once, with 11 in its component.
    assert Counter(ids)[1] == 1 and not {2, 3, 10} & set(ids) and Counter(ids)[12] <= 1 and {4, 5, 6, 7, 9, 14} <= set(ids) and 8 not in ids


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100 + i, 100) for i in range(1, 40)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["comp"] for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- Decontamination ---------------------------------------------------------------------------


@pytest.mark.parametrize("size", [1 << 24, 40])
def test_decontamination(spark, table, size):
    """By an index that is sent, and by joins."""
    items = [(1, " ".join(f"Line {i} of a text that has some words" for i in range(2, 5))), (2, "seven WIZARDS, mix!"), (3, None), (4, ""), (None, "lazy dog"), (5, "one"), (5, "the old tower"), (60, "word1 über1 word2 über2 word3 über3 word4 über4 word5 über5 word6 über6 word7 über7 word8")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, contaminated string")
    df = clashing(table, "row", "n_words", "spans", "items", "number", "met")
    marked = decontamination.mark(df, bench, index_bytes=size)
    got = [(r["row"]["text"], r["n_words"], sum(s["end"] - s["first"] for s in r["spans"]), list(r["items"])) for r in marked.collect()]
    expected = [(t, *x) for t, x in zip([t for _, t in rows_of(df)], brute.contamination([t for _, t in rows_of(df)], items), strict=True)]
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert max(x[2] for x in got) > 13
    kept = decontamination.remove_contaminated(df, bench, index_bytes=size)
    assert_same_rows(kept, df)
    assert kept.count() == sum(not (h and 20 * h >= n) for _, n, h, _ in expected)


def test_decontamination_joined_equals_sent(spark, sample):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = [sorted(map(str, decontamination.mark(sample, bench, index_bytes=b).collect())) for b in (1 << 24, 0)]
    assert rows[0] == rows[1] and any("end=" in r for r in rows[0])


def test_decontamination_empty(spark, table, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.remove_contaminated(table, none).count() == table.count()
    assert decontamination.remove_contaminated(empty, none).count() == 0


# -- Mixing ------------------------------------------------------------------------------------


def test_mixing(table, empty):
    got = mixing.mix_sources(table.withColumn("size", F.lit("clash")).withColumn("weight", F.lit(1))).collect()
    sizes = Counter()
    for r in table.collect():
        sizes[r["source"]] += len(brute.words(r["text"]))
    expected = brute.targets(sizes)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], expected[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - t) < 1 for s, t in expected.items()) and len(got) == table.count()
    again = mixing.mix_sources(table.repartition(5))
    assert sorted((tuple(r) for r in again.collect()), key=key) == sorted(map(tuple, got), key=key)
    assert mixing.mix_sources(empty).count() == 0


def test_mixing_without_words(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r["target"], r["taken"]) for r in mixing.mix_sources(df).collect()} == {(0.0, 0)}


# -- Language ----------------------------------------------------------------------------------


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = language.fit(docs.where(half), rows=300)
    marked = language.identify(docs.where(~half), model, host=F.col("source"))
    right, n, kept = marked.agg(F.sum((F.col("lang") == F.col("row.lang")).cast("int")), F.count("*"), F.sum(F.col("keep").cast("int"))).head()
    assert right / n > 0.99 and kept / n > 0.99


def test_language_evidence(spark):
    """The host decides where texts do not, and so does a declared language."""
    texts = {"en": "the and of that with from this", "de": "und der die nicht mit auf ist"}
    train = spark.createDataFrame([(i, texts[k] + f" {k}", k) for i, k in enumerate(["en", "de"] * 20)], "doc_id long, text string, lang string")
    model = language.fit(train)
    rows = [(i, texts["de"] * 3, "h.de", None) for i in range(30)] + [(100 + i, texts["en"] * 3, "h.en", None) for i in range(30)]
    rows += [(200, "xq", "h.de", None), (201, "xq", "h.en", None), (202, "xq", None, "de"), (203, "xq", None, "en"), (204, "", "h.de", "de"), (205, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, declared string")
    got = {r["row"]["doc_id"]: r for r in language.identify(df, model, host=F.col("host"), declared=F.col("declared"), suffix=F.substring_index("host", ".", -1)).collect()}
    assert [got[i]["lang"] for i in range(200, 206)] == ["de", "en", "de", "en", None, None]
    assert not got[204]["keep"] and not got[205]["keep"] and got[0]["keep"]


def test_language_edges(table, empty):
    df = clashing(table, "row", "n", "ev", "fits", "declared", "suffix", "host", "prob", "keep", "post", "host_rows", "host_sums", "of_host", "id", "label", "__n", "__keep")
    marked = language.of_documents(df, df)
    assert_same_rows(marked.select("row.*"), df)
    got = {r["row"]["doc_id"]: r for r in marked.collect()}
    assert marked.count() == df.count() and got[4]["lang"] is None and got[5]["keep"] is False and got[6]["keep"] is False and got[9]["keep"]
    assert language.of_documents(empty, empty).count() == 0
    assert [r[0] for r in empty.sparkSession.createDataFrame([('<p><html x="1" LANG=de-AT>',), ("<html>",), (None,)], "h string").select(language.declared_language(F.col("h"))).collect()] == ["de", None, None]
    urls = [("https://a.b.co:80/x.fr",), ("http://u.example.de?x",), ("nothing",), (None,)]
    assert [r[0] for r in empty.sparkSession.createDataFrame(urls, "u string").select(language.address_suffix(F.col("u"))).collect()] == ["co", "de", None, None]


def test_language_rare_label(spark):
    """A language of a few rows is in the model however many rows the others have."""
    texts = {"en": "the and of that with from this", "de": "und der die nicht mit auf ist", "fi": "kaikki ihmiset syntyvat vapaina ja tasavertaisina"}
    labels = F.when(F.col("doc_id") % 2500 == 7, "fi").when(F.col("doc_id") % 4 == 0, "de").otherwise("en")
    train = spark.range(10_000).withColumnRenamed("id", "doc_id").withColumn("lang", labels).withColumn("text", F.create_map(*[F.lit(x) for kv in texts.items() for x in kv])[F.col("lang")])
    model = language.fit(train, rows=100)
    assert model.languages == ["de", "en", "fi"]
    got = language.identify(train.where("lang = 'fi'"), model).collect()
    assert len(got) == 4 and all(r["lang"] == "fi" and r["keep"] for r in got)
    assert language.quota([5, 1000, 3000], 105) == 50 and language.quota([5, 10], 100) == 20 and language.quota([], 100) == 20


FOREIGN = {
    "ru": "В начале было слово и слово было у людей которые жили в большом городе на берегу моря",
    "ja": "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。",
    "zh": "中华人民共和国的首都是北京这里有很多人",
    "el": "Η γλώσσα είναι ένα σύστημα επικοινωνίας που χρησιμοποιούν οι άνθρωποι",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem",
    "none": "xkcd bvrt qwzp mnbv lkjh gfds zxcv plkm wrtp sdfg hjkl zxcvb qwrtp",
}


def test_language_fusion(spark):
    """Declarations, suffixes and hosts, with nulls and repeated rows, as brute force fuses them."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    hosts = [None, "a.de", "b.de", "c.fr", "d"]
    rows = [(r["doc_id"], r["text"], hosts[r["doc_id"] % 5] if r["doc_id"] % 7 else "a.de", [None, r["lang"], "xx", "en"][r["doc_id"] % 4]) for r in docs]
    rows += [(-1, None, "a.de", "de"), (-2, "", None, None), (-3, "der die und", "c.fr", None), (-4, "of", "b.de", "en"), *rows[:3]]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, said string").repartition(3)
    model = language.fit(spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in docs], "doc_id long, text string, lang string"), rows=60)
    suffix = F.when(F.col("host").contains("."), F.substring_index("host", ".", -1))
    got = sorted((r["row"]["doc_id"], r["lang"], r["prob"]) for r in language.identify(df, model, declared=F.col("said"), suffix=suffix, host=F.col("host")).where("lang IS NOT NULL").collect())

    names, size = model.languages, len(model.languages)
    n, ll = model.scores([(t or "").encode() for _, t, _, _ in rows])
    softmax = lambda xs: [math.exp(x - max(xs)) / sum(math.exp(y - max(xs)) for y in xs) for x in xs]
    add = lambda xs: [sum(x) for x in zip([0.0] * size, *xs, strict=True)]
    smooth = lambda sums, c, above: [(x + language.KAPPA * q) / (c + language.KAPPA) for x, q in zip(sums, above, strict=True)]
    end = lambda h: h.rpartition(".")[2] if h and "." in h else None
    word = lambda d: d if d is None or d in names else "other"
    seen = [(i, h, word(d), [float(x) / math.sqrt(n[k]) for x in ll[k]]) for k, (i, _, h, d) in enumerate(rows) if n[k]]
    parts = [softmax(ev) for *_, ev in seen]
    overall = [(x + 1) / (sum(add(parts)) + size) for x in add(parts)]
    spoken = add(p for p, x in zip(parts, seen, strict=True) if x[2] is not None)
    expected = []
    for own, (i, h, d, ev) in zip(parts, seen, strict=True):
        same = [p for p, x in zip(parts, seen, strict=True) if end(x[1]) == end(h)]
        above = smooth(add(same), len(same), overall) if end(h) else overall
        there = [p for p, x in zip(parts, seen, strict=True) if x[1] == h]
        prior = smooth([max(x - y, 0) for x, y in zip(add(there), own, strict=True)], len(there) - 1, above) if h else above
        claim = [0.0] * size
        if d is not None:
            said = add(p for p, x in zip(parts, seen, strict=True) if x[2] == d)
            before = [language.DECLARED_RIGHT if d == k else (1 - language.DECLARED_RIGHT) / size for k in names]
            claim = [math.log((a + language.DECLARED_WEIGHT * b) / (c + language.DECLARED_WEIGHT)) for a, b, c in zip(said, before, spoken, strict=True)]
        post = softmax([e + c + math.log(p) for e, c, p in zip(ev, claim, prior, strict=True)])
        expected.append((i, names[post.index(max(post))], max(post)))
    expected.sort()
    assert [x[:2] for x in got] == [x[:2] for x in expected] and len(got) == len(rows) - 2
    assert all(math.isclose(a[2], b[2], rel_tol=1e-6) for a, b in zip(got, expected, strict=True))


def test_language_rejects_others(spark):
    """Texts in none of the labelled languages are not kept; the posterior and the test as brute force has them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    others = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(FOREIGN.values())], docs.schema)
    rows = docs.unionByName(others)
    got = {r["row"]["doc_id"]: r for r in language.identify(rows, language.fit(docs)).collect()}

    def trigrams(text):
        b = [32, *(x | 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x > 127 else 32 for x in text.encode()), 32]
        return Counter((((x * 0x10001 + y) * 0x9E3779B1 + z) * 0x85EBCA6B % 2**32) >> 16 for x, y, z in zip(b, b[1:], b[2:], strict=False) if {x, y, z} != {32})

    texts = {r["doc_id"]: trigrams(r["text"] or "") for r in rows.collect()}
    labels = {r["doc_id"]: r["lang"] for r in docs.collect()}
    names = sorted(set(labels.values()))
    count = {k: sum((texts[i] for i, x in labels.items() if x == k), Counter()) for k in names}
    size = {k: sum(c.values()) for k, c in count.items()}

    def mean(t, k, own=False):
        n = sum(t.values())
        return sum(c * math.log((count[k][g] - c * own + 0.5) / (size[k] - n * own + 2**15)) for g, c in t.items()) / n

    floor, spread = {}, {}
    for k in names:
        m = sorted(mean(texts[i], k, True) for i, x in labels.items() if x == k and texts[i])
        at = 0.01 * (len(m) - 1)
        low = m[int(at)] + (at - int(at)) * (m[int(at) + 1] - m[int(at)])
        floor[k] = min(low, ((m[(len(m) - 1) // 2] + m[len(m) // 2]) / 2 + math.log(0.5 / (size[k] + 2**15))) / 2)
        logs = [(c / size[k], math.log((c + 0.5) / (size[k] + 2**15))) for c in count[k].values()]
        spread[k] = math.sqrt(sum(p * x * x for p, x in logs) - sum(p * x for p, x in logs) ** 2)
    softmax = lambda xs: [math.exp(x - max(xs)) / sum(math.exp(y - max(xs)) for y in xs) for x in xs]
    means = {i: [mean(t, k) for k in names] for i, t in texts.items() if t}
    ev = {i: [x * math.sqrt(sum(texts[i].values())) for x in m] for i, m in means.items()}
    mass = [sum(p) for p in zip(*map(softmax, ev.values()), strict=True)]
    prior = [(x + 1) / (sum(mass) + len(names)) for x in mass]
    for i, m in means.items():
        post = softmax([e + math.log(p) for e, p in zip(ev[i], prior, strict=True)])
        best = post.index(max(post))
        k = names[best]
        keep = max(post) >= 0.5 and m[best] >= floor[k] - 3 * spread[k] / math.sqrt(sum(texts[i].values()))
        assert (got[i]["lang"], got[i]["keep"]) == (k, keep) and math.isclose(got[i]["prob"], post[best], rel_tol=1e-6)
    assert not any(got[-1 - i]["keep"] for i in range(len(FOREIGN))) and all(got[i]["keep"] for i in labels if texts[i])


# -- Language model ----------------------------------------------------------------------------


def test_lm_score(spark, table, empty, monkeypatch):
    monkeypatch.setattr(ngram_counts, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(ngram_counts, "PART", 100_000)
    more = spark.createDataFrame([(900, "two words here that are there twice"), (901, "two words here that are there twice"), (902, "fox jumps over the unseen dog")], "doc_id long, text string")
    df = cut(table.select("doc_id", "text").unionByName(more))
    rows = rows_of(df)
    texts = [brute.words(t) for _, t in rows]
    grams = [Counter(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)) for w in texts]
    count = sum(grams, Counter())
    total = sum(map(len, texts))

    def score(w, own):
        out = 0.0
        for i in range(len(w)):
            f = 1.0
            for n in (3, 2, 1):
                g = tuple(w[i - n + 1 : i + 1]) if i - n + 1 >= 0 else None
                if g and count[g] > own[g]:
                    out += math.log(f * (count[g] - own[g]) / (total - len(w) if n == 1 else count[g[:-1]] - own[g[:-1]]))
                    break
                f *= 0.4 if g else 1
            else:
                out += math.log(f / (total - len(w)))
        return out

    got = sorted(((r["doc_id"], r["n_words"], round(r["log_sum"], 2), r["score"]) for r in lm_score.score(clashing(df, "score", "block", "ids", "part")).collect()), key=key)
    expected = sorted(((i, len(w), round(score(w, own), 2), None) for (i, _), w, own in zip(rows, texts, grams, strict=True)), key=key)
    assert [g[:2] for g in got] == [e[:2] for e in expected]
    assert all(math.isclose(g[2], e[2], rel_tol=1e-6, abs_tol=2e-2) for g, e in zip(got, expected, strict=True))
    assert all((g[3] is None) if not g[1] else math.isclose(g[3], g[2] / g[1], rel_tol=1e-3, abs_tol=1e-2) for g in got)
    assert lm_score.score(empty).count() == 0


# -- Substring dedup ---------------------------------------------------------------------------


def test_substring_paragraphs(sample, table):
    df = sample.select("doc_id", "text").unionByName(table.select("doc_id", "text"))
    spans = substring_dedup.repeated_spans(df.withColumn("first", F.lit("clash")))
    got = {(r["row"], r["first_word"]) for r in spans.where("kind = 'paragraph'").collect()}
    paragraphs = []
    for r in df.withColumn("row", F.monotonically_increasing_id()).collect():
        at = 0
        for line in (r["text"] or "").split("\n"):
            w = brute.words(line)
            if len(w) >= substring_dedup.LEAST_WORDS:
                paragraphs.append(((r["row"], at), brute.shingles(line)))
            at += len(w)
    paragraphs.sort()
    found = brute.components([s for _, s in paragraphs])
    expected = {p for i, (p, _) in enumerate(paragraphs) if found[i] != i}
    # MinHash may miss some of the least similar ones; what it finds is exact.
    assert got <= expected and len(got) >= 0.98 * len(expected) and expected


def test_substring_passages(spark, empty):
    import random

    r = random.Random(9)
    sentence = lambda n: " ".join(f"v{r.randrange(10**6)}" for _ in range(n)) + "."
    passage = " ".join(sentence(11) for _ in range(5))
    rows = [(i, sentence(30) + " " + sentence(4) + " " + passage + " " + sentence(25)) for i in range(4)] + [(9, " ".join(sentence(12) for _ in range(6))), (10, None), (11, "")]
    spans = substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(s["doc_id"], s["first_word"], s["n_words"], s["kept_doc_id"]) for s in spans} == {(i, 34, 55, 0) for i in (1, 2, 3)}
    assert substring_dedup.repeated_spans(empty).count() == 0


def test_substring_runs(spark, monkeypatch):
    """Copies that no sentence borders hold: cut in mid-sentence, unpunctuated, of short sentences, over lines."""
    import random

    monkeypatch.setattr(substring_dedup, "BATCH", 300)
    monkeypatch.setattr(substring_dedup, "PART", 300)
    r = random.Random(4)
    some = lambda n, end="": [f"u{r.randrange(10**6)}{end}" for _ in range(n)]
    plain, short, cut_off, lines = some(60), [w + "." * (i % 4 == 3) for i, w in enumerate(some(70))], some(55), some(50)
    lines[25] += "\n"
    texts = []
    for i in range(4):
        parts = [plain[i:], short, cut_off, lines] if i else [plain, short, cut_off[:49], lines]
        texts.append(" ".join(x for p in parts for x in (*some(80, "," * (i % 2)), *p)))
    texts += [" ".join(cut_off + some(70)), " ".join(["of"] * 120), None, "", " ".join(some(49)), " ".join(texts[1].split()[70:300])]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    spans = substring_dedup.repeated_spans(rows).collect()
    seen, expected = {}, set()
    for i, text in enumerate(texts):
        w = (text or "").split()
        for q in range(len(w) - substring_dedup.RUN + 1):
            d, p = seen.setdefault(tuple(w[q : q + substring_dedup.RUN]), (i, q))
            if d != i or q - p >= substring_dedup.RUN:
                expected |= {(i, k) for k in range(q, q + substring_dedup.RUN)}
    assert {(s["doc_id"], k) for s in spans for k in range(s["first_word"], s["first_word"] + s["n_words"])} == expected
    assert len({i for i, _ in expected}) == 6 and "run" in {s["kind"] for s in spans}


def test_substring_runs_of_many_blocks(spark, monkeypatch):
    """Passages that many blocks have, periodic ones and repeated words: spans and who keeps them, by brute force."""
    import random

    monkeypatch.setattr(substring_dedup, "BATCH", 200)
    monkeypatch.setattr(substring_dedup, "PART", 400)
    r = random.Random(12)
    some = lambda n: [f"u{r.randrange(10**7)}" for _ in range(n)]
    passages = [some(50), some(90), some(140)]
    makers = [
        lambda: passages[0],
        lambda: (lambda p: p[(a := r.randrange(30)) : a + r.randrange(50, 110)])(passages[r.randrange(1, 3)]),
        lambda: ["of"] * r.randrange(40, 140),
        lambda: ["a", "b", "c"] * r.randrange(15, 50),
        lambda: passages[1] * 2,
    ]
    texts = [" ".join(x for _ in range(r.randrange(1, 4)) for x in (*some(r.randrange(60, 90)), *makers[r.randrange(len(makers))]())) + " " + " ".join(some(70)) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(substring_dedup, "similar_paragraphs", lambda rows, met: spark.createDataFrame([], "row long, first_word long, n_words long, kind string, kept_row long"))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        spans = substring_dedup.repeated_spans(rows).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    seen, copies = {}, {}
    for i, text in enumerate(texts):
        w = text.split()
        for q in range(len(w) - substring_dedup.RUN + 1):
            d, p = seen.setdefault(tuple(w[q : q + substring_dedup.RUN]), (i, q))
            if d != i or q - p >= substring_dedup.RUN:
                copies[i, q] = d
    expected = {(i, k) for i, q in copies for k in range(q, q + substring_dedup.RUN)}
    got = [(s["doc_id"], k) for s in spans for k in range(s["first_word"], s["first_word"] + s["n_words"])]
    assert set(got) == expected and len(got) == len(expected) > 2000
    for s in spans:
        inside = range(s["first_word"], s["first_word"] + s["n_words"] - substring_dedup.RUN + 1)
        assert s["kept_doc_id"] == min(copies[s["doc_id"], q] for q in inside if (s["doc_id"], q) in copies)


def test_a_hot_passage_costs_a_block_one_chain():
    import pyarrow as pa

    passage = [f"p{i}" for i in range(50)]
    texts = [" ".join([*(f"a{i}x{k}" for k in range(60)), *passage, *(f"b{i}x{k}" for k in range(60))]) for i in range(900)]
    u = next(substring_dedup.units([t.encode() for t in texts[:1]]))
    g, least, _ = u.runs()
    mark = int((g == least[60]).nonzero()[0][0])
    batch = pa.RecordBatch.from_pydict({"text": texts, "row": list(range(900)), "marks": [[mark]] * 900, "gone": [None] * 900})
    dealt = pa.Table.from_batches(list(substring_dedup._deal_runs(0, 10**9)(iter([batch]))))
    behind = dealt.filter(pa.compute.less(dealt["part"], 0))
    heads = dealt.filter(pa.compute.greater_equal(dealt["part"], 0))
    row, n = substring_dedup._columns(behind, "doc", "n")
    assert sorted(row.tolist()) == list(range(1, 900)) and set(n.tolist()) == {1}
    found = substring_dedup._run_heads(heads).to_pylist()
    assert found == [{"row": 0, "first": 60, "n": 1, "chain": found[0]["chain"], "lead_row": 0}]
