import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from depdelver.llm import ball_clusters, fingerprints, token_alignment
from depdelver.session import cut

VECTORS = "vec_id long, embedding array<float>, cluster string, id string, v string, ids string"
CORPUS = "doc_id long, text string, block string, at string, rid string, n string, key string"


# -- op11 -----------------------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, size, scale=64.0):
    """(id, cluster, distance) and centroids, in Python's integers."""
    kept = []
    for i, e in rows:
        if e is not None and len(e) == size and all(x is not None and np.isfinite(x) for x in e):
            kept.append((i, [int(np.floor(scale * np.float64(np.float32(x)))) for x in e]))
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    centroids = [x for _, x in named[:k]]
    if not centroids:
        return [], []

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        for j in range(len(centroids)):
            if mine := [x for (_, x), c in zip(kept, own, strict=True) if c == j]:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return sorted(((i, near(x)[1], near(x)[0]) for i, x in kept), key=str), centroids


def test_clusters_against_brute_force(spark):
    r = random.Random(4)
    spots = [[r.uniform(-3, 3) for _ in range(5)] for _ in range(6)]
    rows = [(i, [x + r.gauss(0, 0.05) for x in r.choice(spots)]) for i in range(400)]
    rows += [(1000 + i, list(spots[0])) for i in range(300)]  # a hot vector, ties, repeated rows and ids
    rows += [(7, list(spots[1])), (7, list(spots[2])), (None, list(spots[3])), (None, None), (8000, None), (8001, []), (8002, [1.0] * 4), (8003, [None] * 5), (8004, [float("nan")] * 5), (8005, [float("inf")] * 5), (8006, [-0.0] * 5)]
    df = spark.createDataFrame([(i, e, "x", "y", "z", "w") for i, e in rows], VECTORS).repartition(3)
    for k, rounds in ((6, 3), (3, 1), (2000, 1)):
        found = ball_clusters.cluster(df, k, rounds, size=5)
        expected, centroids = brute_clusters(rows, k, rounds, 5)
        assert found.centroids == centroids
        assert sorted(map(tuple, found.rows.collect()), key=str) == expected
    found = ball_clusters.cluster(df, 6, 3, size=5)
    assert sum(found.sizes) == len(expected) and sum(found.whole) > 100  # balls are assigned as a whole


def test_clusters_of_large_components_and_none(spark):
    rows = [(i, [float(3e38 if i % 3 == 0 else -1e20 * i), float(i)]) for i in range(20)]
    df = spark.createDataFrame([(i, e, None, None, None, None) for i, e in rows], VECTORS)
    held = lambda x: max(-(2**53), min(2**53, int(np.floor(64.0 * np.float64(np.float32(x))))))
    points = {i: [held(x) for x in e] for i, e in rows}
    found = ball_clusters.cluster(df, 4, 2, size=2)
    assert all(all(abs(x) <= 2**53 for x in c) for c in found.centroids)
    for i, c, d in map(tuple, found.rows.collect()):
        away = [sum((a - b) ** 2 for a, b in zip(points[i], m, strict=True)) for m in found.centroids]
        assert c == away.index(min(away)) and d == min(min(away), 2**63 - 1)
    nothing = ball_clusters.cluster(df.limit(0), size=2)
    assert nothing.rows.count() == 0 and nothing.centroids == []
    assert ball_clusters.cluster(df, size=3).rows.count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_balls_hold_their_vectors(seed):
    r = np.random.default_rng(seed)
    x = np.floor(r.normal(size=(700, 4)) * r.choice([1, 30, 1e9], size=(1, 4)))
    x[:200] = x[0]
    tree, order = ball_clusters.build(x)
    assert sorted(order.tolist()) == list(range(700)) and (tree.vectors == x[order]).all()
    for (a, b), center, radius, total in zip(tree.ranges.tolist(), tree.centers, tree.radii, tree.sums.tolist(), strict=True):
        assert np.sqrt(((tree.vectors[a:b] - center) ** 2).sum(axis=1)).max() <= radius
        assert total == [sum(map(int, c)) for c in tree.vectors[a:b].T]


# -- op12 -----------------------------------------------------------------------------------------


def brute_alignment(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text, one token at a time."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(f"{token_alignment.FOLDER}/{token_alignment.FILE_A}")
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=f"{token_alignment.FOLDER}/{token_alignment.FILE_B}")
    of, extra = {}, 0
    for byte in range(256):
        if 33 <= byte < 127 or 161 <= byte < 173 or byte > 173:
            of[chr(byte)] = byte
        else:
            of[chr(256 + extra)] = byte
            extra += 1
    groups = []
    for text in texts:
        out = []
        if text:
            ids = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
            sides = [bytes(of[c] for c in a_side.id_to_token(i)) for i in ids[0]], [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
            if all(b"".join(s) == (" " + text).encode() for s in sides):
                i = j = end_a = end_b = 0
                now = [], []
                while i < len(ids[0]) or j < len(ids[1]):
                    if end_a <= end_b and i < len(ids[0]):
                        now[0].append(ids[0][i])
                        end_a += len(sides[0][i])
                        i += 1
                    else:
                        now[1].append(ids[1][j])
                        end_b += len(sides[1][j])
                        j += 1
                    if end_a == end_b:
                        out.append(now)
                        now = [], []
        groups.append(out)
    linked = [[(p, q) for x, y in g for p in x for q in y] for g in groups]
    counts = Counter(pair for links in linked for pair in set(links))
    best: dict[int, int] = {}
    for (p, _), n in counts.items():
        best[p] = max(best.get(p, 0), n)
    text_of = lambda g: ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
    return [(sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(m), sum(counts[p] == best[p[0]] for p in m), sum(counts[p] for p in m), text_of(g)) for g, m in zip(groups, linked, strict=True)], counts


ODD = [None, "", " ", "a", "  lead", "x▁y", "a\x00b", "<|endoftext|> <s> </s> a", "日本語 の 文章  nbsp 😀 e", "a b" * 30, "tabs\t\ta\n\n b \r\n c", "it's 'quoted' don't", "Q" * 3000 + " z", "line one\nline two\n" * 5000, "same text", "same text"]


def test_alignment_against_brute_force(spark, sample):
    r = random.Random(1)
    texts = [*ODD, "".join(r.choice("abc \n\té!.'0") for _ in range(5000)), *[x["text"] for x in sample.collect()]]
    rows = [(None if i == 3 else i, t, "b", "a", "r", "n", "k") for i, t in enumerate(texts)]
    found = token_alignment.Alignment(cut(spark.createDataFrame(rows, CORPUS).repartition(3)))
    expected, counts = brute_alignment(texts)
    assert sorted(map(tuple, found.documents().collect()), key=str) == sorted(((i, *x) for (i, *_), x in zip(rows, expected, strict=True)), key=str)
    pairs = {(x["a"], x["b"]): (x["documents"], x["best_of_a"], x["best_of_b"]) for x in found.pair_counts().collect()}
    best = lambda side: {k: max(n for p, n in counts.items() if p[side] == k) for k in {p[side] for p in counts}}
    of_a, of_b = best(0), best(1)
    assert pairs == {p: (n, n == of_a[p[0]], n == of_b[p[1]]) for p, n in counts.items()}


def test_alignment_of_nothing(spark, empty):
    assert token_alignment.Alignment(cut(empty)).documents().count() == 0
    nothing = token_alignment.Alignment(cut(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")))
    assert sorted(map(tuple, nothing.documents().collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_large_groups_are_linked_in_pieces(monkeypatch):
    r = np.random.default_rng(3)
    a, b = r.integers(0, 9, 300).astype(np.int32), r.integers(0, 7, 400).astype(np.int32)
    group_a, group_b = np.sort(r.integers(0, 5, 300)), np.sort(r.integers(0, 5, 400))
    text = np.array([0, 0, 1, 1, 3])
    expected = Counter((int(text[g]) << 32) | (int(x) << 16) | int(y) for x, g in zip(a, group_a, strict=True) for y, h in zip(b, group_b, strict=True) if g == h)
    for most in (10, 5000, 1 << 20):
        monkeypatch.setattr(token_alignment, "LINKS", most)
        keys, times = token_alignment.links(a, b, group_a, group_b, text)
        assert dict(zip(keys.tolist(), times.tolist(), strict=True)) == expected and (np.diff(keys.astype(np.int64)) > 0).all()


def test_pieces_lines_and_libraries(monkeypatch):
    """A text in pieces, a piece by lines, and either library give the same tokens."""
    t = token_alignment.tokenizers(f"{token_alignment.FOLDER}/{token_alignment.FILE_A}", f"{token_alignment.FOLDER}/{token_alignment.FILE_B}")
    r = random.Random(5)
    for k in range(40):
        text = "".join(r.choice(["word", "\n", "\n\n", "é", "'s", ".", "\t", "日本" if k % 2 else "ß", "9", " ", " ", "  ", "\u00a0", "\x85", "'ll"]) for _ in range(300))
        whole = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
        assert (t.ids_a(" " + text), t.b.encode(text)) == whole == t.by_lines(text)
        monkeypatch.setattr(token_alignment, "PIECE", 20)
        assert len(token_alignment.pieces(text)) > 1
        a, b, size = token_alignment.streams(t, [text.encode(), None, b"", "a\u2581".encode(), b"z"])
        tail = t.a.encode(" z", add_special_tokens=False).ids, t.b.encode("z")
        assert (a.tolist(), b.tolist()) == (whole[0] + tail[0], whole[1] + tail[1]) and size.tolist() == [len(text.encode()) + 1, 0, 0, 0, 2]
        monkeypatch.undo()


# -- op13 -----------------------------------------------------------------------------------------


def brute_fingerprint(text, weight=lambda term: 1):
    for c in "\t\n\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in text.split(" ") if w]
    votes, total = [0] * 64, 0
    for term in [" ".join(words[i : i + 2]) for i in range(len(words))]:
        h, w = int(hashlib.md5(term.encode()).hexdigest()[:16], 16), weight(term)
        total += w
        for i in range(64):
            votes[i] += w * (h >> i & 1)
    return sum(1 << i for i in range(64) if 2 * votes[i] > total)


def test_fingerprints_against_brute_force(spark, table):
    texts = [r["text"] for r in table.collect()]
    rows = spark.createDataFrame([(i, t, None, None, None, "n", "k") for i, t in enumerate(texts)], CORPUS).repartition(3)
    for weight, plain in ((None, lambda t: 1), (F.length, len)):
        got = {r["doc_id"]: r["fingerprint"] % (1 << 64) for r in fingerprints.simhash(rows, ["doc_id", "n", "key"], weight=weight).collect()}
        assert got == {i: brute_fingerprint(t, plain) for i, t in enumerate(texts)}
    assert fingerprints.simhash(rows.limit(0), ["doc_id"]).count() == 0


def test_edited_texts_and_ring(spark):
    r = random.Random(2)
    rows = [(r.choice([None, *range(40)]), "".join(r.choice("aé😀 b") for _ in range(r.randrange(30)))) for _ in range(60)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for some in (rows, rows[:1], [(1, "abcdefgh"), (2, "x"), (3, "")], []):
            df = cut(spark.createDataFrame(some, "doc_id long, text string").withColumn("rid", F.monotonically_increasing_id()))
            got = fingerprints.edited(df).collect()
            keyed = {x["rid"]: x for x in got}
            assert len(got) == len(some)
            assert {x["after"] for x in got} == set(keyed)
            ids = [(x["doc_id"] is None, x["doc_id"] or 0) for x in got]
            falls = 0
            for x in got:
                y = keyed[x["after"]]
                k = len(x["text"]) // 4
                assert x["edited"] == x["text"][: len(x["text"]) - k] + y["text"][:k] and x["next_id"] == y["doc_id"]
                falls += (y["doc_id"] is None, y["doc_id"] or 0) < (x["doc_id"] is None, x["doc_id"] or 0)
            assert falls <= 1 and (not ids or falls == (len(set(ids)) > 1))  # once around
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize(("radius", "blocks"), [(0, 1), (3, 4), (3, 6), (7, 9)])
def test_all_prints_within_the_radius(spark, radius, blocks):
    r = random.Random(radius)
    some = [r.getrandbits(64) for _ in range(6)]
    values = [0, (1 << 64) - 1]
    for x in some:
        for d in range(radius + 3):
            values.append(x ^ sum(1 << b for b in r.sample(range(64), d)))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in [*signed, *signed[:5], None]], "fingerprint long")
    asked = spark.createDataFrame([(v,) for v in [*signed[::3], signed[0], None]], "query long")
    got = sorted(map(tuple, fingerprints.within(asked, prints, radius, blocks).collect()))
    assert got == sorted({(a, b, ((a ^ b) % (1 << 64)).bit_count()) for a in signed[::3] for b in signed if ((a ^ b) % (1 << 64)).bit_count() <= radius})
    with pytest.raises(ValueError):
        fingerprints.tables(3, 3)


def test_fingerprint_query_tells_edits_from_other_texts(spark):
    rows = fingerprints.op13_fingerprints(spark, "/root/testdata/sf0.001").collect()
    long_ = [r for r in rows if r["n_chars"] > 400]
    assert len(rows) == 200 and sum(r["near_edited"] > r["near_next"] for r in long_) > 0.95 * len(long_)
    assert {r["near_docs"] is None for r in rows if r["doc_id"] % 100} == {True} and all(r["near_docs"] >= 0 for r in rows if not r["doc_id"] % 100)


def test_fingerprint_query_on_edges(spark, table, tmp_path):
    table.write.parquet(str(tmp_path / "documents.parquet"))
    rows = fingerprints.op13_fingerprints(spark, str(tmp_path)).collect()
    assert len(rows) == table.count()
    prints = {}
    for r in rows:
        prints.setdefault(r["fingerprint"], []).append(r["doc_id"])
    assert {1, 2, 3} <= set(next(v for v in prints.values() if 1 in v)) and {4, 5, 6} <= set(prints["0" * 16])
    table.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert fingerprints.op13_fingerprints(spark, str(tmp_path / "none")).count() == 0
