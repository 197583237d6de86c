"""Benchmark decontamination by winnowed fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depdelver.llm.rows import column, unpacked, whole
from depdelver.llm.textops import PUNCT, U, as_bytes, grams, slices, window_hash, word_blocks
from depdelver.session import cut

#: Words of a window, and of the k-grams of which the least one in a window is its fingerprint.
WINDOW, GRAM = 13, 7
#: Bytes of benchmark text whose index is sent to every executor; a larger one is joined by a shuffle.
INDEX_BYTES = 16 << 20
SPAN = T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())])


@dataclass
class Index:
    """Windows of one length: their fingerprints, and by window hash the items that have it."""

    words: int
    gram: int
    prints: np.ndarray  # sorted
    seen: np.ndarray  # which low bits a fingerprint has
    windows: np.ndarray  # sorted
    at: np.ndarray  # where each window's items start
    items: np.ndarray


def fingerprints(h: np.ndarray, words: int, gram: int) -> np.ndarray:
    """Of every ``words`` consecutive words, the least hash of the k-grams inside."""
    g = grams(h, gram)
    m = len(h) - words + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = g[:m].copy()
    for i in range(1, words - gram + 1):
        np.minimum(out, g[i : i + m], out=out)
    return out


def windows_of(texts: list[bytes | None], window: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of every text with words: its number, its windows' length, their fingerprints and hashes (a shorter text is one window)."""
    for first, end, h, offs in word_blocks(texts, PUNCT):
        for j in range(first, end):
            own = h[offs[j - first] : offs[j - first + 1]]
            if len(own):
                n = min(window, len(own))
                yield j, n, fingerprints(own, n, min(GRAM, n)), grams(own, n)


def build(items: list[tuple[str | None, bytes]], window: int) -> tuple[list[Index], list[str | None]]:
    """Indexes by window length and the items' ids, with null, the first, for items without one."""
    names = [None, *sorted({i for i, _ in items} - {None})]
    number = {n: k for k, n in enumerate(names)}
    found: dict[int, tuple[list, list, list]] = {}
    for j, n, own, windows in windows_of([t for _, t in items], window):
        prints, hashes, ids = found.setdefault(n, ([], [], []))
        prints.append(own)
        hashes.append(windows)
        ids.append(np.full(len(windows), number[items[j][0]], np.int64))
    out = []
    for n, (prints, hashes, ids) in sorted(found.items(), reverse=True):
        p = np.unique(np.concatenate(prints))
        w, i = np.concatenate(hashes), np.concatenate(ids)
        order = np.lexsort((i, w))
        w, i = w[order], i[order]
        keep = np.ones(len(w), bool)
        keep[1:] = (w[1:] != w[:-1]) | (i[1:] != i[:-1])
        w, i = w[keep], i[keep]
        windows, at = np.unique(w, return_index=True)
        bits = 1 << min(24, max(10, int(len(p) * 16).bit_length()))
        seen = np.zeros(bits, bool)
        seen[(p & U(bits - 1)).astype(np.int64)] = True
        out.append(Index(n, min(GRAM, n), p, seen, windows, np.append(at, len(w)), i))
    return out, names


def hits(h: np.ndarray, offs: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of the index begin in a block, and which of its windows they are."""
    prints = fingerprints(h, index.words, index.gram)
    at = np.flatnonzero(index.seen[(prints & U(len(index.seen) - 1)).astype(np.int64)])
    if not len(at):
        return at, at
    doc = np.searchsorted(offs, at, side="right")
    at = at[at + index.words <= offs[doc]]
    near = np.minimum(np.searchsorted(index.prints, prints[at]), len(index.prints) - 1)
    at = at[index.prints[near] == prints[at]]
    w = window_hash(h, at, index.words)
    k = np.minimum(np.searchsorted(index.windows, w), len(index.windows) - 1)
    same = index.windows[k] == w
    return at[same], k[same]


def spans_of(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Intervals, with those that meet made one."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def analyse(texts: list[bytes | None], indexes: list[Index], names: list[str]) -> tuple[np.ndarray, dict[int, tuple[list, list]]]:
    """Words of each text; of those with hits, the hit spans and the items' ids."""
    n_words, found = np.zeros(len(texts), np.int64), {}
    for first, end, h, offs in word_blocks(texts, PUNCT):
        n_words[first:end] = np.diff(offs)
        starts, ends, docs, items = [], [], [], []
        for index in indexes:
            at, k = hits(h, offs, index)
            if len(at):
                doc = np.searchsorted(offs, at, side="right") - 1
                starts.append(at)
                ends.append(at + index.words)
                docs.append(doc)
                n = index.at[k + 1] - index.at[k]
                each = np.repeat(index.at[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
                items.append(np.unique(np.repeat(doc, n) * len(names) + index.items[each]))
        if starts:
            a, b, d, i = (np.concatenate(x) for x in (starts, ends, docs, items))
            for x in np.unique(d).tolist():
                own = d == x
                mine = np.unique(i[i // len(names) == x] % len(names))
                found[first + x] = (spans_of(a[own] - offs[x], b[own] - offs[x]), [names[k] for k in mine.tolist() if k])
    return n_words, found


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def _marker(index, at: int):
    """Adds n_words, spans and items to rows whose text is field ``at`` of column row, by an index that is held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes, names = index.value
        for batch in slices(batches):
            n_words, found = analyse(as_bytes(batch.column("row").field(at)), indexes, names)
            spans: list = [[]] * len(batch)
            items: list = [[]] * len(batch)
            for i, (s, k) in found.items():
                spans[i], items[i] = [{"first": a, "end": b} for a, b in s], k
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n_words), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], ["row", "n_words", "spans", "items"])

    return run


# -- A benchmark of any size: fingerprints are joined by a shuffle ---------------------------------


def _item_windows(window: int):
    """(length, print, hash, item) of every window of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names = batch.column(0).to_pylist()
            for j, n, prints, hashes in windows_of(as_bytes(batch.column(1)), window):
                m = len(hashes)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, n, np.int32)), pa.array(prints.view(np.int64)), pa.array(hashes.view(np.int64)), pa.array([names[j]] * m, pa.string())], ["length", "print", "hash", "item"])

    return run


def _doc_prints(lengths: list[int]):
    """(number, length, print): the distinct fingerprints of every document, for each length of windows that items have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            numbers = batch.column(0).to_numpy()
            for first, _, h, offs in word_blocks(as_bytes(batch.column(1)), PUNCT):
                for n in lengths:
                    prints = fingerprints(h, n, min(GRAM, n))
                    doc = np.searchsorted(offs, np.arange(len(prints)), side="right")
                    whole_ = np.arange(len(prints)) + n <= offs[np.minimum(doc, len(offs) - 1)]
                    prints, doc = prints[whole_], doc[whole_] - 1 + first
                    new = np.flatnonzero(np.append(True, (prints[1:] != prints[:-1]) | (doc[1:] != doc[:-1]))[: len(prints)])
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[doc[new]]), pa.array(np.full(len(new), n, np.int32)), pa.array(prints[new].view(np.int64))], ["number", "length", "print"])

    return run


def _candidate_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(number, length, hash, first) of the windows whose fingerprints an item has."""
    for batch in slices(batches):
        numbers, texts, met = batch.column("number").to_numpy(), as_bytes(batch.column("text")), batch.column("met").to_pylist()
        for first, end, h, offs in word_blocks(texts, PUNCT):
            for j in range(first, end):
                own = h[offs[j - first] : offs[j - first + 1]]
                for n in {x["length"] for x in met[j]}:
                    wanted = np.array([x["print"] for x in met[j] if x["length"] == n], np.int64).view(np.uint64)
                    at = np.flatnonzero(np.isin(fingerprints(own, n, min(GRAM, n)), wanted))
                    hashes = window_hash(own, at, n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), numbers[j])), pa.array(np.full(len(at), n, np.int32)), pa.array(hashes.view(np.int64)), pa.array(at)], ["number", "length", "hash", "first"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        n = np.zeros(len(batch), np.int64)
        for first, end, _, offs in word_blocks(as_bytes(batch.column(1)), PUNCT):
            n[first:end] = np.diff(offs)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], ["number", "n_words"])


def _joined(docs: DataFrame, items: DataFrame, text: str, window: int) -> DataFrame:
    """``mark`` by shuffles: three passes over the documents, whatever the benchmark's size."""
    windows = cut(items.mapInArrow(_item_windows(window), "length int, print long, hash long, item string"))
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # ``window`` of them at most
    texts = docs.select(F.monotonically_increasing_id().alias("number"), column(text).alias("text"))
    prints = texts.mapInArrow(_doc_prints(lengths), "number long, length int, print long")
    known = cut(windows.select("length", "print").distinct())
    met = cut(prints.join(known, ["length", "print"], "left_semi").groupBy("number").agg(F.collect_set(F.struct("length", "print")).alias("met")))
    hot = texts.join(met.hint("merge"), "number").mapInArrow(_candidate_windows, "number long, length int, hash long, first long")
    named = windows.groupBy("length", "hash").agg(F.collect_set("item").alias("items"))
    found = cut(hot.join(named, ["length", "hash"]).select("number", "first", (F.col("first") + F.col("length")).alias("end"), "items"))
    spans = F.array_sort(F.collect_set(F.struct("first", "end")))
    start = F.expr("CAST(array() AS ARRAY<STRUCT<first: BIGINT, end: BIGINT>>)")

    def merge(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        longer = F.struct(last["first"].alias("first"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(out) > 0) & (x["first"] <= F.get(out, F.size(out) - 1)["end"]), F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(out, F.array(x)))

    hits_ = found.groupBy("number").agg(spans.alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    hits_ = hits_.select("number", F.aggregate("s", start, merge).alias("spans"), "items")
    counts = texts.mapInArrow(_count_words, "number long, n_words long").join(hits_, "number", "left")
    rows = docs.select(F.monotonically_increasing_id().alias("number"), whole(docs).alias("row")).join(cut(counts).hint("merge"), "number")
    none = F.array().cast("array<string>")
    return rows.select("row", "n_words", F.coalesce("spans", start).alias("spans"), F.coalesce("items", none).alias("items"))


def mark(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """row (all columns, whatever their names), n_words, spans (of words, end exclusive) and items (sorted ids).

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. A document
    word is hit if it is inside an occurrence of ``window`` consecutive words of an item, or of a
    whole item with fewer. By winnowing, two equal windows have the same least k-gram hash, so
    each window's fingerprint is looked up among the benchmark's, and a match is extended to
    the whole window before it counts: no shared window is missed and none is made up.

    Null and empty texts have no words; items without a text take no part; items without an id
    hit words, but are in no list of items; items of the same id are one item; repeated documents
    are each judged; empty tables give no rows or no hits. Words are compared by hashes of 64
    bits.

    The fingerprints of a benchmark of up to ``index_bytes`` of text are sent to every executor,
    and documents do not move. Those of a larger one are joined with the documents' by a shuffle,
    in three passes over the documents whatever its size; ``docs`` should then be a table or
    another deterministic plan. Both give the same rows.
    """
    items = benchmark.where(column(item_text).isNotNull()).select(column(item_id).cast("string").alias("item"), column(item_text).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0))), F.lit(0))).head()[0]
    if size > index_bytes:
        return _joined(docs, items, text, window)
    held = [(r[0], r[1].encode("utf-8", "surrogatepass")) for r in items.toLocalIterator()]  # up to index_bytes
    index = docs.sparkSession.sparkContext.broadcast(build(held, window))
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("items", T.ArrayType(T.StringType()))])
    return docs.select(whole(docs).alias("row")).mapInArrow(_marker(index, docs.columns.index(text)), schema)


def measures(marked: DataFrame) -> dict:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    return {
        "n_words": F.col("n_words"),
        "n_hit": n_hit,
        "n_items": F.size("items").cast("long"),
        "items_sha256": F.sha2(F.concat_ws(",", F.array_sort("items")), 256),
        "contaminated": (n_hit > 0) & (20 * n_hit >= F.col("n_words")),
    }


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents, with their own columns, of which less than 5% of the words are hit.

    Null and empty texts have no words and stay, rows with a null or repeated id are judged row by
    row, an empty benchmark or an item without words hits nothing; long texts are read whole.
    """
    marked = mark(docs, benchmark, **kw)
    return unpacked(marked.where(~measures(marked)["contaminated"]))


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    marked = mark(docs.select("doc_id", "text"), items)
    return marked.select("row.doc_id", *[c.alias(n) for n, c in measures(marked).items()])


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bi AS (
  SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM bi
), di AS (
  SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k
), hit AS (
  SELECT di.doc_id, di.i, di.k, bw.item_id FROM di JOIN bw ON bw.k = di.k AND bw.g = array_to_string(list_slice(di.w, di.i, di.i + di.k - 1), ' ')
), p AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY 1
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY 1
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN it USING (doc_id)
"""
