"""Substring dedup: MinHash banding of paragraphs, and equal pieces and runs of words inside longer ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depdelver.llm.components import connected_components
from depdelver.llm.jaccard_join import search_groups
from depdelver.llm.rows import column
from depdelver.llm.textops import BLOCK, SPACES, U, as_bytes, distinct, grams, hash_buffer, mix, pack, pack_sorted, pieces, run_hashes, slices, unpack, unpack_sorted, window_hash
from depdelver.session import cut, settle

SHINGLE = 5
PERCENT = 75
#: Bands and rows: paragraphs of similarity 0.75 meet with probability 1 - (1 - 0.75**4)**20 = 0.9995.
BANDS, ROWS = 20, 4
#: Words that a paragraph, or a run of pieces, must have to be removed, by default; words that a piece has at least.
LEAST_WORDS, PIECE_WORDS = 20, 8
#: Words in a row that make a copy wherever they begin and end, and of the word grams of which the
#: least one marks such a run.
RUN, GRAM = 50, 16
#: Keys that a task gathers before it deals them out, and keys of a part.
BATCH, PART = 1_500_000, 1_500_000

_rng = np.random.Generator(np.random.PCG64(31337))
_MUL = (_rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) << 1) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
PIECE, PARAGRAPH, MARK = 0, 1, 2

PACKED = "part int, block long, keys binary, doc binary, first binary, words binary, lead_doc binary, lead_first binary, lead_words binary"
_SCHEMA = pa.schema([("part", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in ("keys", "doc", "first", "words", "lead_doc", "lead_first", "lead_words"))])
MET = "kind int, row long, first long, words long, lead_row long, lead_first long, lead_words long"
_MET = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("row", "first", "words", "lead_row", "lead_first", "lead_words"))])
RUNS = "part int, hashes binary, doc binary, first binary, n binary, chain binary, led binary, lead_doc binary, lead_first binary, step binary"
_RUNS = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("hashes", "doc", "first", "n", "chain", "led", "lead_doc", "lead_first", "step"))])
HEAD = "row long, first long, n long, chain long, lead_row long"
_HEAD = pa.schema([(c, pa.int64()) for c in ("row", "first", "n", "chain", "lead_row")])
BEHIND = "row long, first long, n long, chain long, lead_row long, lead_first long, step long"
_BEHIND = pa.schema([(c, pa.int64()) for c in ("row", "first", "n", "chain", "lead_row", "lead_first", "step")])


def sliding(x: np.ndarray, n: int, best: Callable) -> np.ndarray:
    """The best of every ``n`` consecutive values."""
    k = 1
    while 2 * k <= n:
        x = best(x[:-k], x[k:])
        k *= 2
    return best(x[: len(x) - (n - k)], x[n - k :]) if k < n else x


class Units:
    """The words of some texts, with their paragraphs (lines) and pieces.

    A piece is a sentence: it ends with a paragraph or after a full stop, or ! or ?.
    """

    def __init__(self, raws: list[bytes], docs: np.ndarray, cuts: np.ndarray):
        """Either one ``raws``, texts joined by line feeds, of documents ``docs`` from bytes ``cuts``
        on; or the consecutive parts of one long text, which are hashed one by one."""
        hashes, paras, closes, places, seen = [], [], [], [], 0
        for raw in raws:
            starts, ends, h = hash_buffer(raw, SPACES, True)
            buf = np.frombuffer(raw, np.uint8)
            feeds = np.flatnonzero(buf == 10)
            last = buf[ends - 1] if len(ends) else buf[:0]
            hashes.append(h)
            paras.append(np.searchsorted(feeds, starts) + seen)
            closes.append((last == 0x2E) | (last == 0x21) | (last == 0x3F))  # . ! ?
            places.append(np.searchsorted(cuts, starts, side="right") - 1 if len(raws) == 1 else np.zeros(len(starts), np.int64))
            seen += len(feeds)
        self.h, para, closed, text = (np.concatenate(x) for x in (hashes, paras, closes, places))
        n = len(self.h)
        new = np.diff(para, prepend=-1) != 0
        self.first_paragraph = np.flatnonzero(new)
        sentence = np.flatnonzero(new | np.append(True, closed[:-1])[:n])
        self.doc = docs[text] if n else text
        self.place = np.arange(n) - np.searchsorted(text, np.arange(len(docs)))[text] if n else text
        self.first_piece = sentence

    def spans(self, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        n = np.diff(np.append(first, len(self.h)))
        keep = n >= least
        return first[keep], n[keep]

    def shingles(self, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shingle hashes of spans, one of the whole for fewer words than SHINGLE, and where each span's start."""
        g = np.append(grams(self.h, SHINGLE), np.zeros(min(SHINGLE - 1, len(self.h)), np.uint64))
        for k in range(1, SHINGLE):
            short = first[n == k]
            g[short] = window_hash(self.h, short, k)
        k = np.maximum(n - SHINGLE + 1, 1)
        at = np.cumsum(k) - k
        return g[np.repeat(first - at, k) + np.arange(k.sum())], at

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hashes of GRAM words; of every RUN words, the least of those inside, and whether they are of one text."""
        if len(self.h) < RUN:
            return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, bool)
        g = grams(self.h, GRAM)
        return g, sliding(g, RUN - GRAM + 1, np.minimum), self.doc[: 1 - RUN] == self.doc[RUN - 1 :]

    def marks(self) -> tuple[np.ndarray, np.ndarray]:
        """The least hashes of all runs and where they are, the first two places of each in a text."""
        g, least, whole = self.runs()
        if not whole.any():
            return g[:0], np.empty(0, np.int64)
        around = np.zeros(RUN - GRAM, np.uint64)
        at = np.flatnonzero(sliding(np.concatenate([around, np.where(whole, least, U(0)), around]), RUN - GRAM + 1, np.maximum) == g)
        at = at[np.lexsort((at, g[at], self.doc[at]))]
        third = (g[at[2:]] == g[at[:-2]]) & (self.doc[at[2:]] == self.doc[at[:-2]])
        at = at[~np.append([False, False], third)[: len(at)]]
        return g[at], at


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """(row of the first, texts) of a few consecutive documents at a time."""
    for batch in slices(batches):
        yield batch.column(1)[0].as_py(), as_bytes(batch.column(0))


def units(texts: list[bytes | None]) -> Iterator[Units]:
    """The texts, about BLOCK bytes at a time; a longer one by itself."""
    parts, docs, size = [], [], 0

    def made() -> Units:
        return Units([b"\n".join(parts)], np.array(docs), np.cumsum([0, *(len(x) + 1 for x in parts[:-1])]))

    for i, text in enumerate(texts):
        if not text:
            continue
        if parts and size + len(text) > BLOCK:
            yield made()
            parts, docs, size = [], [], 0
        if len(text) > BLOCK:
            yield Units(list(pieces(text, SPACES)), np.array([i]), np.zeros(1, np.int64))
        else:
            parts.append(text)
            docs.append(i)
            size += len(text) + 1
    if parts:
        yield made()


def band_keys(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each band, a hash of its minima for each paragraph."""
    t = (shingles >> U(32)).astype(np.uint32)
    out = np.empty((BANDS, len(at)), np.uint64)
    for b in range(BANDS):
        key = np.full(len(at), b + 1, np.uint64)
        for r in range(b * ROWS, (b + 1) * ROWS):
            key = mix(key * U(0x9E3779B97F4A7C15) + np.minimum.reduceat(t * _MUL[r] + _ADD[r], at))
        out[b] = key
    return out


def _deal(bits: int, least_words: int, piece_words: int):
    """The keys of every unit: bands of paragraphs, hashes of whole pieces, and marks of runs.

    Of one key, a block deals its first unit only, by hash, so that a hot key costs a part one
    entry a block. The others stay behind (part -1), each with that first unit.
    """

    def packed(part: int, block: int, *columns) -> tuple:
        return part, block, *columns, *[None] * (7 - len(columns))

    def flush(block: int, rows: list) -> Iterator[pa.RecordBatch]:
        keys, doc, first, words = (np.concatenate(x).astype(np.uint64) for x in zip(*rows, strict=True))
        order = np.argsort(keys, kind="stable")  # units of one key stay in the order of their places
        keys, doc, first, words = keys[order], doc[order], first[order], words[order]
        lead = np.append(True, keys[1:] != keys[:-1])
        head, late = np.flatnonzero(lead), np.flatnonzero(~lead)
        out = []
        if len(late):
            to = head[np.cumsum(lead)[late] - 1]
            own = [doc[late], first[late], words[late], doc[to], first[to], words[to]]
            order = np.lexsort((own[4], own[3], own[2], own[1], own[0]))
            own = [x[order] for x in own]
            new = np.append(True, np.any([x[1:] != x[:-1] for x in own], axis=0))  # bands mostly agree
            new &= (own[0] != own[3]) | (own[1] != own[4])
            out.append(packed(-1, block, None, *(pack(x[new]) for x in own)))
        keys, doc, first, words = (x[head] for x in (keys, doc, first, words))
        cuts = np.searchsorted(keys >> U(64 - bits), np.arange((1 << bits) + 1)) if bits else [0, len(keys)]
        out += [packed(p, block, pack_sorted(keys[a:b]), *(pack(x[a:b]) for x in (doc, first, words))) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, block = [], 0, None
        for start, texts in blocks(batches):
            if size >= BATCH:
                yield from flush(block, rows)
                rows, size = [], 0
            block = start if not rows else block
            for u in units(texts):
                first, n = u.spans(u.first_paragraph, least_words)
                if len(first):
                    keys = band_keys(*u.shingles(first, n)).ravel()
                    rows.append((keys, np.tile(u.doc[first] + (start - block), BANDS), np.tile(u.place[first], BANDS), np.tile(n * 4 + PARAGRAPH, BANDS)))
                first, n = u.spans(u.first_piece, piece_words)
                if len(first):
                    # A piece's hash: that of its words in order.
                    power = np.concatenate([np.ones(1, np.uint64), np.full(int(n.max()) - 1, 0xFF51AFD7ED558CCD, np.uint64)]).cumprod(dtype=np.uint64)
                    at = np.cumsum(n) - n
                    place = np.arange(n.sum()) - np.repeat(at, n)
                    keys = mix(np.add.reduceat(u.h[np.repeat(first, n) + place] * power[place], at) + n.astype(np.uint64))
                    rows.append((keys, u.doc[first] + (start - block), u.place[first], n * 4 + PIECE))
                keys, first = u.marks()
                if len(first):
                    rows.append((mix(keys ^ U(MARK)), u.doc[first] + (start - block), u.place[first], np.full(len(first), GRAM * 4 + MARK)))
                size = sum(len(r[0]) for r in rows)
        if rows:
            yield from flush(block, rows)

    return run


def _numbers(table: pa.Table | pa.RecordBatch, *names: str) -> list[np.ndarray]:
    """Packed columns of several blocks, with documents as row numbers."""
    block = table.column("block").to_pylist()
    out = []
    for c in names:
        own = [unpack(x).astype(np.int64) for x in table.column(c).to_pylist()]
        out.append(np.concatenate([x + b for x, b in zip(own, block, strict=True)] if c.endswith("doc") else own))
    return out


def _heads(table: pa.Table) -> pa.Table:
    """Of a part, the first units of blocks whose key is in another block, with the first unit of all."""
    keys = np.concatenate([unpack_sorted(x) for x in table.column("keys").to_pylist()])
    row, first, words = _numbers(table, "doc", "first", "words")
    order = np.lexsort((first, row, keys))
    keys, row, first, words = keys[order], row[order], first[order], words[order]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    lead = np.repeat(head, np.diff(np.append(head, len(keys))))
    own = np.flatnonzero((np.arange(len(keys)) != lead) & ((row != row[lead]) | (first != first[lead])))
    lead = lead[own]
    columns = (words[own] & 3, row[own], first[own], words[own] >> 2, row[lead], first[lead], words[lead] >> 2)
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _MET, strict=True)], schema=_MET)


def _left_behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            row, first, words, lead_row, lead_first, lead_words = _numbers(batch, "doc", "first", "words", "lead_doc", "lead_first", "lead_words")
            columns = (words & 3, row, first, words >> 2, lead_row, lead_first, lead_words >> 2)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _MET, strict=True)], schema=_MET)


def meetings(rows: DataFrame, bits: int, least_words: int, piece_words: int) -> DataFrame:
    """kind, row, first, words, lead_row, lead_first, lead_words of the units that share a key with an
    earlier one; the lead is the first of all, and for paragraphs the first of the block besides."""
    dealt = cut(rows.mapInArrow(_deal(bits, least_words, piece_words), PACKED))
    heads = cut(dealt.where("part >= 0").groupBy("part").applyInArrow(_heads, MET).distinct())
    behind = dealt.where("part < 0").mapInArrow(_left_behind, MET)
    above = heads.select("kind", F.col("row").alias("lead_row"), F.col("first").alias("lead_first"), F.struct("lead_row", "lead_first", "lead_words").alias("above"))
    led = behind.join(above, ["kind", "lead_row", "lead_first"], "left")
    lead = F.coalesce("above", F.struct("lead_row", "lead_first", "lead_words"))
    led = led.select("kind", "row", "first", "words", lead.alias("lead")).select("kind", "row", "first", "words", "lead.*")
    return heads.unionByName(led).unionByName(behind.where(F.col("kind") == PARAGRAPH)).distinct()


def _leads(hashes: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of each run, which is the first that equals it."""
    order = np.lexsort((place, row, hashes))
    ordered = hashes[order]
    head = np.append(True, ordered[1:] != ordered[:-1])
    lead = np.empty(len(order), np.int64)
    lead[order] = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
    return lead


def _overlap(row, first, lead_row, lead_first):
    """Whether a run begins inside the one it equals."""
    return (row == lead_row) & (first - lead_first < RUN)


def _deal_runs(bits: int, batch_size: int):
    """The runs of RUN words whose marks are repeated, dealt by mark: the hash of each, and of those
    that follow each other the first place and how many they are. Runs that go with paragraphs are left out.

    Runs that follow each other with one mark are a chain. Of equal runs, a block deals its first
    one only, with the place of its chain and whether the block has others; these stay behind
    (part -1), each with that first run. So a hot passage costs a part one chain a block.
    """

    def flush(rows: list) -> Iterator[pa.RecordBatch]:
        part, doc, first, n, hashes = (np.concatenate(x) for x in zip(*rows, strict=True))
        chain = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(chain)) + (first - np.cumsum(n) + n)[chain]
        lead = _leads(hashes, doc[chain], place)
        own = lead == np.arange(len(lead))
        led = np.zeros(len(lead), bool)
        led[lead[~own]] = True
        out = []
        q = np.flatnonzero(~own)
        if len(q):
            q = q[np.lexsort((place[q], doc[chain[q]]))]
            to = lead[q]
            row, at, lead_row, lead_at, lead_chain = doc[chain[q]], place[q], doc[chain[to]], place[to], first[chain[to]]
            step = np.append(np.diff(lead_at), 1)
            broken = (np.diff(at) != 1) | (step[:-1] < 0) | (step[:-1] > 1)
            for x in (row, lead_row, lead_chain, _overlap(row, at, lead_row, lead_at)):
                broken |= x[1:] != x[:-1]
            turned = np.append(False, ~broken[:-1] & (step[1:-1] != step[:-2]))[: len(broken)]
            begin = np.flatnonzero(np.append(True, broken | turned))
            k = np.diff(np.append(begin, len(q)))
            columns = (row[begin], at[begin], k, lead_chain[begin], None, lead_row[begin], lead_at[begin], np.where(k > 1, step[begin], 1))
            out.append((-1, None, *(x if x is None else pack(x) for x in columns)))
        q = np.flatnonzero(own)
        q = q[np.argsort(part[chain[q]], kind="stable")]
        begin = np.flatnonzero(np.append(True, (np.diff(q) != 1) | (np.diff(chain[q]) != 0) | (led[q[1:]] != led[q[:-1]])))
        end = np.append(begin[1:], len(q))
        head = q[begin]
        columns = (doc[chain[head]], place[head], end - begin, first[chain[head]], led[head])
        cuts = np.append(np.flatnonzero(np.diff(part[chain[head]], prepend=-1)), len(head))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            out.append((int(part[chain[head[a]]]), hashes[q[begin[a] : end[b - 1]]].tobytes(), *(pack(x[a:b]) for x in columns), None, None, None))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _RUNS, strict=True)], schema=_RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in slices(batches):
            texts, numbers = as_bytes(batch.column("text")), batch.column("row").to_numpy()
            marks, gone = batch.column("marks").to_pylist(), batch.column("gone").to_pylist()
            for u in units(texts):
                g, least, whole = u.runs()
                if not whole.any():
                    continue
                begins = np.flatnonzero(u.place == 0)
                which = u.doc[begins].tolist()
                wanted = distinct(g[np.concatenate([b + np.array(marks[d], np.int64) for b, d in zip(begins.tolist(), which, strict=True)])])
                left = np.zeros(len(u.h) + 1, np.int64)
                for b, d in zip(begins.tolist(), which, strict=True):
                    for x in gone[d] or ():
                        left[b + x["first_word"]] += 1
                        left[b + x["first_word"] + x["n_words"]] -= 1
                gone_words = np.append(0, np.cumsum(np.cumsum(left[:-1]) > 0))
                near = np.minimum(np.searchsorted(wanted, least), len(wanted) - 1)
                q = np.flatnonzero(whole & (wanted[near] == least) & (gone_words[RUN:] - gone_words[:-RUN] < RUN))
                if not len(q):
                    continue
                new = np.flatnonzero(np.append(True, (np.diff(q) != 1) | (least[q[1:]] != least[q[:-1]]) | (u.doc[q[1:]] != u.doc[q[:-1]])))
                part = mix(least[q[new]]) >> U(64 - bits) if bits else np.zeros(len(new), np.uint64)
                rows.append((part.astype(np.int64), numbers[u.doc[q[new]]], u.place[q[new]], np.diff(np.append(new, len(q))), run_hashes(u.h, q, RUN)))
                size += len(q)
                if size >= batch_size:
                    yield from flush(rows)
                    rows, size = [], 0
        if rows:
            yield from flush(rows)

    return run


def _columns(table: pa.Table | pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [np.concatenate([unpack(x) for x in table.column(c).to_pylist()]).astype(np.int64) for c in names]


def _run_heads(table: pa.Table) -> pa.Table:
    """Of a part, the first runs of blocks with the row of the first of all: those that are not
    themselves the first, and those that others of their block follow."""
    hashes = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()])
    row, first, n, chain, led = _columns(table, "doc", "first", "n", "chain", "led")
    span = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(span)) + (first - np.cumsum(n) + n)[span]
    lead = _leads(hashes, row[span], place)
    lead_row = row[span[lead]]
    q = np.flatnonzero((lead != np.arange(len(lead))) | (led[span] == 1))
    begin = np.flatnonzero(np.append(True, (np.diff(span[q]) != 0) | (np.diff(q) != 1) | (np.diff(lead_row[q]) != 0))[: len(q)])
    k, q = np.diff(np.append(begin, len(q))), q[begin]
    columns = (row[span[q]], place[q], k, chain[span[q]], lead_row[q])
    return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in columns], schema=_HEAD)


def _runs_behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            columns = _columns(batch, "doc", "first", "n", "chain", "lead_doc", "lead_first", "step")
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], schema=_BEHIND)


def copied_runs(texts: DataFrame, bits: int) -> DataFrame:
    """row, first_word, n_words, kept_row of the words whose runs are there before; ``texts``: text,
    row, marks, gone. A run that overlaps its first occurrence is no copy."""
    dealt = cut(texts.mapInArrow(_deal_runs(bits, BATCH), RUNS))
    heads = cut(dealt.where("part >= 0").groupBy("part").applyInArrow(_run_heads, HEAD))
    behind = dealt.where("part < 0").mapInArrow(_runs_behind, BEHIND)
    # A run left behind has the first run of its first one's chain at that place; chains are short.
    to = heads.select(F.col("row").alias("lead_row"), "chain", F.col("first").alias("a"), (F.col("first") + F.col("n") - 1).alias("z"), F.col("lead_row").alias("kept_row"))
    last = F.col("lead_first") + F.col("step") * (F.col("n") - 1)
    led = behind.withColumn("last", last).join(to, ["lead_row", "chain"]).where("a <= last and z >= lead_first")
    led = led.where((F.col("kept_row") != F.col("lead_row")) | ~_overlap(F.col("row"), F.col("first"), F.col("lead_row"), F.col("lead_first")))
    # Of a span whose first runs follow each other, the piece that has this first row.
    begin, end = F.greatest("a", "lead_first"), F.least("z", "last")
    led = led.select("row", (F.col("first") + F.col("step") * (begin - F.col("lead_first"))).alias("first"), F.when(F.col("step") == 1, end - begin + 1).otherwise(F.col("n")).alias("n"), "kept_row")
    copies = heads.where("row <> lead_row").select("row", "first", "n", F.col("lead_row").alias("kept_row")).unionByName(led)
    return copies.select("row", F.col("first").alias("first_word"), (F.col("n") + RUN - 1).alias("n_words"), "kept_row")


SET = "rid long, n long, h1 long, h2 long, tokens binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingle sets of the listed paragraphs of each text."""
    names = ("rid", "n", "h1", "h2", "tokens")
    for batch in slices(batches):
        texts, wanted = as_bytes(batch.column("text")), batch.column("wanted").to_pylist()
        out: list[tuple] = []
        want = [{x["first"]: x["id"] for x in w} for w in wanted]
        for u in units(texts):
            first, n = u.spans(u.first_paragraph, 1)
            ids = [want[d].get(p) for d, p in zip(u.doc[first].tolist(), u.place[first].tolist(), strict=True)]
            keep = np.array([i is not None for i in ids], bool)
            if not keep.any():
                continue
            hashes, at = u.shingles(first[keep], n[keep])
            for i, own in zip((i for i in ids if i is not None), np.split(hashes >> U(8), at[1:]), strict=True):
                t = distinct(own)
                out.append((i, len(t), int(mix(t).sum(dtype=np.uint64).astype(np.int64)), int(mix(t ^ U(77)).sum(dtype=np.uint64).astype(np.int64)), t.tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)


def similar_paragraphs(rows: DataFrame, met: DataFrame) -> DataFrame:
    """row, first_word, n_words, kind, kept_row of the paragraphs that are not the first of their
    cluster; exact similarity within groups of colliding ones."""
    edges = met.where(F.col("kind") == PARAGRAPH)
    leads = edges.select(*[F.col(f"lead_{c}").alias(c) for c in ("row", "first", "words")])
    nodes = edges.select("row", "first", "words").unionByName(leads).distinct()
    nodes = cut(cut(nodes).withColumn("id", F.monotonically_increasing_id()))
    wanted = nodes.groupBy("row").agg(F.collect_list(F.struct("first", "id")).alias("wanted"))
    texts = rows.join(wanted.hint("merge"), F.col("number") == F.col("row")).select("text", "wanted")
    sets = cut(texts.mapInArrow(_sets, SET))
    same = ["n", "h1", "h2"]
    reps = cut(sets.groupBy(*same).agg(F.min(F.struct("rid", "tokens")).alias("x")).select(*same, "x.*"))
    rep_of = sets.select(*same, F.col("rid").alias("id")).join(reps.select(*same, F.col("rid").alias("rep")), same)
    placed = cut(nodes.join(rep_of.select("id", "rep"), "id"))
    # Paragraphs that collide have a lead in common: it is the key of their list, and in it.
    known = placed.select(F.col("row").alias("lead_row"), F.col("first").alias("lead_first"), F.col("id").alias("key"), F.col("rep").alias("lead_rep"))
    listed = cut(edges.select("row", "first", "lead_row", "lead_first").join(placed.select("row", "first", "rep"), ["row", "first"]).join(known, ["lead_row", "lead_first"]).select("key", "rep", "lead_rep").distinct())
    posted = listed.select("key", F.col("rep").alias("rid")).unionByName(listed.select("key", F.col("lead_rep").alias("rid"))).distinct()
    pairs = listed.where("rep <> lead_rep").select(F.col("rep").alias("a"), F.col("lead_rep").alias("b"))
    linked = settle(lambda: search_groups(reps, connected_components(pairs), posted, PERCENT))
    placed = cut(placed.join(linked, F.col("rep") == F.col("member"), "left").select("row", "first", "words", F.coalesce("least", "rep").alias("cluster")))
    heads = placed.groupBy("cluster").agg(F.min(F.struct("row", "first")).alias("lead"), F.count("*").alias("k")).where("k > 1")
    paragraphs = placed.join(cut(heads), "cluster").where(F.struct("row", "first") != F.col("lead"))
    return paragraphs.select("row", F.col("first").alias("first_word"), F.col("words").alias("n_words"), F.lit("paragraph").alias("kind"), F.col("lead.row").alias("kept_row"))


def repeated_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, piece_words: int = PIECE_WORDS) -> DataFrame:
    """The spans of words to remove: doc_id, row, first_word, n_words, kind, kept_doc_id, kept_row.

    Paragraphs are lines. Those of ``least_words`` words or more are compared by their sets of five
    words in a row (with fewer words, by the whole): MinHash bands, tuned for a recall of 0.9995 at a similarity of 0.75, find
    which ones collide; colliding ones are compared exactly, and those of 0.75 or more make
    clusters, of which all but the first paragraph, by row and place, go ("paragraph"). What
    repeats inside differing paragraphs is found by its pieces, sentences of ``piece_words`` words or
    more: a run of repeated pieces, with ``least_words`` words or more in them and no more than
    ``piece_words`` between two, goes but for its first occurrence ("pieces"). RUN words in a row or
    more that repeat go but for their first occurrence too, wherever they begin and end ("run"; a
    span of both is one). Runs wholly in paragraphs that go are no occurrences, nor is one that
    overlaps its first occurrence.

    Runs are found by winnowing: of each RUN words, the least hash of GRAM words inside is dealt;
    where one is repeated, the hashes of all runs that it marks are compared, so none is missed.

    ``row`` is monotonically_increasing_id in ``docs``. Null and empty texts have no spans; null
    and repeated ids are kept row by row, and equal rows are copies of each other; other columns
    are not read; an empty table gives no rows. ``docs`` should be a table or another
    deterministic plan.

    Keys are dealt packed, the first unit of each key in a block only; the others are joined to
    the first of all by that one, a join that splits hot keys. Texts move twice, to those documents that have
    colliding paragraphs and to those that have repeated marks. Equal sets are one before clusters
    are searched. Of runs, 8 bytes for each word that has a repeated mark near it are dealt, of
    equal ones in a block the first; the others are joined to what that one's chain is a copy of.
    """
    if least_words < 1 or piece_words < 1:
        raise ValueError("paragraphs and pieces have a word at least")
    rows = docs.select(column(text).alias("text"), F.monotonically_increasing_id().alias("number"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(column(text))), F.lit(0))).head()[0]
    met = settle(lambda: meetings(rows, max(0, ceil(log2(max(1, size / 17 / PART)))), least_words, piece_words))

    paragraphs = settle(lambda: similar_paragraphs(rows, met))

    # Runs of words: of the texts with repeated marks.
    marks = met.where(F.col("kind") == MARK)
    marks = marks.select("row", "first").unionByName(marks.select(F.col("lead_row").alias("row"), F.col("lead_first").alias("first")))
    gone = paragraphs.groupBy("row").agg(F.collect_list(F.struct("first_word", "n_words")).alias("gone"))
    marked = cut(marks.groupBy("row").agg(F.collect_set("first").alias("marks")).join(gone, "row", "left"))
    texts = rows.join(marked.hint("merge"), F.col("number") == F.col("row")).select("text", "row", "marks", "gone")
    bits = max(0, ceil(log2(max(1, size / 6 / PART))))
    copies = settle(lambda: copied_runs(texts, bits)).withColumn("run", F.lit(True))

    # Pieces: runs of repeated ones that follow each other.
    repeats = met.where(F.col("kind") == PIECE).select("row", "first", "words", "lead_row").distinct()
    by = Window.partitionBy("row").orderBy("first")
    # Sentences that are too short for a piece may lie between two of a run.
    begins = F.coalesce(F.col("first") - F.lag(F.col("first") + F.col("words")).over(by) > piece_words, F.lit(True))
    runs = repeats.withColumn("new", begins.cast("long")).withColumn("run", F.sum("new").over(by)).groupBy("row", "run")
    first, end = F.min("first"), F.max(F.col("first") + F.col("words"))
    runs = runs.agg(first.alias("first_word"), (end - first).alias("n_words"), F.sum("words").alias("met"), F.min("lead_row").alias("kept_row")).where(F.col("met") >= least_words)
    runs = runs.select("row", "first_word", "n_words", F.lit(False).alias("run"), "kept_row").unionByName(copies)
    # Spans that overlap are one.
    by = Window.partitionBy("row").orderBy("first_word", "n_words", "run", "kept_row")
    reached = F.max(F.col("first_word") + F.col("n_words")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("new", F.coalesce(F.col("first_word") >= reached, F.lit(True)).cast("long")).withColumn("span", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy("row", "span")
    first, end = F.min("first_word"), F.max(F.col("first_word") + F.col("n_words"))
    runs = runs.agg(first.alias("first_word"), (end - first).alias("n_words"), F.when(F.max("run"), "run").otherwise("pieces").alias("kind"), F.min("kept_row").alias("kept_row")).drop("span")
    spans = cut(paragraphs.unionByName(runs))
    names = cut(docs.select(column(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row")))
    kept = names.select(F.col("doc_id").alias("kept_doc_id"), F.col("row").alias("kept_row"))
    return spans.join(names, "row").join(kept, "kept_row").select("doc_id", "row", "first_word", "n_words", "kind", "kept_doc_id", "kept_row")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    spans = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return spans.select("doc_id", "first_word", "n_words", "kind", "kept_doc_id")
