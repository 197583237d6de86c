"""Alignment of two tokenizers over a corpus: groups of tokens that cover the same bytes, and linked token pairs."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depdelver.llm.ngram_counts import blocks
from depdelver.llm.rows import column
from depdelver.llm.textops import U, pack, pack_sorted, slices, unpack, unpack_sorted
from depdelver.session import cut

FOLDER = "/opt/tokenizers"
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Text of a block's documents that is aligned at once.
STEP_BYTES = 1 << 20
#: Linked pairs that are made at once, and characters of a longer text that are encoded at once.
LINKS, PIECE = 4_000_000, 1 << 16
#: The pattern by which A's kind of vocabulary divides texts before it merges bytes (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

ALIGNED = "block long, at int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, keys binary, docs binary, place binary, times binary, cuts binary"
_ALIGNED = pa.schema([("block", pa.int64()), ("at", pa.int32()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups", pa.string()), *((c, pa.binary()) for c in ("keys", "docs", "place", "times", "cuts"))])

#: A space between two ASCII characters that are none: tokens of either side end before it. A line's begin between such.
_BORDER = re.compile(r"(?<=[!-~]) (?=[!-~])")
_LINE = re.compile(r"(?<=[!-~]\n)(?=[!-~])")


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, the other ones as characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, file_a: str, file_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(file_a), SentencePieceProcessor(model_file=file_b)
        self.a.encode_special_tokens = True
        byte_of = _byte_of_char()
        entries = self.a.get_vocab()
        bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            bytes_a[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        special = set(self.a.get_added_tokens_decoder())
        self.latin = Encoding("a", pat_str=PATTERN, mergeable_ranks={x: i for i, x in enumerate(bytes_a) if i not in special}, special_tokens={})
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.b.id_to_piece(list(range(self.b.get_piece_size()))))]
        (self.size_a, self.from_a, self.raw_a), (self.size_b, self.from_b, self.raw_b) = map(_table, (bytes_a, bytes_b))

    def ids_a(self, text: str) -> list[int]:
        """By the faster of two libraries with the same vocabulary where all characters are below U+0240, whose
        kinds no two versions of their tables tell apart; else by the one whose file it is."""
        if np.frombuffer(text.encode(), np.uint8).max(initial=0) < 0xC9:
            return self.latin.encode_ordinary(text)
        return self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of space and piece by A, and of the piece by B, which adds the space."""
        long_ = {i: self.by_lines(x) for i, x in enumerate(pieces) if len(x) > 2 * PIECE}
        ids_a = [long_[i][0] if i in long_ else self.ids_a(" " + x) for i, x in enumerate(pieces)]
        ids_b = self.b.encode(["" if i in long_ else x for i, x in enumerate(pieces)], num_threads=1)
        return ids_a, [long_[i][1] if i in long_ else x for i, x in enumerate(ids_b)]

    def by_lines(self, piece: str) -> tuple[list[int], list[int]]:
        """``encode`` of a long one: tokens of either side end at a line feed between two ASCII characters."""
        lines = _LINE.split(piece)
        ids_a = [i for k, x in enumerate(lines) for i in self.ids_a(x if k else " " + x)]
        # A line feed before a line keeps B from putting a space there; it and the space are two tokens.
        ids_b = [i for k, x in enumerate(lines) for i in (self.b.encode("\n" + x)[2:] if k else self.b.encode(x))]
        return ids_a, ids_b


def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token its size, and where it begins in the bytes of all."""
    size = np.array([len(x) for x in tokens], np.int64)
    return size, np.cumsum(size) - size, np.frombuffer(b"".join(tokens), np.uint8)


@lru_cache(2)
def tokenizers(file_a: str, file_b: str) -> Tokenizers:
    return Tokenizers(file_a, file_b)


def pieces(text: str) -> list[str]:
    """A text in pieces that are encoded by themselves as they are in the text: they end where the next one's space begins."""
    out, at = [], 0
    while len(text) - at > 2 * PIECE:
        border = _BORDER.search(text, at + PIECE)
        if not border:
            break
        out.append(text[at : border.start()])
        at = border.end()
    return [*out, text[at:]]


def _spelled(ids: np.ndarray, size: np.ndarray, start: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """The bytes of some tokens, one after the other."""
    n = size[ids]
    return raw[np.repeat(start[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())]


def streams(t: Tokenizers, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of all texts by A and by B, and how many bytes of tokens each text has (0: it has no tokens)."""
    parts = [pieces(x.decode()) if x else [] for x in texts]
    of = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    flat = [x for p in parts for x in p]
    wanted = np.array([len(x.encode()) + 1 for x in flat], np.int64)
    sides = []
    good = np.ones(len(flat), bool)
    for lists, size in zip(t.encode(flat), (t.size_a, t.size_b), strict=True):
        ids = np.fromiter(chain.from_iterable(lists), np.int64, sum(map(len, lists)))
        piece = np.repeat(np.arange(len(flat)), [len(x) for x in lists])
        good &= np.bincount(piece, size[ids], len(flat)).astype(np.int64) == wanted
        sides.append((ids, piece))
    # Of the right length: held against the text, byte by byte.
    text = np.frombuffer(b"".join(b" " + x.encode() for x, g in zip(flat, good.tolist(), strict=True) if g), np.uint8)
    place = np.repeat(np.flatnonzero(good), wanted[good])
    for (ids, piece), table in zip(sides, ((t.size_a, t.from_a, t.raw_a), (t.size_b, t.from_b, t.raw_b)), strict=True):
        good[place[_spelled(ids[good[piece]], *table) != text]] = False
        if not good[place].all():  # the rest is held against the rest
            text, place = text[good[place]], place[good[place]]
    whole = np.ones(len(texts), bool)
    whole[of[~good]] = False
    a, b = (ids[whole[of[piece]]] for ids, piece in sides)
    size = np.bincount(of, wanted, len(texts)).astype(np.int64) if len(flat) else np.zeros(len(texts), np.int64)
    return a, b, np.where(whole, size, 0)


def merge(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where both sides' rising token ends meet, and the group of each token: two pointers, moved by whole arrays."""
    at = np.searchsorted(ends_b, ends_a)  # the first end of B that is not before A's
    meet = ends_b[np.minimum(at, len(ends_b) - 1)] == ends_a if len(ends_b) else np.zeros(0, bool)
    in_b = np.zeros(len(ends_b), bool)
    in_b[at[meet]] = True
    return ends_a[meet], np.cumsum(meet) - meet, np.cumsum(in_b) - in_b


@lru_cache(1)
def _digits(n: int, last: int) -> np.ndarray:
    """Every number below ``n`` in decimal digits and a byte after them, filled up with zeros before it."""
    out = np.zeros((n, 6), np.uint8)
    text = np.char.mod("%d", np.arange(n)).astype("S5")
    out[:, :5] = text.view(np.uint8).reshape(n, 5)
    out[:, 5] = last
    return out


def group_texts(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, first: np.ndarray) -> list[str]:
    """Of each text, its groups as ``a1,a2|b1;a3|b2,b3``; ``first``: the number of each text's first group, and of all."""
    side = np.concatenate([2 * group_a, 2 * group_b + 1])
    order = np.argsort(side, kind="stable")
    side = side[order]
    cells = _digits(1 << 16, ord(","))[np.concatenate([a, b])[order]]
    last = np.append(side[1:] != side[:-1], True)[: len(side)]
    cells[last, 5] = np.where(side[last] & 1, ord(";"), ord("|"))
    start = np.searchsorted(side, 2 * first)
    filled = np.append(0, np.cumsum((cells != 0).sum(axis=1)))
    raw = cells[cells != 0].tobytes()
    return [raw[filled[i] : max(filled[i], filled[j] - 1)].decode() for i, j in zip(start[:-1], start[1:], strict=True)]


def _unique(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(times, first) if len(first) else times


def links(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct linked (text, A id, B id), packed 32, 16 and 16 bits, in order, and how many links each is.

    ``text``: of each group. All tokens of a group are linked; they are made LINKS at a time, and
    of a larger group by its distinct ids.
    """
    n = len(text)
    n_a, n_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    from_a, from_b = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
    made = np.append(0, np.cumsum(n_a * n_b))
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    keys, times = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    g = 0
    while g < n:
        end = max(g + 1, int(np.searchsorted(made, made[g] + LINKS, "right")) - 1)
        if end == g + 1 and made[end] - made[g] > LINKS:
            x, xs = np.unique(a[from_a[g] : from_a[g + 1]], return_counts=True)
            y, ys = np.unique(b[from_b[g] : from_b[g + 1]], return_counts=True)
            step = max(1, LINKS // len(y))
            for i in range(0, len(x), step):
                keys.append(((U(int(text[g])) << U(32)) | (x[i : i + step, None] << U(16)) | y).ravel())
                times.append((xs[i : i + step, None] * ys).ravel())
        else:
            size = (n_a * n_b)[g:end]
            within = np.arange(made[end] - made[g]) - np.repeat(made[g:end] - made[g], size)
            wide = np.repeat(n_b[g:end], size)
            i = np.repeat(from_a[g:end], size) + within // wide
            j = np.repeat(from_b[g:end], size) + within % wide
            found = (np.repeat(text[g:end], size).astype(np.uint64) << U(32)) | (a[i] << U(16)) | b[j]
            one = _unique(found, np.ones(len(found), np.int64))
            keys.append(one[0])
            times.append(one[1])
        g = end
    return _unique(np.concatenate(keys), np.concatenate(times))


def _steps(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, x in enumerate(texts):
        if i > at and size + len(x or b"") > STEP_BYTES:
            yield at, i
            at, size = i, 0
        size += len(x or b"")
    yield at, len(texts)


def _align_texts(t: Tokenizers, texts: list[bytes | None]) -> tuple[list, np.ndarray, np.ndarray]:
    """n_a, n_b, n_groups, n_links and groups of each text; and ``links``."""
    a, b, size = streams(t, texts)
    ends_a, ends_b, borders = np.cumsum(t.size_a[a]), np.cumsum(t.size_b[b]), np.append(0, np.cumsum(size))
    common, group_a, group_b = merge(ends_a, ends_b)
    first = np.searchsorted(common, borders, "right")
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    counts = lambda ends: np.diff(np.searchsorted(ends, borders, "right"))
    linked = np.append(0, np.cumsum(np.bincount(group_a, minlength=len(common)) * np.bincount(group_b, minlength=len(common))))
    rows = [counts(ends_a), counts(ends_b), np.diff(first), np.diff(linked[first]), group_texts(a, b, group_a, group_b, first)]
    return rows, *links(a, b, group_a, group_b, text)


def _align(file_a: str, file_b: str):
    """A row for each document of a block with its groups, and one (``at`` -1) with the block's distinct linked pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(file_a, file_b)
        for block, ids, texts in blocks(batches):
            found, times = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for at, end in _steps(texts):
                rows, keys, n = _align_texts(t, texts[at:end])
                own = [[block] * (end - at), range(at, end), ids[at:end], *rows, *[[None] * (end - at)] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(own, _ALIGNED, strict=True)], schema=_ALIGNED)
                found.append(keys + (U(at) << U(32)))
                times.append(n)
            found, times = np.concatenate(found), np.concatenate(times)
            keys, place, docs = np.unique(found & U(0xFFFFFFFF), return_inverse=True, return_counts=True)
            cuts = np.searchsorted(found, np.arange(len(texts) + 1).astype(np.uint64) << U(32))
            row = [block, -1, *[None] * 6, pack_sorted(keys), pack(docs), pack(place), pack(times), pack_sorted(cuts.astype(np.uint64))]
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _ALIGNED, strict=True)], schema=_ALIGNED)

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, key, docs): the distinct pairs of each block, and how many of its documents have each."""
    for batch in slices(batches, 1):
        for block, keys, docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            k, n = unpack_sorted(keys).astype(np.int64), unpack(docs).astype(np.int64)
            for at in range(0, len(k), 100_000):
                part = k[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(part), pa.array(n[at : at + 100_000])], ["block", "key", "docs"])


class Alignment:
    """The aligned corpus: a table of documents and blocks, from which pair counts and documents' figures come."""

    def __init__(self, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", folder: str = FOLDER, file_a: str = FILE_A, file_b: str = FILE_B, keep: Callable[[Column], Column] = lambda groups: groups):
        """Encodes space and text by A (a byte-level vocabulary) and text by B (pieces), and aligns them.

        Byte offsets where a token of A and one of B end cut both into groups; all pairs of tokens
        of a group are linked. ``folder`` has both files, at the same path on every executor.
        ``keep``: what is kept of a document's groups, which are text, ``a1,a2|b1;a3|b2,b3``.
        Special tokens' strings inside texts are plain text. A text that is null or empty, or
        whose tokens' bytes are not the space and the text, has no tokens: zeros and no groups.
        Repeated rows are documents each; an id may be null. An empty table gives no rows. Other
        columns are not read. A run of a text without a space between ASCII characters, or a line feed
        between such, is encoded as a whole, and is all that has to fit a task. Rows are numbered by
        monotonically_increasing_id, so ``docs`` should be a table or another deterministic plan.
        """
        a, b = f"{folder}/{file_a}", f"{folder}/{file_b}"
        rows = docs.select(column(doc_id).cast("long"), column(text).cast("string"), F.monotonically_increasing_id())
        self.table = cut(rows.mapInArrow(_align(a, b), ALIGNED).withColumn("groups", keep(F.col("groups"))))

    def block_pairs(self) -> DataFrame:
        """(block, key, docs): a hot pair is one row a block of documents."""
        return self.table.where("at = -1").select("block", "keys", "docs").mapInArrow(_pairs, "block long, key long, docs long")

    def pair_counts(self) -> DataFrame:
        """(key, a, b, documents, best_of_a, best_of_b): how many documents hold a pair linked, and whether no other pair of its A, and of its B, is in more."""
        counts = self.block_pairs().groupBy("key").agg(F.sum("docs").alias("documents"))
        counts = cut(counts.select("key", F.shiftright("key", 16).cast("int").alias("a"), F.col("key").bitwiseAND(F.lit(0xFFFF)).cast("int").alias("b"), "documents"))
        most = lambda side: counts.groupBy(side).agg(F.max("documents").alias(f"most_{side}"))
        found = counts.join(most("a"), "a").join(most("b"), "b")
        return found.select("key", "a", "b", "documents", *[(F.col("documents") == F.col(f"most_{x}")).alias(f"best_of_{x}") for x in "ab"])

    def documents(self) -> DataFrame:
        """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair no other one of its A is more frequent than), count_sum (of its links' counts), groups."""
        totals = self.block_pairs().select("block", "key").join(self.pair_counts().select("key", "documents", "best_of_a"), "key")
        schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
        return self.table.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(_finish, schema)


def _finish(table: pa.Table, totals: pa.Table) -> pa.Table:
    """The documents of a block, with the sums of their links' counts."""
    at = table.column("at").to_numpy()
    row = int(np.flatnonzero(at == -1)[0])
    place, times = (unpack(table.column(c)[row].as_py()).astype(np.int64) for c in ("place", "times"))
    cuts = unpack_sorted(table.column("cuts")[row].as_py()).astype(np.int64)
    order = np.argsort(totals.column("key").to_numpy(), kind="stable")
    documents, best = totals.column("documents").to_numpy()[order], totals.column("best_of_a").combine_chunks().to_numpy(zero_copy_only=False)[order]
    per = lambda x: np.diff(np.append(0, np.cumsum(x))[cuts])
    sums = per(times * documents[place]), per(times * best[place]) if len(place) else np.diff(cuts)
    docs = table.filter(pa.array(at >= 0))
    own = docs.column("at").to_numpy()
    out = [docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [pa.array(sums[1][own].astype(np.int64)), pa.array(sums[0][own].astype(np.int64)), docs.column("groups")]
    return pa.table(out, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    digest = lambda groups: F.when(groups == "", "").otherwise(F.sha2(groups, 256))
    found = Alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=digest).documents()
    return found.withColumnRenamed("groups", "groups_sha256")
