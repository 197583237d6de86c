"""Vectorised word hashing for Python operators.

Texts are handled as UTF-8 bytes, a couple of megabytes at a time. A word's hash is a
polynomial over its bytes modulo 2**64 taken from prefix sums, so that a block costs a few
numpy passes whatever its words are. Nothing is cut off: a text longer than a block is
hashed piece by piece, at word boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK = 1 << 20
_B = 0x9E3779B97F4A7C15 | 1
_BINV = pow(_B, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_POWERS: dict[str, np.ndarray] = {}

#: Words of `[^\x20\x09-\x0D]+`.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` in lower-cased text: digits, a-z, not ASCII.
PUNCT = np.zeros(256, bool)
PUNCT[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the base and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        m = max(n, BLOCK + 4096)
        for key, base in (("up", _B), ("down", _BINV)):
            a = np.full(m, base, dtype=np.uint64)
            a[0] = 1
            _POWERS[key] = np.multiply.accumulate(a)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def hash_buffer(raw: bytes, seps: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every word in ``raw``: first byte, end, hash."""
    buf = np.frombuffer(raw, np.uint8)
    inside = ~seps[buf]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64)
    up, down = _powers(len(buf) + 1)
    table = _BYTE[_LOWER] if lower else _BYTE
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(table[buf] * up[: len(buf)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return starts, ends, mix(h + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def pieces(text: bytes, seps: np.ndarray) -> Iterator[bytes]:
    """``text`` in pieces of about BLOCK bytes that end at separators."""
    at, n = 0, len(text)
    view = np.frombuffer(text, np.uint8)
    while at < n:
        end = min(n, at + BLOCK)
        while end < n:
            found = np.flatnonzero(seps[view[end : end + 4096]])
            if len(found):
                end += int(found[0])
                break
            end = min(n, end + 4096)
        yield text[at:end]
        at = end


def word_blocks(texts: list[bytes | None], seps: np.ndarray = SPACES, lower: bool = True, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of consecutive texts: (first, end, word hashes, where each text's words start and the last's end).

    Null and empty texts have no words.
    """
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or b"") <= limit):
            size += len(texts[j] or b"") + 1
            j += 1
        if size > limit + 1:  # one long text
            parts = [hash_buffer(p, seps, lower)[2] for p in pieces(texts[i] or b"", seps)]
            h = np.concatenate(parts) if parts else np.empty(0, np.uint64)
            yield i, j, h, np.array([0, len(h)])
        else:
            raw = b" ".join([t or b"" for t in texts[i:j]])
            at = np.cumsum([0, *(len(t or b"") + 1 for t in texts[i:j])])
            starts, _, h = hash_buffer(raw, seps, lower)
            yield i, j, h, np.searchsorted(starts, at)
        i = j


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` consecutive word hashes, those across texts included."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out *= U(0xFF51AFD7ED558CCD)
        out += h[i : i + m]
    return mix(out + U(n))


def window_hash(h: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """The hashes that ``grams`` gives, of the runs from ``at`` only."""
    out = np.zeros(len(at), np.uint64)
    for i in range(words):
        out *= U(0xFF51AFD7ED558CCD)
        out += h[at + i]
    return mix(out + U(words))


def run_hashes(h: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """Hashes of the runs of ``words`` word hashes from ``at``, in the same few passes whatever ``words`` is."""
    up, down = _powers(len(h) + 1)
    sums = np.empty(len(h) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[at + words] - sums[at]) * down[at] + U(words))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def pack(x: np.ndarray) -> bytes:
    """Whole numbers, the first bytes of all, then the second ones and so on, compressed."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + len(x).to_bytes(8, "little") + squeeze(planes.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    width, n = blob[0], int.from_bytes(blob[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(unsqueeze(blob[9:]), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unsqueeze(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending whole numbers by their differences."""
    return pack(np.diff(x, prepend=U(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that few texts are held twice."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The texts of an Arrow column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()
