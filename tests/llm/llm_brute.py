"""The operators by their definitions, for small inputs."""

import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=True):
    text = (text or "").translate(LOWER) if lower else text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(sets, percent=75):
    """The least index of each set's component."""
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    having = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in having[g])
        for j, k in shared.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for g in s:
            having[g].append(i)
    return [find(i) for i in range(len(sets))]


def dedup_lines(rows, n=3):
    """rows: (doc_id, text); the texts that are left."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    split = [None if t is None else t.split("\n") for _, t in rows]
    windows = defaultdict(list)
    seen = set()
    for i in order:
        if split[i] is None or rows[i] in seen:
            continue
        seen.add(rows[i])
        own = [x.strip(" \t\r") for x in split[i]]
        for p in range(len(own) - n + 1):
            if any(own[p : p + n]):
                windows[tuple(own[p : p + n])].append((i, p))
    gone = defaultdict(set)
    for places in windows.values():
        first, at = places[0]
        for i, p in places[1:]:
            gone[rows[i]] |= set(range(max(p, at + n) if i == first else p, p + n))
    return [None if s is None else "\n".join(x for k, x in enumerate(s) if k not in gone[r]) for r, s in zip(rows, split, strict=True)]


def contamination(texts, items, window=13):
    """For each text: words, hit words, items."""
    having = defaultdict(set)
    for name, t in items:
        w = plain_words(t)
        if w:
            k = min(window, len(w))
            for i in range(len(w) - k + 1):
                having[tuple(w[i : i + k])].add(name)
    sizes = {len(g) for g in having}
    out = []
    for t in texts:
        w, hit, found = plain_words(t), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if names := having.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    found |= names
        out.append((len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def targets(sizes, epochs=3):
    """sizes: {source: words}; each source's target."""
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(epochs * sizes[s] for s in capped)
        free = sum(w for s, w in weights.items() if s not in capped)
        over = {s for s, w in weights.items() if s not in capped and left / free * w >= epochs * sizes[s]}
        if not over:
            return {s: epochs * sizes[s] if s in capped else left / free * w for s, w in weights.items()}
        capped |= over
        if len(capped) == len(sizes):
            return {s: float(epochs * sizes[s]) for s in sizes}
