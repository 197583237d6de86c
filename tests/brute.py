"""Minimal dependencies by the definition."""

from itertools import combinations


def brute_fds(columns, rows, null_equals_null=True, limit=None):
    def agree(a, b):
        return a == b and (null_equals_null or a is not None)

    def holds(lhs, a):
        return all(agree(r[a], s[a]) for r, s in combinations(rows, 2) if all(agree(r[i], s[i]) for i in lhs))

    out = set()
    for a in range(len(columns)):
        minimal = []
        others = [i for i in range(len(columns)) if i != a]
        for k in range(len(others) + 1 if limit is None else min(limit, len(others)) + 1):
            for lhs in combinations(others, k):
                if not any(set(m) <= set(lhs) for m in minimal) and holds(lhs, a):
                    minimal.append(lhs)
        out |= {(frozenset(columns[i] for i in m), columns[a]) for m in minimal}
    return out
