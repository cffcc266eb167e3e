"""Plain-Python versions of the operators, for small tables."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def folded(text):
    return words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text, size):
    w = folded(text)
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def least_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def repeats_removed(texts, window):
    """Per text: its words and whether each goes."""
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((w, gone))
    return out


def fitting(total, limit, penalties):
    """Least cost of windows over cuts at the places that have a penalty, by trying all."""
    best = [0.0] + [float("inf")] * total
    for j in range(1, total + 1):
        for i in range(max(0, j - limit), j):
            best[j] = min(best[j], best[i] + limit - (j - i) + (penalties.get(j, float("inf")) if j < total else 0))
    return best[total]
