"""Plain-Python versions of the corpus operators, for small inputs."""

from __future__ import annotations

import hashlib
from collections import Counter


def words(text):
    return (text or "").encode().split()


def bag(tokens, size=5):
    if not tokens:
        return Counter()
    return Counter(tuple(tokens[i : i + size]) for i in range(max(1, len(tokens) - size + 1)))


def jaccard(a, b):
    both = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


def classes(docs, similarity=0.8):
    """{doc_id: smallest id of its near-duplicate class} from all pairs."""
    bags = {i: bag(words(t)) for i, t in docs}
    parent = {i: i for i in bags}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(bags)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if bags[a] and bags[b] and jaccard(bags[a], bags[b]) >= similarity:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def without_repeats(docs, span, split, join):
    """[(id, units, removed units, runs, sha256)] of units in repeated windows."""
    units = [(i, split(t)) for i, t in docs]
    seen = Counter(
        tuple(u[k : k + span]) for _, u in units for k in range(len(u) - span + 1)
    )
    out = []
    for i, u in units:
        gone = [False] * len(u)
        for k in range(len(u) - span + 1):
            if seen[tuple(u[k : k + span])] > 1:
                gone[k : k + span] = [True] * span
        kept = join([x for x, g in zip(u, gone) if not g])
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(u), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def leaks(docs, items, similarity=0.8):
    """{(doc_id, item_id)} with a window as long as the item that is similar enough."""
    out = set()
    for item, text in items:
        own = (text or "").lower().split()
        if not own:
            continue
        for doc, text in docs:
            there = (text or "").lower().split()
            for k in range(max(1, len(there) - len(own) + 1)):
                window = there[k : k + len(own)]
                if window and jaccard(bag(window), bag(own)) >= similarity:
                    out.add((doc, item))
                    break
    return out
