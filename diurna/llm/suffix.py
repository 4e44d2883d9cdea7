"""Suffix sorting by linear grouping (Lyndon groups).

Suffixes start grouped by first symbol. Groups are settled from the greatest
down. The nearest earlier suffix of a smaller group, the previous-smaller
pointer, is the suffix whose known prefix the settled one continues: it leaves
its group for one just above, further up the more often in a row the settled
prefix continues it. When every group is settled, the suffixes of a group share
their longest Lyndon prefix. One pass from the least suffix up then emits each
group's order: a suffix takes the next place of its group when the suffix behind
its Lyndon prefix has its place. Nothing is renamed and sorted again.
"""

from __future__ import annotations

import numpy as np

from diurna.session import ship_by_value


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions of ``symbols`` in the order of the suffixes that start there."""
    size = len(symbols)
    first = np.argsort(symbols, kind="stable")
    ranked = symbols[first]
    head = np.zeros(size, np.int64)
    change = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))[: size or None]
    lengths = np.diff(np.append(change, size))
    head[first] = np.repeat(change, lengths)
    place = np.empty(size, np.int64)
    place[first] = np.arange(size)
    order, group, place = first.tolist(), head.tolist(), place.tolist()
    extent = dict(zip(change.tolist(), lengths.tolist()))
    smaller = [-1] * size

    end = size
    while end > 0:
        start = group[order[end - 1]]
        continued: dict[int, int] = {}
        for i in sorted(order[start:end]):
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                continued[p] = continued.get(p, 0) + 1
        end = start
        leaving: dict[int, list[tuple[int, int]]] = {}
        for p, times in continued.items():
            leaving.setdefault(group[p], []).append((times, p))
        for old, moves in leaving.items():
            moves.sort()
            slot = old + extent[old] - len(moves)
            extent[old] -= len(moves)
            last = 0
            for times, p in moves:
                other, here = order[slot], place[p]
                order[here], place[other] = other, here
                order[slot], place[p] = p, slot
                if times != last:
                    last, new = times, slot
                    extent[new] = 0
                group[p] = new
                extent[new] += 1
                slot += 1

    placed = [False] * size
    free = list(range(size))
    behind = size
    for rank in range(-1, size):
        if rank >= 0:
            behind = order[rank]
        p = behind - 1
        while p >= 0 and not placed[p]:
            placed[p] = True
            slot = free[group[p]]
            free[group[p]] = slot + 1
            order[slot] = p
            p = smaller[p]
    return np.array(order, np.int64)


ship_by_value(__name__)
