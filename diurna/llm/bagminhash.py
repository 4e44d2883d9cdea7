"""Signatures for weighted Jaccard similarity (bag minwise hashing).

For each element and each interval of the discretised weight axis there is a
Poisson process of points (time, place on the axis, component), seeded by the
element and the interval alone. A bag meets the points whose place is below the
element's weight, and a signature component is its earliest time. Two bags agree
in a component with probability equal to their weighted Jaccard similarity, so
the estimate is unbiased.

The axis is halved hierarchically: (0, 1], (1, 2], (2, 4], (4, 8], ... An
interval below the weight is met as a whole. In the one that holds the weight,
the bits of a point's place are the descent through its halves. Points come in
time order, and only those up to a bound are made: for a bag of total weight W,
about m log m points settle all m components however long the text is.
"""

from __future__ import annotations

import numpy as np

from diurna.llm.text import mixed
from diurna.session import ship_by_value

_STEP = 0x9E3779B97F4A7C15
_OTHER = 0xA0761D6478BD642F


def _times(count: int, factor: int) -> np.uint64:
    return np.uint64(count * factor & 0xFFFFFFFFFFFFFFFF)


def bags(rows: np.ndarray, hashes: np.ndarray):
    """(row, element, multiplicity) of rows' elements; rows in ascending order."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(rows)))
    return rows[at], hashes[at], counts


def _intervals(rows, elements, counts):
    """(row, seed, length, part met) of every weight interval a bag reaches."""
    parts = []
    low, length, level = 0, 1, 0
    while len(rows):
        seed = mixed(elements + _times(level, _OTHER))
        parts.append((rows, seed, np.full(len(rows), length), np.minimum(counts - low, length)))
        low += length
        if level:
            length *= 2
        level += 1
        more = counts > low
        rows, elements, counts = rows[more], elements[more], counts[more]
    if not parts:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none
    return tuple(np.concatenate(column) for column in zip(*parts))


def _earliest(rows, seed, length, met, bound, components, times):
    """Lower ``times`` by every point up to its row's time bound."""
    at = np.zeros(len(rows))
    step = 0
    while len(rows):
        draw = mixed(seed + _times(2 * step, _STEP))
        uniform = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        at = at - np.log(uniform) / length
        live = at <= bound[rows]
        rows, seed, length, met, at = rows[live], seed[live], length[live], met[live], at[live]
        place = mixed(seed + _times(2 * step + 1, _STEP))
        inside = (place & (length - 1).astype(np.uint64)).astype(np.int64) < met
        component = ((place >> np.uint64(32)) * np.uint64(components)) >> np.uint64(32)
        slot = rows[inside] * components + component[inside].astype(np.int64)
        np.minimum.at(times, slot, at[inside])
        step += 1


def signatures(rows, elements, counts, row_count: int, components: int) -> np.ndarray:
    """row_count x components numbers; a row without elements has zeros."""
    total = np.bincount(rows, counts, row_count)
    some = total > 0
    intervals = _intervals(rows, elements, counts.astype(np.int64))
    times = np.full(row_count * components, np.inf)
    reach = np.log(components) + 3.0
    open_rows = some.copy()
    while open_rows.any():
        bound = np.where(open_rows, components * reach / np.maximum(total, 1), 0.0)
        wanted = open_rows[intervals[0]]
        _earliest(*[column[wanted] for column in intervals], bound, components, times)
        open_rows = some & np.isinf(times.reshape(row_count, components)).any(axis=1)
        reach *= 2
    out = mixed(times.view(np.uint64)).reshape(row_count, components)
    out[~some] = 0
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One key per band of consecutive components; equal only for the same band."""
    rows, components = signature.shape
    size = components // bands
    parts = signature[:, : bands * size].reshape(rows, bands, size)
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (rows, 1))
    for i in range(size):
        keys = mixed(keys ^ parts[:, :, i]) + np.uint64(_STEP)
    return keys.view(np.int64)


def similarity(a: tuple, b: tuple) -> float:
    """Weighted Jaccard of two bags given as (sorted elements, multiplicities)."""
    total = int(a[1].sum() + b[1].sum())
    _, left, right = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][left], b[1][right]).sum())
    return both / (total - both) if total > both else 0.0


ship_by_value(__name__)
