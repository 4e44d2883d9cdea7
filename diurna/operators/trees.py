"""Regression trees, many at a time, as array operations.

Features are binned once, and all trees of a forest grow together, level by level, from
one histogram of sums and weights per open node, or from its sorted rows once nodes are
small. Boosting uses the same step for one tree a round. This is one task's part: all
rows of a small table, or of one node of a larger one; the rest is Spark's
(``diurna.plans.modeling``, ``diurna.plans.growth``).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

from diurna.session import ship_by_value

BINS = 64
# Cells of the histograms of one growing step, and rows times trees in it.
STEP_CELLS = 1 << 23
# Rows that walk down a tree together, and levels between looks at who has arrived.
SCORE_ROWS = 1 << 13
LEVELS = 4


@dataclass(frozen=True)
class ForestPoint:
    """Bagged trees on all features; a depth of None has no limit."""

    name: str
    max_depth: int | None
    min_leaf: int
    trees: int = 300

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int) -> Ensemble:
        edges, codes = binned(x)
        rng, parts = np.random.default_rng(seed), []
        step = max(1, STEP_CELLS // (max(1, len(y)) * x.shape[1] * BINS // 2 + 1))
        for at in range(0, self.trees, step):
            some = min(step, self.trees - at)
            # Draws with replacement, as a weight per row and tree.
            drawn = rng.multinomial(len(y), np.full(len(y), 1 / len(y)), some)
            tree, row = np.nonzero(drawn)
            parts.append(
                grown(
                    codes[row], y[row], drawn[tree, row].astype(float), tree, some,
                    self.max_depth, self.min_leaf, 0.0,
                )
            )
        return Ensemble(edges, joined(parts), 0.0, 1.0 / self.trees)


@dataclass(frozen=True)
class BoostedPoint:
    """Gradient boosting of squared error with an L2 term on the leaves."""

    name: str
    max_depth: int
    learning_rate: float
    min_child: float
    rounds: int = 300
    l2: float = 1.0

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int) -> Ensemble:
        edges, codes = binned(x)
        ones, single = np.ones(len(y)), np.zeros(len(y), np.int64)
        start = float(y.mean())
        at, parts = np.full(len(y), start), []
        for _ in range(self.rounds):
            tree = grown(
                codes, y - at, ones, single, 1, self.max_depth, self.min_child, self.l2
            )
            parts.append(tree)
            at = at + self.learning_rate * tree.values(codes, np.zeros(1, np.int64))[:, 0]
        return Ensemble(edges, joined(parts), start, self.learning_rate)


@dataclass
class Nodes:
    """Trees as arrays over nodes; a leaf's feature is -1. Rows with code <= cut go left."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def values(self, codes: np.ndarray, roots: np.ndarray) -> np.ndarray:
        """Leaf value of each row (down) in each tree (across)."""
        node = np.broadcast_to(roots, (len(codes), len(roots))).copy()
        every = np.arange(len(codes))[:, None]
        while True:
            feature = self.feature[node]
            inner = feature >= 0
            if not inner.any():
                return self.value[node]
            goes_left = codes[every, np.maximum(feature, 0)] <= self.cut[node]
            node = np.where(inner, np.where(goes_left, self.left[node], self.right[node]), node)

    @cached_property
    def paths(self) -> tuple[np.ndarray, ...]:
        """(feature, cut, left, leaf) for ``sums``: a leaf is its own left child, and no
        code is above its cut."""
        leaf = self.feature < 0
        itself = np.arange(len(self.feature))
        return (
            np.where(leaf, 0, self.feature).astype(np.intp),
            np.where(leaf, BINS, self.cut).astype(np.intp),
            np.where(leaf, itself, self.left).astype(np.intp),
            leaf,
        )

    def sums(self, codes: np.ndarray) -> np.ndarray:
        """Sum of the leaf values of all trees for each row.

        A right child lies next to the left one. Rows that have reached a leaf are put
        aside every few levels.
        """
        feature, cut, left, leaf = self.paths
        flat, width = codes.ravel(), codes.shape[1]
        first = np.arange(len(codes)) * width
        total = np.zeros(len(codes))
        for root in self.roots:
            reached = np.full(len(codes), root, np.intp)
            rows, node, begin = None, reached, first
            while True:
                for _ in range(LEVELS):
                    code = flat.take(begin + feature.take(node))
                    node = left.take(node) + (code > cut.take(node))
                if rows is None:
                    reached = node
                else:
                    reached[rows] = node
                going = np.flatnonzero(~leaf.take(node))
                if not len(going):
                    break
                rows = going if rows is None else rows[going]
                node, begin = node[going], begin[going]
            total += self.value.take(reached)
        return total


@dataclass
class Ensemble:
    """``start`` plus ``rate`` times the sum of all trees."""

    edges: list[np.ndarray]
    nodes: Nodes
    start: float
    rate: float

    def parts(self) -> tuple:
        """Plain arrays and numbers, to be stored; ``Ensemble.of`` reads them."""
        n = self.nodes
        nodes = (n.roots, n.feature, n.cut, n.left, n.right, n.value)
        return self.edges, nodes, self.start, self.rate

    @staticmethod
    def of(parts: tuple) -> Ensemble:
        edges, nodes, start, rate = parts
        return Ensemble(edges, Nodes(*nodes), start, rate)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Tree by tree, a block of rows at a time: both stay in the processor's cache."""
        codes = coded(x, self.edges)
        total = np.zeros(len(x))
        if codes.shape[1]:
            for at in range(0, len(x), SCORE_ROWS):
                block = np.ascontiguousarray(codes[at : at + SCORE_ROWS])
                total[at : at + SCORE_ROWS] = self.nodes.sums(block)
        else:
            total += self.nodes.value[self.nodes.roots].sum()
        return self.start + self.rate * total


def binned(x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(cut values per feature, codes): at most ``BINS`` bins, cuts between values."""
    edges = []
    for column in x.T:
        values = np.unique(column)
        middles = (values[1:] + values[:-1]) / 2
        if len(middles) >= BINS:
            marks = np.quantile(column, np.arange(1, BINS) / BINS, method="lower")
            at = np.searchsorted(values, np.unique(marks))
            middles = middles[at[at < len(middles)]]
        edges.append(middles)
    return edges, coded(x, edges)


def coded(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    columns = [np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)]
    return np.stack(columns, axis=1) if columns else np.zeros((len(x), 0), np.int64)


def grown(
    codes: np.ndarray,
    target: np.ndarray,
    weight: np.ndarray,
    tree: np.ndarray,
    trees: int,
    max_depth: int | None,
    min_weight: float,
    l2: float,
) -> Nodes:
    """Grow ``trees`` trees level by level; row i belongs to tree ``tree[i]``.

    A node is cut where the sum of squared totals over weight plus ``l2`` gains most,
    if both sides weigh ``min_weight``; the first feature and lowest cut of equals.
    """
    features = codes.shape[1]
    feature = [np.full(trees, -1)]
    cut, left, right = [np.zeros(trees, np.int64)], [np.zeros(trees, np.int64)], []
    right.append(np.zeros(trees, np.int64))
    sums = np.bincount(tree, weight * target, trees)
    weights = np.bincount(tree, weight, trees)
    value = [sums / np.maximum(weights + l2, 1e-300)]
    first, size, depth = 0, trees, 0
    # Gains are counted in these units, so that equal ones stay equal.
    unit = 1e-9 * max(1.0, np.abs(target).max(initial=0.0)) ** 2
    node, rows = tree.astype(np.int64), np.arange(len(target))
    while len(rows) and (max_depth is None or depth < max_depth) and features:
        order = np.argsort(_short(node[rows] - first, size), kind="stable")
        rows = rows[order]
        local = node[rows] - first
        # Few rows a node: sorting them costs less than a histogram of every bin.
        search = by_order if size * BINS > len(rows) else by_histogram
        gains, best = search(codes, target, weight, rows, local, size, min_weight, l2, unit)
        opened = gains > 0
        chosen = np.flatnonzero(opened)
        if not len(chosen):
            break
        child = np.cumsum(opened) * 2 - 2 + first + size
        f, c = best // BINS, best % BINS
        feature[-1][chosen], cut[-1][chosen] = f[chosen], c[chosen]
        left[-1][chosen], right[-1][chosen] = child[chosen], child[chosen] + 1
        keep = opened[local]
        rows, local = rows[keep], local[keep]
        goes_left = codes[rows, f[local]] <= c[local]
        node[rows] = child[local] + ~goes_left
        first, size, depth = first + size, 2 * len(chosen), depth + 1
        below = node[rows] - first
        sums = np.bincount(below, weight[rows] * target[rows], size)
        weights = np.bincount(below, weight[rows], size)
        value.append(sums / np.maximum(weights + l2, 1e-300))
        for column, empty in ((feature, -1), (cut, 0), (left, 0), (right, 0)):
            column.append(np.full(size, empty))
    parts = [np.concatenate(c) for c in (feature, cut, left, right, value)]
    return Nodes(np.arange(trees), *parts)


def gain_of(left_w, left_s, all_w, all_s, min_weight: float, l2: float, unit: float) -> np.ndarray:
    """What a cut gains, in whole units; -inf where a side is too light."""
    right_w, right_s = all_w - left_w, all_s - left_s
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_s**2 / (left_w + l2) + right_s**2 / (right_w + l2)
        gain -= all_s**2 / (all_w + l2)
    fine = (left_w >= max(min_weight, 1e-9)) & (right_w >= max(min_weight, 1e-9))
    return np.where(fine, np.rint(gain / unit), -np.inf)


def histogram(codes, weight, total, local, size: int) -> np.ndarray:
    """Weights (None: 1 a row) and totals per node, feature and bin: (2, size, features, BINS)."""
    cells, begin = np.empty((2, size, codes.shape[1], BINS)), local * BINS
    for f in range(codes.shape[1]):
        at = begin + codes[:, f]
        for out, v in zip(cells, (weight, total)):
            out[:, f] = np.bincount(at, v, size * BINS).reshape(size, BINS)
    return cells


def best_cuts(cells: np.ndarray, min_weight: float, l2: float, unit: float):
    """(gains, feature * BINS + cut) of each node of a histogram."""
    left_w, left_s = cells.cumsum(axis=3)
    all_w, all_s = left_w[:, :1, -1:], left_s[:, :1, -1:]
    gain = gain_of(left_w, left_s, all_w, all_s, min_weight, l2, unit).reshape(len(left_w), -1)
    best = gain.argmax(axis=1)
    return gain[np.arange(len(gain)), best], best


def by_histogram(codes, target, weight, rows, local, size, min_weight, l2, unit):
    """Best cut of each node; ``rows`` come sorted by ``local``, their node."""
    gains, best = np.full(size, -np.inf), np.zeros(size, np.int64)
    step = max(1, STEP_CELLS // (codes.shape[1] * BINS * 2))
    for low in range(0, size, step):
        high = min(size, low + step)
        a, b = np.searchsorted(local, [low, high])
        own = rows[a:b]
        cells = histogram(
            codes[own], weight[own], weight[own] * target[own], local[a:b] - low, high - low
        )
        gains[low:high], best[low:high] = best_cuts(cells, min_weight, l2, unit)
    return gains, best


def _short(node: np.ndarray, size: int) -> np.ndarray:
    """Numbers of 16 bits, where they suffice, are sorted digit by digit."""
    return node.astype(np.uint16) if size <= 1 << 16 else node


def by_order(codes, target, weight, rows, local, size, min_weight, l2, unit):
    """The same from the rows of a node in the order of a feature's codes."""
    gains, best = np.full(size, -np.inf), np.zeros(size, np.int64)
    short, own_w = _short(local, size), weight[rows]
    own_s = own_w * target[rows]
    begin = np.searchsorted(local, np.arange(size))
    filled = np.flatnonzero(np.diff(np.append(begin, len(rows))))
    all_w, all_s = np.zeros(size), np.zeros(size)
    all_w[filled], all_s[filled] = (np.add.reduceat(v, begin[filled]) for v in (own_w, own_s))
    inside = local[1:] == local[:-1]
    for f in range(codes.shape[1]):
        code = codes[rows, f].astype(np.uint8)
        order = np.argsort(code, kind="stable")
        order = order[np.argsort(short[order], kind="stable")]
        code = code[order]
        at = np.flatnonzero(inside & (code[1:] != code[:-1]))
        if not len(at):
            continue
        own = local[at]
        left = []
        for v in (own_w, own_s):
            upto = np.cumsum(v[order])
            left.append(upto[at] - np.append(0.0, upto)[begin[own]])
        gain = gain_of(*left, all_w[own], all_s[own], min_weight, l2, unit)
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        top = np.full(size, -np.inf)
        top[own[starts]] = np.maximum.reduceat(gain, starts)
        hit = np.flatnonzero(gain == top[own])[::-1]
        place = np.zeros(size, np.int64)
        place[own[hit]] = at[hit]  # the lowest is written last
        better = top > gains
        gains[better] = top[better]
        best[better] = f * BINS + code[place[better]].astype(np.int64)
    return gains, best


def joined(parts: list[Nodes]) -> Nodes:
    """Several groups of trees as one, in small types."""
    ahead = np.cumsum([0, *[len(p.feature) for p in parts]])[:-1]
    return Nodes(
        np.concatenate([p.roots + a for p, a in zip(parts, ahead)]).astype(np.int32),
        np.concatenate([p.feature for p in parts]).astype(np.int16),
        np.concatenate([p.cut for p in parts]).astype(np.int16),
        np.concatenate([p.left + a for p, a in zip(parts, ahead)]).astype(np.int32),
        np.concatenate([p.right + a for p, a in zip(parts, ahead)]).astype(np.int32),
        np.concatenate([p.value for p in parts]).astype(np.float64),
    )


ship_by_value(__name__)
