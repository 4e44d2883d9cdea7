"""Ensembles grown over the whole cluster, against fits on all rows in one place."""

from __future__ import annotations

import numpy as np
import pytest

from diurna.operators import trees
from diurna.plans import growth, modeling

COLUMNS = ["a", "b", "c"]
FORESTS = [trees.ForestPoint(f"f{d}", d, 2, 4) for d in (None, 2, 5)]
BOOSTED = [trees.BoostedPoint("g2", 2, 0.3, 1, 4), trees.BoostedPoint("g3", 3, 0.1, 5, 3)]
ROWS = 900


@pytest.fixture(scope="module")
def folded(spark):
    """Few values in one column, more than there are bins in another."""
    rng = np.random.default_rng(8)
    x = np.stack([rng.normal(size=ROWS), rng.integers(0, 5, ROWS), rng.gamma(2, 3, ROWS)], axis=1)
    y = 3 * x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=ROWS) * 0.1
    rows = [(i % 3 + 1, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "fold int, a double, b double, c double, y double")


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(growth, "LOCAL_ROWS", 100)
    monkeypatch.setattr(growth, "STORED_ROUNDS", 3)
    monkeypatch.setattr(growth, "CHUNK_TREES", 3)


def arrays(df):
    pdf = df.toPandas()
    return pdf["fold"].to_numpy(), pdf[COLUMNS].to_numpy(float), pdf["y"].to_numpy(float)


def test_bins_part_the_training_rows_as_in_one_place(folded):
    fold, x, _ = arrays(folded)
    found = growth.fold_edges(folded, [1, 2, 3], COLUMNS)
    for h, edges in enumerate(found):
        train = x[fold != h + 1]
        _, want = trees.binned(train)
        codes = trees.coded(train, edges)
        for f in range(len(COLUMNS)):
            pairs = set(zip(codes[:, f].tolist(), want[:, f].tolist()))
            assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
        assert codes.max() < trees.BINS


def test_boosting_equals_a_fit_on_all_training_rows(folded, small):
    fold, x, y = arrays(folded)
    got = modeling.cross_validate_grid(folded, BOOSTED, COLUMNS, "y").collect()
    edges = growth.fold_edges(folded, [1, 2, 3], COLUMNS)
    assert len(got) == 6
    for r in got:
        point = next(p for p in BOOSTED if p.name == r.model)
        train, codes = fold != r.fold, trees.coded(x, edges[r.fold - 1])
        at = np.full(ROWS, y[train].mean())
        for _ in range(point.rounds):
            tree = trees.grown(
                codes[train], (y - at)[train], np.ones(train.sum()), np.zeros(train.sum(), int),
                1, point.max_depth, point.min_child, point.l2,
            )
            at = at + point.learning_rate * tree.values(codes, tree.roots)[:, 0]
        error = np.abs(y - at)[~train]
        assert (r.train_size, r.validation_size) == (600, 300)
        assert r.mae == pytest.approx(error.mean()) and r.rmse == pytest.approx(np.sqrt((error**2).mean()))


def test_forests_equal_trees_of_all_drawn_rows(spark, folded, small):
    """Nodes above 100 rows are cut by histograms, the rest where their rows meet."""
    got = {(r.model, r.fold): r for r in modeling.cross_validate_grid(folded, FORESTS, COLUMNS, "y").collect()}
    edges = growth.fold_edges(folded, [1, 2, 3], COLUMNS)
    blocks = growth.blocked(folded, edges, COLUMNS, "y", spark.sparkContext.defaultParallelism).collect()
    assert len(got) == 9 and len(blocks) > 3
    held = [np.frombuffer(b.fold, np.int32) for b in blocks]
    y = [np.frombuffer(b.y) for b in blocks]
    codes = [np.frombuffer(b.codes, np.uint8).reshape(3, -1, 3) for b in blocks]
    for h in range(3):
        sizes = {b.block: int((f != h + 1).sum()) for b, f in zip(blocks, held)}
        train = np.concatenate(held) != h + 1
        own, target = np.concatenate([c[h] for c in codes]), np.concatenate(y)
        for point in FORESTS:
            total = np.zeros((~train).sum())
            for t in range(point.trees):
                weight = np.concatenate([growth.drawn(42, h + 1, t, b.block, sizes) for b in blocks])
                assert weight.sum() == 600
                some = weight > 0
                tree = trees.grown(
                    own[train][some], target[train][some], weight[some], np.zeros(some.sum(), int),
                    1, point.max_depth, point.min_leaf, 0.0,
                )
                total += tree.values(own[~train], tree.roots)[:, 0]
            error = np.abs(target[~train] - total / point.trees)
            r = got[point.name, h + 1]
            assert r.mae == pytest.approx(error.mean()) and r.rmse == pytest.approx(np.sqrt((error**2).mean()))


def test_no_row_is_left_out_of_a_fit(spark, monkeypatch):
    """One row in 6,000 has another target; only a fit on all rows can know it."""
    rows = [(i % 2 + 1, float(i // 2 == 1234), 1e6 * (i // 2 == 1234)) for i in range(6_000)]
    df = spark.createDataFrame(rows, "fold int, a double, y double")
    point = trees.BoostedPoint("g", 1, 1.0, 1, 1, l2=0.0)
    for bound in (20_000, 1_000):
        monkeypatch.setattr(growth, "LOCAL_ROWS", bound)
        got = modeling.cross_validate_grid(df, [point], ["a"], "y").collect()
        assert [r.mae for r in got] == pytest.approx([0, 0], abs=1e-6)
