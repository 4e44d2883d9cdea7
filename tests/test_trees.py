"""Tree ensembles against a recursive version, and grids that resume."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from diurna.operators import trees
from diurna.plans import modeling


def plain_tree(codes, target, weight, depth, min_weight, l2, top):
    """Nested (feature, cut, left, right) or leaf value, by trying every cut."""
    total, mass = (weight * target).sum(), weight.sum()
    unit = 1e-9 * max(1.0, np.abs(top).max()) ** 2
    best = (0.0, None)
    for f in range(codes.shape[1]):
        for c in range(int(codes[:, f].max(initial=0))):
            side = codes[:, f] <= c
            a, b = weight[side].sum(), weight[~side].sum()
            if min(a, b) < max(min_weight, 1e-9):
                continue
            x, y = (weight * target)[side].sum(), (weight * target)[~side].sum()
            gain = x * x / (a + l2) + y * y / (b + l2) - total * total / (mass + l2)
            if round(gain / unit) > best[0]:
                best = (round(gain / unit), (f, c, side))
    if depth == 0 or best[1] is None:
        return total / (mass + l2)
    f, c, side = best[1]
    below = [
        plain_tree(codes[s], target[s], weight[s], depth - 1, min_weight, l2, top)
        for s in (side, ~side)
    ]
    return (f, c, *below)


def plain_value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("cells", [1 << 23, 1 << 11])
@pytest.mark.parametrize("depth, min_weight, l2", [(None, 1, 0.0), (3, 5, 1.0), (2, 1, 1.0)])
def test_trees_grown_together_equal_single_ones(monkeypatch, cells, depth, min_weight, l2):
    monkeypatch.setattr(trees, "STEP_CELLS", cells)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(80, 4)), 1)
    y = x[:, 0] * 2 + (x[:, 1] > 0) + rng.normal(size=80)
    _, codes = trees.binned(x)
    drawn = rng.multinomial(80, np.full(80, 1 / 80), 6)
    tree, row = np.nonzero(drawn)
    weight = drawn[tree, row].astype(float)
    found = trees.grown(codes[row], y[row], weight, tree, 6, depth, min_weight, l2)
    got = found.values(codes, found.roots)
    for t in range(6):
        own = tree == t
        deep = 99 if depth is None else depth
        want = plain_tree(codes[row[own]], y[row[own]], weight[own], deep, min_weight, l2, y)
        assert got[:, t] == pytest.approx([plain_value(want, r) for r in codes])


def test_boosting_adds_shrunk_residual_trees():
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(60, 3)), rng.normal(size=60)
    model = trees.BoostedPoint("p", 2, 0.3, 1, rounds=4).fit(x, y, 0)
    _, codes = trees.binned(x)
    at = np.full(60, y.mean())
    for _ in range(4):
        tree = plain_tree(codes, y - at, np.ones(60), 2, 1, 1.0, y - at)
        at = at + 0.3 * np.array([plain_value(tree, r) for r in codes])
    assert model.predict(x) == pytest.approx(at)
    assert trees.Ensemble.of(model.parts()).predict(x) == pytest.approx(at)


def test_bins_keep_order_and_are_bounded():
    x = np.stack([np.arange(1000.0), np.repeat([1.0, 2.0], 500), np.zeros(1000)], axis=1)
    edges, codes = trees.binned(x)
    assert [len(e) < trees.BINS for e in edges] == [True] * 3 and len(edges[2]) == 0
    assert codes.max() < trees.BINS and (np.diff(codes[:, 0]) >= 0).all()
    assert set(codes[:500, 1]) == {0} and set(codes[500:, 1]) == {1}


@pytest.fixture(scope="module")
def folded(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 2))
    y = 3 * x[:, 0] + rng.normal(size=300) * 0.1
    rows = [(i % 5 + 1, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "fold int, a double, b double, y double").repartition(3)


POINTS = [trees.ForestPoint("f", 4, 2, 20), trees.BoostedPoint("g", 2, 0.1, 1, 40)]


@pytest.mark.parametrize("fit_rows", [2_000, 100])
def test_grid_metrics_are_those_of_all_rows(folded, fit_rows):
    got = modeling.cross_validate_grid(folded, POINTS, ["a", "b"], "y", fit_rows).collect()
    rows = modeling._grid_sample(folded.select("fold", "y", "a", "b"), 300, fit_rows)
    every = folded.toPandas()
    assert len(rows) == 300 if fit_rows > 300 else 60 < len(rows) < 150
    for r in got:
        point = next(p for p in POINTS if p.name == r.model)
        train, test = rows[rows.fold != r.fold], every[every.fold == r.fold]
        model = point.fit(train[["a", "b"]].to_numpy(), train.y.to_numpy(), 42 + r.fold)
        if fit_rows > 300:  # row order decides a bootstrap
            model = None
        assert (r.train_size, r.validation_size) == (240, 60) and r.r2 > 0.7
        if model is not None and isinstance(point, trees.BoostedPoint):
            e = model.predict(test[["a", "b"]].to_numpy()) - test.y.to_numpy()
            assert r.mae == pytest.approx(np.abs(e).mean())
            assert r.r2 == pytest.approx(1 - (e @ e) / ((test.y - test.y.mean()) ** 2).sum())
    assert len(got) == 10


def test_a_rerun_resumes(folded, tmp_path, monkeypatch):
    path = f"{tmp_path}/grid"
    modeling.cross_validate_grid(folded, POINTS[:1], ["a", "b"], "y", results=path)
    asked = []
    whole = modeling._fitted

    def watched(spark, points, *rest):
        asked.extend(p.name for p in points)
        return whole(spark, points, *rest)

    monkeypatch.setattr(modeling, "_fitted", watched)
    found = modeling.cross_validate_grid(folded, POINTS, ["a", "b"], "y", results=path)
    assert asked == ["g"] and found.count() == 10
    modeling.cross_validate_grid(folded, POINTS, ["a", "b"], "y", results=path)
    assert asked == ["g"]


def test_grid_of_no_rows(folded):
    assert modeling.cross_validate_grid(folded.limit(0), POINTS, ["a", "b"], "y").count() == 0
    assert folded.where(F.col("a").isNull()).count() == 0


def test_scores_of_deep_trees_equal_the_walk(spark):
    """Trees of any depth, single leaves and many blocks, against node by node."""
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (300, 3))
    y = np.where(x[:, 0] > 0, x[:, 1], rng.normal(0, 1, 300))
    for model in (
        trees.ForestPoint("deep", None, 1, 12).fit(x, y, 1),
        trees.ForestPoint("leaves", 0, 1, 5).fit(x, y, 1),
        trees.BoostedPoint("boosted", 2, 0.1, 1.0, 9).fit(x, y, 1),
        trees.ForestPoint("no features", None, 1, 4).fit(x[:, :0], y, 1),
    ):
        rows = rng.normal(0, 1, (trees.SCORE_ROWS + 50, len(model.edges)))
        codes = trees.coded(rows, model.edges)
        want = model.start + model.rate * model.nodes.values(codes, model.nodes.roots).sum(axis=1)
        assert model.predict(rows) == pytest.approx(want, rel=1e-12)


def test_rows_of_one_file_are_scored_in_many_tasks(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(int(i % 2 + 1), *map(float, v)) for i, v in enumerate(rng.normal(0, 1, (400, 3)))]
    spark.createDataFrame(rows, "fold int, y double, a double, b double").coalesce(1).write.parquet(
        str(tmp_path / "one")
    )
    df = spark.read.parquet(str(tmp_path / "one"))
    x, y = np.array([r[2:] for r in rows]), np.array([r[1] for r in rows])
    model = trees.BoostedPoint("b", 2, 0.1, 1.0, 9).fit(x, y, 0)
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup("scoring", "scoring")
    got = modeling._scored(df, {(0, 1): model, (0, 2): model}, ["a", "b"], 0.0, 7).collect()
    context.setLocalProperty("spark.jobGroup.id", None)
    stages = [
        tracker.getStageInfo(s)
        for j in tracker.getJobIdsForGroup("scoring")
        for s in tracker.getJobInfo(j).stageIds
    ]
    assert 7 in {s.numTasks for s in stages if s}
    error = np.abs(y - model.predict(x))
    fold = np.array([r[0] for r in rows])
    assert {r.fold: r.absolute for r in got} == pytest.approx({f: error[fold == f].sum() for f in (1, 2)})
