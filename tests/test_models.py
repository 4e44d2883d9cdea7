from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from diurna.operators import aggregates
from diurna.plans import dataset, explore, modeling, scoring
from diurna.schemas import FEATURES, TARGET
from diurna.sources import artifacts

COLUMNS = ["x1", "x2", "x3"]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3)) * [1.0, 50.0, 0.01] + [0.0, 1e4, 3.0]
    y = 2.0 + x @ np.array([1.0, 0.02, 30.0]) + rng.normal(size=200)
    fold = np.arange(200) % 5 + 1
    return x, y, fold


@pytest.fixture(scope="module")
def frame(spark, table):
    x, y, fold = table
    rows = [(int(f), *map(float, a), float(b)) for f, a, b in zip(fold, x, y, strict=True)]
    return spark.createDataFrame(rows, "fold int, x1 double, x2 double, x3 double, y double").cache()


def least_squares(x, y, alpha):
    mu, sd = x.mean(0), x.std(0)
    z = (x - mu) / sd
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / sd
    return y.mean() - beta @ mu, beta


@pytest.mark.parametrize("alpha", [0.0, 0.1, 100.0])
def test_cross_validation_equals_numpy(frame, table, alpha):
    x, y, fold = table
    spec = modeling.LinearSpec("m", tuple(COLUMNS), alpha)
    got = {
        r.fold: r
        for r in modeling.cross_validate(frame, [modeling.dummy_spec(), spec], COLUMNS, "y")
        .where("model = 'm'")
        .collect()
    }
    for f in range(1, 6):
        t, v = fold != f, fold == f
        b0, b = least_squares(x[t], y[t], alpha)
        e = y[v] - b0 - x[v] @ b
        assert got[f].train_size == t.sum() and got[f].validation_size == v.sum()
        assert got[f].mae == pytest.approx(np.abs(e).mean(), rel=1e-9)
        assert got[f].rmse == pytest.approx(np.sqrt((e**2).mean()), rel=1e-9)
        assert got[f].r2 == pytest.approx(1 - (e**2).sum() / ((y[v] - y[v].mean()) ** 2).sum(), rel=1e-9)


def test_task_functions_travel_by_value():
    """Executors hold no copy of the package."""
    from pyspark import cloudpickle

    from diurna.streaming import triggers

    registered = cloudpickle.list_registry_pickle_by_value()
    assert {modeling.__name__, triggers.__name__} <= set(registered)


def test_gram_agrees_with_mllib(spark, frame):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    ours = modeling.final_fit(frame, COLUMNS, "y").first()["coefficients"]
    ready = VectorAssembler(inputCols=COLUMNS, outputCol="f").transform(frame)
    theirs = LinearRegression(featuresCol="f", labelCol="y", solver="normal").fit(ready)
    assert ours[0] == pytest.approx(theirs.intercept, rel=1e-6)
    assert ours[1:] == pytest.approx(list(theirs.coefficients), rel=1e-6)


def test_any_estimator_can_be_validated(frame):
    from pyspark.ml.regression import LinearRegression

    est = {"ml": LinearRegression(featuresCol="features_vector", labelCol="y", solver="normal")}
    theirs = modeling.cross_validate_estimators(frame, est, 5, COLUMNS, "y").collect()
    ours = modeling.cross_validate(frame, [modeling.linear_spec(COLUMNS)], COLUMNS, "y").collect()
    assert {r.fold: pytest.approx(r.mae, rel=1e-6) for r in theirs} == {r.fold: r.mae for r in ours}


def test_grids_have_the_protocol_size():
    from diurna.schemas import BOOSTING_GRID as b
    from diurna.schemas import FOREST_GRID as f

    assert len(modeling.forest_grid(f["max_depth"], f["min_samples_leaf"], f["trees"])) == 9
    grid = modeling.boosting_grid(b["max_depth"], b["learning_rate"], b["min_child_weight"], b["rounds"])
    assert len(grid) == 12
    assert len(modeling.ridge_specs()) == 5


@pytest.mark.parametrize("name, points", [("cv_forest", 9), ("cv_gbt", 12)])
def test_tree_queries_run_their_whole_grid(spark, sf_dir, monkeypatch, name, points):
    """The grid that is handed on, and the best pick of made-up metrics."""
    import __spark_entry__ as entry

    asked = []

    def validated(development, grid):
        asked.extend(grid)
        rows = [
            (p.name, f, 8, 2, 0.1 * (i + 2) if i != 3 else 0.1, 1.0, 0.0)
            for i, p in enumerate(grid)
            for f in range(1, 6)
        ]
        return spark.createDataFrame(rows, modeling.RESULTS)

    monkeypatch.setattr(modeling, "cross_validate_grid", validated)
    found = entry.queries()[name](spark, sf_dir).collect()
    size = "trees" if name == "cv_forest" else "rounds"
    assert [getattr(p, size) for p in asked] == [300] * points
    assert len(found) == 5 * points
    assert {r.model for r in found if r.best} == {asked[3].name}


def test_ablation_groups_must_cover():
    assert len(modeling.ablation_specs()) == 5
    with pytest.raises(ValueError, match="cover"):
        modeling.ablation_specs({"age": ["age_scaled"]})


def test_delta_order(spark):
    rows = [("A", 0.2, 0.0, 0.0), ("Full", 0.1, 0.0, 0.0), ("B", 0.5, 0.0, 0.0)]
    summary = spark.createDataFrame(rows, "model string, mae_mean double, rmse_mean double, r2_mean double")
    got = aggregates.delta_against(summary).collect()
    assert [r.model for r in got] == ["Full", "B", "A"]
    assert got[1].delta_mae_vs_full == pytest.approx(0.4)


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "a double, b double")
    got = {(r.column_a, r.column_b): r.correlation for r in aggregates.corr_matrix(df, ["a", "b"]).collect()}
    assert got[("a", "b")] is None and got[("a", "a")] == pytest.approx(1.0)


def test_correlations_equal_pairwise_deletion(spark):
    """Any pattern of missing values; large offsets do not cost precision."""
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        x = rng.gauss(0, 1)
        full = [1e9 + x, 3 * x + rng.gauss(0, 1), rng.gauss(0, 1e-3), 0.1]
        rows.append(tuple(v if rng.random() < 0.7 else None for v in full))
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = {(r.column_a, r.column_b): r.correlation for r in aggregates.corr_matrix(df, names).collect()}
    assert len(got) == 16
    for i, p in enumerate(names):
        for j, q in enumerate(names):
            kept = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
            if "d" in (p, q):
                assert got[(p, q)] is None
            else:
                want = np.corrcoef(np.array(kept).T)[0, 1]
                assert got[(p, q)] == pytest.approx(want, abs=1e-6)
    ranked = aggregates.corr_with(df, ["c", "b", "d"], "a").collect()
    assert [r.feature for r in ranked] == ["b", "c", "d"]
    assert ranked[0].correlation == pytest.approx(got[("a", "b")])


def test_correlation_of_nothing_is_missing(spark):
    """An empty table, and a pair that is never present together."""
    empty = spark.createDataFrame([], "a double, b double")
    assert [r.correlation for r in aggregates.corr_matrix(empty, ["a", "b"]).collect()] == [None] * 4
    apart = spark.createDataFrame([(1.0, None), (2.0, None), (None, 1.0), (None, 3.0)], "a double, b double")
    got = {(r.column_a, r.column_b): r.correlation for r in aggregates.corr_matrix(apart, ["a", "b"]).collect()}
    assert got[("a", "b")] is None and got[("b", "b")] == pytest.approx(1.0)


# --- dataset contract -------------------------------------------------------


def test_redundancy_equals_numpy(spark):
    """Pairs with a missing side are left out of a correlation only."""
    rng = np.random.default_rng(4)
    a, b, z = rng.normal(5, 1, 40), rng.normal(3, 1, 40), rng.normal(0, 1, 40)
    y = 2 * a - b + 0.3 * z + rng.normal(0, 0.1, 40)
    rows = [tuple(map(float, r)) for r in zip(y, a, b, z)]
    rows = [(*r[:3], None if i % 5 == 0 else r[3]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "y double, a double, b double, z double")
    got = aggregates.redundancy(df, "y", "a", "b", "z", ("y", "b")).first()
    design = np.stack([np.ones(40), a, b], axis=1)
    weights = np.linalg.lstsq(design, y, rcond=None)[0]
    residual = y - design @ weights
    known = np.arange(40) % 5 != 0
    assert (got.coef_1, got.coef_2) == pytest.approx(tuple(weights[1:]))
    assert got.r2 == pytest.approx(1 - residual @ residual / (y.var() * 40))
    for value, name in ((residual, "residual"), (y / b, "per_unit")):
        want = np.corrcoef(value[known], z[known])[0, 1]
        assert got[f"corr_{name}_latent"] == pytest.approx(want)


def test_redundancy_with_a_constant_latent(spark):
    rows = [(1.0, 2.0, 4.0, 7.0), (2.0, 3.0, 1.0, 7.0), (5.0, 1.0, 2.0, 7.0), (3.0, 3.0, 3.0, 7.0)]
    df = spark.createDataFrame(rows, "y double, a double, b double, z double")
    got = aggregates.redundancy(df, "y", "a", "b", "z", ("y", "b")).first()
    assert got.corr_residual_latent is None and got.corr_per_unit_latent is None


def feature_row(**changes):
    base = {
        "age_scaled": 0.0,
        "mean_daily_use_minutes": 131.5,
        "mean_daily_session_count": 17.0,
        "median_session_duration": 6.25,
        "mean_daily_app_openings": 38.0,
        "post_bedtime_use_ratio": 0.07,
        "school_use_ratio": 0.03,
        "games_share": 0.35,
        "social_share": 0.15,
        "entertainment_share": 0.25,
        "education_share": 0.1,
    }
    return {**base, **changes}


def feature_frame(spark, rows):
    schema = "child_id long, " + ", ".join(f"{f} double" for f in FEATURES)
    return spark.createDataFrame(
        [(i, *[r[f] for f in FEATURES]) for i, r in enumerate(rows, 1)], schema
    )


def test_audit_rejects_leaks(spark):
    df = feature_frame(spark, [feature_row()]).withColumn(TARGET, F.lit(2.0))
    dataset.audit_columns(df)
    with pytest.raises(ValueError, match="forbidden"):
        dataset.audit_columns(df.withColumn("S", F.lit(1.0)))
    with pytest.raises(ValueError, match="columns"):
        dataset.audit_columns(df.select("child_id", TARGET, *FEATURES))
    x, y = dataset.split_x_y(df)
    assert x.columns == FEATURES and y.columns == [TARGET]


def test_assembly_needs_one_target_per_child(spark):
    df = feature_frame(spark, [feature_row(), feature_row()])
    target = spark.createDataFrame([(1, 2.0), (2, 3.0), (2, 4.0)], f"child_id long, {TARGET} double")
    with pytest.raises(Exception, match="duplicate key"):
        dataset.assemble(df, target).collect()


# --- scoring ----------------------------------------------------------------

MODEL = scoring.LinearModel(1.0, tuple(0.01 * i for i in range(11)))


@pytest.mark.parametrize(
    ("changes", "reason"),
    [
        ({}, None),
        ({"mean_daily_use_minutes": None}, "not_finite"),
        ({"median_session_duration": float("nan")}, "not_finite"),
        ({"median_session_duration": float("inf")}, "not_finite"),
        ({"age_scaled": 1.6}, "range:age_scaled"),
        ({"age_scaled": 1.5}, None),
        ({"mean_daily_use_minutes": -10.0}, "range:mean_daily_use_minutes"),
        ({"mean_daily_app_openings": 0.0}, "range:mean_daily_app_openings"),
        ({"school_use_ratio": 1.5}, "range:school_use_ratio"),
        ({"games_share": 0.5}, None),
        ({"games_share": 0.51}, "share_sum"),
    ],
)
def test_input_checks(spark, changes, reason):
    got = scoring.score(feature_frame(spark, [feature_row(**changes)]), MODEL).first()
    assert got.reject_reason == reason
    assert (got.prediction is None) == (reason is not None)


def test_missing_unknown_and_reordered_columns(spark):
    df = feature_frame(spark, [feature_row()])
    assert scoring.check_input(df.drop("games_share")).first().reject_reason == "missing:games_share"
    extra = df.withColumn("unknown_feature", F.lit(1.0))
    assert scoring.check_input(extra).first().reject_reason == "unknown:unknown_feature"
    text = df.withColumn("games_share", F.lit("many"))
    assert scoring.check_input(text).first().reject_reason == "not_numeric"
    shuffled = df.select("child_id", *reversed(FEATURES))
    a, b = scoring.score(df, MODEL).first(), scoring.score(shuffled, MODEL).first()
    assert abs(a.prediction - b.prediction) < 1e-12


def test_predictions_are_not_clipped(spark):
    big = scoring.LinearModel(100.0, (0.0,) * 11)
    got = scoring.score(feature_frame(spark, [feature_row()]), big).first()
    assert got.prediction == 100.0 and not got.within_expected_range
    report = scoring.weekly_analysis(scoring.score(feature_frame(spark, [feature_row()]), MODEL))
    assert len(report.columns) == 10 and report.first().predicted_severity == pytest.approx(
        1.0 + sum(0.01 * i * feature_row()[f] for i, f in enumerate(FEATURES))
    )


def test_artifact_round_trip(spark, tmp_path):
    path = str(tmp_path / "model")
    artifacts.save_linear(spark, MODEL, path)
    assert artifacts.load_linear(spark, path) == MODEL
    df = feature_frame(spark, [feature_row(age_scaled=a / 10) for a in range(-15, 16)])
    assert artifacts.verify_saved(spark, MODEL, path, df) <= 1e-12
    other = scoring.LinearModel(1.5, MODEL.coefficients)
    with pytest.raises(ValueError, match="differs"):
        artifacts.verify_saved(spark, other, path, df)


def test_incomplete_artifacts_are_refused(spark, tmp_path):
    path = str(tmp_path / "broken")
    artifacts.save_linear(spark, MODEL, path)
    contract = spark.read.parquet(f"{path}/contract").cache()
    contract.count()
    contract.drop("target").write.mode("overwrite").parquet(f"{tmp_path}/b2/contract")
    with pytest.raises(ValueError, match="target"):
        artifacts.load_contract(spark, f"{tmp_path}/b2")
    contract.withColumn("n_features", F.lit(3)).write.parquet(f"{tmp_path}/b3/contract")
    with pytest.raises(ValueError, match="disagree"):
        artifacts.load_contract(spark, f"{tmp_path}/b3")


def test_sensitivity_accepts_any_scorer(spark):
    df = feature_frame(spark, [feature_row(age_scaled=a / 10) for a in range(-15, 16)])
    profiles = explore.sensitivity_profiles(df)
    assert profiles.count() == 22
    scored = profiles.withColumn("prediction", F.col("age_scaled") * 2)
    top = explore.sensitivity(scored).first()
    assert top.feature == "age_scaled" and top.delta == pytest.approx(3.0)


def test_bands_count_rows_without_a_prediction(spark):
    rows = [(100.0 + i % 3, 2.0 if i % 4 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "mean_daily_use_minutes double, prediction double")
    assert [r.n for r in explore.band_summary(df).collect()] == [20]
