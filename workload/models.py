"""Dataset assembly, model evaluation, exploration and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from diurna.operators import aggregates, sets
from diurna.operators.single import with_row
from diurna.plans import dataset, eventlog, explore, modeling, scoring, study, weekly
from diurna.schemas import (
    BOOSTING_GRID,
    FEATURES,
    FOREST_GRID,
    RIDGE_ALPHAS,
    TARGET,
    TRAIN_FRACTIONS,
)
from diurna.session import written_table
from diurna.sources.tables import table
from workload import regression_sql as reg
from workload.behaviour_sql import r6 as R
from workload.behaviour_sql import with_tables
from workload.diagnostics import describe_sql
from workload.registry import events, longs, query, rounded

IDS = ["child_id", "week_index"]
METRICS = ["mae", "rmse", "r2"]

# A fixed linear model, so that scoring can be checked in SQL.
DEMO_MODEL = scoring.LinearModel(
    intercept=1.2,
    coefficients=(0.15, 0.006, 0.05, 0.004, 0.03, 0.8, 0.4, 0.1, 0.2, -0.1, -0.3),
)
SCORE_SQL = reg.prediction(FEATURES, "m").replace("m[1]", "1.2")
for _i, _w in enumerate(DEMO_MODEL.coefficients, 2):
    SCORE_SQL = SCORE_SQL.replace(f"m[{_i}]", str(_w))

DATASET_CTES = [
    f"""
    ds AS (
      SELECT f.*, t.y AS "{TARGET}", p.age, p."S", p."B", p."F", p."U"
      FROM feat f JOIN tgt t USING (child_id, week_index) JOIN prof p USING (child_id)
    )""",
    """
    dsr AS (
      SELECT *, row_number() OVER (PARTITION BY age
                  ORDER BY md5('42:' || child_id || ':' || week_index), child_id, week_index) AS r,
             count(*) OVER (PARTITION BY age) AS sz
      FROM ds
    )""",
    "dev0 AS (SELECT * EXCLUDE (r, sz) FROM dsr WHERE r > floor(sz * 0.2))",
    "tst AS (SELECT * EXCLUDE (r, sz) FROM dsr WHERE r <= floor(sz * 0.2))",
    """
    dev AS (
      SELECT d.*, CAST((off + row_number() OVER (PARTITION BY d.age
                ORDER BY md5('42:' || child_id || ':' || week_index), child_id, week_index) - 1) % 5 + 1
              AS BIGINT) AS fold
      FROM dev0 d JOIN (
        SELECT age, coalesce(sum(n) OVER (ORDER BY age ROWS BETWEEN UNBOUNDED PRECEDING
                 AND 1 PRECEDING), 0) AS off
        FROM (SELECT age, count(*) AS n FROM dev0 GROUP BY age)) o ON o.age = d.age
    )""",
    """
    trn AS (
      SELECT v.fold AS fold, d.* EXCLUDE (fold) FROM dev d,
             (SELECT unnest([1, 2, 3, 4, 5])::BIGINT AS fold) v WHERE d.fold <> v.fold
    )""",
]


def metric_rows(parts: list[str]) -> str:
    return (
        "SELECT model, fold, train_size, validation_size, " + R(*METRICS)
        + " FROM (" + " UNION ALL ".join(parts) + ")"
    )


def cv_ctes(specs: list[modeling.LinearSpec]) -> tuple[list[str], list[str]]:
    ctes, selects = [], []
    for i, spec in enumerate(specs):
        tag = f"m{i}"
        ctes += reg.solve_ctes(tag, "trn", spec.columns, TARGET, ["fold"], spec.alpha)
        selects.append(reg.fold_metrics(tag, spec.name, "dev", spec.columns, TARGET))
    return ctes, selects


def cv_sql(specs: list[modeling.LinearSpec]) -> str:
    ctes, selects = cv_ctes(specs)
    return with_tables(metric_rows(selects), *DATASET_CTES, *ctes, recursive=True)


def summary_sql(specs: list[modeling.LinearSpec], body: str) -> str:
    ctes, selects = cv_ctes(specs)
    cv = f"cv AS ({' UNION ALL '.join(selects)})"
    summed = """
    summ AS (
      SELECT model, avg(mae) AS mae_mean, stddev_samp(mae) AS mae_std, avg(rmse) AS rmse_mean,
             stddev_samp(rmse) AS rmse_std, avg(r2) AS r2_mean, stddev_samp(r2) AS r2_std
      FROM cv GROUP BY model)
    """
    return with_tables(body, *DATASET_CTES, *ctes, cv, summed, recursive=True)


def metrics_of(results):
    return results.select(
        "model", *longs("fold", "train_size", "validation_size"), *rounded(*METRICS)
    )


SUMMARY = [f"{m}_{s}" for m in METRICS for s in ("mean", "std")]


@query(
    "dataset_assembly",
    with_tables(
        f"SELECT child_id, CAST(week_index AS BIGINT) AS week_index, {R(*FEATURES, TARGET)} FROM ds",
        *DATASET_CTES,
    ),
)
def dataset_assembly(spark, sf_dir):
    features = written_table(weekly.from_events(events(spark, sf_dir)), "features")
    rows = dataset.assemble(features, eventlog.target_rows(features), IDS)
    dataset.audit_columns(rows, IDS)
    return rows.select(*longs(*IDS), *rounded(*FEATURES, TARGET))


@query(
    "dataset_split",
    with_tables(
        """
        SELECT child_id, CAST(week_index AS BIGINT) AS week_index, age::BIGINT AS age,
               'test' AS split, NULL::BIGINT AS fold FROM tst
        UNION ALL
        SELECT child_id, CAST(week_index AS BIGINT), age::BIGINT, 'development', fold FROM dev
        """,
        *DATASET_CTES,
    ),
)
def dataset_split(spark, sf_dir):
    split = written_table(
        study.split_rows(study.labelled_rows(events(spark, sf_dir))), "split"
    )
    test = split.where("split = 'test'").withColumn("fold", F.lit(None).cast("int"))
    folded = study.folded_rows(split.where("split = 'development'"))
    return sets.concat([test, folded]).select(*longs(*IDS, "age", "fold"), "split")


@query("cv_dummy", cv_sql([modeling.dummy_spec()]))
def cv_dummy(spark, sf_dir):
    development = study.development_rows(events(spark, sf_dir))
    return metrics_of(modeling.cross_validate(development, [modeling.dummy_spec()]))


@query("cv_linear", cv_sql([modeling.linear_spec()]))
def cv_linear(spark, sf_dir):
    development = study.development_rows(events(spark, sf_dir))
    return metrics_of(modeling.cross_validate(development, [modeling.linear_spec()]))


@query("cv_ridge", cv_sql(modeling.ridge_specs()))
def cv_ridge(spark, sf_dir):
    development = study.development_rows(events(spark, sf_dir))
    return metrics_of(modeling.cross_validate(development, modeling.ridge_specs(RIDGE_ALPHAS)))


COMPARED = [modeling.dummy_spec(), modeling.linear_spec(), *modeling.ridge_specs()]


@query("cv_summary", summary_sql(COMPARED, f"SELECT model, {R(*SUMMARY)} FROM summ"))
def cv_summary(spark, sf_dir):
    results = modeling.cross_validate(study.development_rows(events(spark, sf_dir)), COMPARED)
    return aggregates.summarize_folds(results).select("model", *rounded(*SUMMARY))


@query(
    "cv_best_model",
    summary_sql(
        COMPARED,
        f"SELECT model, {R(*SUMMARY)} FROM summ ORDER BY mae_mean, rmse_mean, model LIMIT 1",
    ),
)
def cv_best_model(spark, sf_dir):
    results = modeling.cross_validate(study.development_rows(events(spark, sf_dir)), COMPARED)
    best = aggregates.best_model(aggregates.summarize_folds(results))
    return best.select("model", *rounded(*SUMMARY))


DELTAS = [f"delta_{m}_vs_full" for m in METRICS]


@query(
    "ablation",
    summary_sql(
        modeling.ablation_specs(),
        f"SELECT s.model, {R(*SUMMARY, prefix='s.')}, "
        + ", ".join(f"round(s.{m}_mean - f.{m}_mean, 6) AS delta_{m}_vs_full" for m in METRICS)
        + " FROM summ s, (SELECT * FROM summ WHERE model = 'Full') f",
    ),
)
def ablation(spark, sf_dir):
    results = modeling.cross_validate(
        study.development_rows(events(spark, sf_dir)), modeling.ablation_specs()
    )
    deltas = aggregates.delta_against(aggregates.summarize_folds(results))
    return deltas.select("model", *rounded(*SUMMARY, *DELTAS))


@query(
    "cv_alt_columns",
    summary_sql(modeling.alternative_specs(), f"SELECT model, {R(*SUMMARY)} FROM summ"),
)
def cv_alt_columns(spark, sf_dir):
    """Diagnostic models on the latent stand-ins; same folds."""
    results = modeling.cross_validate(
        study.development_rows(events(spark, sf_dir)), modeling.alternative_specs(), study.LATENTS
    )
    return aggregates.summarize_folds(results).select("model", *rounded(*SUMMARY))


CURVE_CTES = [
    """
    curve AS (
      SELECT * EXCLUDE (cr, cn) FROM (
        SELECT t.*, q.frac AS train_fraction,
               count(*) OVER (PARTITION BY t.fold, q.frac, age) AS cn,
               row_number() OVER (PARTITION BY t.fold, q.frac, age ORDER BY
                 md5('42:' || t.fold || ':' || CAST(round(q.frac * 100) AS INTEGER) || ':'
                     || child_id || ':' || week_index), child_id, week_index) AS cr
        FROM trn t, (SELECT unnest([0.25, 0.5, 0.75, 1.0])::DOUBLE AS frac) q)
      WHERE cr <= floor(cn * train_fraction)
    )""",
    *reg.solve_ctes("lc", "curve", FEATURES, TARGET, ["fold", "train_fraction"]),
]


@query(
    "learning_curve",
    with_tables(
        "SELECT train_fraction, fold, train_size, validation_size, "
        + R(*METRICS)
        + " FROM ("
        + reg.fold_metrics("lc", "LinearRegression", "dev", FEATURES, TARGET, "train_fraction")
        + ")",
        *DATASET_CTES,
        *CURVE_CTES,
        recursive=True,
    ),
)
def learning_curve(spark, sf_dir):
    curve = modeling.learning_curve(
        study.development_rows(events(spark, sf_dir)),
        study.STRATA,
        study.IDS,
        fractions=TRAIN_FRACTIONS,
    )
    return curve.select(
        "train_fraction", *longs("fold", "train_size", "validation_size"), *rounded(*METRICS)
    )


@query(
    "final_test",
    with_tables(
        f"""
        SELECT 'LinearRegression' AS model, any_value(train_size) AS development_size,
               count(*) AS test_size, round(avg(abs(y - p)), 6) AS mae,
               round(sqrt(avg((y - p) * (y - p))), 6) AS rmse,
               round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2
        FROM (SELECT f.train_size, v."{TARGET}" AS y, {reg.prediction(FEATURES, 'f.coef')} AS p
              FROM tst v, ft_fit f)
        """,
        *DATASET_CTES,
        *reg.solve_ctes("ft", "dev0", FEATURES, TARGET, []),
        recursive=True,
    ),
)
def final_test(spark, sf_dir):
    split = written_table(
        study.split_rows(study.labelled_rows(events(spark, sf_dir))), "split"
    )
    found = modeling.final_test(
        split.where("split = 'development'"), split.where("split = 'test'")
    )
    return found.select("model", *longs("development_size", "test_size"), *rounded(*METRICS))


FOREST_POINTS = modeling.forest_points(
    FOREST_GRID["max_depth"], FOREST_GRID["min_samples_leaf"], FOREST_GRID["trees"]
)
BOOSTING_POINTS = modeling.boosting_points(
    BOOSTING_GRID["max_depth"],
    BOOSTING_GRID["learning_rate"],
    BOOSTING_GRID["min_child_weight"],
    BOOSTING_GRID["rounds"],
)


def grid_results(development, points):
    """Fold metrics of a whole grid with each point's summary and the best pick."""
    results = modeling.cross_validate_grid(development, points)
    summary = aggregates.summarize_folds(results)
    best = aggregates.best_model(summary).select(F.col("model").alias("best"))
    summed = with_row(summary, best).withColumn("best", F.col("model") == F.col("best"))
    return results.join(summed, "model").select(
        "model",
        *longs("fold", "train_size", "validation_size"),
        *rounded(*METRICS, *SUMMARY),
        "best",
    )


@query("cv_forest")
def cv_forest(spark, sf_dir):
    """The whole forest grid of the protocol."""
    return grid_results(study.development_rows(events(spark, sf_dir)), FOREST_POINTS)


@query("cv_gbt")
def cv_gbt(spark, sf_dir):
    """The whole boosting grid of the protocol."""
    return grid_results(study.development_rows(events(spark, sf_dir)), BOOSTING_POINTS)


@query(
    "cv_grids",
    with_tables(
        f"""
        SELECT model, fold, total - here AS train_size, here AS validation_size,
               TRUE AS below_dummy_rmse
        FROM (SELECT fold, count(*) AS here, sum(count(*)) OVER ()::BIGINT AS total
              FROM dev GROUP BY fold),
             (SELECT unnest([{", ".join(f"'{p.name}'" for p in [*FOREST_POINTS, *BOOSTING_POINTS])}])
              AS model)
        """,
        *DATASET_CTES,
    ),
)
def cv_grids(spark, sf_dir):
    """Both grids; SQL knows the sizes, and that a fit beats the mean over all folds."""
    development = study.development_rows(events(spark, sf_dir))
    results = modeling.cross_validate_grid(development, [*FOREST_POINTS, *BOOSTING_POINTS])
    dummy = modeling.cross_validate(development, [modeling.dummy_spec()]).agg(
        F.avg("rmse").alias("dummy")
    )
    means = results.groupBy("model").agg(F.avg("rmse").alias("mean"))
    judged = with_row(means, dummy).select(
        "model", (F.col("mean") < F.col("dummy")).alias("below_dummy_rmse")
    )
    return results.join(judged, "model").select(
        "model", *longs("fold", "train_size", "validation_size"), "below_dummy_rmse"
    )


@query(
    "regression_metrics",
    """
    SELECT l_returnflag, count(*) AS validation_size, round(avg(abs(y - p)), 6) AS mae,
           round(sqrt(avg((y - p) * (y - p))), 6) AS rmse,
           round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2
    FROM (SELECT l_returnflag, l_extendedprice / 1000 AS y, 2 * l_quantity + l_tax AS p
          FROM lineitem) GROUP BY l_returnflag
    """,
)
def regression_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_returnflag",
        (F.col("l_extendedprice") / 1000).alias("y"),
        (2 * F.col("l_quantity") + F.col("l_tax")).alias("p"),
    )
    found = aggregates.regression_metrics(rows, "y", "p", ["l_returnflag"])
    return found.select("l_returnflag", *longs("validation_size"), *rounded(*METRICS))


# --- scoring and exploration ------------------------------------------------

SCORED_CTE = f"""
sc AS (
  SELECT *, child_id * 1000 + week_index AS row_id, {SCORE_SQL} AS prediction
  FROM feat
)
"""
REASON_SQL = (
    "CASE WHEN NOT (isfinite(age_scaled)"
    + "".join(f" AND coalesce(isfinite({f}), false)" for f in FEATURES[1:])
    + ") THEN 'not_finite' WHEN age_scaled NOT BETWEEN -1.5 AND 1.5 THEN 'range:age_scaled' "
    + "".join(f"WHEN {f} <= 0 THEN 'range:{f}' " for f in FEATURES[1:5])
    + "".join(f"WHEN {f} NOT BETWEEN 0 AND 1 THEN 'range:{f}' " for f in FEATURES[5:])
    + "WHEN games_share + social_share + entertainment_share + education_share > 1 + 1e-10 "
    + "THEN 'share_sum' END"
)


def feature_rows(spark, sf_dir):
    return weekly.from_events(events(spark, sf_dir))


def scored_rows(spark, sf_dir):
    """Every feature row with the fixed model's prediction, stored once."""
    rows = feature_rows(spark, sf_dir).withColumns(
        {
            "row_id": F.col("child_id") * 1000 + F.col("week_index"),
            "prediction": DEMO_MODEL.prediction(),
        }
    )
    return written_table(rows, "scored")


@query(
    "score_batch",
    with_tables(
        f"""
        SELECT child_id, week_index::BIGINT AS week_index, {REASON_SQL} AS reject_reason,
               CASE WHEN {REASON_SQL} IS NULL THEN round(prediction, 6) END AS prediction,
               '1.0' AS model_version, 1.0::DOUBLE AS target_min, 5.0::DOUBLE AS target_max,
               CASE WHEN {REASON_SQL} IS NULL THEN prediction BETWEEN 1 AND 5 END
                 AS within_expected_range
        FROM sc
        """,
        SCORED_CTE,
    ),
)
def score_batch(spark, sf_dir):
    scored = scoring.score(feature_rows(spark, sf_dir), DEMO_MODEL, IDS)
    return scored.select(
        *longs(*IDS),
        "reject_reason",
        *rounded("prediction"),
        "model_version",
        "target_min",
        "target_max",
        "within_expected_range",
    )


@query(
    "weekly_analysis",
    with_tables(
        f"""
        SELECT child_id, week_index::BIGINT AS week_index, '1.0' AS model_version,
               round(prediction, 6) AS predicted_severity,
               prediction BETWEEN 1 AND 5 AS prediction_within_expected_range,
               {R('mean_daily_use_minutes', 'mean_daily_session_count', 'mean_daily_app_openings',
                  'median_session_duration', 'post_bedtime_use_ratio', 'school_use_ratio')}
        FROM sc WHERE {REASON_SQL} IS NULL
        """,
        SCORED_CTE,
    ),
)
def weekly_analysis(spark, sf_dir):
    report = scoring.weekly_analysis(
        scoring.score(feature_rows(spark, sf_dir), DEMO_MODEL, IDS), IDS
    )
    numbers = [
        "predicted_severity",
        "mean_daily_use_minutes",
        "mean_daily_session_count",
        "mean_daily_app_openings",
        "median_session_duration",
        "post_bedtime_use_ratio",
        "school_use_ratio",
    ]
    return report.select(
        *longs(*IDS), "model_version", "prediction_within_expected_range", *rounded(*numbers)
    )


@query(
    "score_distribution",
    with_tables(describe_sql("sc", {"prediction": "prediction"}), SCORED_CTE),
)
def score_distribution(spark, sf_dir):
    found = aggregates.describe(
        scored_rows(spark, sf_dir), ["prediction"], [0.05, 0.25, 0.5, 0.75, 0.95]
    )
    return found.select("metric", "statistic", *rounded("value"))


@query(
    "standardized_coefs",
    with_tables(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, {w}::DOUBLE AS coef_raw, "
            f"round(stddev_samp({c}), 6) AS std_dataset, "
            f"round({w} * stddev_samp({c}), 6) AS effect_1_std FROM feat"
            for c, w in DEMO_MODEL.weights.items()
        )
    ),
)
def standardized_coefs(spark, sf_dir):
    effects = explore.standardized_effects(feature_rows(spark, sf_dir), DEMO_MODEL.weights)
    return effects.select("feature", *rounded("coef_raw", "std_dataset", "effect_1_std"))


@query(
    "sensitivity_p25_p75",
    with_tables(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, round(quantile_cont({c}, 0.25), 6) AS p25, "
            f"round(quantile_cont({c}, 0.75), 6) AS p75, "
            + ", ".join(
                f"round(1.2 + "
                + " + ".join(
                    f"{w} * quantile_cont({o}, {q if o == c else 0.5})"
                    for o, w in DEMO_MODEL.weights.items()
                )
                + f", 6) AS prediction_p{int(q * 100)}"
                for q in (0.25, 0.75)
            )
            + f", round({w0} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)), 6) AS delta "
            "FROM feat"
            for c, w0 in DEMO_MODEL.weights.items()
        )
    ),
)
def sensitivity_p25_p75(spark, sf_dir):
    rows = written_table(feature_rows(spark, sf_dir), "features")
    profiles = explore.sensitivity_profiles(rows).withColumn(
        "prediction", DEMO_MODEL.prediction()
    )
    found = explore.sensitivity(profiles)
    return found.select(
        "feature", *rounded("p25", "p75", "prediction_p25", "prediction_p75", "delta")
    )


TRIM_CTE = (
    "tq AS (SELECT "
    + ", ".join(
        f"quantile_cont({f}, 0.05) AS lo_{f}, quantile_cont({f}, 0.95) AS hi_{f}" for f in FEATURES
    )
    + " FROM sc), trimmed AS (SELECT sc.* FROM sc, tq WHERE "
    + " AND ".join(f"{f} BETWEEN lo_{f} AND hi_{f}" for f in FEATURES)
    + ")"
)


@query(
    "trim_p5_p95",
    with_tables("SELECT row_id, round(prediction, 6) AS prediction FROM trimmed", SCORED_CTE, TRIM_CTE),
)
def trim_p5_p95(spark, sf_dir):
    return explore.trim(scored_rows(spark, sf_dir)).select(
        *longs("row_id"), *rounded("prediction")
    )


@query(
    "best_contrast_pair",
    with_tables(
        """
        SELECT a.row_id AS id_a, b.row_id AS id_b,
               round(abs(a.prediction - b.prediction), 6) AS difference
        FROM trimmed a JOIN trimmed b ON a.age_scaled = b.age_scaled AND a.row_id < b.row_id
             AND abs(a.mean_daily_use_minutes - b.mean_daily_use_minutes) <= 3.0
        ORDER BY abs(a.prediction - b.prediction) DESC, a.row_id, b.row_id LIMIT 1
        """,
        SCORED_CTE,
        TRIM_CTE,
    ),
)
def best_contrast_pair(spark, sf_dir):
    kept = written_table(explore.trim(scored_rows(spark, sf_dir)), "trimmed")
    return explore.contrast_pair(kept).select(*longs("id_a", "id_b"), *rounded("difference"))


@query(
    "best_contrast_pair_all",
    with_tables(
        """
        SELECT a.row_id AS id_a, b.row_id AS id_b,
               round(abs(a.prediction - b.prediction), 6) AS difference
        FROM sc a JOIN sc b ON a.age_scaled = b.age_scaled AND a.row_id < b.row_id
             AND abs(a.mean_daily_use_minutes - b.mean_daily_use_minutes) <= 3.0
        ORDER BY abs(a.prediction - b.prediction) DESC, a.row_id, b.row_id LIMIT 1
        """,
        SCORED_CTE,
    ),
)
def best_contrast_pair_all(spark, sf_dir):
    """The same search on the untrimmed table."""
    return explore.contrast_pair(scored_rows(spark, sf_dir)).select(
        *longs("id_a", "id_b"), *rounded("difference")
    )


@query(
    "band_summary",
    with_tables(
        """
        SELECT round_even(mean_daily_use_minutes / 10, 0) * 10 AS use_band, count(*) AS n,
               round(avg(prediction), 6) AS mean_prediction,
               round(min(prediction), 6) AS min_prediction,
               round(max(prediction), 6) AS max_prediction,
               round(stddev_samp(prediction), 6) AS std_prediction,
               round(max(prediction) - min(prediction), 6) AS prediction_range
        FROM sc GROUP BY 1 HAVING count(*) >= 15
        ORDER BY max(prediction) - min(prediction) DESC, 1 LIMIT 15
        """,
        SCORED_CTE,
    ),
)
def band_summary(spark, sf_dir):
    bands = explore.band_summary(
        feature_rows(spark, sf_dir).withColumn("prediction", DEMO_MODEL.prediction())
    )
    return bands.select(
        "use_band",
        *longs("n"),
        *rounded(
            "mean_prediction",
            "min_prediction",
            "max_prediction",
            "std_prediction",
            "prediction_range",
        ),
    )
