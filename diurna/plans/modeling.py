"""Model evaluation from distributed sufficient statistics, and MLlib trees.

Every linear model of the evaluation protocol (mean baseline, least squares,
ridge, ablations, alternative columns, learning curve, final fit) is a function
of sums of squares and products. One aggregate pass per protocol yields those
sums per fold; the training part of a fold is the total minus the fold. The
small solves run inside a task on k rows, and the coefficients (k folds x the
models of the protocol, a size the data does not influence) are broadcast back
for the scoring pass, where the absolute error needs the rows themselves.

Tree ensembles have no such sums. A grid fits every point and fold on all training rows:
in a task of its own where the table is small, else level by level over the whole
cluster (``diurna.plans.growth``). ``cross_validate_estimators`` fits any MLlib estimator.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import partial
from multiprocessing.pool import ThreadPool
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diurna.operators import aggregates, sampling, trees
from diurna.operators.single import with_row
from diurna.plans import growth
from diurna.schemas import (
    CV_FOLDS,
    CV_SEED,
    FEATURE_GROUPS,
    FEATURES,
    RIDGE_ALPHAS,
    TARGET,
    TRAIN_FRACTIONS,
)
from diurna.session import scratch_path, ship_by_value

ship_by_value(__name__)


@dataclass(frozen=True)
class LinearSpec:
    """A linear model: its columns (none = predict the mean) and ridge alpha.

    ``alpha`` penalises coefficients of columns standardised on the training
    rows; 0 is ordinary least squares.
    """

    name: str
    columns: tuple[str, ...]
    alpha: float = 0.0


def dummy_spec() -> LinearSpec:
    return LinearSpec("DummyMean", ())


def linear_spec(columns: Sequence[str] = FEATURES, name: str = "LinearRegression") -> LinearSpec:
    return LinearSpec(name, tuple(columns))


def ridge_specs(alphas: Sequence[float] = RIDGE_ALPHAS) -> list[LinearSpec]:
    return [LinearSpec(f"Ridge_alpha_{a:g}", tuple(FEATURES), a) for a in alphas]


def ablation_specs(
    groups: Mapping[str, Sequence[str]] = FEATURE_GROUPS, columns: Sequence[str] = FEATURES
) -> list[LinearSpec]:
    """The full model and one without each group; groups must cover the columns."""
    covered = [c for members in groups.values() for c in members]
    if sorted(covered) != sorted(columns):
        raise ValueError("ablation groups do not cover the features exactly once")
    specs = [LinearSpec("Full", tuple(columns))]
    for name, members in groups.items():
        kept = tuple(c for c in columns if c not in members)
        specs.append(LinearSpec(f"Without_{name}", kept))
    return specs


def alternative_specs() -> list[LinearSpec]:
    return [
        LinearSpec("Oracle_S", ("S",)),
        LinearSpec("Oracle_S_U", ("S", "U")),
        LinearSpec("Oracle_S_U_B_F", ("S", "U", "B", "F")),
    ]


# --- sufficient statistics --------------------------------------------------


def _names(columns: Sequence[str]) -> list[tuple[str, int, int]]:
    n = len(columns)
    return [(f"c_{i}_{j}", i, j) for i in range(n) for j in range(i, n)]


def gram(df: DataFrame, columns: Sequence[str], target: str, by: Sequence[str]) -> DataFrame:
    """Per group: n, sums and products of columns + target, about global means.

    Centring first keeps the normal equations well conditioned; the means come
    along as columns m_<i>.
    """
    variables = [*columns, target]
    means = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(variables)])
    centred = with_row(df, means).select(
        *by,
        *[f"m_{i}" for i in range(len(variables))],
        *[(F.col(c) - F.col(f"m_{i}")).alias(f"v_{i}") for i, c in enumerate(variables)],
    )
    return centred.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.first(f"m_{i}").alias(f"m_{i}") for i in range(len(variables))],
        *[F.sum(f"v_{i}").alias(f"s_{i}") for i in range(len(variables))],
        *[F.sum(F.col(f"v_{i}") * F.col(f"v_{j}")).alias(name) for name, i, j in _names(variables)],
    )


def subset_grams(
    df: DataFrame, columns: Sequence[str], target: str, subsets: str, draws: Sequence[tuple[int, float]]
) -> DataFrame:
    """``gram`` of every training subset in one pass, without copies of rows.

    ``subsets`` holds a bit for each subset a row is in (``sampling.with_subsets``). A
    task adds up one small matrix per subset over its rows and hands those on.
    """
    variables = [*columns, target]
    size = len(variables)
    means = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(variables)])
    centred = with_row(df, means).select(
        F.col(subsets).alias("mask"),
        *[f"m_{i}" for i in range(size)],
        *[(F.col(c) - F.col(f"m_{i}")).cast("double").alias(f"v_{i}") for i, c in enumerate(variables)],
    )
    upper = [(i, j) for _, i, j in _names(range(size))]
    names = ["n", *[f"s_{i}" for i in range(size)], *[n for n, _, _ in _names(range(size))]]

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(draws), size + 1, size + 1))
        middle = None
        for batch in batches:
            if not len(batch):
                continue
            if middle is None:
                middle = batch[[f"m_{i}" for i in range(size)]].iloc[0].to_numpy(float)
            mask = batch["mask"].to_numpy(np.int64)
            # A missing value adds nothing to the sums it would be in.
            values = np.nan_to_num(batch[[f"v_{i}" for i in range(size)]].to_numpy(float))
            rows = np.hstack([np.ones((len(batch), 1)), values])
            for bit in range(len(draws)):
                mine = rows[(mask >> bit) & 1 == 1]
                sums[bit] += mine.T @ mine
        if middle is None:
            return
        table = [
            [fold, part, *middle, s[0, 0], *s[0, 1:], *[s[i + 1, j + 1] for i, j in upper]]
            for (fold, part), s in zip(draws, sums, strict=True)
            if s[0, 0] > 0
        ]
        head = ["validation_fold", "train_fraction", *[f"m_{i}" for i in range(size)]]
        yield pd.DataFrame(table, columns=[*head, *names])

    schema = "validation_fold int, train_fraction double, " + ", ".join(
        f"{c} double" for c in [*[f"m_{i}" for i in range(size)], *names]
    )
    return (
        centred.mapInPandas(add_up, schema)
        .groupBy("validation_fold", "train_fraction")
        .agg(
            *[F.first(f"m_{i}").alias(f"m_{i}") for i in range(size)],
            *[F.sum(c).alias(c) for c in names],
        )
    )


def _additive(columns: Sequence[str]) -> list[str]:
    size = len(columns) + 1
    return ["n", *[f"s_{i}" for i in range(size)], *[n for n, _, _ in _names(range(size))]]


def complement(grams: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Training statistics of each fold: the total minus the fold.

    ``grams`` has one row per fold, so the unpartitioned window holds k rows.
    """
    everything = Window.partitionBy()
    means = [f"m_{i}" for i in range(len(columns) + 1)]
    return grams.select(
        *by, *means, *[(F.sum(c).over(everything) - F.col(c)).alias(c) for c in _additive(columns)]
    )


def _solve(row: Any, variables: Sequence[str], spec: LinearSpec) -> np.ndarray:
    """[intercept, one coefficient per variable]; 0 for unused columns."""
    size = len(variables) + 1
    cross = np.zeros((size, size))
    for name, i, j in _names(range(size)):
        cross[i, j] = cross[j, i] = row[name]
    sums = np.array([row[f"s_{i}"] for i in range(size)])
    n = row["n"]
    scatter = cross - np.outer(sums, sums) / n
    centre = np.array([row[f"m_{i}"] for i in range(size)]) + sums / n
    used = [variables.index(c) for c in spec.columns]
    beta = np.zeros(len(variables))
    if used:
        left = scatter[np.ix_(used, used)]
        scale = np.sqrt(np.diag(left) / n)
        scale[scale == 0] = 1.0
        scaled = left / np.outer(scale, scale) + spec.alpha * np.eye(len(used))
        solution = np.linalg.lstsq(scaled, scatter[used, size - 1] / scale, rcond=None)[0]
        beta[used] = solution / scale
    return np.concatenate([[centre[-1] - beta @ centre[:-1]], beta])


def fit(
    statistics: DataFrame,
    columns: Sequence[str],
    specs: Sequence[LinearSpec],
    by: Mapping[str, str],
) -> DataFrame:
    """Solve every spec on every row of statistics.

    ``by`` maps the key columns to their SQL types. Columns: keys, model,
    train_size, coefficients (intercept first, then ``columns``).
    """
    variables, keys = list(columns), list(by)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for record in batch.to_dict("records"):
                for spec in specs:
                    coefficients = _solve(record, variables, spec)
                    rows.append(
                        [*[record[k] for k in keys], spec.name, int(record["n"]), coefficients]
                    )
            yield pd.DataFrame(rows, columns=[*keys, "model", "train_size", "coefficients"])

    schema = ", ".join(f"{k} {t}" for k, t in by.items())
    schema += (", " if schema else "") + "model string, train_size long, coefficients array<double>"
    return statistics.mapInPandas(solve, schema)


def predicted(columns: Sequence[str], coefficients: Column) -> Column:
    total = coefficients[0]
    for i, c in enumerate(columns):
        total = total + coefficients[i + 1] * F.col(c)
    return total


def score_folds(
    df: DataFrame,
    coefficients: DataFrame,
    columns: Sequence[str],
    target: str,
    labels: Sequence[Mapping[str, Any]],
    fold: str = "fold",
) -> DataFrame:
    """Metrics per fold and model, in one pass without copying rows.

    ``labels`` lists the models a fold has (column -> value); their coefficients
    become columns of the fold's row, so a data row meets all of them at once.
    """
    names = list(labels[0])

    def is_label(label):
        test = F.lit(True)
        for name in names:
            test = test & (F.col(name) == F.lit(label[name]))
        return test

    wide = coefficients.groupBy(fold).agg(
        *[F.max(F.when(is_label(x), F.col("train_size"))).alias(f"t_{i}") for i, x in enumerate(labels)],
        *[
            F.max(F.when(is_label(x), F.col("coefficients"))).alias(f"b_{i}")
            for i, x in enumerate(labels)
        ],
    )
    joined = df.join(F.broadcast(wide), fold)  # one row per fold
    errors = joined.select(
        fold,
        target,
        *[f"t_{i}" for i in range(len(labels))],
        *[
            (F.col(target) - predicted(columns, F.col(f"b_{i}"))).alias(f"e_{i}")
            for i in range(len(labels))
        ],
    )
    summed = errors.groupBy(fold).agg(
        F.count(F.lit(1)).alias("validation_size"),
        F.var_pop(target).alias("variance"),
        *[F.first(f"t_{i}").alias(f"t_{i}") for i in range(len(labels))],
        *[F.avg(F.abs(f"e_{i}")).alias(f"a_{i}") for i in range(len(labels))],
        *[F.avg(F.col(f"e_{i}") * F.col(f"e_{i}")).alias(f"q_{i}") for i in range(len(labels))],
    )
    entries = [
        F.struct(
            *[F.lit(v).alias(k) for k, v in label.items()],
            F.col(f"t_{i}").alias("train_size"),
            F.col(f"a_{i}").alias("mae"),
            F.sqrt(f"q_{i}").alias("rmse"),
            (1 - F.try_divide(F.col(f"q_{i}"), F.col("variance"))).alias("r2"),
        )
        for i, label in enumerate(labels)
    ]
    return summed.select(fold, "validation_size", F.explode(F.array(*entries)).alias("e")).select(
        *[f"e.{n}" for n in names],
        fold,
        "e.train_size",
        "validation_size",
        "e.mae",
        "e.rmse",
        "e.r2",
    )


def cross_validate(
    folded: DataFrame,
    specs: Sequence[LinearSpec],
    columns: Sequence[str] = FEATURES,
    target: str = TARGET,
) -> DataFrame:
    """Per-fold metrics of every spec. ``folded`` holds a ``fold`` column.

    Reads ``folded`` three times (means, products, errors): pass a stored table.
    """
    training = complement(gram(folded, columns, target, ["fold"]), columns, ["fold"])
    models = fit(training, columns, specs, {"fold": "int"})
    return score_folds(folded, models, columns, target, [{"model": s.name} for s in specs])


def learning_curve(
    folded: DataFrame,
    strata: Sequence[str],
    ids: Sequence[str],
    columns: Sequence[str] = FEATURES,
    target: str = TARGET,
    fractions: Sequence[float] = TRAIN_FRACTIONS,
    k: int = CV_FOLDS,
    seed: int = CV_SEED,
) -> DataFrame:
    """Least squares on growing stratified parts of each fold's training rows."""
    marked = sampling.with_subsets(folded, strata, ids, fractions, k, seed, "__subsets")
    draws = sampling.draws_of(fractions, k)
    statistics = subset_grams(marked, columns, target, "__subsets", draws)
    models = fit(
        statistics,
        columns,
        [linear_spec(columns)],
        {"validation_fold": "int", "train_fraction": "double"},
    ).withColumnRenamed("validation_fold", "fold")
    return score_folds(
        folded, models, columns, target, [{"train_fraction": float(f)} for f in fractions]
    )


def final_fit(
    development: DataFrame, columns: Sequence[str] = FEATURES, target: str = TARGET
) -> DataFrame:
    """One row: the least-squares model of the whole development set."""
    return fit(gram(development, columns, target, []), columns, [linear_spec(columns)], {})


def final_test(
    development: DataFrame,
    test: DataFrame,
    columns: Sequence[str] = FEATURES,
    target: str = TARGET,
) -> DataFrame:
    """Fit on development, evaluate once on test."""
    model = final_fit(development, columns, target)
    scored = with_row(test, model).select(
        "model",
        "train_size",
        target,
        predicted(columns, F.col("coefficients")).alias("prediction"),
    )
    return aggregates.regression_metrics(scored, target, "prediction", ["model", "train_size"]).select(
        "model",
        F.col("train_size").alias("development_size"),
        F.col("validation_size").alias("test_size"),
        "mae",
        "rmse",
        "r2",
    )


# --- tree models ------------------------------------------------------------


def forest(max_depth: int | None, min_leaf: int, trees: int = 300, seed: int = CV_SEED) -> Estimator:
    """Bagged trees on all features; None means as deep as MLlib allows (30)."""
    return RandomForestRegressor(
        featuresCol="features_vector",
        labelCol=TARGET,
        numTrees=trees,
        maxDepth=30 if max_depth is None else max_depth,
        minInstancesPerNode=min_leaf,
        featureSubsetStrategy="all",
        seed=seed,
    )


def boosting(
    max_depth: int, learning_rate: float, min_child: int, rounds: int = 300, seed: int = CV_SEED
) -> Estimator:
    """Gradient boosted trees."""
    return GBTRegressor(
        featuresCol="features_vector",
        labelCol=TARGET,
        maxIter=rounds,
        stepSize=learning_rate,
        maxDepth=max_depth,
        minInstancesPerNode=min_child,
        seed=seed,
    )


def forest_grid(depths, leaves, trees: int = 300) -> dict[str, Estimator]:
    return {
        f"RF_depth_{d}_leaf_{leaf}": forest(d, leaf, trees) for d in depths for leaf in leaves
    }


def forest_points(depths, leaves, size: int = 300) -> list[trees.ForestPoint]:
    return [
        trees.ForestPoint(f"RF_depth_{d}_leaf_{leaf}", d, leaf, size)
        for d in depths
        for leaf in leaves
    ]


def boosting_points(depths, rates, children, rounds: int = 300) -> list[trees.BoostedPoint]:
    return [
        trees.BoostedPoint(f"GBT_depth_{d}_lr_{r:g}_child_{c}", d, r, c, rounds)
        for d in depths
        for r in rates
        for c in children
    ]


def boosting_grid(depths, rates, children, rounds: int = 300) -> dict[str, Estimator]:
    return {
        f"GBT_depth_{d}_lr_{r:g}_child_{c}": boosting(d, r, c, rounds)
        for d in depths
        for r in rates
        for c in children
    }


def cross_validate_estimators(
    folded: DataFrame,
    estimators: Mapping[str, Estimator],
    k: int = CV_FOLDS,
    columns: Sequence[str] = FEATURES,
    target: str = TARGET,
) -> DataFrame:
    """Per-fold metrics of any pyspark.ml regressors (distributed training).

    The folds of an estimator are fitted side by side, and only their metrics
    are kept: a grid of deep forests never stands in the driver as a whole.
    """
    ready = VectorAssembler(inputCols=list(columns), outputCol="features_vector").transform(
        folded.select("fold", target, *columns)
    ).select("fold", target, "features_vector")

    def one(name: str, estimator: Estimator, fold: int) -> list[tuple]:
        training = ready.where(F.col("fold") != fold)
        model = estimator.fit(training)
        scored = model.transform(ready.where(F.col("fold") == fold))
        sizes = training.agg(F.count(F.lit(1)).alias("train_size"))
        metrics = aggregates.regression_metrics(scored, target, "prediction", ["fold"])
        return [
            (name, r.fold, r.train_size, r.validation_size, r.mae, r.rmse, r.r2)
            for r in with_row(metrics, sizes).collect()
        ]

    spark, found = folded.sparkSession, []
    with ThreadPool(k) as pool:
        for name, estimator in estimators.items():
            run = inheritable_thread_target(spark)(partial(one, name, estimator))
            found += [row for rows in pool.map(run, range(1, k + 1)) for row in rows]
    return spark.createDataFrame(
        found,
        "model string, fold int, train_size long, validation_size long, "
        "mae double, rmse double, r2 double",
    )


# Rows of a scoring task: this many at least, and ten times as many at most.
SCORE_TASK_ROWS = 2_000
RESULTS = (
    "model string, fold int, train_size long, validation_size long, "
    "mae double, rmse double, r2 double"
)


def _grid_sample(rows: DataFrame, size: int, fit_rows: int | None) -> pd.DataFrame:
    """All rows of a small table; about ``fit_rows``, where a caller asks for a sample."""
    if fit_rows is None or size <= fit_rows:
        return rows.toPandas()
    share = F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(share * size < fit_rows).toPandas()


def _fitted(spark, points, folds: Sequence[int], sample, seed: int) -> dict:
    """{(point, fold): ensemble} of every point and fold, each from its own task."""
    jobs = [(i, fold) for i in range(len(points)) for fold in folds]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, x, y = sample.value
        for batch in batches:
            for job in batch.column(0).to_pylist():
                i, held_out = jobs[job]
                train = fold != held_out
                if not train.any():
                    continue
                parts = points[i].fit(x[train], y[train], seed + held_out).parts()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([job]), pa.array([pickle.dumps(parts)])], ["job", "parts"]
                )

    found = spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(fit, "job long, parts binary")
    return {jobs[r.job]: trees.Ensemble.of(pickle.loads(r.parts)) for r in found.collect()}


def _scored(
    rows: DataFrame, fitted: dict, columns: Sequence[str], centre: float, parts: int
) -> DataFrame:
    """Per point and fold: sums of errors and of the target over all validation rows.

    A row is small but costly to score, so the rows are dealt to ``parts`` tasks,
    however few files they lie in.
    """
    shared = rows.sparkSession.sparkContext.broadcast(
        {key: ensemble.parts() for key, ensemble in fitted.items()}
    )
    width = len(columns)
    names = ("rows", "absolute", "squared", "target", "target2")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = {key: trees.Ensemble.of(parts) for key, parts in shared.value.items()}
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            held_out = batch.column(0).to_numpy()
            y = batch.column(1).to_numpy(zero_copy_only=False)
            x = np.stack(
                [batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(width)], axis=1
            ).astype(float)
            for (i, fold), model in models.items():
                own = held_out == fold
                if own.any():
                    e, t = y[own] - model.predict(x[own]), y[own] - centre
                    part = np.array([own.sum(), np.abs(e).sum(), e @ e, t.sum(), t @ t])
                    sums[i, fold] = sums.get((i, fold), 0.0) + part
        if sums:
            keys = list(zip(*sums))
            yield pa.RecordBatch.from_arrays(
                [pa.array(k, pa.int32()) for k in keys]
                + [pa.array(c) for c in np.stack(list(sums.values()), axis=1)],
                ["point", "fold", *names],
            )

    schema = "point int, fold int, " + ", ".join(f"{n} double" for n in names)
    spread = rows.repartition(parts)
    return spread.mapInArrow(score, schema).groupBy("point", "fold").agg(
        *[F.sum(n).alias(n) for n in names]
    )


def _small_scores(
    rows: DataFrame,
    points: Sequence[trees.ForestPoint | trees.BoostedPoint],
    folds: Sequence[int],
    columns: Sequence[str],
    target: str,
    seed: int,
    total: int,
    fit_rows: int | None,
) -> Iterator[tuple[list, DataFrame]]:
    """(points, their scores) of one group of points after the other."""
    spark = rows.sparkSession
    drawn = _grid_sample(rows, total, fit_rows)
    y = drawn[target].to_numpy(float)
    sample = spark.sparkContext.broadcast(
        (drawn["fold"].to_numpy(), drawn[list(columns)].to_numpy(float), y)
    )
    centre = float(y.mean()) if len(y) else 0.0
    cores = spark.sparkContext.defaultParallelism
    step = max(1, -(-2 * cores // max(1, len(folds))))
    parts = max(1, min(2 * cores, -(-total // SCORE_TASK_ROWS)), total // (10 * SCORE_TASK_ROWS))
    for at in range(0, len(points), step):
        group = list(points[at : at + step])
        yield group, _scored(rows, _fitted(spark, group, folds, sample, seed), columns, centre, parts)


def cross_validate_grid(
    folded: DataFrame,
    points: Sequence[trees.ForestPoint | trees.BoostedPoint],
    columns: Sequence[str] = FEATURES,
    target: str = TARGET,
    fit_rows: int | None = None,
    seed: int = CV_SEED,
    results: str | None = None,
) -> DataFrame:
    """Per-fold metrics of every point of a grid of tree ensembles, fitted on all rows.

    Up to ``growth.LOCAL_ROWS`` rows, points go in groups that fill the cluster twice,
    each point and fold is fitted in a task of its own, and one pass over ``folded``
    scores the group; larger tables stay spread over the cluster (``growth``).
    ``results`` names a folder that keeps each group's metrics; a rerun starts at the
    first point not in it. ``fit_rows`` is for trials: fits take about so many rows.
    """
    spark = folded.sparkSession
    rows = folded.select("fold", target, *columns)
    sizes = {r.fold: r["count"] for r in rows.groupBy("fold").count().collect()}
    total = sum(sizes.values())
    results = results or scratch_path(spark, "grid")
    known = spark.createDataFrame([], RESULTS)
    known.write.mode("append").parquet(results)
    done = {r.model for r in spark.read.parquet(results).select("model").distinct().collect()}
    todo = [p for p in points if p.name not in done]
    folds = sorted(sizes)
    if fit_rows is None and total > growth.LOCAL_ROWS:
        scored = growth.grid_scores(rows, todo, folds, columns, target, seed)
    else:
        scored = _small_scores(rows, todo, folds, columns, target, seed, total, fit_rows)
    for group, found in scored:
        lines = []
        for r in found.collect():  # one row per point and fold
            spread = r.target2 - r.target**2 / r.rows
            lines.append(
                (
                    group[r.point].name,
                    r.fold,
                    total - sizes[r.fold],
                    sizes[r.fold],
                    r.absolute / r.rows,
                    float(np.sqrt(r.squared / r.rows)),
                    1 - r.squared / spread if spread > 0 else None,
                )
            )
        spark.createDataFrame(lines, RESULTS).coalesce(1).write.mode("append").parquet(results)
    names = [p.name for p in points]
    return spark.read.schema(RESULTS).parquet(results).where(F.col("model").isin(names))
