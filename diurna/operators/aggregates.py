"""Descriptive, correlation and regression aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diurna.operators import quantiles
from diurna.operators.single import with_row
from diurna.session import written_table


def unpivot_row(row: DataFrame, cells: dict[str, dict[str, Column]], key: str) -> DataFrame:
    """One-row frame -> one row per entry of ``cells``."""
    entries = [
        F.struct(F.lit(name).alias(key), *[c.alias(n) for n, c in columns.items()])
        for name, columns in cells.items()
    ]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


# --- summaries --------------------------------------------------------------


def describe(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float] = (0.25, 0.5, 0.75),
    by: Sequence[str] = (),
) -> DataFrame:
    """Long summary: by..., metric, statistic, value.

    Statistics: count, mean, std (ddof 1), min, exact percentiles, max.
    """
    by = list(by)
    values = quantiles.melted(df, columns, by)
    moments = values.groupBy(*by, "metric").agg(
        F.count("value").cast("double").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    stats = ["count", "mean", "std", "min", "max"]
    long = moments.select(
        *by,
        "metric",
        F.explode(
            F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).alias("value")) for s in stats])
        ).alias("e"),
    ).select(*by, "metric", "e.statistic", "e.value")
    exact = quantiles.exact_quantiles(df, columns, probabilities, by)
    name = F.lit(None)
    for p in probabilities:
        name = F.when(F.col("probability") == float(p), f"{p * 100:g}%").otherwise(name)
    return long.unionByName(
        exact.select(*by, "metric", name.alias("statistic"), F.col("quantile").alias("value"))
    )


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """Count and share of each value; NULL left out.

    The total is a second tiny aggregate over the counts, not over the rows.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias("rows")
    )
    return with_share(counts, "rows", "share")


def with_share(groups: DataFrame, amount: str, out: str) -> DataFrame:
    """Amount of each group over the amount of all groups."""
    total = groups.agg(F.sum(amount).alias("__total"))
    return (
        with_row(groups, total)
        .withColumn(out, F.try_divide(F.col(amount), F.col("__total")))
        .drop("__total")
    )


def group_mean_median(df: DataFrame, label: str, value: str) -> DataFrame:
    """Mean and exact median per label, for labels of any size."""
    means = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.avg(value).alias("mean"))
    medians = quantiles.exact_quantiles(df, [value], [0.5], [label]).select(
        label, F.col("quantile").alias("median")
    )
    return means.join(medians, label)


def session_bounds(episodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First start, last end, total and count of the episodes of a session."""
    return episodes.groupBy(*keys).agg(
        F.min("episode_start_minute").alias("first_episode_start"),
        F.max("episode_end_minute").alias("last_episode_end"),
        F.sum("episode_duration_minutes").alias("episode_minutes"),
        F.count(F.lit(1)).alias("episode_count"),
    )


def short_profile(episodes: DataFrame, seconds: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Per threshold: episodes shorter than it, their share of rows and minutes."""
    length = F.col("episode_duration_minutes")
    measures = [F.count(F.lit(1)).alias("n"), F.sum(length).alias("minutes")]
    for s in seconds:
        short = length < F.lit(s / 60)
        measures += [
            F.count_if(short).alias(f"n{s}"),
            F.coalesce(F.sum(F.when(short, length)), F.lit(0.0)).alias(f"m{s}"),
        ]
    cells = {
        str(s): {
            "episodes": F.col(f"n{s}"),
            "row_share": F.try_divide(F.col(f"n{s}"), F.col("n")),
            "minute_share": F.try_divide(F.col(f"m{s}"), F.col("minutes")),
        }
        for s in seconds
    }
    return unpivot_row(episodes.agg(*measures), cells, "under_seconds").withColumn(
        "under_seconds", F.col("under_seconds").cast("long")
    )


def crowded_share(counts: DataFrame, count: str, above: int) -> DataFrame:
    """How many groups have more than ``above`` members, and their share."""
    return counts.agg(
        F.count_if(F.col(count) > above).alias("groups_above"),
        F.try_divide(F.count_if(F.col(count) > above), F.count(F.lit(1))).alias("share_above"),
    )


def top_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """First n rows in a total order (a bounded heap per task)."""
    return df.orderBy(*order).limit(n)


def extreme_days(daily: DataFrame) -> DataFrame:
    """Days whose night share is 1 or above one half, school share above one half."""
    night, school = F.col("post_bedtime_use_ratio"), F.col("school_use_ratio")
    tests = {
        "post_bedtime_equal_1": F.abs(night - 1.0) <= 1e-10 + 1e-5,
        "post_bedtime_over_half": night > 0.5,
        "school_over_half": school > 0.5,
    }
    row = daily.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(t).alias(k) for k, t in tests.items()]
    )
    cells = {
        k: {"days": F.col(k), "share": F.try_divide(F.col(k), F.col("n"))} for k in tests
    }
    return unpivot_row(row, cells, "extreme")


# --- correlations -----------------------------------------------------------


def pair_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """column_a, column_b, correlation over the rows in which both columns are present.

    Rows are summed once per pattern of missing values, and the few pattern rows are
    added up per pair, so a pair costs one product instead of masked moments of its own.
    Values are taken from the column's mean, which keeps the sums small. A column that is
    constant over a pair's rows, or a pair without rows, gives NULL.
    """
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    place = {c: i for i, c in enumerate(columns)}
    wanted = [(place[a], place[b]) for a, b in pairs]
    products = sorted({(min(p), max(p)) for p in wanted} | {(i, i) for i in place.values()})
    stored = written_table(
        df.select(*[F.col(c).cast("double").alias(f"v{i}") for c, i in place.items()]), "values"
    )
    means = stored.selectExpr(
        *[f"avg(v{i}) FILTER (WHERE abs(v{i}) < double('inf')) AS m{i}" for i in place.values()]
    )
    centred = with_row(stored, means).selectExpr(*[f"v{i} - m{i} AS v{i}" for i in place.values()])
    patterns = centred.groupBy(*[F.col(f"v{i}").isNull() for i in place.values()]).agg(
        F.expr("count(1) AS n"),
        *[F.expr(f"{how}(v{i}) AS {how}{i}") for i in place.values() for how in ("sum", "min", "max")],
        *[F.expr(f"sum(v{i} * v{j}) AS p{i}_{j}") for i, j in products],
    )
    listed = {how: [f"{how}{i}" for i in place.values()] for how in ("sum", "min", "max")}
    listed["p"] = [f"p{i}_{j}" for i, j in products]
    rows = patterns.selectExpr(
        "n", *[f"array({', '.join(items)}) AS {name}" for name, items in listed.items()]
    )
    # A row without values, so that an empty table has its pairs too.
    lacking = [f"CAST(NULL AS array<double>) AS {name}" for name in listed]
    rows = rows.unionAll(df.sparkSession.range(1).selectExpr("0L AS n", *lacking))

    at = {p: i for i, p in enumerate(products)}
    literal = ", ".join(
        f"named_struct('x', {x}, 'y', {y}, 'xy', {at[min(x, y), max(x, y)]}, "
        f"'xx', {at[x, x]}, 'yy', {at[y, y]})"
        for x, y in wanted
    )
    # What a pattern adds to a pair: nothing where it lacks one of the two columns.
    met = rows.selectExpr("*", f"explode(array({literal})) AS c").selectExpr(
        "*", "p[c.xy] AS xy"
    )
    held = [
        f"IF(xy IS NULL, NULL, {value}) AS {name}"
        for name, value in {
            "n": "n",
            **{f"{k}_{how}": f"{how}[c.{k}]" for k in "xy" for how in ("sum", "min", "max")},
            "x2": "p[c.xx]",
            "y2": "p[c.yy]",
        }.items()
    ]
    cells = met.selectExpr("c.x AS x", "c.y AS y", "xy", *held)
    summed = cells.groupBy("x", "y").agg(
        *[F.sum(c).alias(c) for c in ("n", "xy", "x_sum", "y_sum", "x2", "y2")],
        *[F.min(c).alias(c) for c in ("x_min", "y_min")],
        *[F.max(c).alias(c) for c in ("x_max", "y_max")],
    )

    def moment(xy: str, x: str, y: str) -> Column:
        n = F.col("n")
        return F.col(xy) / n - (F.col(x) / n) * (F.col(y) / n)

    def deviation(side: str) -> Column:
        variance = moment(f"{side}2", f"{side}_sum", f"{side}_sum")
        return F.sqrt(F.greatest(variance, F.lit(0.0)))

    spread = deviation("x") * deviation("y")
    varies = (F.col("x_max") > F.col("x_min")) & (F.col("y_max") > F.col("y_min"))
    found = F.when(varies, F.try_divide(moment("xy", "x_sum", "y_sum"), spread))
    names = F.array(*[F.lit(c) for c in columns])
    return summed.select(
        names[F.col("x")].alias("column_a"),
        names[F.col("y")].alias("column_b"),
        found.alias("correlation"),
    )


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All pairs, both ways and each column with itself; constant columns give NULL."""
    pairs = [*combinations(columns, 2), *[(c, c) for c in columns]]
    found = pair_correlations(df, pairs)
    turned = found.where("column_a <> column_b").select(
        F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), "correlation"
    )
    return found.unionAll(turned)


def corr_with(df: DataFrame, columns: Sequence[str], anchor: str) -> DataFrame:
    """Correlation of each column with the anchor, strongest first."""
    found = pair_correlations(df, [(c, anchor) for c in columns])
    return found.select(F.col("column_a").alias("feature"), "correlation").orderBy(
        F.abs("correlation").desc_nulls_last(), "feature"
    )


def _corr(a: str, b: str) -> Column:
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def redundancy(
    df: DataFrame, y: str, x1: str, x2: str, latent: str, per_unit: tuple[str, str]
) -> DataFrame:
    """Does y still say something once x1 and x2 are known?

    OLS y ~ 1 + x1 + x2 in closed form from one covariance pass; a second pass
    takes the residual's spread and its correlation with ``latent``, and that
    of the ratio ``per_unit``.
    """
    m = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in (y, x1, x2)],
        F.var_pop(x1).alias("s11"),
        F.var_pop(x2).alias("s22"),
        F.covar_pop(x1, x2).alias("s12"),
        F.covar_pop(x1, y).alias("s1y"),
        F.covar_pop(x2, y).alias("s2y"),
    )
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    fitted = m.select(
        *[f"m_{c}" for c in (y, x1, x2)],
        F.try_divide(F.col("s22") * F.col("s1y") - F.col("s12") * F.col("s2y"), det).alias("b1"),
        F.try_divide(F.col("s11") * F.col("s2y") - F.col("s12") * F.col("s1y"), det).alias("b2"),
    )
    predicted = (
        F.col(f"m_{y}")
        + F.col("b1") * (F.col(x1) - F.col(f"m_{x1}"))
        + F.col("b2") * (F.col(x2) - F.col(f"m_{x2}"))
    )
    scored = with_row(df, fitted).select(
        y,
        latent,
        "b1",
        "b2",
        (F.col(y) - predicted).alias("residual"),
        F.try_divide(F.col(per_unit[0]), F.col(per_unit[1])).alias("per_unit"),
    )
    return scored.agg(
        F.first("b1").alias("coef_1"),
        F.first("b2").alias("coef_2"),
        (1 - F.try_divide(F.sum(F.col("residual") * F.col("residual")), F.var_pop(y) * F.count(y))).alias("r2"),
        F.stddev_samp(y).alias("std_y"),
        F.stddev_samp("residual").alias("std_residual"),
        _corr("residual", latent).alias("corr_residual_latent"),
        _corr("per_unit", latent).alias("corr_per_unit_latent"),
    )


# --- model metrics ----------------------------------------------------------


def regression_metrics(
    df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()
) -> DataFrame:
    """Size, MAE, RMSE and R2 (against the mean of the rows at hand)."""
    error = F.col(actual) - F.col(predicted)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("validation_size"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.try_divide(F.avg(error * error), F.var_pop(actual))).alias("r2"),
    )


METRICS = ("mae", "rmse", "r2")


def summarize_folds(results: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean and ddof-1 spread of each metric over the folds of a model."""
    return results.groupBy(*by).agg(
        *[F.avg(m).alias(f"{m}_mean") for m in METRICS],
        *[F.stddev_samp(m).alias(f"{m}_std") for m in METRICS],
    )


def best_model(summary: DataFrame) -> DataFrame:
    """Lowest MAE, then RMSE, then name."""
    return summary.orderBy("mae_mean", "rmse_mean", "model").limit(1)


def delta_against(summary: DataFrame, full: str = "Full") -> DataFrame:
    """Metric differences to the full model; full first, worst loss next."""
    base = summary.where(F.col("model") == full).select(
        *[F.col(f"{m}_mean").alias(f"__{m}") for m in METRICS]
    )
    return (
        with_row(summary, base)
        .withColumns(
            {f"delta_{m}_vs_full": F.col(f"{m}_mean") - F.col(f"__{m}") for m in METRICS}
        )
        .drop(*[f"__{m}" for m in METRICS])
        .orderBy((F.col("model") == full).desc(), F.col("delta_mae_vs_full").desc())
    )
