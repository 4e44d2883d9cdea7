"""Exploring a scored table: trimming, contrast pairs, bands, sensitivity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diurna.functions import numeric
from diurna.operators import aggregates, pairs, quantiles
from diurna.operators.single import with_row
from diurna.schemas import FEATURES


def trim(
    df: DataFrame, columns: Sequence[str] = FEATURES, low: float = 0.05, high: float = 0.95
) -> DataFrame:
    """Rows inside [P_low, P_high] of every column, bounds from the whole table."""
    bounds = quantiles.quantile_row(df, columns, [low, high])
    lows, highs = F.col(quantiles.percent_name(low)), F.col(quantiles.percent_name(high))
    inside = F.lit(True)
    for c in columns:
        inside = inside & F.col(c).between(lows[c], highs[c])
    return with_row(df, bounds).where(inside).select(*df.columns)


def contrast_pair(df: DataFrame, width: float = 3.0, id_: str = "row_id") -> DataFrame:
    """Same age, use within ``width`` minutes, most different prediction."""
    return pairs.best_contrast_pair(
        df, "age_scaled", "mean_daily_use_minutes", "prediction", id_, width
    )


def band_summary(
    df: DataFrame, width: float = 10.0, min_rows: int = 15, top: int = 15
) -> DataFrame:
    """Spread of predictions within bands of similar use, widest first."""
    bands = (
        df.withColumn("use_band", numeric.band(F.col("mean_daily_use_minutes"), width))
        .groupBy("use_band")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("prediction").alias("mean_prediction"),
            F.min("prediction").alias("min_prediction"),
            F.max("prediction").alias("max_prediction"),
            F.stddev_samp("prediction").alias("std_prediction"),
        )
        .withColumn("prediction_range", F.col("max_prediction") - F.col("min_prediction"))
    )
    return aggregates.top_rows(
        bands.where(F.col("n") >= min_rows),
        [F.col("prediction_range").desc(), F.col("use_band")],
        top,
    )


def standardized_effects(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Effect of one standard deviation of each feature, strongest first."""
    row = df.agg(*[F.stddev_samp(c).alias(c) for c in weights])
    cells = {
        c: {
            "coef_raw": F.lit(float(w)),
            "std_dataset": F.col(c),
            "effect_1_std": F.lit(float(w)) * F.col(c),
        }
        for c, w in weights.items()
    }
    return aggregates.unpivot_row(row, cells, "feature").orderBy(
        F.abs("effect_1_std").desc_nulls_last(), "feature"
    )


def sensitivity_profiles(df: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Two rows per feature: it at P25 / P75, every other one at its median."""
    marks = quantiles.quantile_row(df, columns, [0.25, 0.5, 0.75])
    profiles = [
        F.struct(
            F.lit(varied).alias("feature"),
            F.lit(side).alias("side"),
            *[F.col(side if c == varied else "p50")[c].alias(c) for c in columns],
        )
        for varied in columns
        for side in ("p25", "p75")
    ]
    return marks.select(F.explode(F.array(*profiles)).alias("r")).select("r.*")


def sensitivity(scored_profiles: DataFrame) -> DataFrame:
    """Prediction change P25 -> P75 per feature, strongest first.

    Takes sensitivity_profiles scored by any model (column ``prediction``).
    """
    value = F.lit(None).cast("double")
    for c in FEATURES:
        value = F.when(F.col("feature") == c, F.col(c)).otherwise(value)
    sides = scored_profiles.withColumn("value", value).groupBy("feature").agg(
        *[
            F.max(F.when(F.col("side") == s, F.col(v))).alias(name)
            for s, v, name in (
                ("p25", "value", "p25"),
                ("p75", "value", "p75"),
                ("p25", "prediction", "prediction_p25"),
                ("p75", "prediction", "prediction_p75"),
            )
        ]
    )
    return sides.withColumn("delta", F.col("prediction_p75") - F.col("prediction_p25")).orderBy(
        F.abs("delta").desc(), "feature"
    )
