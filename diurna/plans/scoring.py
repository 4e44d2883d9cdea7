"""Batch scoring of validated weekly rows with a linear model table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diurna.functions import numeric
from diurna.schemas import (
    FEATURES,
    POSITIVE_FEATURES,
    RATIO_FEATURES,
    SHARE_FEATURES,
    TARGET,
    TARGET_RANGE,
)


@dataclass(frozen=True)
class LinearModel:
    """Coefficients with the contract a scorer checks them against."""

    intercept: float
    coefficients: tuple[float, ...]
    features: tuple[str, ...] = tuple(FEATURES)
    model_version: str = "1.0"
    model_type: str = "LinearRegression"
    target: str = TARGET
    target_range: tuple[float, float] = TARGET_RANGE
    training_population: str = "synthetic"
    development_size: int = 0
    test_size: int = 0

    @property
    def weights(self) -> dict[str, float]:
        return dict(zip(self.features, self.coefficients, strict=True))

    def prediction(self) -> Column:
        return numeric.linear_score(self.weights, self.intercept)


def first_failure(columns: Sequence[tuple[str, T.DataType]]) -> Column:
    """Why a row cannot be scored, or NULL; rules in order of severity.

    Missing and unknown columns are properties of the table, numbers and
    ranges of the row.
    """
    names = [n for n, _ in columns]
    types = dict(columns)
    missing = sorted(set(FEATURES) - set(names))
    if missing:
        return F.lit("missing:" + ",".join(missing))
    textual = sorted(
        f
        for f in FEATURES
        if not isinstance(types[f], T.NumericType | T.StringType | T.BooleanType)
    )
    if textual:
        return F.lit("not_numeric:" + ",".join(textual))

    values = {f: F.col(f).try_cast("double") if _is_text(types[f]) else F.col(f).cast("double") for f in FEATURES}
    reason = F.when(F.lit(False), F.lit(""))
    unparsed = F.lit(False)
    for f in FEATURES:
        if _is_text(types[f]):
            unparsed = unparsed | (F.col(f).isNotNull() & values[f].isNull())
    finite = F.lit(True)
    for f in FEATURES:
        finite = finite & numeric.is_finite(values[f])
    reason = reason.when(unparsed, "not_numeric").when(~finite, "not_finite")
    reason = reason.when(~values["age_scaled"].between(-1.5, 1.5), "range:age_scaled")
    for f in POSITIVE_FEATURES:
        reason = reason.when(values[f] <= 0, f"range:{f}")
    for f in RATIO_FEATURES:
        reason = reason.when(~values[f].between(0.0, 1.0), f"range:{f}")
    shares = sum((values[f] for f in SHARE_FEATURES[1:]), values[SHARE_FEATURES[0]])
    return reason.when(shares > 1.0 + 1e-10, "share_sum")


def _is_text(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType)


def check_input(df: DataFrame, ids: Sequence[str] = ("child_id",)) -> DataFrame:
    """Add ``reject_reason`` (NULL for rows that may be scored)."""
    columns = [(f.name, f.dataType) for f in df.schema.fields if f.name not in ids]
    unknown = sorted({n for n, _ in columns} - set(FEATURES))
    reason = first_failure(columns)
    if unknown and not (set(FEATURES) - {n for n, _ in columns}):
        reason = F.lit("unknown:" + ",".join(unknown))
    return df.withColumn("reject_reason", reason)


def score(df: DataFrame, model: LinearModel, ids: Sequence[str] = ("child_id",)) -> DataFrame:
    """Score valid rows; predictions are never clipped.

    Rejected rows stay, with their reason and no prediction.
    """
    checked = check_input(df.select(*ids, *[c for c in df.columns if c not in ids]), ids)
    low, high = model.target_range
    return (
        checked.withColumn(
            "prediction", F.when(F.col("reject_reason").isNull(), model.prediction())
        )
        .withColumns(
            {
                "model_version": F.lit(model.model_version),
                "target_min": F.lit(low),
                "target_max": F.lit(high),
                "within_expected_range": F.col("prediction").between(low, high),
            }
        )
    )


def weekly_analysis(scored: DataFrame, ids: Sequence[str] = ("child_id",)) -> DataFrame:
    """The nine reported fields of a scored week; no labels, no thresholds."""
    return scored.where(F.col("reject_reason").isNull()).select(
        *ids,
        "model_version",
        F.col("prediction").alias("predicted_severity"),
        F.col("within_expected_range").alias("prediction_within_expected_range"),
        "mean_daily_use_minutes",
        "mean_daily_session_count",
        "mean_daily_app_openings",
        "median_session_duration",
        "post_bedtime_use_ratio",
        "school_use_ratio",
    )
