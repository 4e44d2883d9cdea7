"""Training table: features joined to the target, audited against leakage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from diurna.operators import joins
from diurna.schemas import FEATURES, FORBIDDEN_FEATURES, TARGET


def assemble(
    features: DataFrame, target: DataFrame, keys: Sequence[str] = ("child_id",)
) -> DataFrame:
    """One-to-one join; exact columns in contract order."""
    joined = joins.validated_join(
        features.select(*keys, *FEATURES), target.select(*keys, TARGET), list(keys)
    )
    return joined.select(*keys, *FEATURES, TARGET)


def forbidden_columns(columns: Sequence[str], allowed: Sequence[str] = ("child_id",)) -> list[str]:
    """Columns that leak identity or latents into a training table."""
    return sorted((set(FORBIDDEN_FEATURES) - set(allowed)) & set(columns))


def audit_columns(df: DataFrame, keys: Sequence[str] = ("child_id",)) -> None:
    """Raise unless the columns are exactly keys, whitelist, target."""
    leaked = forbidden_columns(df.columns, keys)
    if leaked:
        raise ValueError(f"forbidden columns in the dataset: {leaked}")
    expected = [*keys, *FEATURES, TARGET]
    if df.columns != expected:
        raise ValueError(f"columns {df.columns}, expected {expected}")
    if TARGET in FEATURES or "child_id" in FEATURES:
        raise ValueError("target or identifier among the features")


def split_x_y(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whitelisted features in order, and the target; the id stays out."""
    return df.select(*FEATURES), df.select(TARGET)
