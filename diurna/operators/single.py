"""Values of a one-row frame as columns of another frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_of(single: DataFrame) -> Column:
    """The row of a one-row frame as a struct: a scalar subquery.

    It runs once per query and is a constant for the frame that uses it; no
    row yields NULL, a second row is an error.
    """
    return single.select(F.struct(*single.columns)).scalar()


def with_row(df: DataFrame, single: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame to every row."""
    return df.withColumn("__single", row_of(single)).select(
        *df.columns, *[F.col("__single")[c].alias(c) for c in single.columns]
    )
