"""Set operations over id columns and result tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def concat(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all parts; columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def overlap_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct ids in both, only in a, only in b, in either.

    One aggregate over the stacked ids tells the side of every id, so the four
    set sizes cost one shuffle.
    """
    sides = (
        a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b"))
        .unionByName(b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")))
        .groupBy(key)
        .agg(F.max("a").alias("a"), F.max("b").alias("b"))
    )
    tests = {
        "both": (F.col("a") == 1) & (F.col("b") == 1),
        "only_a": (F.col("a") == 1) & (F.col("b") == 0),
        "only_b": (F.col("a") == 0) & (F.col("b") == 1),
        "either": F.lit(True),
    }
    row = sides.agg(*[F.count_if(t).alias(name) for name, t in tests.items()])
    entries = F.array(
        *[F.struct(F.lit(n).alias("part"), F.col(n).alias("ids")) for n in tests]
    )
    return row.select(F.explode(entries).alias("e")).select("e.*")
