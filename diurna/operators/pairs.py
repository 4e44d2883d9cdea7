"""Best contrast pair in a band, without listing pairs.

Wanted: two rows of the same group whose ``x`` differs by at most ``width`` and
whose ``score`` differs most. Listing the pairs of a band is quadratic. Instead
rows are reduced to the extreme scores of narrow cells. Cells close enough
that any two of their rows qualify are compared by their extremes alone, and
give a lower bound. Only cells at the edge of the band need single rows, and of
those only rows that can still reach the bound: of one ``x`` the extremes, which are
matched by running extremes along ``x``, carried from slice to slice of a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diurna.operators.scans import carried_scan
from diurna.operators.single import with_row
from diurna.session import written_table

CELLS_PER_WIDTH = 16
# Slices of an edge cell, each a chunk of the scan.
SLICES = 1024


def _pair(id_x: Column, id_y: Column, diff: Column) -> Column:
    """Sorts first when the difference is larger, then by the smaller ids."""
    return F.struct(
        (-diff).alias("neg_diff"),
        F.least(id_x, id_y).alias("id_a"),
        F.greatest(id_x, id_y).alias("id_b"),
    )


def _low(score: Column, id_: Column) -> Column:
    return F.min(F.struct(score.alias("score"), id_.alias("id")))


def _high(score: Column, id_: Column) -> Column:
    """Highest score, smallest id: the minimum of the negated score."""
    return F.min(F.struct((-score).alias("neg"), id_.alias("id")))


def best_contrast_pair(
    df: DataFrame, group: str, x: str, score: str, id_: str, width: float
) -> DataFrame:
    """One row: id_a < id_b and their score difference (none without a pair)."""
    step = width / CELLS_PER_WIDTH
    rows = df.select(
        F.col(group).alias("g"),
        F.col(x).alias("x"),
        F.col(score).alias("score"),
        F.col(id_).alias("id"),
        F.floor(F.col(x) / F.lit(step)).cast("long").alias("cell"),
    ).where("g IS NOT NULL AND x IS NOT NULL AND score IS NOT NULL")

    # A handful of numbers per narrow cell. Stored: it is read several times,
    # and its known size lets the planner broadcast it while it is small.
    cells = written_table(
        rows.groupBy("g", "cell").agg(
            _low(F.col("score"), F.col("id")).alias("low"),
            _high(F.col("score"), F.col("id")).alias("high"),
        ),
        "cells",
    )

    # Cells up to CELLS_PER_WIDTH - 2 apart: every pair qualifies, whatever the
    # rounding of x / step at a cell border.
    sure = Window.partitionBy("g").orderBy("cell").rangeBetween(0, CELLS_PER_WIDTH - 2)
    ahead = cells.select(
        "g",
        "low",
        "high",
        F.min("low").over(sure).alias("low_near"),
        F.min("high").over(sure).alias("high_near"),
    )
    sure_pairs = ahead.select(
        F.explode(
            F.array(
                _pair(
                    F.col("high.id"), F.col("low_near.id"), -F.col("high.neg") - F.col("low_near.score")
                ),
                _pair(
                    F.col("low.id"), F.col("high_near.id"), -F.col("high_near.neg") - F.col("low.score")
                ),
            )
        ).alias("pair")
    ).where("pair.id_a < pair.id_b")
    floor_ = sure_pairs.agg((-F.min("pair.neg_diff")).alias("bound"))

    # Edge cells: some pairs qualify. Keep rows that may still reach the bound
    # against the extremes of the three cells opposite; equal copies fold.
    first, last = CELLS_PER_WIDTH - 1, CELLS_PER_WIDTH + 1
    by_cell = Window.partitionBy("g").orderBy("cell")

    def extremes(side: str, window) -> list[Column]:
        return [
            F.min("low.score").over(window).alias(f"{side}_low"),
            (-F.min("high.neg").over(window)).alias(f"{side}_high"),
        ]

    edges = cells.select(
        "g",
        "cell",
        *extremes("right", by_cell.rangeBetween(first, last)),
        *extremes("left", by_cell.rangeBetween(-last, -first)),
    )
    near = with_row(rows.join(edges, ["g", "cell"]), floor_)

    def edge_rows(opposite: str, is_left: bool, key: Column) -> DataFrame:
        reach = F.greatest(
            F.col("score") - F.col(f"{opposite}_low"), F.col(f"{opposite}_high") - F.col("score")
        )
        offsets = F.array(*[F.lit(k) for k in range(first, last + 1)])
        left_cell = F.col("cell") if is_left else F.col("cell") - F.col("offset")
        return (
            near.where(reach.isNotNull() & (F.col("bound").isNull() | (reach >= F.col("bound"))))
            .withColumn("offset", F.explode(offsets))
            .groupBy("g", left_cell.alias("left_cell"), "offset", key.alias("key"))
            .agg(
                _low(F.col("score"), F.col("id")).alias("own_low"),
                _high(F.col("score"), F.col("id")).alias("own_high"),
            )
            .withColumn("is_left", F.lit(is_left))
        )

    # Left rows look for right rows with x <= own x + width.
    left = edge_rows("right", True, F.col("x") + F.lit(width))
    right = edge_rows("left", False, F.col("x"))
    right_only = ~F.col("is_left")
    # Stored: few rows are left, and the scan reads them twice.
    matched = carried_scan(
        written_table(left.unionByName(right), "edge-rows"),
        ["g", "left_cell", "offset"],
        F.floor(F.col("key") / F.lit(step / SLICES)),
        ["key"],
        {
            "low": ("min", F.when(right_only, F.col("own_low"))),
            "high": ("min", F.when(right_only, F.col("own_high"))),
        },
        peers=True,
    ).where(F.col("is_left") & F.col("low").isNotNull())

    def contrast(low: str, high: str) -> Column:
        difference = F.abs(-F.col(f"{high}.neg") - F.col(f"{low}.score"))
        return _pair(F.col(f"{low}.id"), F.col(f"{high}.id"), difference)

    edge_pairs = matched.select(
        F.explode(F.array(contrast("low", "own_high"), contrast("own_low", "high"))).alias("pair")
    )
    best = sure_pairs.unionByName(edge_pairs).agg(F.min("pair").alias("pair"))
    return best.where(F.col("pair").isNotNull()).select(
        F.col("pair.id_a").alias("id_a"),
        F.col("pair.id_b").alias("id_b"),
        (-F.col("pair.neg_diff")).alias("difference"),
    )
