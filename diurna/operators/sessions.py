"""Sessionisation by inactivity gap over app episodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def start_grain(
    episodes: DataFrame,
    extra: Sequence[Column] = (),
    keys: Sequence[str] = ("child_id", "day_index"),
) -> DataFrame:
    """Episodes reduced to one row per (child, day, start minute).

    Starts are whole minutes, so a child-day keeps at most 1,440 rows however
    many episodes it had; the reduction combines before the shuffle and its key
    spreads a hot child over all its minutes.
    """
    return episodes.groupBy(*keys, "episode_start_minute").agg(
        F.max("episode_end_minute").alias("reach_minute"),
        F.count(F.lit(1)).alias("openings"),
        *extra,
    )


def number_sessions(
    starts: DataFrame,
    gap_minutes: float = 30.0,
    keys: Sequence[str] = ("child_id", "day_index"),
) -> DataFrame:
    """Add session_index: a new session opens when a start lies more than the
    gap after everything before it has ended."""
    by_start = Window.partitionBy(*keys).orderBy("episode_start_minute")
    reached = F.max("reach_minute").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(
        reached.isNull() | (F.col("episode_start_minute") > reached + F.lit(gap_minutes)), 1
    ).otherwise(0)
    return (
        starts.withColumn("__opens", opens)
        .withColumn("session_index", F.sum("__opens").over(by_start).cast("int"))
        .drop("__opens")
    )


def session_table(
    numbered: DataFrame,
    extra: Sequence[Column] = (),
    keys: Sequence[str] = ("child_id", "day_index"),
) -> DataFrame:
    """One row per session with its bounds; duration is the span."""
    return (
        numbered.groupBy(*keys, "session_index")
        .agg(
            F.min("episode_start_minute").alias("session_start_minute"),
            F.max("reach_minute").alias("session_end_minute"),
            F.sum("openings").alias("openings"),
            *extra,
        )
        .withColumn(
            "session_duration_minutes",
            F.col("session_end_minute") - F.col("session_start_minute"),
        )
    )


def sessionize(
    episodes: DataFrame, gap_minutes: float = 30.0, keys: Sequence[str] = ("child_id", "day_index")
) -> DataFrame:
    """Episodes -> sessions."""
    return session_table(number_sessions(start_grain(episodes, keys=keys), gap_minutes, keys), keys=keys)
