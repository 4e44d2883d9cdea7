"""Streaming sessions by inactivity gap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diurna.plans.eventlog import EPOCH_DAY


def live_sessions(episodes: DataFrame, gap_minutes: int = 30, lateness: str = "1 day") -> DataFrame:
    """Sessions of a stream of app episodes, by the daily table's rules.

    An episode keeps its session open for its own length plus the inactivity gap. The
    day is part of the key and episodes end at midnight, so a session closes there as
    in the daily table. In append mode a session leaves the state, and comes out, once
    the watermark has passed its gap; later episodes of that time are left out.
    """
    begin = F.expr(
        f"CAST('{EPOCH_DAY}' AS TIMESTAMP) + make_dt_interval(day_index, 0, CAST(episode_start_minute AS INT))"
    )
    open_minutes = F.col("episode_end_minute") - F.col("episode_start_minute") + F.lit(gap_minutes)
    gap = F.concat(F.round(open_minutes * 60e6).cast("long").cast("string"), F.lit(" microseconds"))
    source = episodes.withColumn("episode_start", begin)
    if episodes.isStreaming:
        source = source.withWatermark("episode_start", lateness)
    window = F.session_window("episode_start", gap)
    return (
        source.groupBy(window.alias("w"), "child_id", "day_index")
        .agg(
            F.min("episode_start_minute").alias("session_start_minute"),
            F.max("episode_end_minute").alias("session_end_minute"),
            F.count(F.lit(1)).alias("openings"),
        )
        .drop("w")
    )
