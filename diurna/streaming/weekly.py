"""Streaming weekly totals per child."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diurna.functions import numeric
from diurna.plans import eventlog
from diurna.schemas import APP_CATEGORIES, EVENTS
from diurna.sources.tables import stream_table

LATENESS = "2 days"
# Tumbling windows count from 1970-01-01, a Thursday; weeks start on Monday.
MONDAY_OFFSET = "4 days"


def read_events(
    spark: SparkSession, folder: str, files_per_trigger: int | None = None
) -> DataFrame:
    """The event table as a stream; ``event_time`` is a zoned timestamp."""
    return with_event_time(stream_table(spark, folder, "events", EVENTS, files_per_trigger))


def with_event_time(events: DataFrame) -> DataFrame:
    """Watermarks need a timestamp with time zone; sessions run in UTC."""
    return events.withColumn("event_time", F.col("ts").cast("timestamp"))


def end_of_log(spark: SparkSession) -> DataFrame:
    """A row like an event's, after all others, for ``runs.drained_to_end``."""
    row = (None, datetime(9999, 1, 1), -1, None, 1.0, None)
    return with_event_time(spark.createDataFrame([row], EVENTS))


def weekly_totals(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Openings, minutes and category shares per child and 7-day window.

    Works on a stream and on a table, over the events that are episodes. In append
    mode a week comes out, and leaves the state, once the watermark has passed its
    end; rows that come later are left out and counted (``runs.late_rows``). Sums
    only: a median cannot be kept up to date incrementally.
    """
    start = (F.hour("ts") * 60 + F.minute("ts")).cast("double")
    minutes = F.least(start + F.col("value"), F.lit(1440.0)) - start
    category = eventlog.event_category(F.col("event_type"))
    length = numeric.nan_to_null(F.col("value"))
    source = events.where("user_id IS NOT NULL AND ts IS NOT NULL").where(length > 0)
    if events.isStreaming:
        source = source.withWatermark("event_time", lateness)
    window = F.window("event_time", "7 days", startTime=MONDAY_OFFSET)
    measures = [F.count(F.lit(1)).alias("openings"), F.sum(minutes).alias("minutes")]
    measures += [
        F.coalesce(F.sum(F.when(category == c, minutes)), F.lit(0.0)).alias(f"{c}_minutes")
        for c in APP_CATEGORIES
    ]
    totals = source.groupBy(window.alias("week"), (F.col("user_id") + 1).alias("child_id")).agg(
        *measures
    )
    return totals.select(
        "child_id",
        F.col("week.start").alias("week_start"),
        "openings",
        "minutes",
        *[
            numeric.ratio(F.col(f"{c}_minutes"), F.col("minutes")).alias(f"{c}_share")
            for c in APP_CATEGORIES
        ],
    )
