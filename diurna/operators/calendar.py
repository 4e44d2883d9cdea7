"""Entity x calendar expansion with the context of each day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diurna.functions import clock


def select_bedtime(has_school_next: Column) -> Column:
    """School-night or free-night bedtime of the profile columns."""
    return F.when(has_school_next, F.col("bedtime_school_minute")).otherwise(
        F.col("bedtime_non_school_minute")
    )


def with_day_context(df: DataFrame) -> DataFrame:
    """Add the calendar and clock context to rows with profile + day_index.

    Expects the profile's school and bedtime minutes and ``day_start_minute``.
    School minutes become NULL on days without school.
    """
    weekday = clock.weekday_of(F.col("day_index"))
    today = clock.is_school_day(F.col("weekday"))
    tomorrow = clock.is_school_day(clock.next_weekday(F.col("weekday")))
    return (
        df.withColumn("weekday", weekday)
        .withColumns(
            {
                "is_weekend": clock.is_weekend_day(F.col("weekday")),
                "has_school_today": today,
                "has_school_next_day": tomorrow,
            }
        )
        .withColumns(
            {
                "bedtime_minute": select_bedtime(F.col("has_school_next_day")),
                "previous_bedtime_minute": select_bedtime(F.col("has_school_today")),
                "school_start_minute": F.when(
                    F.col("has_school_today"), F.col("school_start_minute")
                ),
                "school_end_minute": F.when(
                    F.col("has_school_today"), F.col("school_end_minute")
                ),
            }
        )
    )


CLOCK_COLUMNS = {
    "school_start": "school_start_minute",
    "school_end": "school_end_minute",
    "bedtime": "bedtime_minute",
    "day_start": "day_start_minute",
    "previous_bedtime": "previous_bedtime_minute",
}


def with_clock_text(df: DataFrame) -> DataFrame:
    """Readable HH:MM columns next to the minute columns."""
    return df.withColumns(
        {text: clock.minutes_to_clock(F.col(minute)) for text, minute in CLOCK_COLUMNS.items()}
    )


def daily_contexts(
    population: DataFrame, first_day: Column, last_day: Column, day_start: Column
) -> DataFrame:
    """One row per child and day first_day..last_day, none if a bound is NULL.

    ``day_start`` may use the profile columns and ``has_school_today``.
    """
    days = population.withColumn("day_index", F.explode(F.sequence(first_day, last_day)))
    flagged = days.withColumn(
        "has_school_today", clock.is_school_day(clock.weekday_of(F.col("day_index")))
    )
    context = with_day_context(flagged.withColumn("day_start_minute", day_start))
    return with_clock_text(context).select(
        "child_id",
        "day_index",
        "weekday",
        "is_weekend",
        "has_school_today",
        "has_school_next_day",
        "school_start_minute",
        "school_end_minute",
        "bedtime_minute",
        "previous_bedtime_minute",
        "day_start_minute",
        *CLOCK_COLUMNS,
    )
