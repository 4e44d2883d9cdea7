"""Adapter: a raw event log seen as behaviour tables.

Every event becomes one app episode, its ``value`` the minutes in the app. The
profile of a child (age, school, bedtimes) follows from the user id by plain
arithmetic, so both it and the day context are computed in place, without a
join, wherever a row carries the child id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diurna.functions import clock, hashing, numeric
from diurna.operators import calendar, intervals, sessions
from diurna.operators.single import row_of
from diurna.schemas import APP_CATEGORIES, MINUTES_PER_DAY, SCHOOL_HOURS, TARGET

EPOCH_DAY = "2024-01-01"

EVENT_CATEGORY = {
    "click": "games",
    "view": "social",
    "purchase": "entertainment",
    "signup": "education",
    "error": "other",
}

def _minutes(text: str) -> int:
    hours, minutes = text.split(":")
    return int(hours) * 60 + int(minutes)


def _choose(key: Column, values: dict) -> Column:
    chosen = F.lit(None)
    for name, value in values.items():
        chosen = F.when(key == name, F.lit(value)).otherwise(chosen)
    return chosen


def event_category(event_type: Column) -> Column:
    return _choose(event_type, EVENT_CATEGORY)


def day_of(ts: Column) -> Column:
    return F.datediff(ts.cast("date"), F.lit(EPOCH_DAY).cast("date"))


def week_of(day_index: Column) -> Column:
    return F.floor(day_index / F.lit(7)).cast("int")


def episodes(events: DataFrame) -> DataFrame:
    """Events -> app episodes, clipped at midnight.

    An event without user, time or length is no episode, and neither is one
    whose length is NaN, zero or negative.
    """
    start = (F.hour("ts") * 60 + F.minute("ts")).cast("double")
    length = numeric.nan_to_null(F.col("value"))
    end = F.least(start + length, F.lit(float(MINUTES_PER_DAY)))
    return (
        events.where(F.col("user_id").isNotNull() & F.col("ts").isNotNull() & (length > 0))
        .select(
            "event_id",
            (F.col("user_id") + 1).alias("child_id"),
            day_of(F.col("ts")).alias("day_index"),
            start.alias("episode_start_minute"),
            end.alias("episode_end_minute"),
            event_category(F.col("event_type")).alias("app_category"),
        )
        .withColumn(
            "episode_duration_minutes",
            F.col("episode_end_minute") - F.col("episode_start_minute"),
        )
    )


def whole_uses(events: DataFrame) -> DataFrame:
    """The same events with their whole length, past midnight where they last so long."""
    length = numeric.nan_to_null(F.col("value"))
    return events.where(
        F.col("user_id").isNotNull() & F.col("ts").isNotNull() & (length > 0)
    ).select(
        "event_id",
        (F.col("user_id") + 1).alias("child_id"),
        day_of(F.col("ts")).alias("day_index"),
        (F.hour("ts") * 60 + F.minute("ts")).cast("double").alias("episode_start_minute"),
        length.alias("use_minutes"),
    )


_LATENT_FACTORS = {"S": 37, "B": 53, "F": 71, "U": 89}


def latent(name: str) -> Column:
    """Latent stand-in of a child, from child_id alone."""
    return (((F.col("child_id") - 1) * _LATENT_FACTORS[name]) % 101 - 50) / F.lit(25.0)


def with_profile(df: DataFrame) -> DataFrame:
    """Profile columns of a child, from child_id alone."""
    uid = F.col("child_id") - 1

    mode = (
        F.when(uid % 3 == 0, "morning").when(uid % 3 == 1, "afternoon").otherwise("full_day")
    )
    shift = ((uid * 7) % 31 - 15).cast("int")
    opens = {name: _minutes(hours[0]) for name, hours in SCHOOL_HOURS.items()}
    closes = {name: _minutes(hours[1]) for name, hours in SCHOOL_HOURS.items()}
    delay = ((uid * 17) % 76).cast("int")
    school_night = (1290 + (uid * 13) % 106).cast("int")
    return df.withColumns(
        {
            "age": (6 + uid % 7).cast("int"),
            "age_scaled": numeric.scale_age(6 + uid % 7),
            "S": latent("S"),
            "B": latent("B"),
            "F": latent("F"),
            "U": latent("U"),
            "school_mode": mode,
            "school_start_minute": (_choose(mode, opens) + shift).cast("int"),
            "school_end_minute": (_choose(mode, closes) + shift).cast("int"),
            "school_shift_minutes": shift,
            "bedtime_school_minute": school_night,
            "bedtime_non_school_minute": school_night + delay,
            "bedtime_non_school_delay_minutes": delay,
        }
    )


def day_start_rule() -> Column:
    """Start of the waking day; uses profile columns and has_school_today."""
    return (
        F.when(~F.col("has_school_today"), 555)
        .when(F.col("school_mode") == "afternoon", 495)
        .otherwise(F.col("school_start_minute") - 75)
        .cast("int")
    )


def population(events: DataFrame) -> DataFrame:
    """One profile row per user seen in the log."""
    children = (
        events.where(F.col("user_id").isNotNull())
        .select((F.col("user_id") + 1).alias("child_id"))
        .distinct()
    )
    profiled = with_profile(children)
    return profiled.withColumns(
        {
            "school_start": clock.minutes_to_clock(F.col("school_start_minute")),
            "school_end": clock.minutes_to_clock(F.col("school_end_minute")),
            "bedtime_school": clock.minutes_to_clock(F.col("bedtime_school_minute")),
            "bedtime_non_school": clock.minutes_to_clock(F.col("bedtime_non_school_minute")),
        }
    )


def calendar_span(events: DataFrame) -> DataFrame:
    """One row: first_day and last_day on which anybody shows up in the log."""
    day = day_of(F.col("ts"))
    return events.where(F.col("user_id").isNotNull()).agg(
        F.min(day).alias("first_day"), F.max(day).alias("last_day")
    )


def daily_contexts(events: DataFrame) -> DataFrame:
    """Every child on every day from the log's first to its last."""
    span = row_of(calendar_span(events))
    return calendar.daily_contexts(
        population(events), span["first_day"], span["last_day"], day_start_rule()
    )


def daily_windows(events: DataFrame) -> DataFrame:
    """The labelled windows of every child and day of the log, as rows.

    A day's windows follow from the child and the weekday, so they are built for one
    week and laid on all days of it.
    """
    span = row_of(calendar_span(events))
    week = calendar.daily_contexts(population(events), F.lit(0), F.lit(6), day_start_rule())
    windows = intervals.day_windows(week.withColumn("S", latent("S")))
    first = span["first_day"] + F.pmod(F.col("day_index") - span["first_day"], F.lit(7))
    days = F.when(first <= span["last_day"], F.sequence(first, span["last_day"], F.lit(7)))
    return windows.withColumn("day_index", F.explode(days))


def with_context(df: DataFrame) -> DataFrame:
    """Profile and day context in place for rows with child_id, day_index."""
    profiled = with_profile(df).withColumn(
        "has_school_today", clock.is_school_day(clock.weekday_of(F.col("day_index")))
    )
    return calendar.with_day_context(profiled.withColumn("day_start_minute", day_start_rule()))


# --- behaviour tables -------------------------------------------------------


def category_minutes(category: str) -> Column:
    hit = F.when(F.col("app_category") == category, F.col("episode_duration_minutes"))
    return F.coalesce(F.sum(hit), F.lit(0.0))


def numbered_starts(events: DataFrame, with_categories: bool = False) -> DataFrame:
    """Start-minute grain with session numbers, laid out by child.

    Two exchanges serve every weekly statistic: the reduction to start minutes
    (combined map-side, keyed by child, day and minute, hence immune to a hot
    child) and this placement by child, whose input holds at most 1,440 rows
    per child-day. All later groupings and windows nest in it.
    """
    extra = [category_minutes(c).alias(c) for c in APP_CATEGORIES] if with_categories else []
    grain = sessions.start_grain(episodes(events), extra)
    return sessions.number_sessions(grain.repartition("child_id"))


def session_rows(events: DataFrame) -> DataFrame:
    """Sessions with context minutes (the scheduled-session table)."""
    bare = sessions.session_table(numbered_starts(events))
    return intervals.with_overlaps(with_context(bare)).select(
        "child_id",
        "day_index",
        "session_index",
        "session_duration_minutes",
        "session_start_minute",
        "session_end_minute",
        "openings",
        "school_use_minutes",
        "post_bedtime_use_minutes",
    )


def daily_rows(events: DataFrame) -> DataFrame:
    """Child-days with at least one session: context, totals, profile."""
    totals = (
        sessions.session_table(numbered_starts(events))
        .groupBy("child_id", "day_index")
        .agg(
            F.sum("session_duration_minutes").alias("daily_use_minutes"),
            F.count(F.lit(1)).alias("daily_session_count"),
        )
    )
    return with_context(totals)


def tagged_episodes(events: DataFrame) -> DataFrame:
    """Episodes with the session they belong to."""
    starts = numbered_starts(events).select(
        "child_id", "day_index", "episode_start_minute", "session_index"
    )
    return episodes(events).join(starts, ["child_id", "day_index", "episode_start_minute"])


def with_target(features: DataFrame) -> DataFrame:
    """Add the synthetic target to feature rows, with a hashed noise term."""
    noise = (
        hashing.unit_interval(hashing.hash_key("target", F.col("child_id"), F.col("week_index")))
        - 0.5
    ) * F.lit(0.5)
    return (
        features.withColumn("target_noise", noise)
        .withColumn(
            "y_star",
            F.lit(0.02) * (F.col("mean_daily_use_minutes") - 120.0)
            + F.lit(0.3) * F.col("age_scaled")
            + F.col("target_noise"),
        )
        .withColumn(TARGET, numeric.logistic_range(F.col("y_star"), 1.0, 5.0))
    )


def target_rows(features: DataFrame) -> DataFrame:
    return with_target(features).select("child_id", "week_index", "y_star", "target_noise", TARGET)


# --- derived views used by the diagnostics ----------------------------------

def session_start_windows(events: DataFrame) -> DataFrame:
    """Sessions with the label of the window they start in."""
    bare = sessions.session_table(numbered_starts(events))
    return with_context(bare).select(
        "child_id",
        "day_index",
        "session_index",
        "session_duration_minutes",
        intervals.segment_label(F.col("session_start_minute")).alias("session_start_window"),
    )


def daily_ratios(events: DataFrame) -> DataFrame:
    """Child-days with their context minutes over their use."""
    return (
        session_rows(events)
        .groupBy("child_id", "day_index")
        .agg(
            F.sum("session_duration_minutes").alias("daily_use_minutes"),
            F.sum("school_use_minutes").alias("school_use_minutes"),
            F.sum("post_bedtime_use_minutes").alias("post_bedtime_use_minutes"),
        )
        .withColumns(
            {
                "school_use_ratio": numeric.ratio(
                    F.col("school_use_minutes"), F.col("daily_use_minutes")
                ),
                "post_bedtime_use_ratio": numeric.ratio(
                    F.col("post_bedtime_use_minutes"), F.col("daily_use_minutes")
                ),
            }
        )
    )
