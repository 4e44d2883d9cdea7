"""Intervals inside a calendar day: labelled windows, overlaps, gaps, slots.

A day's windows are an array column of its day row (at most nine entries), so
labelling a day and measuring overlap needs no explode and no shuffle of its
own; the array is exploded only where windows are wanted as rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diurna.functions import arrays
from diurna.schemas import (
    MINUTES_PER_DAY,
    NIGHT_SEVERITY_SLOPE,
    NO_SCHOOL_MORNING_END,
    PRE_BEDTIME_MINUTES,
    WINDOW_WEIGHTS,
)

DAY = float(MINUTES_PER_DAY)
WINDOW_TYPE = "array<struct<name:string,start_minute:double,end_minute:double>>"


def overlap_minutes(
    start_a: Column, end_a: Column, start_b: Column, end_b: Column
) -> Column:
    """Length of the intersection of two intervals, never negative."""
    return F.greatest(F.lit(0.0), F.least(end_a, end_b) - F.greatest(start_a, start_b))


def segment_label(minute: Column) -> Column:
    """Label of an instant, from the context columns of its day row.

    Order matters: what is left of last night's pre-bedtime, then the night
    before the day starts, then tonight, then school, then free time.
    """
    bedtime = F.col("bedtime_minute")
    rollover = F.col("previous_bedtime_minute") - MINUTES_PER_DAY
    tonight = minute >= bedtime - PRE_BEDTIME_MINUTES
    return (
        F.when((rollover > 0) & (minute >= 0) & (minute < rollover), "pre_bedtime")
        .when(minute < F.col("day_start_minute"), "post_bedtime_overnight")
        .when(tonight & ((bedtime > MINUTES_PER_DAY) | (minute < bedtime)), "pre_bedtime")
        .when((bedtime <= MINUTES_PER_DAY) & (minute >= bedtime), "post_bedtime_overnight")
        .when(
            F.col("has_school_today")
            & (minute >= F.col("school_start_minute"))
            & (minute < F.col("school_end_minute")),
            "school",
        )
        .when(
            minute
            < F.when(F.col("has_school_today"), F.col("school_start_minute")).otherwise(
                NO_SCHOOL_MORNING_END
            ),
            "morning_free",
        )
        .otherwise("daytime_free")
    )


def _inside_day(minute: Column) -> Column:
    return F.when((minute > 0) & (minute < MINUTES_PER_DAY), minute)


def _boundaries() -> Column:
    bedtime = F.col("bedtime_minute")
    edges = [
        F.lit(0),
        F.col("day_start_minute"),
        F.lit(MINUTES_PER_DAY),
        _inside_day(bedtime - PRE_BEDTIME_MINUTES),
        _inside_day(bedtime),
        _inside_day(F.col("previous_bedtime_minute") - MINUTES_PER_DAY),
        F.when(F.col("has_school_today"), F.col("school_start_minute")).otherwise(
            NO_SCHOOL_MORNING_END
        ),
        F.when(F.col("has_school_today"), F.col("school_end_minute")),
    ]
    doubles = F.array(*[e.cast("double") for e in edges])
    return F.sort_array(F.array_distinct(F.array_compact(doubles)))


def day_segments() -> Column:
    """Array of labelled segments of a day row; equal neighbours not merged."""

    def segment(start: Column, end: Column) -> Column:
        return F.struct(
            segment_label((start + end) / 2.0).alias("name"),
            start.alias("start_minute"),
            end.alias("end_minute"),
        )

    def between(edges: Column) -> Column:
        count = F.size(edges) - 1
        return F.zip_with(
            F.slice(edges, F.lit(1), count), F.slice(edges, F.lit(2), count), segment
        )

    return arrays.let(_boundaries(), between)


def merged_segments(segments: Column) -> Column:
    """Fold neighbouring segments of the same label into one window."""

    def step(done: Column, segment: Column) -> Column:
        last = F.element_at(done, -1)
        extended = F.struct(
            last["name"].alias("name"),
            last["start_minute"].alias("start_minute"),
            segment["end_minute"].alias("end_minute"),
        )
        joins = (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["name"] == segment["name"])
        head = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(joins, F.concat(head, F.array(extended))).otherwise(
            F.concat(done, F.array(segment))
        )

    return F.aggregate(segments, F.array().cast(WINDOW_TYPE), step)


def window_weight(name: Column, severity: Column) -> Column:
    """Base weight per label; only the night grows with severity."""
    weight = F.lit(None).cast("double")
    for label, base in WINDOW_WEIGHTS.items():
        value = F.lit(base)
        if label == "post_bedtime_overnight":
            value = value * F.exp(F.lit(NIGHT_SEVERITY_SLOPE) * severity)
        weight = F.when(name == label, value).otherwise(weight)
    return weight


def day_windows(days: DataFrame, keys: Sequence[str] = ("child_id", "day_index")) -> DataFrame:
    """One row per labelled window: 1-based index, bounds, weight.

    A day always has windows, so the outer explode loses nothing; it keeps the
    planner from evaluating the windows once more as a filter.
    """
    listed = days.select(
        *keys, "S", F.posexplode_outer(merged_segments(day_segments())).alias("pos", "w")
    )
    return listed.select(
        *keys,
        (F.col("pos") + 1).cast("int").alias("window_index"),
        F.col("w.name").alias("window_name"),
        F.col("w.start_minute").alias("window_start"),
        F.col("w.end_minute").alias("window_end"),
        window_weight(F.col("w.name"), F.col("S")).alias("weight"),
    )


def label_overlap(segments: Column, label: str, start: Column, end: Column) -> Column:
    """Minutes of [start, end) inside all segments of one label."""
    return F.aggregate(
        segments,
        F.lit(0.0),
        lambda total, w: total
        + F.when(
            w["name"] == label,
            overlap_minutes(start, end, w["start_minute"], w["end_minute"]),
        ).otherwise(F.lit(0.0)),
    )


def label_minutes(sessions_in_context: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Add <label>_minutes for any window labels to rows that carry their context.

    The windows of a day are at most eight and are built once per row.
    """
    start, end = F.col("session_start_minute"), F.col("session_end_minute")
    laid = sessions_in_context.withColumn("__segments", day_segments())
    minutes = [
        label_overlap(F.col("__segments"), label, start, end).alias(f"{label}_minutes")
        for label in labels
    ]
    return laid.select(*sessions_in_context.columns, *minutes)


CONTEXT_COLUMNS = [
    "has_school_today",
    "school_start_minute",
    "school_end_minute",
    "bedtime_minute",
    "previous_bedtime_minute",
    "day_start_minute",
]


def label_bounds(label: str) -> list[tuple[Column, Column]]:
    """The stretches of a day with a label, as (start, end) expressions.

    Same rules as segment_label, solved for the two labels that sessions are
    measured against; an end at or before its start means an empty stretch.
    """
    bedtime = F.col("bedtime_minute").cast("double")
    rollover = F.greatest(F.col("previous_bedtime_minute") - F.lit(DAY), F.lit(0.0))
    awake = F.greatest(F.col("day_start_minute").cast("double"), rollover)
    if label == "post_bedtime_overnight":
        return [
            (rollover, F.col("day_start_minute").cast("double")),
            (F.greatest(bedtime, awake), F.lit(DAY)),
        ]
    if label == "school":
        start = F.greatest(F.col("school_start_minute").cast("double"), awake)
        end = F.least(F.col("school_end_minute").cast("double"), bedtime - PRE_BEDTIME_MINUTES)
        empty = F.lit(0.0)
        today = F.col("has_school_today")
        return [(F.when(today, start).otherwise(empty), F.when(today, end).otherwise(empty))]
    raise ValueError(f"no closed form for {label}")


def with_overlaps(sessions_in_context: DataFrame) -> DataFrame:
    """Add school and post-bedtime minutes to rows that carry their context.

    Plain arithmetic on the row: no window rows, no arrays.
    """
    start, end = F.col("session_start_minute"), F.col("session_end_minute")

    def minutes(label: str) -> Column:
        parts = [
            overlap_minutes(start, end, a, F.greatest(a, b)) for a, b in label_bounds(label)
        ]
        return sum(parts[1:], parts[0])

    return sessions_in_context.withColumns(
        {
            "school_use_minutes": minutes("school"),
            "post_bedtime_use_minutes": minutes("post_bedtime_overnight"),
        }
    )


def context_overlap(
    sessions: DataFrame, days: DataFrame, keys: Sequence[str] = ("child_id", "day_index")
) -> DataFrame:
    """Overlap join: minutes each session spends at school and past bedtime."""
    context = days.select(*keys, *CONTEXT_COLUMNS)
    return with_overlaps(sessions.join(context, list(keys))).drop(*CONTEXT_COLUMNS)


def free_gaps(
    busy: DataFrame,
    keys: Sequence[str] = ("child_id", "day_index"),
    start: str = "session_start_minute",
    end: str = "session_end_minute",
) -> DataFrame:
    """Complement of possibly overlapping busy intervals within [0, 1440].

    Intervals are first reduced to the longest one per start, so a day costs at
    most as many window rows as it has distinct starts.
    """
    longest = busy.groupBy(*keys, F.col(start).alias("__start")).agg(F.max(end).alias("__end"))
    by_start = Window.partitionBy(*keys).orderBy("__start")
    reach = F.coalesce(
        F.max("__end").over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)
    )
    ahead = longest.select(
        *keys,
        F.greatest(reach, F.lit(0.0)).alias("gap_start"),
        F.col("__start").alias("gap_end"),
    )
    tail = longest.groupBy(*keys).agg(
        F.greatest(F.max("__end"), F.lit(0.0)).alias("gap_start"), F.lit(DAY).alias("gap_end")
    )
    return ahead.unionByName(tail).where("gap_end > gap_start")


def slot_candidates(
    gaps: DataFrame,
    windows: DataFrame,
    duration: float | Column,
    keys: Sequence[str] = ("child_id", "day_index"),
) -> DataFrame:
    """Start ranges where an item of ``duration`` fits, with mass and share.

    Both sides hold a bounded number of rows per day, so the equi-join on the
    day with a range condition never explodes.
    """
    length = F.lit(float(duration)) if not isinstance(duration, Column) else duration
    fitted = gaps.withColumn("__latest", F.col("gap_end") - length).where(
        F.col("__latest") >= F.col("gap_start")
    )
    ranges = fitted.join(windows, list(keys)).select(
        *keys,
        "window_name",
        "weight",
        F.greatest("gap_start", "window_start").alias("slot_start"),
        F.least("__latest", "window_end").alias("slot_end"),
    )
    massed = ranges.where("slot_end > slot_start").withColumn(
        "mass", F.col("weight") * (F.col("slot_end") - F.col("slot_start"))
    )
    share = F.col("mass") / F.sum("mass").over(Window.partitionBy(*keys))
    return massed.where("mass > 0").withColumn("probability", share)


def overlap_violations(
    sessions: DataFrame, keys: Sequence[str] = ("child_id", "day_index")
) -> DataFrame:
    """Sessions that begin before the previous one in start order has ended.

    Meant for session tables, where a day holds a bounded number of rows.
    """
    by_start = Window.partitionBy(*keys).orderBy("session_start_minute", "session_end_minute")
    return sessions.withColumn("previous_end", F.lag("session_end_minute").over(by_start)).where(
        F.col("session_start_minute") < F.col("previous_end") - F.lit(1e-9)
    )
