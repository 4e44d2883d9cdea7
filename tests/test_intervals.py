from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from diurna.operators import calendar, intervals, sessions
from diurna.plans import eventlog

DAY_SCHEMA = (
    "child_id long, day_index int, S double, has_school_today boolean, school_start_minute int, "
    "school_end_minute int, bedtime_minute int, previous_bedtime_minute int, day_start_minute int"
)


def day(spark, rows):
    return spark.createDataFrame(rows, DAY_SCHEMA)


def labels(df):
    return [
        (r.window_name, r.window_start, r.window_end)
        for r in intervals.day_windows(df).orderBy("window_index").collect()
    ]


def test_school_day_windows(spark):
    df = day(spark, [(1, 0, 0.0, True, 480, 735, 1320, 1320, 405)])
    assert labels(df) == [
        ("post_bedtime_overnight", 0, 405),
        ("morning_free", 405, 480),
        ("school", 480, 735),
        ("daytime_free", 735, 1200),
        ("pre_bedtime", 1200, 1320),
        ("post_bedtime_overnight", 1320, 1440),
    ]


def test_rollover_of_both_bedtimes(spark):
    df = day(spark, [(1, 5, 0.0, False, None, None, 1470, 1460, 555)])
    assert labels(df) == [
        ("pre_bedtime", 0, 20),
        ("post_bedtime_overnight", 20, 555),
        ("morning_free", 555, 720),
        ("daytime_free", 720, 1350),
        ("pre_bedtime", 1350, 1440),
    ]


def test_pre_bedtime_beats_late_school(spark):
    df = day(spark, [(1, 0, 0.0, True, 780, 1260, 1290, 1290, 495)])
    assert ("school", 780, 1170) in labels(df)
    assert ("pre_bedtime", 1170, 1290) in labels(df)


def test_night_weight_grows_with_severity(spark):
    df = day(spark, [(1, 0, 2.0, True, 480, 735, 1320, 1320, 405)])
    weights = {r.window_name: r.weight for r in intervals.day_windows(df).collect()}
    assert weights["post_bedtime_overnight"] == pytest.approx(0.15 * 2.718281828**0.2)
    assert weights["school"] == 0.2


def _random_days(n):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        school = rng.random() < 0.6
        start = rng.randint(420, 900)
        rows.append(
            (
                i,
                0,
                0.0,
                school,
                start if school else None,
                min(start + rng.randint(60, 600), 1439) if school else None,
                rng.randint(1100, 1560),
                rng.randint(1100, 1560),
                rng.randint(1, 700),
            )
        )
    return rows


def test_closed_form_overlap_equals_window_overlap(spark):
    """Row arithmetic against the windows it replaces, on odd days too."""
    rng = random.Random(3)
    days = day(spark, _random_days(300))
    spans = []
    for i in range(300):
        a = rng.uniform(0, 1400)
        spans.append((i, 0, 1, a, min(a + rng.uniform(0, 900), 1440.0)))
    rows = spark.createDataFrame(
        spans,
        "child_id long, day_index int, session_index int, "
        "session_start_minute double, session_end_minute double",
    )
    fast = intervals.context_overlap(rows, days)
    start, end = F.col("session_start_minute"), F.col("session_end_minute")
    slow = (
        rows.join(days, ["child_id", "day_index"])
        .withColumn("w", intervals.day_segments())
        .select(
            "child_id",
            intervals.label_overlap(F.col("w"), "school", start, end).alias("a"),
            intervals.label_overlap(F.col("w"), "post_bedtime_overnight", start, end).alias("b"),
        )
    )
    off = fast.join(slow, "child_id").where(
        (F.abs(F.col("school_use_minutes") - F.col("a")) > 1e-9)
        | (F.abs(F.col("post_bedtime_use_minutes") - F.col("b")) > 1e-9)
    )
    assert off.count() == 0


def test_windows_cover_random_days(spark):
    days = intervals.day_windows(day(spark, _random_days(300)))
    covered = days.groupBy("child_id").agg(F.sum(F.col("window_end") - F.col("window_start")).alias("t"))
    assert covered.where("abs(t - 1440) > 1e-9").count() == 0


BUSY = "child_id long, day_index int, session_start_minute double, session_end_minute double"


def test_free_gaps_with_overlapping_busy_time(spark):
    busy = spark.createDataFrame(
        [(1, 0, 100.0, 300.0), (1, 0, 150.0, 200.0), (1, 0, 400.0, 500.0), (2, 0, 0.0, 1440.0)], BUSY
    )
    gaps = intervals.free_gaps(busy).orderBy("child_id", "gap_start").collect()
    assert [(r.child_id, r.gap_start, r.gap_end) for r in gaps] == [
        (1, 0, 100),
        (1, 300, 400),
        (1, 500, 1440),
    ]


def test_slot_candidates(spark):
    gaps = spark.createDataFrame(
        [(1, 0, 0.0, 100.0), (1, 0, 200.0, 215.0)],
        "child_id long, day_index int, gap_start double, gap_end double",
    )
    windows = spark.createDataFrame(
        [(1, 0, "a", 1.0, 0.0, 60.0), (1, 0, "b", 2.0, 60.0, 1440.0)],
        "child_id long, day_index int, window_name string, weight double, "
        "window_start double, window_end double",
    )
    got = {
        r.window_name: (r.slot_start, r.slot_end, r.mass, r.probability)
        for r in intervals.slot_candidates(gaps, windows, 20.0).collect()
    }
    assert got == {"a": (0.0, 60.0, 60.0, 0.6), "b": (60.0, 80.0, 40.0, 0.4)}


def test_overlap_violations(spark):
    rows = spark.createDataFrame(
        [(1, 0, 0.0, 10.0), (1, 0, 10.0, 20.0), (1, 0, 19.0, 30.0), (1, 1, 5.0, 9.0)], BUSY
    )
    found = intervals.overlap_violations(rows).collect()
    assert [(r.session_start_minute, r.previous_end) for r in found] == [(19.0, 20.0)]


def test_sessionize_by_gap(spark):
    rows = [
        (1, 0, 0.0, 10.0),
        (1, 0, 40.0, 45.0),  # exactly 30 minutes later: same session
        (1, 0, 76.0, 80.0),  # 31 minutes later: new one
        (1, 0, 76.0, 200.0),
        (1, 0, 210.0, 212.0),  # the long episode is still open
    ]
    episodes = spark.createDataFrame(
        rows, "child_id long, day_index int, episode_start_minute double, episode_end_minute double"
    )
    found = sessions.sessionize(episodes).orderBy("session_index").collect()
    assert [(r.session_start_minute, r.session_end_minute, r.openings) for r in found] == [
        (0, 45, 2),
        (76, 212, 3),
    ]


def test_calendar_context(spark):
    people = spark.createDataFrame([(1, 480, 735, 1300, 1350, "morning")],
        "child_id long, school_start_minute int, school_end_minute int, "
        "bedtime_school_minute int, bedtime_non_school_minute int, school_mode string")
    rows = {
        r.day_index: r
        for r in calendar.daily_contexts(
            people, F.lit(0), F.lit(6), eventlog.day_start_rule()
        ).collect()
    }
    assert len(rows) == 7
    assert rows[4].bedtime_minute == 1350 and rows[4].previous_bedtime_minute == 1300  # Friday
    assert rows[6].bedtime_minute == 1300 and rows[6].previous_bedtime_minute == 1350  # Sunday
    assert rows[5].school_start_minute is None and rows[5].is_weekend
    assert rows[0].day_start == "06:45" and rows[5].day_start_minute == 555
