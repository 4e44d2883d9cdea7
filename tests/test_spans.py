"""Overlap join with a given windows table, against brute force."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from diurna.operators import intervals, spans
from diurna.plans import eventlog

LEFT = "child_id long, a double, b double, l long"
RIGHT = "child_id long, c double, d double, r long"


def brute(left, right):
    def real(k, s, e):
        return None not in (k, s, e) and abs(s) < float("inf") and abs(e) < float("inf") and s < e

    return sorted(
        (x[0], x[3], y[3])
        for x in left
        for y in right
        if x[0] == y[0] and real(*x[:3]) and real(*y[:3]) and max(x[1], y[1]) < min(x[2], y[2])
    )


def joined(spark, left, right, hot_rows):
    met = spans.overlapping(
        spark.createDataFrame(left, LEFT),
        spark.createDataFrame(right, RIGHT),
        ["child_id"],
        ("a", "b"),
        ("c", "d"),
        hot_rows=hot_rows,
    )
    return sorted((x.child_id, x.l, x.r) for x in met.select("child_id", "l", "r").collect())


def random_spans(rng, n, longest):
    """A third of the spans of child 1 lie in one stretch of 20 minutes."""
    rows = []
    for i in range(n):
        hot = rng.random() < 0.33
        start = float(rng.randint(5000, 5020) if hot else rng.randint(-3000, 9000))
        length = 2.0 ** rng.uniform(-2, longest)
        rows.append((1 if hot else rng.randint(1, 3), start, start + length, i))
    return rows


@pytest.mark.parametrize("hot_rows", [5, 20_000])
def test_pairs_equal_brute_force(spark, hot_rows):
    rng = random.Random(11)
    left, right = random_spans(rng, 150, 9), random_spans(rng, 120, 14)
    assert joined(spark, left, right, hot_rows) == brute(left, right)


def test_edges_of_spans(spark):
    inf = float("inf")
    left = [
        (1, 0.0, 64.0, 1),  # ends where a bucket and a window begin
        (1, 64.0, 64.0, 2),  # empty
        (1, 70.0, 60.0, 3),  # ends before it starts
        (1, None, 80.0, 4),
        (None, 0.0, 80.0, 5),
        (1, -inf, inf, 6),
        (1, float("nan"), 80.0, 7),
        (1, -10.0, 1e6, 8),
        (1, 10.0, 20.0, 9),
        (1, 10.0, 20.0, 9),  # a repeated row
        (1, -1e12, 1e12, 10),  # longer than the coarsest bucket
    ]
    right = [(1, 64.0, 65.0, 1), (1, 0.0, 15.0, 2), (None, 0.0, 15.0, 3), (1, -5.0, -1.0, 4)]
    got = joined(spark, left, right, 20_000)
    assert got == brute(left, right)
    assert (1, 1, 1) not in got and got.count((1, 9, 2)) == 2
    assert joined(spark, left, [], 20_000) == [] and joined(spark, [], right, 20_000) == []


def test_clashing_names_are_refused(spark):
    left = spark.createDataFrame([(1, 0.0, 1.0, 5)], LEFT)
    with pytest.raises(ValueError, match="both sides"):
        spans.overlapping(left, left, ["child_id"], ("a", "b"), ("a", "b"))


def test_hot_bucket_is_cut_into_parts(spark):
    """Every row of a side in one bucket: no task gets them all."""
    n = 4_000
    left = spark.range(n).select(
        F.lit(1).alias("child_id"), F.lit(100.0).alias("a"), F.lit(110.0).alias("b"), F.col("id").alias("l")
    )
    right = spark.createDataFrame([(1, 105.0, 120.0, 1)], RIGHT)
    met = spans.overlapping(left, right, ["child_id"], ("a", "b"), ("c", "d"), hot_rows=100)
    assert met.count() == n and met.select("l").distinct().count() == n
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "__part_a" in plan


WINDOWS = "child_id long, window_name string, window_start double, window_end double"
USES = "child_id long, start double, end double, note string"


def test_minutes_by_label_across_midnight(spark):
    windows = spark.createDataFrame(
        [
            (1, "night", 1320.0, 1440.0),
            (1, "night", 1440.0, 1800.0),
            (1, "school", 1900.0, 2000.0),
            (1, None, 0.0, 5000.0),
            (1, "night", None, 5000.0),
        ],
        WINDOWS,
    )
    uses = spark.createDataFrame(
        [
            (1, 1400.0, 1950.0, "over midnight"),
            (1, 1400.0, 1950.0, "over midnight"),
            (1, 0.0, 10.0, "no window"),
            (2, 1400.0, 1500.0, "no such child"),
            (None, 1400.0, 1500.0, "no child"),
            (1, None, 1500.0, "no start"),
        ],
        USES,
    )
    got = spans.label_minutes(uses, windows, ["night", "school"])
    assert got.columns == [*uses.columns, "night_minutes", "school_minutes"]
    rows = sorted((r.note, r.night_minutes, r.school_minutes) for r in got.collect())
    assert rows == [
        ("no child", 0.0, 0.0),
        ("no start", None, None),
        ("no such child", 0.0, 0.0),
        ("no window", 0.0, 0.0),
        ("over midnight", 400.0, 50.0),
        ("over midnight", 400.0, 50.0),
    ]


def test_window_table_equals_windows_of_the_row(spark, sf_dir):
    """All five labels of every session, by join and by arithmetic on the row."""
    from diurna.operators import sessions
    from diurna.plans import eventlog
    from diurna.schemas import WINDOW_WEIGHTS
    from diurna.sources.tables import table

    labels = list(WINDOW_WEIGHTS)
    ev = table(spark, sf_dir, "events")
    bare = sessions.session_table(eventlog.numbered_starts(ev))
    by_row = intervals.label_minutes(eventlog.with_context(bare), labels)
    keys = ["child_id", "day_index"]
    windows = intervals.day_windows(
        eventlog.daily_contexts(ev).withColumn("S", eventlog.latent("S"))
    )
    by_join = spans.label_minutes(
        bare, windows, labels, keys, ("session_start_minute", "session_end_minute"), hot_rows=50
    )
    ids = [*keys, "session_index"]
    pairs = by_row.select(*ids, *[F.col(f"{n}_minutes").alias(f"x_{n}") for n in labels]).join(
        by_join.select(*ids, *[f"{n}_minutes" for n in labels]), ids, "full"
    )
    same = F.lit(True)
    for n in labels:
        gap = F.abs(F.col(f"x_{n}") - F.col(f"{n}_minutes")) < 1e-9
        same = same & F.coalesce(gap, F.lit(False))
    assert pairs.where(~same).count() == 0 and pairs.count() == bare.count()


def test_spans_of_all_lengths_share_a_grid():
    """Few rows a span if lengths are mixed; a fine grid where all spans are short."""
    mixed = {0: (700, 14_000.0), 1: (250, 35_000.0), 2: (50, 15_000.0)}
    assert spans._finest_grid(mixed, mixed) == 2
    assert spans._placed_rows(mixed, mixed, 2) < 0.5 * spans._placed_rows(mixed, mixed, 0)
    short = {0: (1000, 5_000.0)}
    assert spans._finest_grid(short, short) == 0
    assert spans._finest_grid({}, short) == 0 and spans._finest_grid({}, {}) == 0


@pytest.mark.parametrize("finest", [0, 1, 4, spans.GRIDS - 1])
def test_pairs_on_any_grid(spark, monkeypatch, finest):
    monkeypatch.setattr(spans, "_finest_grid", lambda *_: finest)
    rng = random.Random(13)
    left, right = random_spans(rng, 120, 9), random_spans(rng, 90, 12)
    assert joined(spark, left, right, 7) == brute(left, right)


def test_windows_of_a_week_are_those_of_every_day(spark):
    """A log from before day 0 to the middle of a later week."""
    rows = [
        (1, datetime(2023, 12, 21, 5), 7, "click", 1.0, ""),
        (2, datetime(2024, 1, 17, 9), 12, "click", 1.0, ""),
        (3, datetime(2024, 1, 9, 9), 33, "view", 1.0, ""),
        (4, None, 34, "view", 1.0, ""),
    ]
    events = spark.createDataFrame(
        rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    )
    want = intervals.day_windows(
        eventlog.daily_contexts(events).withColumn("S", eventlog.latent("S"))
    )
    got = eventlog.daily_windows(events)
    assert got.columns == want.columns and want.count() > 4 * 28 * 4
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert eventlog.daily_windows(events.where("event_id = 4")).count() == 0
