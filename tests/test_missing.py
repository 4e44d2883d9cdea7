"""Missing and odd values, days outside the first month, tables of many files."""

from __future__ import annotations

import shutil
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from diurna.functions import clock
from diurna.operators import joins, quantiles, sampling
from diurna.plans import checks, eventlog, interventions

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
EPOCH = datetime(2024, 1, 1)


def log(spark, rows):
    full = [(i, EPOCH + timedelta(days=d, hours=9), u, "click", v, "") for i, (d, u, v) in enumerate(rows)]
    return spark.createDataFrame(full, EVENT)


def test_calendar_runs_from_the_first_to_the_last_day(spark):
    events = log(spark, [(-3, 1, 5.0), (45, 2, 5.0)])
    rows = eventlog.daily_contexts(events).collect()
    assert sorted({r.day_index for r in rows}) == list(range(-3, 46))
    assert len(rows) == 2 * 49
    assert {r.day_index: r.weekday for r in rows}[-3] == 4


def test_weekdays_before_day_zero(spark):
    found = spark.range(-9, 9).select("id", clock.weekday_of(F.col("id")).alias("w")).collect()
    assert all(r.w == r.id % 7 for r in found)


def test_events_without_a_length_are_no_episodes(spark):
    events = log(spark, [(0, 1, float("nan")), (0, 1, -4.0), (0, 1, 0.0), (0, 1, None), (0, 1, 6.0)])
    assert [r.episode_duration_minutes for r in eventlog.episodes(events).collect()] == [6.0]


@pytest.mark.parametrize(
    "now, hour, minute, device, want",
    [
        (EPOCH + timedelta(hours=21), None, 0, True, "invalid_bedtime"),
        (EPOCH + timedelta(hours=21), 22, None, True, "invalid_bedtime"),
        (EPOCH + timedelta(hours=21), 22, 0, None, "device_not_in_use"),
        (None, 22, 0, True, "missing_time"),
        (EPOCH + timedelta(hours=21), 22, 0, True, "bedtime_transition"),
    ],
)
def test_nothing_fires_on_a_missing_value(spark, now, hour, minute, device, want):
    row = spark.createDataFrame(
        [(now, hour, minute, device, None)],
        "current_time timestamp_ntz, bedtime_hour int, bedtime_minute int, device_in_use boolean, "
        "last_bedtime_intervention timestamp_ntz",
    )
    assert row.select(interventions.bedtime_reason()).first()[0] == want


def test_rows_without_a_stratum_or_key_stay(spark):
    rows = spark.createDataFrame([(i, None if i < 2 else "a") for i in range(5)], "id long, s string")
    folds = sampling.stratified_folds(rows, ["s"], ["id"], 2, 1).collect()
    assert sorted(r.id for r in folds) == [0, 1, 2, 3, 4]
    split = sampling.stratified_split(rows, ["s"], ["id"], 1, test_rows=1).collect()
    assert sorted(str(r.s) for r in split if r.split == "test") == ["None", "a"]
    probes = spark.createDataFrame(
        [(1, "k", EPOCH), (2, None, EPOCH), (3, "k", None)], "id long, k string, t timestamp_ntz"
    )
    history = spark.createDataFrame([("k", EPOCH), (None, EPOCH)], "k string, h timestamp_ntz")
    found = joins.as_of(probes, history, ["k"], "t", "h", "last").collect()
    assert {r.id: r.last for r in found} == {1: EPOCH, 2: None, 3: None}


def test_missing_values_break_checks(spark):
    daily = spark.createDataFrame(
        [(None, None), (5.0, 1)], "daily_use_minutes double, daily_session_count long"
    )
    assert {r.failed_rows for r in checks.daily_totals(daily).collect()} == {1}


def test_a_session_without_episodes_is_found(spark):
    columns = ["child_id", "day_index", "session_index"]
    sessions = spark.createDataFrame(
        [(1, 0, 1, 5.0, 0.0, 5.0)],
        "child_id long, day_index int, session_index int, session_duration_minutes double, "
        "session_start_minute double, session_end_minute double",
    )
    bounds = spark.createDataFrame(
        [],
        "child_id long, day_index int, session_index int, episode_count long, "
        "episode_minutes double, first_episode_start double, last_episode_end double",
    )
    rows = spark.createDataFrame(
        [], "episode_duration_minutes double, episode_end_minute double, episode_start_minute double"
    )
    found = {r.check: r.failed_rows for r in checks.episodes(sessions, bounds, rows).collect()}
    assert found["one_episode_per_session"] == 1 and columns


@pytest.mark.parametrize("rows", [1, 2, 40, 50, 999, 1000, 1001, 5000])
def test_quantiles_at_every_size(spark, rows):
    import numpy as np

    values = np.random.default_rng(rows).exponential(size=rows) ** 3
    probabilities = [0.0, 0.01, 0.5, 0.9, 0.99, 1.0]
    frame = spark.createDataFrame([(float(v),) for v in values], "x double")
    found = quantiles.exact_quantiles(frame, ["x"], probabilities).collect()
    assert {r.probability for r in found} == set(probabilities)
    for r in found:
        assert r.quantile == pytest.approx(np.quantile(values, r.probability))


@pytest.mark.parametrize("name", ["stream_weekly_totals", "stream_sessions", "stream_history"])
def test_streams_read_tables_of_many_files(spark, sf_dir, tmp_path, name):
    for table in ("events", "orders"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").repartition(3).write.parquet(
            f"{tmp_path}/{table}.parquet"
        )
    for file in Path(sf_dir).glob("*.parquet"):
        if not (tmp_path / file.name).exists():
            shutil.copy(file, tmp_path / file.name)
    run = entry.queries()[name]
    one = sorted(map(str, run(spark, sf_dir).collect()))
    assert one and one == sorted(map(str, run(spark, str(tmp_path)).collect()))
