"""Suites that compare two tables notice rows that only one of them has."""

from __future__ import annotations

import pytest

from diurna.plans import checks

DAILY = (
    "child_id long, day_index int, daily_use_minutes double, daily_session_count long, "
    "has_school_today boolean"
)
SESSIONS = (
    "child_id long, day_index int, session_start_minute double, session_end_minute double, "
    "session_duration_minutes double, school_use_minutes double, post_bedtime_use_minutes double"
)
DAYS = [(1, 0, 30.0, 2, True), (1, 1, 10.0, 1, False), (2, 0, 5.0, 1, True)]
ROWS = [
    (1, 0, 0.0, 10.0, 10.0, 1.0, 0.0),
    (1, 0, 20.0, 40.0, 20.0, 0.0, 2.0),
    (1, 1, 0.0, 10.0, 10.0, 0.0, 0.0),
    (2, 0, 0.0, 5.0, 5.0, 0.0, 0.0),
]
EXPECTED = {
    checks.conservation: {"time_conserved", "count_conserved"},
    checks.scheduled_sessions: {"time_conserved"},
    checks.overlaps: {"school_within_day", "night_within_day"},
}


def failed(spark, suite, days, rows):
    found = suite(spark.createDataFrame(days, DAILY), spark.createDataFrame(rows, SESSIONS))
    return {r.check: r.failed_rows for r in found.collect() if r.failed_rows}


@pytest.mark.parametrize("suite", EXPECTED, ids=lambda s: s.__name__)
def test_unmatched_days_and_sessions_fail(spark, suite):
    assert failed(spark, suite, DAYS, ROWS) == {}
    without_day = failed(spark, suite, DAYS[1:], ROWS)
    without_sessions = failed(spark, suite, DAYS, ROWS[:-1])
    for found in (without_day, without_sessions):
        assert EXPECTED[suite] <= set(found)
        assert all(found[name] == 1 for name in EXPECTED[suite])
