"""Operators on inputs with missing values, made from the given tables by id."""

from __future__ import annotations

from pyspark.sql import functions as F

from diurna.operators import joins, sampling
from diurna.plans import checks, eventlog, interventions
from diurna.schemas import SPLIT_SEED, TEST_PER_STRATUM
from diurna.sources.tables import table
from workload.quality import checks_sql, report
from workload.registry import events, longs, query


def _missing(column: str, key: str, step: int, rest: int):
    """``column`` with a NULL in every ``step``-th row by id."""
    return F.when(F.col(key) % step != rest, F.col(column)).alias(column)


@query(
    "bedtime_nulls",
    """
    WITH asked AS (
      SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN ts END AS t,
             CASE WHEN event_id % 7 <> 1 THEN 19 + event_id % 7 END AS h,
             CASE WHEN event_id % 11 <> 2 THEN event_id % 70 END AS m,
             CASE WHEN event_id % 3 <> 0 THEN event_type <> 'error' END AS device
      FROM events),
    timed AS (
      SELECT *, h BETWEEN 0 AND 23 AND m BETWEEN 0 AND 59 AS valid,
             (h * 60 + m) * 60000000 - (epoch_us(t) - epoch_us(date_trunc('day', t)::TIMESTAMP)) AS ahead
      FROM asked)
    SELECT event_id, CASE
        WHEN NOT coalesce(device, false) THEN 'device_not_in_use'
        WHEN NOT coalesce(valid, false) THEN 'invalid_bedtime'
        WHEN t IS NULL THEN 'missing_time'
        WHEN CASE WHEN ahead < 0 THEN ahead + 86400000000 ELSE ahead END > 3600000000
          THEN 'outside_bedtime_window'
        ELSE 'bedtime_transition' END AS reason
    FROM timed
    """,
)
def bedtime_nulls(spark, sf_dir):
    """Missing device state, clock or time: no row fires on what is not known."""
    key = F.col("event_id")
    asked = events(spark, sf_dir).select(
        "event_id",
        F.when(key % 5 != 0, F.col("ts")).alias("current_time"),
        F.when(key % 7 != 1, 19 + key % 7).cast("int").alias("bedtime_hour"),
        F.when(key % 11 != 2, key % 70).cast("int").alias("bedtime_minute"),
        F.when(key % 3 != 0, F.col("event_type") != "error").alias("device_in_use"),
        F.lit(None).cast("timestamp_ntz").alias("last_bedtime_intervention"),
    )
    return asked.select(*longs("event_id"), interventions.bedtime_reason().alias("reason"))


@query(
    "asof_nulls",
    """
    WITH log AS (
      SELECT event_id, event_type, CASE WHEN event_id % 6 <> 0 THEN user_id END AS u,
             CASE WHEN event_id % 10 <> 3 THEN ts END AS t FROM events)
    SELECT p.event_id, p.u AS user_id, strftime(h.t, '%Y-%m-%d %H:%M:%S.%f') AS last_seen
    FROM log p ASOF LEFT JOIN (SELECT u, t FROM log WHERE event_type = 'signup'
                               AND u IS NOT NULL AND t IS NOT NULL) h
      ON p.u = h.u AND p.t >= h.t
    """,
)
def asof_nulls(spark, sf_dir):
    """Probes without a key or a time stay and find nothing."""
    log = events(spark, sf_dir).select(
        "event_id", "event_type", _missing("user_id", "event_id", 6, 0),
        _missing("ts", "event_id", 10, 3),
    )
    history = log.where("event_type = 'signup'").select("user_id", F.col("ts").alias("seen_at"))
    found = joins.as_of(log.drop("event_type"), history, ["user_id"], "ts", "seen_at", "last_seen")
    return found.select(
        *longs("event_id", "user_id"),
        F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_seen"),
    )


@query(
    "stratified_nulls",
    f"""
    WITH part AS (
      SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 1 THEN o_orderpriority END AS stratum
      FROM orders),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY stratum
                  ORDER BY md5('{SPLIT_SEED}:' || o_orderkey), o_orderkey) AS r FROM part),
    sizes AS (
      SELECT stratum, coalesce(sum(count(*)) OVER (ORDER BY stratum NULLS FIRST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM part GROUP BY stratum)
    SELECT o_orderkey, ranked.stratum,
           CASE WHEN r <= {TEST_PER_STRATUM} THEN 'test' ELSE 'development' END AS split,
           ((before + r - 1) % 5 + 1)::BIGINT AS fold
    FROM ranked JOIN sizes ON ranked.stratum IS NOT DISTINCT FROM sizes.stratum
    """,
)
def stratified_nulls(spark, sf_dir):
    """Rows without a stratum are a stratum of their own, for the quota and the folds."""
    part = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 4 != 1, F.col("o_orderpriority")).alias("stratum"),
    )
    split = sampling.stratified_split(
        part, ["stratum"], ["o_orderkey"], SPLIT_SEED, test_rows=TEST_PER_STRATUM
    )
    folded = sampling.stratified_folds(split, ["stratum"], ["o_orderkey"], 5, SPLIT_SEED)
    return folded.select(*longs("o_orderkey", "fold"), "stratum", "split")


DAILY_SQL = """
(SELECT CASE WHEN o_orderkey % 9 <> 2 THEN o_totalprice / 200 END AS use,
        CASE WHEN o_orderkey % 8 <> 3 THEN o_orderkey % 3 END AS n FROM orders)
"""


@query(
    "dq_nulls",
    checks_sql(
        {
            DAILY_SQL: {
                "use_positive": "NOT use > 0",
                "use_below_day": "NOT use < 1440",
                "count_positive": "NOT n >= 1",
            }
        }
    ),
)
def dq_nulls(spark, sf_dir):
    """A missing value breaks the rules that need it."""
    key = F.col("o_orderkey")
    daily = table(spark, sf_dir, "orders").select(
        F.when(key % 9 != 2, F.col("o_totalprice") / 200).alias("daily_use_minutes"),
        F.when(key % 8 != 3, key % 3).alias("daily_session_count"),
    )
    return report(checks.daily_totals(daily))


@query(
    "calendar_span",
    """
    SELECT min(d)::BIGINT AS first_day, max(d)::BIGINT AS last_day
    FROM (SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d
          FROM events WHERE user_id IS NOT NULL)
    """,
)
def calendar_span(spark, sf_dir):
    return eventlog.calendar_span(events(spark, sf_dir)).select(*longs("first_day", "last_day"))
