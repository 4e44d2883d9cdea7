"""Streaming jobs run to the end of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from diurna.plans import eventlog
from diurna.schemas import APP_CATEGORIES, INTERVENTION_RECORD
from diurna.session import scratch_path
from diurna.sources.files import read_records
from diurna.sources.tables import stream_table, table
from diurna.streaming import history, runs, sessions, triggers, weekly
from workload import interventions as ivn
from workload.behaviour_sql import with_tables
from workload.interventions import BEDTIME_SQL, FIRST_RULE_SQL, REQUEST_SQL, RESPONSE_SQL
from workload.registry import longs, query, rounded


@query(
    "stream_weekly_totals",
    with_tables(
        """
        SELECT child_id, strftime(DATE '2024-01-01' + CAST(week * 7 AS INTEGER), '%Y-%m-%d') AS week_start,
               count(*) AS openings, round(sum(m), 6) AS minutes,
        """
        + ", ".join(
            f"round(coalesce(sum(m) FILTER (cat = '{c}'), 0) / nullif(sum(m), 0), 6) AS {c}_share"
            for c in APP_CATEGORIES
        )
        + """
        FROM (SELECT *, e - s AS m, floor(day_index / 7) AS week FROM ep) GROUP BY child_id, week
        """
    ),
)
def stream_weekly_totals(spark, sf_dir):
    """All weeks: those that end while the log is read, and at its end the open ones."""
    log, end = weekly.read_events(spark, sf_dir), weekly.end_of_log(spark)
    totals, _ = runs.drained_to_end(log, end, weekly.weekly_totals, "weekly-totals")
    return totals.select(
        *longs("child_id", "openings"),
        F.date_format("week_start", "yyyy-MM-dd").alias("week_start"),
        *rounded("minutes", *[f"{c}_share" for c in APP_CATEGORIES]),
    )


@query(
    "stream_sessions",
    with_tables(
        """
        SELECT child_id, day_index, round(ss, 6) AS session_start_minute,
               round(se, 6) AS session_end_minute, openings
        FROM sess0
        """
    ),
)
def stream_sessions(spark, sf_dir):
    """All sessions: those that close while the log is read, and at its end the open ones."""
    log, end = weekly.read_events(spark, sf_dir), weekly.end_of_log(spark)
    live, _ = runs.drained_to_end(
        log, end, lambda rows: sessions.live_sessions(eventlog.episodes(rows)), "live-sessions"
    )
    return live.select(
        *longs("child_id", "day_index", "openings"),
        *rounded("session_start_minute", "session_end_minute"),
    )


@query(
    "stream_triggers",
    with_tables(
        """
        SELECT request_id AS event_id, child_id,
               CASE WHEN request_id IN (SELECT eid FROM fire) THEN 'bedtime_transition'
                    ELSE 'bedtime_cooldown_active' END AS reason
        FROM open_events WHERE reason = 'bedtime_transition'
          AND ts < (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM cnd)
        """,
        REQUEST_SQL,
        BEDTIME_SQL,
        *ivn.FIRE_CTES,
        recursive=True,
    ),
)
def stream_triggers(spark, sf_dir):
    """Decisions on the candidates that the watermark, a day late, has passed."""
    runs.use_rocksdb(spark)
    log = weekly.read_events(spark, sf_dir)
    rows = ivn.bedtime_rows(ivn.request_rows(log))
    fired = runs.drain(triggers.bedtime_triggers(rows), "triggers")
    return fired.select(*longs("event_id", "child_id"), "reason")


@query(
    "stream_history",
    f"""
    WITH {RESPONSE_SQL}
    SELECT DISTINCT sha256(concat_ws('|', child_id::VARCHAR, t, source, context,
             array_to_string(offered, ','), response, coalesce(selected, ''))) AS intervention_id,
           child_id, t AS timestamp, source, context, array_to_string(offered, ',') AS activities_offered,
           response, selected AS selected_activity_id
    FROM (SELECT *, strftime(event_time, '%Y-%m-%dT%H:%M:%S') AS t FROM resp)
    WHERE {FIRST_RULE_SQL} IS NULL
    """,
)
def stream_history(spark, sf_dir):
    """Responses streamed twice; the history keeps one line each."""
    orders = table(spark, sf_dir, "orders")
    stream = (
        stream_table(spark, sf_dir, "orders", orders.schema)
        .withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2))))
        .drop("delivery")
    )
    path, rejected = scratch_path(spark, "history"), scratch_path(spark, "history-rejected")
    checkpoint = scratch_path(spark, "history-checkpoint")
    runs.finish(history.ingest(ivn.response_rows(stream), path, rejected, checkpoint))
    kept = read_records(spark, path)
    columns = [f.name for f in INTERVENTION_RECORD.fields]
    return kept.withColumn("activities_offered", F.concat_ws(",", "activities_offered")).select(
        *longs("child_id"), *[c for c in columns if c != "child_id"]
    )
