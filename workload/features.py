"""Sessions, day context, intervals and weekly features."""

from __future__ import annotations

from pyspark.sql import functions as F

from diurna.operators import intervals, scans, sessions
from diurna.plans import eventlog, weekly
from diurna.schemas import FEATURES
from diurna.sources.tables import table
from workload.behaviour_sql import r6 as R
from workload.behaviour_sql import with_tables
from workload.registry import events, longs, query, rounded


def by_week(df):
    return df.withColumn("week_index", eventlog.week_of(F.col("day_index")))


@query(
    "weekly_features",
    with_tables(
        f"SELECT child_id, CAST(week_index AS BIGINT) AS week_index, {R(*FEATURES)} FROM feat"
    ),
)
def weekly_features(spark, sf_dir):
    table_ = weekly.from_events(events(spark, sf_dir))
    return table_.select(*longs("child_id", "week_index"), *rounded(*FEATURES))


@query(
    "weekly_daily_means",
    with_tables(
        "SELECT child_id, CAST(week_index AS BIGINT) AS week_index, "
        + R("mean_daily_use_minutes", "mean_daily_session_count", "mean_daily_app_openings")
        + " FROM daym"
    ),
)
def weekly_daily_means(spark, sf_dir):
    ev = events(spark, sf_dir)
    means = weekly.daily_means(by_week(eventlog.daily_rows(ev)), eventlog.episodes(ev))
    return means.select(
        *longs("child_id", "week_index"),
        *rounded("mean_daily_use_minutes", "mean_daily_session_count", "mean_daily_app_openings"),
    )


@query(
    "median_session",
    with_tables(
        "SELECT child_id, CAST(week_index AS BIGINT) AS week_index, "
        + R("median_session_duration")
        + " FROM wsess"
    ),
)
def median_session(spark, sf_dir):
    rows = by_week(eventlog.session_rows(events(spark, sf_dir)))
    return weekly.median_sessions(rows).select(
        *longs("child_id", "week_index"), *rounded("median_session_duration")
    )


@query(
    "context_ratios",
    with_tables(
        "SELECT child_id, CAST(week_index AS BIGINT) AS week_index, "
        + R("school_use_ratio", "post_bedtime_use_ratio")
        + " FROM feat"
    ),
)
def context_ratios(spark, sf_dir):
    ev = events(spark, sf_dir)
    ratios = weekly.context_ratios(
        by_week(eventlog.session_rows(ev)), by_week(eventlog.daily_rows(ev))
    )
    return ratios.select(
        *longs("child_id", "week_index"), *rounded("school_use_ratio", "post_bedtime_use_ratio")
    )


@query(
    "category_shares",
    with_tables(
        """
        SELECT child_id, CAST(week_index AS BIGINT) AS week_index,
               round(games / tot, 6) AS games_share, round(social / tot, 6) AS social_share,
               round(entertainment / tot, 6) AS entertainment_share,
               round(education / tot, 6) AS education_share, round(other / tot, 6) AS other_share
        FROM wcat_t
        """
    ),
)
def category_shares(spark, sf_dir):
    shares = weekly.category_shares(by_week(eventlog.episodes(events(spark, sf_dir))))
    names = [c for c in shares.columns if c.endswith("_share")]
    return shares.select(*longs("child_id", "week_index"), *rounded(*names))


@query(
    "sessionize",
    with_tables(
        """
        SELECT child_id, day_index, CAST(session_index AS BIGINT) AS session_index,
               round(ss, 6) AS session_start_minute, round(se, 6) AS session_end_minute,
               round(dur, 6) AS session_duration_minutes, openings
        FROM sess0
        """
    ),
)
def sessionize(spark, sf_dir):
    rows = sessions.sessionize(eventlog.episodes(events(spark, sf_dir)))
    return rows.select(
        *longs("child_id", "day_index", "session_index", "openings"),
        *rounded("session_start_minute", "session_end_minute", "session_duration_minutes"),
    )


@query(
    "daily_context",
    with_tables(
        """
        SELECT child_id, day_index, wd AS weekday, wd >= 5 AS is_weekend,
               school_today AS has_school_today, school_next AS has_school_next_day,
               ss_min AS school_start_minute, se_min AS school_end_minute,
               bed AS bedtime_minute, prev_bed AS previous_bedtime_minute,
               day_start AS day_start_minute,
               printf('%02d:%02d', ss_min // 60, ss_min % 60) AS school_start,
               printf('%02d:%02d', se_min // 60, se_min % 60) AS school_end,
               printf('%02d:%02d', (bed % 1440) // 60, bed % 60)
                 || CASE WHEN bed >= 1440 THEN ' (+1d)' ELSE '' END AS bedtime,
               printf('%02d:%02d', day_start // 60, day_start % 60) AS day_start,
               printf('%02d:%02d', (prev_bed % 1440) // 60, prev_bed % 60)
                 || CASE WHEN prev_bed >= 1440 THEN ' (+1d)' ELSE '' END AS previous_bedtime
        FROM (SELECT child_id, day_index::BIGINT AS day_index, wd::BIGINT AS wd, school_today,
                     school_next, ss_min::BIGINT AS ss_min, se_min::BIGINT AS se_min,
                     bed::BIGINT AS bed, prev_bed::BIGINT AS prev_bed,
                     day_start::BIGINT AS day_start FROM cal)
        """
    ),
)
def daily_context(spark, sf_dir):
    ctx = eventlog.daily_contexts(events(spark, sf_dir))
    ints = [
        "child_id",
        "day_index",
        "weekday",
        "school_start_minute",
        "school_end_minute",
        "bedtime_minute",
        "previous_bedtime_minute",
        "day_start_minute",
    ]
    return ctx.select(*longs(*ints), *[c for c in ctx.columns if c not in ints])


@query(
    "day_windows",
    with_tables(
        """
        SELECT child_id, day_index::BIGINT AS day_index, k::BIGINT AS window_index,
               name AS window_name, round(ws, 6) AS window_start, round(we, 6) AS window_end,
               round(w, 6) AS weight
        FROM win
        """
    ),
)
def day_windows(spark, sf_dir):
    days = eventlog.daily_contexts(events(spark, sf_dir)).join(
        eventlog.population(events(spark, sf_dir)).select("child_id", "S"), "child_id"
    )
    return intervals.day_windows(days).select(
        *longs("child_id", "day_index", "window_index"),
        "window_name",
        *rounded("window_start", "window_end", "weight"),
    )


@query(
    "context_overlap",
    with_tables(
        """
        SELECT child_id, day_index, session_index::BIGINT AS session_index,
               round(school, 6) AS school_use_minutes, round(night, 6) AS post_bedtime_use_minutes
        FROM sess
        """
    ),
)
def context_overlap(spark, sf_dir):
    ev = events(spark, sf_dir)
    rows = sessions.sessionize(eventlog.episodes(ev))
    return intervals.context_overlap(rows, eventlog.daily_rows(ev)).select(
        *longs("child_id", "day_index", "session_index"),
        *rounded("school_use_minutes", "post_bedtime_use_minutes"),
    )


GAPS_SQL = """
gap0 AS (
  SELECT child_id, day_index, ss, se,
         coalesce(max(se) OVER (PARTITION BY child_id, day_index ORDER BY ss, se
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS cur
  FROM (SELECT child_id, day_index, s AS ss, e AS se FROM ep)
),
gap AS (
  SELECT child_id, day_index, cur AS gs, ss AS ge FROM gap0 WHERE ss > cur
  UNION ALL
  SELECT child_id, day_index, max(se), 1440.0 FROM gap0
  GROUP BY child_id, day_index HAVING max(se) < 1440
)
"""


def busy_gaps(spark, sf_dir):
    return intervals.free_gaps(
        eventlog.episodes(events(spark, sf_dir)),
        start="episode_start_minute",
        end="episode_end_minute",
    )


@query(
    "free_gaps",
    with_tables(
        "SELECT child_id, day_index, round(gs, 6) AS gap_start, round(ge, 6) AS gap_end FROM gap",
        GAPS_SQL,
    ),
)
def free_gaps(spark, sf_dir):
    return busy_gaps(spark, sf_dir).select(
        *longs("child_id", "day_index"), *rounded("gap_start", "gap_end")
    )


@query(
    "slot_candidates",
    with_tables(
        """
        SELECT child_id, day_index, name AS window_name, round(a, 6) AS slot_start,
               round(b, 6) AS slot_end, round(w, 6) AS weight, round(w * (b - a), 6) AS mass,
               round(w * (b - a) / sum(w * (b - a)) OVER (PARTITION BY child_id, day_index), 6)
                 AS probability
        FROM (SELECT g.child_id, g.day_index, name, w, greatest(gs, ws) AS a,
                     least(ge - 20, we) AS b
              FROM gap g JOIN win USING (child_id, day_index) WHERE ge - 20 >= gs)
        WHERE b > a
        """,
        GAPS_SQL,
    ),
)
def slot_candidates(spark, sf_dir):
    windows = intervals.day_windows(eventlog.daily_rows(events(spark, sf_dir)))
    slots = intervals.slot_candidates(busy_gaps(spark, sf_dir), windows, 20.0)
    return slots.select(
        *longs("child_id", "day_index"),
        "window_name",
        *rounded("slot_start", "slot_end", "weight", "mass", "probability"),
    )


@query(
    "sequential_layout",
    with_tables(
        """
        SELECT event_id, child_id, day_index, session_index::BIGINT AS session_index,
               row_number() OVER w AS episode_index,
               round(ss + coalesce(sum(dur) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING
                 AND 1 PRECEDING), 0), 6) AS laid_start,
               round(ss + sum(dur) OVER (w ROWS UNBOUNDED PRECEDING), 6) AS laid_end
        FROM (SELECT *, min(s) OVER (PARTITION BY child_id, day_index, session_index) AS ss
              FROM ept)
        WINDOW w AS (PARTITION BY child_id, day_index, session_index ORDER BY s, event_id)
        """
    ),
)
def sequential_layout(spark, sf_dir):
    ev = events(spark, sf_dir)
    keys = ["child_id", "day_index", "session_index"]
    origin = eventlog.session_rows(ev).select(*keys, "session_start_minute")
    placed = eventlog.tagged_episodes(ev).join(origin, keys)
    chunk, order = F.col("episode_start_minute"), ["episode_start_minute", "event_id"]
    laid = scans.sequential_layout(
        placed,
        keys,
        chunk,
        order,
        "episode_duration_minutes",
        "session_start_minute",
        "episode_index",
        "laid_start",
        "laid_end",
    )
    return laid.select(
        *longs("event_id", *keys, "episode_index"), *rounded("laid_start", "laid_end")
    )


@query(
    "proportional_allocation",
    """
    SELECT l_orderkey, l_partkey, l_linenumber::BIGINT AS l_linenumber,
           round(o_totalprice * l_extendedprice
                 / sum(l_extendedprice) OVER (PARTITION BY l_orderkey), 6) AS allocated
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    """,
)
def proportional_allocation(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice"
    )
    totals = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_totalprice"
    )
    parts = scans.proportional_allocation(
        lines, totals, ["l_orderkey"], "l_extendedprice", "o_totalprice", "allocated"
    )
    return parts.select(
        *longs("l_orderkey", "l_partkey", "l_linenumber"), *rounded("allocated")
    )


@query(
    "overlap_violations",
    with_tables(
        """
        SELECT child_id, day_index, session_index::BIGINT AS session_index,
               round(s, 6) AS session_start_minute, round(pe, 6) AS previous_end
        FROM (SELECT *, lag(e) OVER (PARTITION BY child_id, day_index ORDER BY s, e) AS pe
              FROM (SELECT child_id, day_index, session_index, ss - 20 AS s, se AS e FROM sess0))
        WHERE s < pe - 1e-9
        UNION ALL
        SELECT child_id, day_index, session_index::BIGINT, round(s, 6), round(pe, 6)
        FROM (SELECT *, lag(e) OVER (PARTITION BY child_id, day_index ORDER BY s, e) AS pe
              FROM (SELECT child_id, day_index, session_index, ss - 45 AS s, se AS e FROM sess0))
        WHERE s < pe - 1e-9
        """
    ),
)
def overlap_violations(spark, sf_dir):
    """Sessions as found never overlap; warm-up margins of 20 minutes still do
    not, margins of 45 minutes do."""
    rows = eventlog.session_rows(events(spark, sf_dir))

    def widened(margin):
        return intervals.overlap_violations(
            rows.withColumn("session_start_minute", F.col("session_start_minute") - margin)
        ).select(
            *longs("child_id", "day_index", "session_index"),
            *rounded("session_start_minute", "previous_end"),
        )

    return widened(20.0).unionByName(widened(45.0))
