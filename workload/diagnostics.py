"""Summaries, correlations and diagnostics over the behaviour tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from diurna.operators import aggregates, joins
from diurna.plans import eventlog, weekly
from diurna.schemas import APP_CATEGORIES, FEATURES
from diurna.session import written_table
from diurna.sources.tables import table
from workload.behaviour_sql import with_tables
from workload.registry import events, longs, query, rounded

SESSION_KEYS = ["child_id", "day_index", "session_index"]


def feature_table(spark, sf_dir):
    """Feature rows stored once: the diagnostics read them several times."""
    return written_table(weekly.from_events(events(spark, sf_dir)), "features")


def describe_sql(source: str, metrics: dict[str, str], percents=(5, 25, 50, 75, 95)) -> str:
    parts = []
    for metric, expr in metrics.items():
        stats = {
            "count": f"CAST(count({expr}) AS DOUBLE)",
            "mean": f"avg({expr})",
            "std": f"stddev_samp({expr})",
            "min": f"min({expr})",
            "max": f"max({expr})",
            **{f"{p}%": f"quantile_cont({expr}, {p / 100})" for p in percents},
        }
        parts += [
            f"SELECT '{metric}' AS metric, '{s}' AS statistic, round({e}, 6) AS value FROM {source}"
            for s, e in stats.items()
        ]
    return " UNION ALL ".join(parts)


@query("describe_metric", with_tables(describe_sql("feat", {f: f for f in FEATURES})))
def describe_metric(spark, sf_dir):
    found = aggregates.describe(
        feature_table(spark, sf_dir), FEATURES, [0.05, 0.25, 0.5, 0.75, 0.95]
    )
    return found.select("metric", "statistic", *rounded("value"))


@query(
    "describe_lineitem",
    describe_sql(
        "lineitem",
        {c: c for c in ("l_quantity", "l_extendedprice", "l_discount")},
        (1, 25, 50, 75, 99),
    ),
)
def describe_lineitem(spark, sf_dir):
    """The same summary at volume, read straight from the stored table."""
    found = aggregates.describe(
        table(spark, sf_dir, "lineitem"),
        ["l_quantity", "l_extendedprice", "l_discount"],
        [0.01, 0.25, 0.5, 0.75, 0.99],
    )
    return found.select("metric", "statistic", *rounded("value"))


def corr_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS correlation "
        f"FROM {source}"
        for a in columns
        for b in columns
    )


@query("corr_matrix", with_tables(corr_sql("feat", FEATURES)))
def corr_matrix(spark, sf_dir):
    matrix = aggregates.corr_matrix(weekly.from_events(events(spark, sf_dir)), FEATURES)
    return matrix.select("column_a", "column_b", *rounded("correlation"))


@query(
    "corr_ranking",
    with_tables(
        " UNION ALL ".join(
            f"SELECT '{f}' AS feature, round(corr({f}, \"S\"), 6) AS correlation "
            "FROM feat JOIN prof p USING (child_id)".replace(f"corr({f}", f"corr(feat.{f}")
            for f in FEATURES
        )
    ),
)
def corr_ranking(spark, sf_dir):
    """Which feature carries the latent S, strongest first."""
    profiled = weekly.from_events(events(spark, sf_dir)).select(
        *[F.col(f) for f in FEATURES], eventlog.latent("S").alias("S")
    )
    return aggregates.corr_with(profiled, FEATURES, "S").select("feature", *rounded("correlation"))


@query(
    "category_latent_corr",
    with_tables(
        " UNION ALL ".join(
            f"SELECT '{c}_share' AS feature, '{z}' AS latent, "
            f"round(corr(w.{c} / w.tot, p.\"{z}\"), 6) AS correlation "
            "FROM kidcat w JOIN prof p USING (child_id)"
            for c in APP_CATEGORIES
            for z in ("S", "age_scaled")
        ),
        """
        kidcat AS (
          SELECT *, nullif(games + social + entertainment + education + other, 0) AS tot
          FROM (SELECT child_id, sum(games) AS games, sum(social) AS social,
                       sum(entertainment) AS entertainment, sum(education) AS education,
                       sum(other) AS other FROM wcat GROUP BY child_id))
        """,
    ),
)
def category_latent_corr(spark, sf_dir):
    """Do category shares follow S or age? (they should not)"""
    shares = weekly.category_shares(eventlog.episodes(events(spark, sf_dir)), ["child_id"])
    names = [f"{c}_share" for c in APP_CATEGORIES]
    profiled = eventlog.with_profile(shares)
    parts = [
        aggregates.corr_with(profiled, names, z).withColumn("latent", F.lit(z))
        for z in ("S", "age_scaled")
    ]
    return parts[0].unionByName(parts[1]).select("feature", "latent", *rounded("correlation"))


START_WINDOW_SQL = """
startw AS (
  SELECT s.child_id, s.day_index, s.session_index, s.dur, w.name
  FROM sess0 s JOIN win w ON s.child_id = w.child_id AND s.day_index = w.day_index
       AND s.ss >= w.ws AND s.ss < w.we
)
"""


@query(
    "duration_by_window",
    with_tables(
        """
        SELECT name AS start_window, round(avg(dur), 6) AS mean,
               round(quantile_cont(dur, 0.5), 6) AS median
        FROM startw GROUP BY name
        """,
        START_WINDOW_SQL,
    ),
)
def duration_by_window(spark, sf_dir):
    rows = written_table(eventlog.session_start_windows(events(spark, sf_dir)), "starts")
    return aggregates.group_mean_median(
        rows, "session_start_window", "session_duration_minutes"
    ).select(F.col("session_start_window").alias("start_window"), *rounded("mean", "median"))


@query(
    "start_window_share",
    with_tables(
        """
        SELECT name AS start_window, count(*) AS rows,
               round(count(*) / sum(count(*)) OVER (), 6) AS share
        FROM startw GROUP BY name
        """,
        START_WINDOW_SQL,
    ),
)
def start_window_share(spark, sf_dir):
    rows = eventlog.session_start_windows(events(spark, sf_dir))
    return aggregates.frequencies(rows, "session_start_window").select(
        F.col("session_start_window").alias("start_window"), *longs("rows"), *rounded("share")
    )


@query(
    "use_by_group",
    with_tables(
        """
        SELECT 'age' AS grouping, CAST(age AS VARCHAR) AS label, round(avg(use), 6) AS mean_use,
               round(avg(n), 6) AS mean_sessions
        FROM day JOIN prof USING (child_id) GROUP BY age
        UNION ALL
        SELECT 'is_weekend', CASE WHEN day_index % 7 >= 5 THEN 'true' ELSE 'false' END,
               round(avg(use), 6), round(avg(n), 6)
        FROM day GROUP BY day_index % 7 >= 5
        """
    ),
)
def use_by_group(spark, sf_dir):
    """Mean use and sessions by age and by weekend; one pass over child-days.

    Both groupings come from one fine aggregate (age x weekend), so the days
    are shuffled once.
    """
    fine = (
        eventlog.daily_rows(events(spark, sf_dir))
        .groupBy("age", "is_weekend")
        .agg(
            F.sum("daily_use_minutes").alias("use"),
            F.sum("daily_session_count").alias("sessions"),
            F.count(F.lit(1)).alias("days"),
        )
    )
    labelled = fine.select(
        F.explode(
            F.array(
                F.struct(
                    F.lit("age").alias("grouping"), F.col("age").cast("string").alias("label")
                ),
                F.struct(
                    F.lit("is_weekend").alias("grouping"),
                    F.col("is_weekend").cast("string").alias("label"),
                ),
            )
        ).alias("g"),
        "use",
        "sessions",
        "days",
    )
    return labelled.groupBy("g.grouping", "g.label").agg(
        F.round(F.sum("use") / F.sum("days"), 6).alias("mean_use"),
        F.round(F.sum("sessions") / F.sum("days"), 6).alias("mean_sessions"),
    )


@query(
    "short_episode_profile",
    with_tables(
        " UNION ALL ".join(
            f"SELECT {s}::BIGINT AS under_seconds, count(*) FILTER (d < {s}/60.0) AS episodes, "
            f"round(count(*) FILTER (d < {s}/60.0) / count(*), 6) AS row_share, "
            f"round(coalesce(sum(d) FILTER (d < {s}/60.0), 0) / sum(d), 6) AS minute_share "
            "FROM (SELECT e - s AS d FROM ep)"
            for s in (1, 5, 10)
        )
    ),
)
def short_episode_profile(spark, sf_dir):
    profile = aggregates.short_profile(eventlog.episodes(events(spark, sf_dir)))
    return profile.select(
        *longs("under_seconds", "episodes"), *rounded("row_share", "minute_share")
    )


@query(
    "crowded_sessions",
    with_tables(
        """
        SELECT count(*) FILTER (openings > 3) AS groups_above,
               round(count(*) FILTER (openings > 3) / count(*), 6) AS share_above FROM sess0
        """
    ),
)
def crowded_sessions(spark, sf_dir):
    rows = eventlog.session_rows(events(spark, sf_dir))
    return aggregates.crowded_share(rows, "openings", 3).select(
        *longs("groups_above"), *rounded("share_above")
    )


@query(
    "top_sessions",
    with_tables(
        """
        SELECT child_id, day_index, session_index::BIGINT AS session_index, openings,
               round(dur, 6) AS session_duration_minutes
        FROM sess0 ORDER BY openings DESC, dur DESC, child_id, day_index, session_index LIMIT 10
        """
    ),
)
def top_sessions(spark, sf_dir):
    top = aggregates.top_rows(
        eventlog.session_rows(events(spark, sf_dir)),
        [
            F.col("openings").desc(),
            F.col("session_duration_minutes").desc(),
            *[F.col(k) for k in SESSION_KEYS],
        ],
        10,
    )
    return top.select(*longs(*SESSION_KEYS, "openings"), *rounded("session_duration_minutes"))


@query(
    "overlap_extremes",
    with_tables(
        """
        SELECT 'post_bedtime_equal_1' AS extreme, count(*) FILTER (abs(nr - 1) <= 1e-10 + 1e-5)
                 AS days, round(count(*) FILTER (abs(nr - 1) <= 1e-10 + 1e-5) / count(*), 6) AS share
        FROM dr
        UNION ALL SELECT 'post_bedtime_over_half', count(*) FILTER (nr > 0.5),
               round(count(*) FILTER (nr > 0.5) / count(*), 6) FROM dr
        UNION ALL SELECT 'school_over_half', count(*) FILTER (sr > 0.5),
               round(count(*) FILTER (sr > 0.5) / count(*), 6) FROM dr
        """,
        """
        dr AS (
          SELECT child_id, day_index, sum(night) / nullif(sum(dur), 0) AS nr,
                 sum(school) / nullif(sum(dur), 0) AS sr
          FROM sess GROUP BY child_id, day_index)
        """,
    ),
)
def overlap_extremes(spark, sf_dir):
    return aggregates.extreme_days(eventlog.daily_ratios(events(spark, sf_dir))).select(
        "extreme", *longs("days"), *rounded("share")
    )


OLS_SQL = """
od AS (
  SELECT mean_daily_app_openings AS y, mean_daily_use_minutes AS a,
         mean_daily_session_count AS b, p."F" AS z
  FROM feat JOIN prof p USING (child_id)
),
om AS (
  SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS saa, var_pop(b) AS sbb,
         covar_pop(a, b) AS sab, covar_pop(a, y) AS say, covar_pop(b, y) AS sby FROM od
),
oc AS (
  SELECT *, (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS c1,
         (saa * sby - sab * say) / (saa * sbb - sab * sab) AS c2 FROM om
),
orr AS (
  SELECT y, z, c1, c2, y - my - c1 * (a - ma) - c2 * (b - mb) AS res, y / b AS unit FROM od, oc
)
"""


@query(
    "ols_redundancy",
    with_tables(
        """
        SELECT round(min(c1), 6) AS coef_1, round(min(c2), 6) AS coef_2,
               round(1 - sum(res * res) / (var_pop(y) * count(*)), 6) AS r2,
               round(stddev_samp(y), 6) AS std_y, round(stddev_samp(res), 6) AS std_residual,
               round(corr(res, z), 6) AS corr_residual_latent,
               round(corr(unit, z), 6) AS corr_per_unit_latent
        FROM orr
        """,
        OLS_SQL,
    ),
)
def ols_redundancy(spark, sf_dir):
    """Openings given use and sessions: is fragmentation F left over?"""
    data = weekly.from_events(events(spark, sf_dir)).withColumn("F", eventlog.latent("F"))
    found = aggregates.redundancy(
        written_table(data, "redundancy"),
        "mean_daily_app_openings",
        "mean_daily_use_minutes",
        "mean_daily_session_count",
        "F",
        ("mean_daily_app_openings", "mean_daily_session_count"),
    )
    return found.select(*rounded(*found.columns))


@query(
    "session_bounds",
    with_tables(
        """
        SELECT child_id, day_index, session_index::BIGINT AS session_index,
               round(min(s), 6) AS first_episode_start, round(max(e), 6) AS last_episode_end,
               round(sum(dur), 6) AS episode_minutes, count(*) AS episode_count
        FROM ept GROUP BY child_id, day_index, session_index
        """
    ),
)
def session_bounds(spark, sf_dir):
    bounds = aggregates.session_bounds(
        eventlog.tagged_episodes(events(spark, sf_dir)), SESSION_KEYS
    )
    return bounds.select(
        *longs(*SESSION_KEYS, "episode_count"),
        *rounded("first_episode_start", "last_episode_end", "episode_minutes"),
    )


@query(
    "attempts_first",
    with_tables(
        """
        SELECT child_id, day_index, round(arg_min(dur, session_index), 6) AS first_duration
        FROM sess0 GROUP BY child_id, day_index
        """
    ),
)
def attempts_first(spark, sf_dir):
    """First value per child-day in session order."""
    first = joins.first_per_key(
        eventlog.session_rows(events(spark, sf_dir)),
        ["child_id", "day_index"],
        ["session_index"],
        ["session_duration_minutes"],
    )
    return first.select(
        *longs("child_id", "day_index"),
        F.round("session_duration_minutes", 6).alias("first_duration"),
    )


@query(
    "population_share",
    with_tables(
        """
        SELECT cat AS app_category, round(sum(e - s), 6) AS minutes,
               round(sum(e - s) / sum(sum(e - s)) OVER (), 6) AS share
        FROM ep GROUP BY cat
        """
    ),
)
def population_share(spark, sf_dir):
    minutes = (
        eventlog.episodes(events(spark, sf_dir))
        .where("app_category IS NOT NULL")
        .groupBy("app_category")
        .agg(F.sum("episode_duration_minutes").alias("minutes"))
    )
    return aggregates.with_share(minutes, "minutes", "share").select(
        "app_category", *rounded("minutes", "share")
    )
