"""Check suites over the behaviour, study and intervention tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from diurna.operators import aggregates, intervals
from diurna.operators.single import row_of
from diurna.plans import checks, eventlog, study, weekly
from diurna.schemas import APP_CATEGORIES, CV_FOLDS, FEATURES, TARGET
from diurna.session import written_table
from diurna.sources.tables import table
from workload.behaviour_sql import with_tables
from workload.interventions import RESPONSE_SQL, RULES_SQL, responses
from workload.models import DATASET_CTES, REASON_SQL
from workload.registry import events, longs, query

IDS = ["child_id", "week_index"]
SESSION = ["child_id", "day_index", "session_index"]


def checks_sql(groups: dict[str, dict[str, str]]) -> str:
    """source -> {check: failing condition}; all counted, undecided ones too."""
    return " UNION ALL ".join(
        f"SELECT '{check}' AS \"check\", count(*) FILTER (coalesce({cond}, true)) AS failed_rows FROM {source}"
        for source, rules in groups.items()
        for check, cond in rules.items()
    )


def report(df):
    return df.select("check", *longs("failed_rows"))


POPULATION_SQL = """
(SELECT 5 + c_custkey % 9 AS age, (c_custkey * 7) % 35 - 17 AS shift,
        1290 + (c_custkey * 13) % 106 AS bed_s,
        1290 + (c_custkey * 13) % 106 + (c_custkey * 17) % 80 - 2 AS bed_n,
        (c_custkey * 17) % 80 - 2 AS delay FROM customer)
"""


@query(
    "dq_population",
    checks_sql(
        {
            POPULATION_SQL: {
                "age_range": "age NOT BETWEEN 6 AND 12",
                "school_shift_range": "shift NOT BETWEEN -15 AND 15",
                "bedtime_order": "bed_n < bed_s",
                "bedtime_delay_range": "delay NOT BETWEEN 0 AND 75",
            }
        }
    ),
)
def dq_population(spark, sf_dir):
    """Profiles read off the customer keys, with values beyond every limit."""
    k = F.col("c_custkey")
    delay = (k * 17) % 80 - 2
    bed = 1290 + (k * 13) % 106
    people = table(spark, sf_dir, "customer").select(
        (5 + k % 9).alias("age"),
        ((k * 7) % 35 - 17).alias("school_shift_minutes"),
        bed.alias("bedtime_school_minute"),
        (bed + delay).alias("bedtime_non_school_minute"),
        delay.alias("bedtime_non_school_delay_minutes"),
    )
    return report(checks.population(people))


@query(
    "dq_context",
    with_tables(
        checks_sql(
            {
                "(SELECT child_id, count(*) AS n FROM cal GROUP BY child_id)": {
                    "days_per_child": "n <> (SELECT max(day_index) - min(day_index) + 1 FROM cal)"
                },
                "cal": {
                    "weekend_flag": "(wd >= 5) <> (wd IN (5, 6))",
                    "no_school_without_times": "NOT school_today AND (ss_min IS NOT NULL OR se_min IS NOT NULL)",
                    "school_with_times": "school_today AND (ss_min IS NULL OR se_min IS NULL)",
                    "day_start_range": "day_start NOT BETWEEN 0 AND 1439",
                },
            }
        )
    ),
)
def dq_context(spark, sf_dir):
    ev = events(spark, sf_dir)
    span = row_of(eventlog.calendar_span(ev))
    days = span["last_day"] - span["first_day"] + 1
    return report(checks.daily_context(eventlog.daily_contexts(ev), days))


@query(
    "dq_daily",
    with_tables(
        checks_sql(
            {
                "day": {
                    "use_positive": "NOT use > 0",
                    "use_below_day": "NOT use < 1440",
                    "count_positive": "NOT n >= 1",
                }
            }
        )
    ),
)
def dq_daily(spark, sf_dir):
    return report(checks.daily_totals(eventlog.daily_rows(events(spark, sf_dir))))


@query(
    "dq_conservation",
    with_tables(
        checks_sql(
            {
                """(SELECT t, rt, c, rc FROM (SELECT child_id, day_index, sum(dur) AS t, count(*) AS c
                     FROM ept GROUP BY ALL) JOIN (SELECT child_id, day_index, sum(dur) AS rt,
                     count(*) AS rc FROM sess0 GROUP BY ALL) USING (child_id, day_index))""": {
                    "time_conserved": "NOT abs(t - rt) <= 1e-8 + 1e-10 * abs(rt)",
                    "count_conserved": "c <> rc",
                },
                "sess0": {"duration_positive": "NOT dur > 0"},
            }
        )
    ),
)
def dq_conservation(spark, sf_dir):
    """Totals taken from episodes against session spans: gaps inside sessions
    and overlapping episodes show up as failures."""
    ev = events(spark, sf_dir)
    totals = eventlog.episodes(ev).groupBy("child_id", "day_index").agg(
        F.sum("episode_duration_minutes").alias("daily_use_minutes"),
        F.count(F.lit(1)).alias("daily_session_count"),
    )
    return report(checks.conservation(totals, eventlog.session_rows(ev)))


@query(
    "dq_windows",
    with_tables(
        checks_sql(
            {
                "wl": {
                    "width_positive": "NOT we - ws > 0",
                    "weight_positive": "NOT w > 0",
                    "contiguous": "pe IS NOT NULL AND NOT abs(pe - ws) <= 1e-8 + 1e-5 * abs(ws)",
                },
                "(SELECT min(ws) AS a, max(we) AS b, sum(we - ws) AS c FROM win GROUP BY child_id, day_index)": {
                    "starts_at_midnight": "NOT abs(a) <= 1e-8",
                    "ends_at_midnight": "NOT abs(b - 1440) <= 1e-8 + 1e-5 * 1440",
                    "covers_day": "NOT abs(c - 1440) <= 1e-8 + 1e-5 * 1440",
                },
            }
        ),
        """
        wl AS (SELECT *, lag(we) OVER (PARTITION BY child_id, day_index ORDER BY ws) AS pe FROM win)
        """,
    ),
)
def dq_windows(spark, sf_dir):
    ev = events(spark, sf_dir)
    days = eventlog.daily_contexts(ev).withColumn("S", eventlog.latent("S"))
    return report(checks.windows(intervals.day_windows(days)))


@query(
    "dq_sessions",
    with_tables(
        checks_sql(
            {
                "sess0": {
                    "starts_in_day": "NOT ss >= 0",
                    "ends_in_day": "NOT se <= 1440",
                    "ends_after_start": "NOT se > ss",
                },
                """(SELECT ss, lag(se) OVER (PARTITION BY child_id, day_index ORDER BY ss, se) AS pe
                    FROM sess0)""": {"no_overlap": "pe IS NOT NULL AND ss < pe - 1e-9"},
                """(SELECT use, t FROM day JOIN (SELECT child_id, day_index, sum(dur) AS t
                    FROM sess0 GROUP BY ALL) USING (child_id, day_index))""": {
                    "time_conserved": "NOT abs(use - t) <= 1e-8 + 1e-10 * abs(t)"
                },
            }
        )
    ),
)
def dq_sessions(spark, sf_dir):
    ev = events(spark, sf_dir)
    return report(checks.scheduled_sessions(eventlog.daily_rows(ev), eventlog.session_rows(ev)))


@query(
    "dq_overlaps",
    with_tables(
        checks_sql(
            {
                "sess": {
                    "school_not_negative": "school < 0",
                    "night_not_negative": "night < 0",
                    "school_within_session": "school > dur + 1e-9",
                    "night_within_session": "night > dur + 1e-9",
                },
                """(SELECT d.use, c.school_today, s.sc, s.ni FROM day d
                    JOIN cal c USING (child_id, day_index)
                    JOIN (SELECT child_id, day_index, sum(school) AS sc, sum(night) AS ni
                          FROM sess GROUP BY ALL) s USING (child_id, day_index))""": {
                    "school_within_day": "sc > use + 1e-8",
                    "night_within_day": "ni > use + 1e-8",
                    "no_school_no_minutes": "NOT school_today AND abs(sc) > 1e-10",
                },
            }
        )
    ),
)
def dq_overlaps(spark, sf_dir):
    ev = events(spark, sf_dir)
    return report(checks.overlaps(eventlog.daily_rows(ev), eventlog.session_rows(ev)))


@query(
    "dq_episodes",
    with_tables(
        checks_sql(
            {
                "ept": {"duration_positive": "NOT dur > 0", "end_after_start": "NOT e > s"},
                """(SELECT s.dur, s.ss, s.se, b.* EXCLUDE (child_id, day_index, session_index)
                    FROM sess0 s JOIN (SELECT child_id, day_index, session_index, min(s) AS f,
                      max(e) AS l, sum(dur) AS m, count(*) AS c FROM ept GROUP BY ALL) b
                    USING (child_id, day_index, session_index))""": {
                    "one_episode_per_session": "c < 1",
                    "duration_conserved": "NOT abs(dur - m) <= 1e-8 + 1e-10 * abs(m)",
                    "first_start_matches": "NOT abs(ss - f) <= 1e-8 + 1e-10 * abs(f)",
                    "last_end_matches": "NOT abs(se - l) <= 1e-8 + 1e-10 * abs(l)",
                },
            }
        )
    ),
)
def dq_episodes(spark, sf_dir):
    ev = events(spark, sf_dir)
    rows = eventlog.tagged_episodes(ev)
    bounds = aggregates.session_bounds(rows, SESSION)
    return report(checks.episodes(eventlog.session_rows(ev), bounds, rows))


@query(
    "dq_split",
    with_tables(
        checks_sql(
            {
                """(SELECT count(*) FILTER (r > q) AS dev, count(*) FILTER (r <= q) AS test
                    FROM (SELECT *, floor(sz * 0.2) AS q FROM dsr) GROUP BY child_id, week_index)""": {
                    "development_ids_unique": "dev > 1",
                    "test_ids_unique": "test > 1",
                    "parts_disjoint": "dev > 0 AND test > 0",
                    "union_complete": "dev + test = 0",
                    "no_foreign_ids": "false",
                },
                """(SELECT any_value(sz) AS sz, count(*) FILTER (r <= floor(sz * 0.2)) AS t
                    FROM dsr GROUP BY age)""": {"stratum_counts": "t <> floor(sz * 0.2)"},
            }
        ),
        *DATASET_CTES,
    ),
)
def dq_split(spark, sf_dir):
    rows = study.labelled_rows(events(spark, sf_dir))
    split = written_table(study.split_rows(rows), "split")
    quota = F.floor(F.col("stratum_size") * F.lit(study.TEST_FRACTION))
    return report(checks.split(split, rows, IDS, study.STRATA, quota))


@query(
    "dq_folds",
    with_tables(
        checks_sql(
            {
                "(SELECT count(*) AS n FROM dev GROUP BY child_id, week_index)": {
                    "validated_once": "n > 1"
                },
                "dev": {"fold_range": "fold NOT BETWEEN 1 AND 5"},
                """(SELECT max(n) - min(n) AS s FROM (
                      SELECT a.age, v.ff, count(d.fold) AS n FROM (SELECT DISTINCT age FROM dev) a
                      CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS ff) v
                      LEFT JOIN dev d ON d.age = a.age AND d.fold = v.ff GROUP BY a.age, v.ff)
                    GROUP BY age)""": {"stratum_balance": "s > 1"},
                "(SELECT max(n) - min(n) AS s FROM (SELECT count(*) AS n FROM dev GROUP BY fold))": {
                    "fold_balance": "s > 1"
                },
            }
        ),
        *DATASET_CTES,
    ),
)
def dq_folds(spark, sf_dir):
    development = study.development_rows(events(spark, sf_dir))
    return report(checks.folds(development, IDS, study.STRATA, CV_FOLDS))


FINITE = " AND ".join(f"coalesce(isfinite({f}), false)" for f in FEATURES)
POSITIVE = " AND ".join(f"{f} > 0" for f in FEATURES[1:5])
UNIT = " AND ".join(f"{f} BETWEEN 0 AND 1" for f in FEATURES[5:])


@query(
    "dq_features",
    with_tables(
        checks_sql(
            {
                "(SELECT 1)": {"columns_exact": "false"},
                "(SELECT count(*) AS n FROM feat GROUP BY child_id, week_index)": {
                    "one_row_per_key": "n > 1"
                },
                "feat": {
                    "finite": f"NOT ({FINITE})",
                    "metrics_positive": f"NOT ({POSITIVE})",
                    "ratios_in_unit": f"NOT ({UNIT})",
                    "shares_within_one": "games_share + social_share + entertainment_share "
                    "+ education_share > 1 + 1e-10",
                },
            }
        )
    ),
)
def dq_features(spark, sf_dir):
    rows = written_table(weekly.from_events(events(spark, sf_dir)), "features")
    return report(checks.features(rows, IDS))


@query(
    "dq_dataset",
    with_tables(
        checks_sql(
            {
                "(SELECT 1)": {
                    "columns_exact": "false",
                    "forbidden_columns": "false",
                    "target_not_a_feature": "false",
                },
                "(SELECT count(*) AS n FROM ds GROUP BY child_id, week_index)": {
                    "one_row_per_key": "n > 1"
                },
                """(SELECT child_id, week_index FROM day EXCEPT SELECT child_id, week_index FROM ds)""": {
                    "rows_complete": "true"
                },
                "ds": {"finite": f'NOT ({FINITE} AND coalesce(isfinite("{TARGET}"), false))'},
            }
        ),
        *DATASET_CTES,
    ),
)
def dq_dataset(spark, sf_dir):
    ev = events(spark, sf_dir)
    rows = written_table(
        eventlog.with_target(weekly.from_events(ev)).select(*IDS, *FEATURES, TARGET), "dataset"
    )
    expected = (
        eventlog.episodes(ev)
        .select("child_id", eventlog.week_of(F.col("day_index")).alias("week_index"))
        .distinct()
    )
    return report(checks.training_table(rows, expected, IDS))


@query(
    "dq_target",
    with_tables(
        checks_sql(
            {
                "(SELECT count(*) AS n FROM tgt GROUP BY child_id, week_index)": {
                    "one_row_per_key": "n > 1"
                },
                "(SELECT child_id, week_index FROM feat EXCEPT SELECT child_id, week_index FROM tgt)": {
                    "rows_complete": "true"
                },
                "tgt": {
                    "finite": "NOT (isfinite(y_star) AND isfinite(target_noise) AND isfinite(y))",
                    "inside_open_range": "NOT (y > 1 AND y < 5)",
                },
            }
        )
    ),
)
def dq_target(spark, sf_dir):
    rows = written_table(weekly.from_events(events(spark, sf_dir)), "features")
    return report(checks.target(eventlog.target_rows(rows), rows, IDS))


@query(
    "dq_categories",
    with_tables(
        checks_sql(
            {
                """(SELECT games / t AS g, social / t AS s, entertainment / t AS en, education / t AS ed,
                           other / t AS o FROM (SELECT *, nullif(games + social + entertainment
                             + education + other, 0) AS t FROM (
                      SELECT child_id, sum(games) AS games, sum(social) AS social,
                        sum(entertainment) AS entertainment, sum(education) AS education,
                        sum(other) AS other FROM wcat GROUP BY child_id)))""": {
                    "preferences_positive": "NOT (g > 0 AND s > 0 AND en > 0 AND ed > 0 AND o > 0)",
                    "preferences_sum_to_one": "NOT abs(g + s + en + ed + o - 1) <= 2e-10",
                },
                "ep": {
                    "category_present": "cat IS NULL",
                    "category_known": "cat NOT IN ('games', 'social', 'entertainment', 'education', 'other')",
                },
            }
        )
    ),
)
def dq_categories(spark, sf_dir):
    """Observed shares per child stand in for preferences."""
    rows = eventlog.episodes(events(spark, sf_dir))
    shares = weekly.category_shares(rows, ["child_id"]).select(
        "child_id", *[F.col(f"{c}_share").alias(f"category_prob_{c}") for c in APP_CATEGORIES]
    )
    return report(checks.categories(shares, rows))


CATALOG_PARTS_SQL = """
cp AS (
  SELECT 'part_' || (p_partkey % 1900) AS activity_id,
         CASE WHEN p_partkey % 41 = 0 THEN '  ' ELSE p_name END AS title,
         CASE WHEN p_partkey % 43 = 0 THEN '' ELSE p_type END AS description,
         CASE p_size % 4 WHEN 0 THEN 'calm' WHEN 1 THEN 'moderate' WHEN 2 THEN 'active' ELSE 'wild' END AS lvl,
         CASE WHEN p_size % 7 = 0 THEN ['bedtime', 'midnight'] WHEN p_size % 2 = 0
              THEN ['voluntary', 'bedtime'] ELSE ['general'] END AS ctx,
         p_size % 3 = 0 AS suitable
  FROM part
)
"""


@query(
    "dq_catalog",
    "WITH "
    + CATALOG_PARTS_SQL
    + checks_sql(
        {
            "(SELECT count(*) AS n FROM cp GROUP BY activity_id)": {"ids_unique": "n > 1"},
            "cp": {
                "title_present": "trim(title) = ''",
                "description_present": "trim(description) = ''",
                "level_known": "lvl NOT IN ('calm', 'moderate', 'active')",
                "contexts_known": "len(list_filter(ctx, lambda x: x NOT IN ('voluntary', 'bedtime', 'general'))) > 0",
                "bedtime_suitable": "list_contains(ctx, 'bedtime') AND NOT suitable",
            },
        }
    ),
)
def dq_catalog(spark, sf_dir):
    """The catalogue suite over a catalogue read off the part table."""
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        F.concat(F.lit("part_"), (k % 1900).cast("string")).alias("activity_id"),
        F.when(k % 41 == 0, "  ").otherwise(F.col("p_name")).alias("title"),
        F.when(k % 43 == 0, "").otherwise(F.col("p_type")).alias("description"),
        F.when(size % 4 == 0, "calm")
        .when(size % 4 == 1, "moderate")
        .when(size % 4 == 2, "active")
        .otherwise("wild")
        .alias("activity_level"),
        F.when(size % 7 == 0, F.array(F.lit("bedtime"), F.lit("midnight")))
        .when(size % 2 == 0, F.array(F.lit("voluntary"), F.lit("bedtime")))
        .otherwise(F.array(F.lit("general")))
        .alias("allowed_contexts"),
        (size % 3 == 0).alias("bedtime_suitable"),
    )
    return report(checks.catalog(rows))


SCORING_INPUT_SQL = f"""
inp AS (
  SELECT l_tax * 40 - 1.55 AS age_scaled, l_extendedprice / 1000 - 3 AS mean_daily_use_minutes,
         l_quantity - 1 AS mean_daily_session_count,
         CASE WHEN l_partkey % 37 = 0 THEN NULL ELSE 4.5 END AS median_session_duration,
         l_quantity + 5 AS mean_daily_app_openings, l_discount * 10.5 AS post_bedtime_use_ratio,
         0.06 AS school_use_ratio, l_discount * 3 AS games_share, l_tax * 3 AS social_share,
         l_discount * 4 AS entertainment_share,
         CASE WHEN l_suppkey % 11 = 0 THEN 'NaN'::DOUBLE ELSE 0.2 END AS education_share
  FROM lineitem
),
why AS (SELECT coalesce({REASON_SQL}, 'ok') AS reason FROM inp)
"""


@query(
    "dq_scoring_input",
    f"WITH {SCORING_INPUT_SQL} SELECT reason AS \"check\", count(*) AS failed_rows FROM why GROUP BY reason",
)
def dq_scoring_input(spark, sf_dir):
    """Scoring rows made of order lines, with all kinds of bad values."""
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        (c("l_tax") * 40 - 1.55).alias("age_scaled"),
        (c("l_extendedprice") / 1000 - 3).alias("mean_daily_use_minutes"),
        (c("l_quantity") - 1).alias("mean_daily_session_count"),
        F.when(c("l_partkey") % 37 == 0, F.lit(None)).otherwise(4.5).alias("median_session_duration"),
        (c("l_quantity") + 5).alias("mean_daily_app_openings"),
        (c("l_discount") * 10.5).alias("post_bedtime_use_ratio"),
        F.lit(0.06).alias("school_use_ratio"),
        (c("l_discount") * 3).alias("games_share"),
        (c("l_tax") * 3).alias("social_share"),
        (c("l_discount") * 4).alias("entertainment_share"),
        F.when(c("l_suppkey") % 11 == 0, F.lit(float("nan"))).otherwise(0.2).alias("education_share"),
    )
    return report(checks.scoring_input(rows, ["l_orderkey"]))


@query("dq_history", f"WITH {RESPONSE_SQL} " + checks_sql({"resp": {k: f"coalesce({c}, false)" for k, c in RULES_SQL.items()}}))
def dq_history(spark, sf_dir):
    return report(checks.history(responses(spark, sf_dir)))
