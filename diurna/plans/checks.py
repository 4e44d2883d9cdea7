"""The check suites of every table of the pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diurna.functions import arrays, clock, numeric
from diurna.operators import intervals
from diurna.operators.quality import (
    constant,
    count_rows,
    duplicate_check,
    run_rules,
    suite,
)
from diurna.plans import dataset, interventions, scoring
from diurna.schemas import (
    ACTIVITY_LEVELS,
    APP_CATEGORIES,
    CONTEXTS,
    FEATURES,
    MINUTES_PER_DAY,
    POSITIVE_FEATURES,
    RATIO_FEATURES,
    SHARE_FEATURES,
    TARGET,
    TARGET_RANGE,
)

DAY = ["child_id", "day_index"]
SESSION = [*DAY, "session_index"]


def _close(a: str, b: str) -> Column:
    return numeric.isclose(F.col(a), F.col(b), 1e-10, 1e-8)


def population(df: DataFrame) -> DataFrame:
    return run_rules(
        df,
        {
            "age_range": ~F.col("age").between(6, 12),
            "school_shift_range": ~F.col("school_shift_minutes").between(-15, 15),
            "bedtime_order": F.col("bedtime_non_school_minute") < F.col("bedtime_school_minute"),
            "bedtime_delay_range": ~F.col("bedtime_non_school_delay_minutes").between(0, 75),
        },
    )


def daily_context(df: DataFrame, n_days: Column) -> DataFrame:
    school, start, end = (
        F.col(c) for c in ("has_school_today", "school_start_minute", "school_end_minute")
    )
    per_child = df.groupBy("child_id").agg(F.count(F.lit(1)).alias("n"))
    return suite(
        [
            run_rules(
                per_child.withColumn("__days", n_days), {"days_per_child": F.col("n") != F.col("__days")}
            ),
            run_rules(
                df,
                {
                    "weekend_flag": F.col("is_weekend") != clock.is_weekend_day(F.col("weekday")),
                    "no_school_without_times": ~school & (start.isNotNull() | end.isNotNull()),
                    "school_with_times": school & (start.isNull() | end.isNull()),
                    "day_start_range": ~F.col("day_start_minute").between(0, MINUTES_PER_DAY - 1),
                },
            ),
        ]
    )


def daily_totals(df: DataFrame) -> DataFrame:
    use = F.col("daily_use_minutes")
    return run_rules(
        df,
        {
            "use_positive": ~(use > 0),
            "use_below_day": ~(use < MINUTES_PER_DAY),
            "count_positive": ~(F.col("daily_session_count") >= 1),
        },
    )


def with_every_day(daily: DataFrame, per_day: DataFrame) -> DataFrame:
    """Days and what sessions say of them; a day on one side only keeps NULLs.

    The rules count an unknown as broken, so a day without sessions and a session
    without its day both fail.
    """
    return daily.join(per_day, DAY, "full")


def conservation(daily: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions of a day add up to its totals, and every day has both."""
    rebuilt = sessions.groupBy(*DAY).agg(
        F.sum("session_duration_minutes").alias("__time"), F.count(F.lit(1)).alias("__count")
    )
    joined = with_every_day(
        daily.select(*DAY, "daily_use_minutes", "daily_session_count"), rebuilt
    )
    return suite(
        [
            run_rules(
                joined,
                {
                    "time_conserved": ~_close("daily_use_minutes", "__time"),
                    "count_conserved": F.col("daily_session_count") != F.col("__count"),
                },
            ),
            run_rules(sessions, {"duration_positive": ~(F.col("session_duration_minutes") > 0)}),
        ]
    )


def windows(df: DataFrame) -> DataFrame:
    """Windows of a day cover it without gap or overlap (<= 9 rows per day)."""
    width = F.col("window_end") - F.col("window_start")
    before = F.lag("window_end").over(Window.partitionBy(*DAY).orderBy("window_start"))
    linked = df.withColumns({"__width": width, "__before": before})
    per_day = linked.groupBy(*DAY).agg(
        F.min("window_start").alias("first"),
        F.max("window_end").alias("last"),
        F.sum("__width").alias("covered"),
    )
    day = F.lit(float(MINUTES_PER_DAY))
    return suite(
        [
            run_rules(
                linked,
                {
                    "width_positive": ~(F.col("__width") > 0),
                    "weight_positive": ~(F.col("weight") > 0),
                    # The first window of a day has none before it.
                    "contiguous": F.col("__before").isNotNull()
                    & ~numeric.isclose(F.col("__before"), F.col("window_start")),
                },
            ),
            run_rules(
                per_day,
                {
                    "starts_at_midnight": ~numeric.isclose(F.col("first"), F.lit(0.0)),
                    "ends_at_midnight": ~numeric.isclose(F.col("last"), day),
                    "covers_day": ~numeric.isclose(F.col("covered"), day),
                },
            ),
        ]
    )


def scheduled_sessions(daily: DataFrame, sessions: DataFrame) -> DataFrame:
    start, end = F.col("session_start_minute"), F.col("session_end_minute")
    rebuilt = sessions.groupBy(*DAY).agg(F.sum("session_duration_minutes").alias("__time"))
    joined = with_every_day(daily.select(*DAY, "daily_use_minutes"), rebuilt)
    return suite(
        [
            run_rules(
                sessions,
                {
                    "starts_in_day": ~(start >= 0),
                    "ends_in_day": ~(end <= MINUTES_PER_DAY),
                    "ends_after_start": ~(end > start),
                },
            ),
            count_rows(intervals.overlap_violations(sessions), "no_overlap"),
            run_rules(joined, {"time_conserved": ~_close("daily_use_minutes", "__time")}),
        ]
    )


def overlaps(daily: DataFrame, sessions: DataFrame) -> DataFrame:
    school, night = F.col("school_use_minutes"), F.col("post_bedtime_use_minutes")
    length = F.col("session_duration_minutes")
    per_day = sessions.groupBy(*DAY).agg(
        F.sum("school_use_minutes").alias("school_use_minutes"),
        F.sum("post_bedtime_use_minutes").alias("post_bedtime_use_minutes"),
    )
    joined = with_every_day(daily.select(*DAY, "has_school_today", "daily_use_minutes"), per_day)
    use = F.col("daily_use_minutes")
    return suite(
        [
            run_rules(
                sessions,
                {
                    "school_not_negative": school < 0,
                    "night_not_negative": night < 0,
                    "school_within_session": school > length + 1e-9,
                    "night_within_session": night > length + 1e-9,
                },
            ),
            run_rules(
                joined,
                {
                    "school_within_day": school > use + 1e-8,
                    "night_within_day": night > use + 1e-8,
                    "no_school_no_minutes": ~F.col("has_school_today") & (F.abs(school) > 1e-10),
                },
            ),
        ]
    )


def episodes(sessions: DataFrame, bounds: DataFrame, rows: DataFrame) -> DataFrame:
    """Episodes against their sessions; ``bounds`` is session_bounds(rows)."""
    joined = sessions.select(
        *SESSION, "session_duration_minutes", "session_start_minute", "session_end_minute"
    ).join(bounds, SESSION, "left")
    return suite(
        [
            run_rules(
                rows,
                {
                    "duration_positive": ~(F.col("episode_duration_minutes") > 0),
                    "end_after_start": ~(
                        F.col("episode_end_minute") > F.col("episode_start_minute")
                    ),
                },
            ),
            run_rules(
                joined,
                {
                    "one_episode_per_session": F.coalesce("episode_count", F.lit(0)) < 1,
                    "duration_conserved": ~_close("session_duration_minutes", "episode_minutes"),
                    "first_start_matches": ~_close("session_start_minute", "first_episode_start"),
                    "last_end_matches": ~_close("session_end_minute", "last_episode_end"),
                },
            ),
        ]
    )


def split(rows: DataFrame, everyone: DataFrame, ids: Sequence[str], strata: Sequence[str], quota: Column) -> DataFrame:
    """Checks a labelled split against the full table.

    ``rows`` holds ids, strata and split; ``quota`` gives the test rows due
    from a stratum of ``stratum_size`` rows.
    """
    sides = (
        rows.select(*ids, F.col("split"), F.lit(0).alias("__all"))
        .unionByName(everyone.select(*ids, F.lit(None).cast("string").alias("split"), F.lit(1).alias("__all")))
        .groupBy(*ids)
        .agg(
            F.count_if(F.col("split") == "development").alias("dev"),
            F.count_if(F.col("split") == "test").alias("test"),
            F.max("__all").alias("known"),
        )
    )
    strata_counts = rows.groupBy(*strata).agg(
        F.count(F.lit(1)).alias("stratum_size"),
        F.count_if(F.col("split") == "test").alias("test_rows"),
    )
    return suite(
        [
            run_rules(
                sides,
                {
                    "development_ids_unique": F.col("dev") > 1,
                    "test_ids_unique": F.col("test") > 1,
                    "parts_disjoint": (F.col("dev") > 0) & (F.col("test") > 0),
                    "union_complete": F.col("dev") + F.col("test") == 0,
                    "no_foreign_ids": F.col("known") == 0,
                },
            ),
            run_rules(strata_counts, {"stratum_counts": F.col("test_rows") != quota}),
        ]
    )


def folds(rows: DataFrame, ids: Sequence[str], strata: Sequence[str], k: int) -> DataFrame:
    """Every row validates once; folds of a stratum differ by one row at most."""
    counts = [F.count_if(F.col("fold") == f) for f in range(1, k + 1)]
    per_stratum = rows.groupBy(*strata).agg(
        (F.greatest(*counts) - F.least(*counts)).alias("spread")
    )
    overall = rows.agg((F.greatest(*counts) - F.least(*counts)).alias("spread"))
    return suite(
        [
            duplicate_check(rows, ids, "validated_once"),
            run_rules(rows, {"fold_range": ~F.coalesce(F.col("fold").between(1, k), F.lit(False))}),
            run_rules(per_stratum, {"stratum_balance": F.col("spread") > 1}),
            run_rules(overall, {"fold_balance": F.col("spread") > 1}),
        ]
    )


def _finite_rules(columns: Sequence[str], name: str) -> dict[str, Column]:
    bad = F.lit(False)
    for c in columns:
        bad = bad | ~numeric.is_finite(F.col(c))
    return {name: bad}


def features(df: DataFrame, keys: Sequence[str] = ("child_id",)) -> DataFrame:
    positive, outside = F.lit(False), F.lit(False)
    for c in POSITIVE_FEATURES:
        positive = positive | ~(F.col(c) > 0)
    for c in RATIO_FEATURES:
        outside = outside | ~F.col(c).between(0, 1)
    shares = sum((F.col(c) for c in SHARE_FEATURES[1:]), F.col(SHARE_FEATURES[0]))
    return suite(
        [
            constant(df.sparkSession, "columns_exact", int(df.columns != [*keys, *FEATURES])),
            duplicate_check(df, keys, "one_row_per_key"),
            run_rules(
                df,
                {
                    **_finite_rules(FEATURES, "finite"),
                    "metrics_positive": positive,
                    "ratios_in_unit": outside,
                    "shares_within_one": shares > 1 + 1e-10,
                },
            ),
        ]
    )


def training_table(df: DataFrame, expected: DataFrame, keys: Sequence[str] = ("child_id",)) -> DataFrame:
    """``expected`` holds the keys the table must cover, one row each."""
    columns = [*keys, *FEATURES, TARGET]
    present = df.select(*keys, F.lit(1).alias("__here"))
    uncovered = expected.select(*keys).join(present, list(keys), "left_anti")
    return suite(
        [
            constant(df.sparkSession, "columns_exact", int(df.columns != columns)),
            constant(
                df.sparkSession,
                "forbidden_columns",
                len(dataset.forbidden_columns(df.columns, keys)),
            ),
            constant(df.sparkSession, "target_not_a_feature", int(TARGET in FEATURES)),
            duplicate_check(df, keys, "one_row_per_key"),
            count_rows(uncovered, "rows_complete"),
            run_rules(df, _finite_rules([*FEATURES, TARGET], "finite")),
        ]
    )


def target(df: DataFrame, everyone: DataFrame, keys: Sequence[str] = ("child_id",)) -> DataFrame:
    low, high = TARGET_RANGE
    uncovered = everyone.select(*keys).join(df.select(*keys), list(keys), "left_anti")
    return suite(
        [
            duplicate_check(df, keys, "one_row_per_key"),
            count_rows(uncovered, "rows_complete"),
            run_rules(
                df,
                {
                    **_finite_rules(["y_star", "target_noise", TARGET], "finite"),
                    "inside_open_range": ~((F.col(TARGET) > low) & (F.col(TARGET) < high)),
                },
            ),
        ]
    )


def categories(preferences: DataFrame, rows: DataFrame) -> DataFrame:
    """``preferences`` holds category_prob_<category> per child."""
    probs = [F.col(f"category_prob_{c}") for c in APP_CATEGORIES]
    not_positive = F.lit(False)
    for p in probs:
        not_positive = not_positive | ~(p > 0)
    total = sum(probs[1:], probs[0])
    return suite(
        [
            run_rules(
                preferences,
                {
                    "preferences_positive": not_positive,
                    "preferences_sum_to_one": ~numeric.isclose(total, F.lit(1.0), 1e-10, 1e-10),
                },
            ),
            run_rules(
                rows,
                {
                    "category_present": F.col("app_category").isNull(),
                    "category_known": ~F.col("app_category").isin(APP_CATEGORIES),
                },
            ),
        ]
    )


def catalog(df: DataFrame) -> DataFrame:
    def blank(c: str) -> Column:
        return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""

    known = F.array(*[F.lit(c) for c in CONTEXTS])
    return suite(
        [
            duplicate_check(df, ["activity_id"], "ids_unique"),
            run_rules(
                df,
                {
                    "title_present": blank("title"),
                    "description_present": blank("description"),
                    "level_known": ~F.coalesce(
                        F.col("activity_level").isin(ACTIVITY_LEVELS), F.lit(False)
                    ),
                    "contexts_known": ~arrays.is_subset(F.col("allowed_contexts"), known),
                    "bedtime_suitable": F.array_contains("allowed_contexts", "bedtime")
                    & ~F.col("bedtime_suitable"),
                },
            ),
        ]
    )


def scoring_input(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Rows per reject reason, valid rows as 'ok'."""
    checked = scoring.check_input(df, ids)
    return checked.groupBy(F.coalesce("reject_reason", F.lit("ok")).alias("check")).agg(
        F.count(F.lit(1)).alias("failed_rows")
    )


def history(df: DataFrame) -> DataFrame:
    # A rule about an optional field says nothing where the field is missing.
    rules = {name: F.coalesce(c, F.lit(False)) for name, c in interventions.record_rules()}
    return run_rules(df, rules)
