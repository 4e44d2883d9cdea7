"""Joins, lookups, sets, sampling and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from diurna.functions import clock, numeric
from diurna.operators import aggregates, joins, sampling, sets
from diurna.plans import eventlog
from diurna.schemas import (
    EPISODE_RATE_PREDICTOR,
    SESSION_COUNT_PREDICTOR,
    SPLIT_SEED,
    TEST_PER_STRATUM,
    TRAIN_FRACTIONS,
    USE_TIME_PREDICTOR,
)
from diurna.session import written_table
from diurna.sources.tables import table
from workload.behaviour_sql import with_tables
from workload.registry import events, longs, query, rounded


@query(
    "validated_join",
    """
    SELECT o_orderkey, o_custkey, c_mktsegment, line_count, round(line_total, 6) AS line_total
    FROM orders JOIN customer ON c_custkey = o_custkey
    JOIN (SELECT l_orderkey, count(*) AS line_count, sum(l_extendedprice) AS line_total
          FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
    """,
)
def validated_join(spark, sf_dir):
    """Orders to their one customer (many to one) and line totals (one to one)."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_mktsegment"
    )
    totals = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.count(F.lit(1)).alias("line_count"), F.sum("l_extendedprice").alias("line_total")
        )
    )
    joined = joins.validated_join(orders, customers, ["o_custkey"], validate="many_to_one")
    joined = joins.validated_join(joined, totals, ["o_orderkey"], validate="one_to_one")
    return joined.select(
        *longs("o_orderkey", "o_custkey", "line_count"), "c_mktsegment", *rounded("line_total")
    )


@query(
    "lookup_join",
    """
    SELECT c_custkey, c_mktsegment, n_name, r_name
    FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
                  LEFT JOIN region ON r_regionkey = n_regionkey
    """,
)
def lookup_join(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    nations = table(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    found = joins.lookup(customers, nations, ["n_nationkey"], ["n_name", "r_regionkey"])
    found = joins.lookup(found, table(spark, sf_dir, "region"), ["r_regionkey"], ["r_name"])
    return found.select(*longs("c_custkey"), "c_mktsegment", "n_name", "r_name")


@query(
    "complete_lookup",
    """
    SELECT o_orderkey, round(c_acctbal, 6) AS c_acctbal
    FROM orders JOIN customer ON c_custkey = o_custkey
    """,
)
def complete_lookup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("c_custkey")
    )
    found = joins.complete_lookup(
        orders, table(spark, sf_dir, "customer"), ["c_custkey"], ["c_acctbal"]
    )
    return found.select(*longs("o_orderkey"), *rounded("c_acctbal"))


@query(
    "first_per_key",
    """
    SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order,
           round(arg_min(o_totalprice, (o_orderdate, o_orderkey)), 6) AS first_total
    FROM orders GROUP BY o_custkey
    """,
)
def first_per_key(spark, sf_dir):
    first = joins.first_per_key(
        table(spark, sf_dir, "orders"),
        ["o_custkey"],
        ["o_orderdate", "o_orderkey"],
        ["o_orderkey", "o_totalprice"],
    )
    return first.select(
        *longs("o_custkey"),
        F.col("o_orderkey").cast("long").alias("first_order"),
        numeric.r6(F.col("o_totalprice")).alias("first_total"),
    )


@query(
    "asof_last_intervention",
    """
    SELECT p.event_id, p.user_id + 1 AS child_id,
           strftime(h.ts, '%Y-%m-%d %H:%M:%S.%f') AS last_intervention,
           h.event_id AS last_event_id
    FROM events p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') h
      ON p.user_id = h.user_id AND p.ts >= h.ts
    """,
)
def asof_last_intervention(spark, sf_dir):
    """Latest earlier sign-up event of the same child for every event."""
    log = events(spark, sf_dir).select(
        "event_id", (F.col("user_id") + 1).alias("child_id"), "ts", "event_type"
    )
    history = log.where("event_type = 'signup'").select(
        "child_id", F.col("ts").alias("shown_at"), F.col("event_id").alias("last_event_id")
    )
    found = joins.as_of(
        log.drop("event_type"), history, ["child_id"], "ts", "shown_at", "last_intervention",
        ["last_event_id"],
    )
    return found.select(
        *longs("event_id", "child_id", "last_event_id"),
        F.date_format("last_intervention", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_intervention"),
    )


@query(
    "membership",
    """
    SELECT o_orderkey, 'member' AS side FROM orders
    WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
    UNION ALL
    SELECT o_orderkey, 'other' FROM orders
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
    """,
)
def membership(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    members = (
        table(spark, sf_dir, "customer")
        .where("c_acctbal > 0")
        .select(F.col("c_custkey").alias("o_custkey"))
    )
    inside = joins.by_membership(orders, members, ["o_custkey"])
    outside = orders.join(members, ["o_custkey"], "left_anti")
    return inside.select(*longs("o_orderkey"), F.lit("member").alias("side")).unionByName(
        outside.select(*longs("o_orderkey"), F.lit("other").alias("side"))
    )


@query(
    "unknown_ids",
    """
    SELECT DISTINCT l_partkey AS part_id FROM lineitem
    WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)
    """,
)
def unknown_ids(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part_id"))
    known = table(spark, sf_dir, "part").where("p_size > 25").select(
        F.col("p_partkey").alias("part_id")
    )
    return joins.unknown_keys(used, known, "part_id").select(*longs("part_id"))


@query(
    "set_operations",
    """
    WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'),
         b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error')
    SELECT 'both' AS part, count(*) AS ids FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
    UNION ALL SELECT 'only_a', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
    UNION ALL SELECT 'only_b', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
    UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)
    """,
)
def set_operations(spark, sf_dir):
    log = events(spark, sf_dir)
    a = log.where("event_type = 'purchase'").select("user_id")
    b = log.where("event_type = 'error'").select("user_id")
    return sets.overlap_counts(a, b, "user_id").select("part", *longs("ids"))


@query(
    "union_results",
    """
    SELECT 'customer' AS source, c_nationkey::BIGINT AS nationkey, count(*) AS rows,
           round(avg(c_acctbal), 6) AS mean_balance FROM customer GROUP BY c_nationkey
    UNION ALL
    SELECT 'supplier', s_nationkey::BIGINT, count(*), round(avg(s_acctbal), 6)
    FROM supplier GROUP BY s_nationkey
    """,
)
def union_results(spark, sf_dir):
    def part(name, prefix):
        return (
            table(spark, sf_dir, name)
            .groupBy(F.col(f"{prefix}_nationkey").cast("long").alias("nationkey"))
            .agg(
                F.count(F.lit(1)).alias("rows"),
                F.round(F.avg(f"{prefix}_acctbal"), 6).alias("mean_balance"),
            )
            .withColumn("source", F.lit(name))
        )

    return sets.concat([part("customer", "c"), part("supplier", "s")])


RANK = """
ranked AS (
  SELECT o_orderkey, o_orderpriority,
         row_number() OVER (PARTITION BY o_orderpriority
           ORDER BY md5('42:' || o_orderkey), o_orderkey) AS r
  FROM orders
),
offs AS (
  SELECT o_orderpriority, coalesce(sum(n) OVER (ORDER BY o_orderpriority
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
),
folded AS (
  SELECT o_orderkey, o_orderpriority, CAST((off + r - 1) % 5 + 1 AS BIGINT) AS fold
  FROM ranked JOIN offs USING (o_orderpriority)
)
"""


@query(
    "stratified_split",
    f"""
    WITH {RANK}
    SELECT o_orderkey, o_orderpriority,
           CASE WHEN r <= 40 THEN 'test' ELSE 'development' END AS split FROM ranked
    """,
)
def stratified_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.stratified_split(
        orders, ["o_orderpriority"], ["o_orderkey"], SPLIT_SEED, test_rows=TEST_PER_STRATUM
    ).select(*longs("o_orderkey"), "o_orderpriority", "split")


def order_folds(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.stratified_folds(orders, ["o_orderpriority"], ["o_orderkey"], 5, 42)


@query("stratified_kfold", f"WITH {RANK} SELECT * FROM folded")
def stratified_kfold(spark, sf_dir):
    return order_folds(spark, sf_dir).select(*longs("o_orderkey", "fold"), "o_orderpriority")


@query(
    "fraction_subsample",
    f"""
    WITH {RANK},
    copies AS (
      SELECT f.*, v.vf, t.frac FROM folded f, (SELECT unnest([1,2,3,4,5])::BIGINT AS vf) v,
             (SELECT unnest([0.25, 0.5, 0.75, 1.0])::DOUBLE AS frac) t WHERE f.fold <> v.vf
    )
    SELECT o_orderkey, o_orderpriority, vf AS validation_fold, frac AS train_fraction
    FROM (SELECT *, count(*) OVER (PARTITION BY vf, frac, o_orderpriority) AS n,
                 row_number() OVER (PARTITION BY vf, frac, o_orderpriority ORDER BY
                   md5('42:' || vf || ':' || CAST(round(frac * 100) AS INTEGER) || ':' || o_orderkey),
                   o_orderkey) AS r FROM copies)
    WHERE r <= floor(n * frac)
    """,
)
def fraction_subsample(spark, sf_dir):
    folded = written_table(order_folds(spark, sf_dir), "folded")
    chosen = sampling.fraction_subsamples(
        folded, ["o_orderpriority"], ["o_orderkey"], TRAIN_FRACTIONS, 5, 42
    )
    return chosen.select(
        *longs("o_orderkey", "validation_fold"), "o_orderpriority", "train_fraction"
    )


@query(
    "clock_functions",
    with_tables(
        """
        SELECT event_id, printf('%02d:%02d', s::BIGINT // 60, s::BIGINT % 60) AS clock,
               s::BIGINT AS back,
               CASE WHEN t >= 0 AND t // 1440 > 0
                 THEN printf('%02d:%02d (+%dd)', (t % 1440) // 60, t % 60, t // 1440)
                 ELSE printf('%02d:%02d', (((t % 1440) + 1440) % 1440) // 60, ((t % 60) + 60) % 60)
               END AS shifted
        FROM (SELECT event_id, s, trunc(s + dur * 20 - 60)::BIGINT AS t
              FROM (SELECT event_id, s, e - s AS dur FROM ep))
        """
    ),
)
def clock_functions(spark, sf_dir):
    eps = eventlog.episodes(events(spark, sf_dir))
    start = F.col("episode_start_minute")
    shifted = start + F.col("episode_duration_minutes") * 20 - 60
    return eps.select(
        *longs("event_id"),
        clock.minutes_to_clock(start).alias("clock"),
        clock.clock_to_minutes(clock.minutes_to_clock(start)).cast("long").alias("back"),
        clock.minutes_to_clock(shifted).alias("shifted"),
    )


@query(
    "minutes_until",
    """
    SELECT event_id, round(CASE WHEN target < ts
             THEN epoch_us(target + INTERVAL 1 DAY) - epoch_us(ts)
             ELSE epoch_us(target) - epoch_us(ts) END / 1000000.0, 6) AS seconds_left
    FROM (SELECT event_id, ts, date_trunc('day', ts)::TIMESTAMP
            + to_minutes(1290 + (user_id * 13) % 106) AS target FROM events
          WHERE user_id IS NOT NULL)
    """,
)
def minutes_until(spark, sf_dir):
    log = eventlog.with_profile(
        events(spark, sf_dir)
        .where("user_id IS NOT NULL")
        .select("event_id", "ts", (F.col("user_id") + 1).alias("child_id"))
    )
    bed = F.col("bedtime_school_minute")
    left = clock.minutes_until(F.col("ts"), F.floor(bed / 60), bed % 60)
    return log.select(*longs("event_id"), F.round(left * 60, 6).alias("seconds_left"))


@query(
    "logistic_score",
    """
    SELECT l_orderkey, l_partkey, l_linenumber::BIGINT AS l_linenumber,
           round(1 + 4 / (1 + exp(-((l_quantity - 25) / 10 - 8 * l_discount))), 6) AS score
    FROM lineitem
    """,
)
def logistic_score(spark, sf_dir):
    x = (F.col("l_quantity") - 25) / 10 - 8 * F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select(
        *longs("l_orderkey", "l_partkey", "l_linenumber"),
        F.round(numeric.logistic_range(x, 1.0, 5.0), 6).alias("score"),
    )


@query(
    "linear_predictor",
    with_tables(
        """
        SELECT child_id,
               round(exp(ln(155.0) + 0.35 * (0.529 * "B" + 0.353 * "S" + 0.118 * age_scaled)), 6)
                 AS expected_use,
               round(exp(ln(24.0) + 0.4 * (0.5625 * "F" + 0.25 * "B" + 0.1875 * "S")), 6)
                 AS expected_sessions,
               round(exp(-ln(6.0) + 0.3 * "F"), 6) AS episode_rate
        FROM prof
        """
    ),
)
def linear_predictor(spark, sf_dir):
    return eventlog.population(events(spark, sf_dir)).select(
        *longs("child_id"),
        F.round(numeric.log_linear_mean(**USE_TIME_PREDICTOR), 6).alias("expected_use"),
        F.round(numeric.log_linear_mean(**SESSION_COUNT_PREDICTOR), 6).alias("expected_sessions"),
        F.round(numeric.log_linear_mean(**EPISODE_RATE_PREDICTOR), 6).alias("episode_rate"),
    )


@query(
    "category_frequency",
    with_tables(
        """
        SELECT cat AS app_category, count(*) AS rows,
               round(count(*) / sum(count(*)) OVER (), 6) AS share
        FROM ep GROUP BY cat
        """
    ),
)
def category_frequency(spark, sf_dir):
    eps = eventlog.episodes(events(spark, sf_dir))
    return aggregates.frequencies(eps, "app_category").select(
        "app_category", *longs("rows"), *rounded("share")
    )
