"""Recommendations, intervention decisions, records and the cooldown replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from diurna.operators import joins
from diurna.plans import eventlog, interventions, recommend
from diurna.sources.catalog import ACTIVITIES, ACTIVITY_IDS, known_ids
from diurna.sources.tables import table
from workload.behaviour_sql import with_tables
from workload.registry import events, longs, query, rounded


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


CATALOG_SQL = (
    "catalog(position, activity_id, category, tags, contexts, calm_night) AS (VALUES "
    + ", ".join(
        f"({i}, '{a[0]}', '{a[3]}', {_sql_list(a[4])}, {_sql_list(a[5])}, "
        f"{str(a[7] and a[6] == 'calm').lower()})"
        for i, a in enumerate(ACTIVITIES)
    )
    + ")"
)
IDS_SQL = _sql_list(ACTIVITY_IDS)

REQUEST_SQL = f"""
req AS (
  SELECT event_id AS request_id, event_type, ts, user_id + 1 AS child_id,
         CASE WHEN event_id % 50 = 7 THEN 'night' WHEN event_id % 3 = 0 THEN 'voluntary'
              WHEN event_id % 3 = 1 THEN 'bedtime' ELSE 'general' END AS context,
         CASE event_type WHEN 'click' THEN ['games', 'toys'] WHEN 'view' THEN ['social']
              WHEN 'purchase' THEN ['drawing', 'creative'] WHEN 'signup' THEN ['reading', 'books']
              ELSE []::VARCHAR[] END AS interests,
         [({IDS_SQL})[user_id % 18 + 1], ({IDS_SQL})[(user_id + 7) % 18 + 1]] AS shown,
         CASE WHEN event_id % 20 = 3 THEN 0 WHEN event_id % 13 = 5 THEN 3
              ELSE 1 + event_id % 12 END AS n
  FROM events WHERE user_id IS NOT NULL
)
"""


def scored_sql(source: str) -> str:
    """Scored and placed candidates of requests (request_id, context, n, ...)."""
    return f"""
    cand AS (
      SELECT r.request_id, r.context, r.n, c.position, c.activity_id, c.category,
             (CASE WHEN len(list_intersect(r.interests, c.tags)) > 0 THEN 1.0::DOUBLE ELSE 0.0 END
              - CASE WHEN list_contains(r.shown, c.activity_id) THEN 2.0::DOUBLE ELSE 0.0 END)
             + CAST('0x' || substr(md5('42:' || r.request_id || ':' || c.activity_id), 1, 8) AS BIGINT)
               / 4294967296.0 * 0.25 AS score,
             count(*) OVER (PARTITION BY r.request_id) AS fit
      FROM {source} r JOIN catalog c ON list_contains(c.contexts, r.context)
           AND (r.context <> 'bedtime' OR c.calm_night)
    ),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY request_id
                  ORDER BY cr > 1, score DESC, position) AS place
      FROM (SELECT *, row_number() OVER (PARTITION BY request_id, category
                        ORDER BY score DESC, position) AS cr FROM cand)
      WHERE n > 0 AND fit >= n
    )
    """


INTERESTS = {
    "click": ["games", "Toys "],
    "view": ["social"],
    "purchase": [" Drawing", "creative", ""],
    "signup": ["reading", "  ", "BOOKS", "books"],
}


def requests(spark, sf_dir):
    """A recommendation request per event."""
    return request_rows(events(spark, sf_dir))


def request_rows(log):
    log = log.where("user_id IS NOT NULL")
    interests = F.lit(None).cast("array<string>")
    for kind, terms in INTERESTS.items():
        interests = F.when(
            F.col("event_type") == kind, F.array(*[F.lit(t) for t in terms])
        ).otherwise(interests)
    k = F.col("event_id")
    context = (
        F.when(k % 50 == 7, "night")
        .when(k % 3 == 0, "voluntary")
        .when(k % 3 == 1, "bedtime")
        .otherwise("general")
    )
    n = F.when(k % 20 == 3, 0).when(k % 13 == 5, F.lit(None)).otherwise(1 + k % 12).cast("int")
    ids = known_ids()
    return log.select(
        k.alias("request_id"),
        "event_type",
        "ts",
        (F.col("user_id") + 1).alias("child_id"),
        context.alias("context"),
        interests.alias("interests"),
        F.array(
            F.get(ids, (F.col("user_id") % 18).cast("int")),
            F.get(ids, ((F.col("user_id") + 7) % 18).cast("int")),
        ).alias("recently_shown_ids"),
        n.alias("n"),
        F.lit(42).alias("random_seed"),
    )


@query(
    "recommend_topk",
    f"""
    WITH {CATALOG_SQL}, {REQUEST_SQL}, {scored_sql('req')}
    SELECT request_id, context, place, activity_id, category, round(score, 6) AS score
    FROM placed WHERE place <= n
    """,
)
def recommend_topk(spark, sf_dir):
    rows = recommend.offered_rows(recommend.recommend(requests(spark, sf_dir)))
    return rows.select(
        *longs("request_id", "place"), "context", "activity_id", "category", *rounded("score")
    )


@query(
    "recommend_rejects",
    f"""
    WITH {CATALOG_SQL}, {REQUEST_SQL}
    SELECT request_id, reason AS reject_reason FROM (
      SELECT request_id, CASE WHEN n <= 0 THEN 'n_not_positive'
               WHEN context NOT IN ('voluntary', 'bedtime', 'general') THEN 'unknown_context'
               WHEN (SELECT count(*) FROM catalog c WHERE list_contains(c.contexts, req.context)
                     AND (req.context <> 'bedtime' OR c.calm_night)) < n THEN 'too_few_candidates'
             END AS reason FROM req)
    WHERE reason IS NOT NULL
    """,
)
def recommend_rejects(spark, sf_dir):
    return (
        recommend.recommend(requests(spark, sf_dir))
        .where("reject_reason IS NOT NULL")
        .select(*longs("request_id"), "reject_reason")
    )


@query(
    "catalog_by_category",
    f"""
    WITH {CATALOG_SQL}, {REQUEST_SQL}
    SELECT r.context, c.category, count(*) AS eligible
    FROM req r JOIN catalog c ON list_contains(c.contexts, r.context)
         AND (r.context <> 'bedtime' OR c.calm_night)
    GROUP BY r.context, c.category
    """,
)
def catalog_by_category(spark, sf_dir):
    """Catalogue entries open to the requests of each context, by category.

    Requests are counted per context first, so only a handful of rows meet
    the catalogue.
    """
    asked = requests(spark, sf_dir).groupBy("context").agg(F.count(F.lit(1)).alias("requests"))
    open_ = asked.select(
        "context",
        "requests",
        F.explode(recommend.eligible(F.col("context"))).alias("a"),
    )
    return open_.groupBy("context", F.col("a.category").alias("category")).agg(
        F.sum("requests").cast("long").alias("eligible")
    )


@query(
    "voluntary_decisions",
    f"""
    WITH {CATALOG_SQL}, {REQUEST_SQL},
    vol AS (SELECT * REPLACE ('voluntary' AS context, 3 AS n) FROM req), {scored_sql('vol')}
    SELECT request_id, true AS should_intervene, 'child_initiated' AS source,
           'voluntary' AS context, 'child_requested_activity' AS reason,
           string_agg(activity_id, ',' ORDER BY place) AS activities
    FROM placed WHERE place <= 3 GROUP BY request_id
    """,
)
def voluntary_decisions(spark, sf_dir):
    decided = interventions.voluntary_decisions(requests(spark, sf_dir))
    return decided.select(
        *longs("request_id"),
        "should_intervene",
        "source",
        "context",
        "reason",
        F.concat_ws(",", "activities").alias("activities"),
    )


BEDTIME_SQL = """
bev AS (
  SELECT p.request_id, p.child_id, p.ts, p.event_type, p.interests, p.shown,
         p.event_type <> 'error' AS device,
         date_trunc('day', p.ts)::TIMESTAMP + to_minutes((c.bed % 1440)::BIGINT) AS tonight,
         h.ts AS last
  FROM req p
  JOIN cal c ON c.child_id = p.child_id
   AND c.day_index = date_diff('day', DATE '2024-01-01', CAST(p.ts AS DATE))
  ASOF LEFT JOIN (SELECT child_id, ts FROM req WHERE event_type = 'signup') h
    ON h.child_id = p.child_id AND p.ts >= h.ts
),
ble AS (
  SELECT *, epoch_us(CASE WHEN tonight < ts THEN tonight + INTERVAL 1 DAY ELSE tonight END)
            - epoch_us(ts) AS left_us
  FROM bev
),
bre AS (
  SELECT *, CASE WHEN NOT device THEN 'device_not_in_use'
                 WHEN left_us > 3600000000 THEN 'outside_bedtime_window'
                 WHEN epoch_us(ts) - epoch_us(last) < 3600000000 THEN 'bedtime_cooldown_active'
                 ELSE 'bedtime_transition' END AS reason
  FROM ble
)
"""


def bedtime_events(spark, sf_dir, with_last=True):
    """An event row per log entry with tonight's bedtime of its child."""
    asked = requests(spark, sf_dir)
    rows = bedtime_rows(asked)
    if not with_last:
        return rows
    history = asked.where("event_type = 'signup'").select("child_id", F.col("ts").alias("shown_at"))
    return joins.as_of(
        rows, history, ["child_id"], "current_time", "shown_at", "last_bedtime_intervention"
    )


def bedtime_rows(asked):
    placed = eventlog.with_context(
        asked.drop("context", "n").withColumn("day_index", eventlog.day_of(F.col("ts")))
    )
    bed = F.col("bedtime_minute") % 1440
    return placed.select(
        "request_id",
        F.col("request_id").alias("event_id"),
        "child_id",
        "event_type",
        F.col("ts").alias("current_time"),
        F.floor(bed / 60).cast("int").alias("bedtime_hour"),
        (bed % 60).cast("int").alias("bedtime_minute"),
        (F.col("event_type") != "error").alias("device_in_use"),
        "interests",
        "recently_shown_ids",
        "random_seed",
    )


@query(
    "bedtime_decisions",
    with_tables(
        """
        SELECT b.request_id, b.child_id, b.reason, b.reason = 'bedtime_transition' AS should_intervene,
               CASE WHEN b.reason = 'bedtime_transition' THEN 'system_bedtime' END AS source,
               CASE WHEN b.reason = 'bedtime_transition' THEN 'bedtime' END AS context,
               coalesce(o.ids, '') AS activities
        FROM bre b LEFT JOIN (
          SELECT request_id, string_agg(activity_id, ',' ORDER BY place) AS ids
          FROM placed WHERE place <= 3 GROUP BY request_id) o ON o.request_id = b.request_id
        """,
        CATALOG_SQL,
        REQUEST_SQL,
        BEDTIME_SQL,
        "fired AS (SELECT *, 'bedtime' AS context, 3 AS n FROM bre WHERE reason = 'bedtime_transition')",
        scored_sql("fired"),
    ),
)
def bedtime_decisions(spark, sf_dir):
    decided = interventions.bedtime_decisions(bedtime_events(spark, sf_dir))
    return decided.select(
        *longs("request_id", "child_id"),
        "reason",
        "should_intervene",
        "source",
        "context",
        F.concat_ws(",", F.coalesce("activities", F.array())).alias("activities"),
    )


FIRE_CTES = [
    """
    open_events AS (
      SELECT request_id, child_id, ts,
             CASE WHEN NOT device THEN 'device_not_in_use'
                  WHEN left_us > 3600000000 THEN 'outside_bedtime_window'
                  ELSE 'bedtime_transition' END AS reason
      FROM ble
    ),
    cnd AS (
      SELECT child_id, ts, request_id AS eid FROM open_events
      WHERE reason = 'bedtime_transition'
    ),
    fire AS (
      SELECT child_id, arg_min(ts, (ts, eid)) AS ts, arg_min(eid, (ts, eid)) AS eid
      FROM cnd GROUP BY child_id
      UNION ALL
      SELECT f.child_id, n.ts, n.eid
      FROM fire f, LATERAL (
        SELECT c.ts, c.eid FROM cnd c
        WHERE c.child_id = f.child_id AND c.ts >= f.ts + INTERVAL 60 MINUTE
        ORDER BY c.ts, c.eid LIMIT 1) n
    )
    """,
]


@query(
    "bedtime_replay",
    with_tables(
        """
        SELECT request_id AS event_id, child_id,
               CASE WHEN reason = 'bedtime_transition' AND request_id NOT IN (SELECT eid FROM fire)
                    THEN 'bedtime_cooldown_active' ELSE reason END AS reason
        FROM open_events
        """,
        REQUEST_SQL,
        BEDTIME_SQL,
        *FIRE_CTES,
        recursive=True,
    ),
)
def bedtime_replay(spark, sf_dir):
    replayed = interventions.bedtime_replay(bedtime_events(spark, sf_dir, with_last=False))
    return replayed.select(*longs("event_id", "child_id"), "reason")


# --- response records -------------------------------------------------------

RESPONSE_SQL = f"""
resp AS (
  SELECT k AS order_id, o_custkey - 5 AS child_id,
         CASE o_orderstatus WHEN 'F' THEN 'child_initiated' WHEN 'O' THEN 'system_bedtime'
              WHEN 'P' THEN 'child_initiated' ELSE 'other' END AS source,
         CASE WHEN k % 10 = 0 THEN 'night' WHEN k % 3 = 0 THEN 'voluntary'
              WHEN k % 3 = 1 THEN 'bedtime' ELSE 'general' END AS context,
         CASE WHEN k % 17 = 0 THEN []::VARCHAR[]
              ELSE [ids[k % 18 + 1], ids[(k + 5) % 18 + 1],
                    CASE WHEN k % 19 = 0 THEN 'mystery_01' ELSE ids[(k + (k % 7) * 3) % 18 + 1] END]
         END AS offered,
         CASE WHEN k % 9 < 4 THEN 'selected' WHEN k % 9 < 6 THEN 'rejected' WHEN k % 9 = 6 THEN 'postponed'
              WHEN k % 9 = 7 THEN 'ignored' ELSE 'maybe' END AS response,
         CASE WHEN k % 9 < 4 THEN CASE WHEN k % 23 = 0 THEN NULL WHEN k % 29 = 0 THEN ids[(k + 1) % 18 + 1]
                                       ELSE ids[k % 18 + 1] END
              WHEN k % 31 = 0 THEN ids[k % 18 + 1] END AS selected,
         o_orderdate AS event_time
  FROM (SELECT *, o_orderkey AS k, {IDS_SQL} AS ids FROM orders)
)
"""
RULES_SQL = {
    "child_id_not_positive": "child_id <= 0",
    "unknown_source": "source NOT IN ('child_initiated', 'system_bedtime')",
    "unknown_context": "context NOT IN ('voluntary', 'bedtime', 'general')",
    "nothing_offered": "len(offered) = 0",
    "duplicate_offer": "len(list_distinct(offered)) < len(offered)",
    "unknown_activity": f"len(list_filter(offered, lambda x: NOT list_contains({IDS_SQL}, x))) > 0",
    "unknown_response": "response NOT IN ('selected', 'rejected', 'postponed', 'ignored')",
    "selection_missing": "response = 'selected' AND selected IS NULL",
    "selection_not_offered": "response = 'selected' AND NOT coalesce(list_contains(offered, selected), false)",
    "selection_without_selected": "response <> 'selected' AND selected IS NOT NULL",
}
FIRST_RULE_SQL = (
    "CASE " + " ".join(f"WHEN {cond} THEN '{name}'" for name, cond in RULES_SQL.items()) + " END"
)


def responses(spark, sf_dir):
    """Response rows in all shapes, one per order."""
    return response_rows(table(spark, sf_dir, "orders"))


def response_rows(orders):
    k = F.col("o_orderkey")
    ids = known_ids()

    def activity(index):
        return F.get(ids, (index % 18).cast("int"))

    offered = F.when(k % 17 == 0, F.array().cast("array<string>")).otherwise(
        F.array(
            activity(k),
            activity(k + 5),
            F.when(k % 19 == 0, F.lit("mystery_01")).otherwise(activity(k + (k % 7) * 3)),
        )
    )
    selected = (
        F.when(
            k % 9 < 4,
            F.when(k % 23 == 0, F.lit(None)).when(k % 29 == 0, activity(k + 1)).otherwise(activity(k)),
        )
        .when(k % 31 == 0, activity(k))
        .otherwise(F.lit(None))
    )
    return orders.select(
        k.alias("order_id"),
        (F.col("o_custkey") - 5).alias("child_id"),
        F.when(F.col("o_orderstatus").isin("F", "P"), "child_initiated")
        .when(F.col("o_orderstatus") == "O", "system_bedtime")
        .otherwise("other")
        .alias("source"),
        F.when(k % 10 == 0, "night")
        .when(k % 3 == 0, "voluntary")
        .when(k % 3 == 1, "bedtime")
        .otherwise("general")
        .alias("context"),
        offered.alias("activities_offered"),
        F.when(k % 9 < 4, "selected")
        .when(k % 9 < 6, "rejected")
        .when(k % 9 == 6, "postponed")
        .when(k % 9 == 7, "ignored")
        .otherwise("maybe")
        .alias("response"),
        selected.alias("selected_activity_id"),
        F.col("o_orderdate").alias("event_time"),
    )


@query(
    "history_records",
    f"""
    WITH {RESPONSE_SQL}
    SELECT sha256(concat_ws('|', child_id::VARCHAR, t, source, context, array_to_string(offered, ','),
                            response, coalesce(selected, ''))) AS intervention_id,
           child_id, t AS timestamp, source, context, array_to_string(offered, ',') AS activities_offered,
           response, selected AS selected_activity_id
    FROM (SELECT *, strftime(event_time, '%Y-%m-%dT%H:%M:%S') AS t FROM resp)
    WHERE {FIRST_RULE_SQL} IS NULL
    """,
)
def history_records(spark, sf_dir):
    built = interventions.build_records(responses(spark, sf_dir))
    return built.withColumn("activities_offered", F.concat_ws(",", "activities_offered")).select(
        *longs("child_id"), *[c for c in built.columns if c != "child_id"]
    )


@query(
    "history_rejects",
    f"""
    WITH {RESPONSE_SQL}
    SELECT order_id, {FIRST_RULE_SQL} AS reject_reason FROM resp WHERE {FIRST_RULE_SQL} IS NOT NULL
    """,
)
def history_rejects(spark, sf_dir):
    checked = interventions.checked_records(responses(spark, sf_dir))
    return checked.where("reject_reason IS NOT NULL").select(*longs("order_id"), "reject_reason")


@query(
    "register_responses",
    with_tables(
        """
        SELECT decision_id, child_id, source, context, activities_offered, response,
               selected AS selected_activity_id,
               CASE WHEN NOT should THEN 'no_intervention'
                    WHEN response NOT IN ('selected', 'rejected', 'postponed', 'ignored')
                      THEN 'unknown_response'
                    WHEN response = 'selected' AND NOT list_contains(string_split(activities_offered, ','), selected)
                      THEN 'selection_not_offered' END AS reject_reason
        FROM (
          SELECT d.request_id AS decision_id, d.child_id, d.should,
                 CASE WHEN d.should THEN d.source END AS source,
                 CASE WHEN d.should THEN d.context END AS context,
                 coalesce(o.ids, '') AS activities_offered,
                 ['selected', 'rejected', 'postponed', 'ignored', 'maybe'][d.request_id % 5 + 1] AS response,
                 CASE WHEN d.request_id % 5 = 0 THEN ids_all[d.child_id % 18 + 1] END AS selected
          FROM deci d LEFT JOIN (
            SELECT request_id, string_agg(activity_id, ',' ORDER BY place) AS ids
            FROM placed WHERE place <= 3 GROUP BY request_id) o ON o.request_id = d.request_id,
            (SELECT """
        + IDS_SQL
        + """ AS ids_all))
        """,
        CATALOG_SQL,
        REQUEST_SQL,
        BEDTIME_SQL,
        """
        deci AS (
          SELECT request_id, child_id, interests, shown, 3 AS n,
                 event_type = 'click' OR reason = 'bedtime_transition' AS should,
                 CASE WHEN event_type = 'click' THEN 'child_initiated' ELSE 'system_bedtime' END AS source,
                 CASE WHEN event_type = 'click' THEN 'voluntary' ELSE 'bedtime' END AS context
          FROM bre
        )""",
        "fired AS (SELECT * FROM deci WHERE should)",
        scored_sql("fired"),
    ),
)
def register_responses(spark, sf_dir):
    """Clicks are voluntary requests, everything else a bedtime evaluation."""
    keep = ["request_id", "child_id", "should_intervene", "source", "context", "activities"]
    asked = requests(spark, sf_dir).where("event_type = 'click'")
    voluntary = interventions.voluntary_decisions(asked).select(*keep)
    nightly = interventions.bedtime_decisions(
        bedtime_events(spark, sf_dir).where("event_type <> 'click'")
    ).select(*keep)
    decisions = voluntary.unionByName(nightly).withColumnRenamed("request_id", "decision_id")
    k = F.col("event_id")
    kinds = F.array(*[F.lit(r) for r in ("selected", "rejected", "postponed", "ignored", "maybe")])
    answers = events(spark, sf_dir).where("user_id IS NOT NULL").select(
        k.alias("decision_id"),
        (F.col("user_id") + 1).alias("child_id"),
        F.get(kinds, (k % 5).cast("int")).alias("response"),
        F.when(k % 5 == 0, F.get(known_ids(), ((F.col("user_id") + 1) % 18).cast("int"))).alias(
            "selected_activity_id"
        ),
    )
    registered = interventions.register_responses(decisions.drop("child_id"), answers)
    return registered.select(
        *longs("decision_id", "child_id"),
        "source",
        "context",
        F.concat_ws(",", F.coalesce("activities_offered", F.array())).alias("activities_offered"),
        "response",
        "selected_activity_id",
        "reject_reason",
    )
