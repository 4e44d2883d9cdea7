"""DuckDB common table expressions that mirror the event-log adapter.

``with_tables(body)`` puts the whole chain in front of a query; DuckDB drops
what the query does not use.
"""

from __future__ import annotations

CHAIN = """
ep AS (
  SELECT event_id, user_id + 1 AS child_id,
         date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day_index,
         CAST(hour(ts) * 60 + minute(ts) AS DOUBLE) AS s,
         least(CAST(hour(ts) * 60 + minute(ts) AS DOUBLE) + value, 1440.0) AS e,
         CASE event_type WHEN 'click' THEN 'games' WHEN 'view' THEN 'social'
              WHEN 'purchase' THEN 'entertainment' WHEN 'signup' THEN 'education'
              WHEN 'error' THEN 'other' END AS cat
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value > 0 AND NOT isnan(value)
),
ep_seq AS (
  SELECT *, e - s AS dur,
         max(e) OVER (PARTITION BY child_id, day_index ORDER BY s, event_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached
  FROM ep
),
ept AS (
  SELECT *, sum(CASE WHEN reached IS NULL OR s > reached + 30 THEN 1 ELSE 0 END)
         OVER (PARTITION BY child_id, day_index ORDER BY s, event_id
               ROWS UNBOUNDED PRECEDING) AS session_index
  FROM ep_seq
),
sess0 AS (
  SELECT child_id, day_index, session_index, min(s) AS ss, max(e) AS se,
         max(e) - min(s) AS dur, count(*) AS openings
  FROM ept GROUP BY ALL
),
kids AS (
  SELECT DISTINCT user_id + 1 AS child_id, user_id AS u FROM events WHERE user_id IS NOT NULL
),
prof AS (
  SELECT child_id, CAST(6 + u % 7 AS INTEGER) AS age, (6 + u % 7 - 9) / 2.0 AS age_scaled,
         ((u * 37) % 101 - 50) / 25.0 AS "S", ((u * 53) % 101 - 50) / 25.0 AS "B",
         ((u * 71) % 101 - 50) / 25.0 AS "F", ((u * 89) % 101 - 50) / 25.0 AS "U",
         CASE u % 3 WHEN 0 THEN 'morning' WHEN 1 THEN 'afternoon' ELSE 'full_day' END AS school_mode,
         CASE u % 3 WHEN 0 THEN 480 WHEN 1 THEN 780 ELSE 495 END + (u * 7) % 31 - 15 AS sch_s,
         CASE u % 3 WHEN 0 THEN 735 WHEN 1 THEN 1035 ELSE 980 END + (u * 7) % 31 - 15 AS sch_e,
         (u * 7) % 31 - 15 AS shift,
         1290 + (u * 13) % 106 AS bed_s, 1290 + (u * 13) % 106 + (u * 17) % 76 AS bed_n,
         (u * 17) % 76 AS delay
  FROM kids
),
cal AS (
  SELECT p.child_id, p."S", p.school_mode, d.day_index, d.wd,
         d.wd < 5 AS school_today, (d.wd + 1) % 7 < 5 AS school_next,
         CASE WHEN d.wd < 5 THEN sch_s END AS ss_min,
         CASE WHEN d.wd < 5 THEN sch_e END AS se_min,
         CASE WHEN (d.wd + 1) % 7 < 5 THEN bed_s ELSE bed_n END AS bed,
         CASE WHEN d.wd < 5 THEN bed_s ELSE bed_n END AS prev_bed,
         CASE WHEN d.wd >= 5 THEN 555 WHEN school_mode = 'afternoon' THEN 495
              ELSE sch_s - 75 END AS day_start
  FROM prof p, (
    SELECT day_index, ((day_index % 7) + 7) % 7 AS wd FROM (
      SELECT unnest(range(min(d), max(d) + 1)) AS day_index FROM (
        SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d
        FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL))) d
),
edge AS (
  SELECT child_id, day_index, unnest(list_sort(list_distinct(list_filter([
           0.0, day_start, 1440.0,
           CASE WHEN bed - 120 > 0 AND bed - 120 < 1440 THEN bed - 120 END,
           CASE WHEN bed > 0 AND bed < 1440 THEN bed END,
           CASE WHEN prev_bed > 1440 THEN prev_bed - 1440 END,
           CASE WHEN school_today THEN ss_min ELSE 720 END,
           se_min]::DOUBLE[], lambda x: x IS NOT NULL)))) AS a
  FROM cal
),
seg AS (
  SELECT *, (a + b) / 2 AS m FROM (
    SELECT child_id, day_index, a,
           lead(a) OVER (PARTITION BY child_id, day_index ORDER BY a) AS b FROM edge)
  WHERE b IS NOT NULL
),
lab AS (
  SELECT seg.*, c."S",
         CASE WHEN prev_bed > 1440 AND m < prev_bed - 1440 THEN 'pre_bedtime'
              WHEN m < day_start THEN 'post_bedtime_overnight'
              WHEN m >= bed - 120 AND (bed > 1440 OR m < bed) THEN 'pre_bedtime'
              WHEN bed <= 1440 AND m >= bed THEN 'post_bedtime_overnight'
              WHEN school_today AND m >= ss_min AND m < se_min THEN 'school'
              WHEN school_today AND m < ss_min THEN 'morning_free'
              WHEN school_today THEN 'daytime_free'
              WHEN m < 720 THEN 'morning_free' ELSE 'daytime_free' END AS name
  FROM seg JOIN cal c USING (child_id, day_index)
),
isl AS (
  SELECT *, sum(CASE WHEN name = pn THEN 0 ELSE 1 END)
            OVER (PARTITION BY child_id, day_index ORDER BY a) AS k
  FROM (SELECT *, lag(name) OVER (PARTITION BY child_id, day_index ORDER BY a) AS pn FROM lab)
),
win AS (
  SELECT child_id, day_index, k, any_value(name) AS name, any_value("S") AS "S",
         min(a) AS ws, max(b) AS we,
         CASE any_value(name) WHEN 'morning_free' THEN 1.0 WHEN 'school' THEN 0.2
              WHEN 'daytime_free' THEN 1.4 WHEN 'pre_bedtime' THEN 1.2
              ELSE 0.15 * exp(0.1 * any_value("S")) END AS w
  FROM isl GROUP BY child_id, day_index, k
),
sess AS (
  SELECT s.child_id, s.day_index, s.session_index, any_value(ss) AS ss, any_value(se) AS se,
         any_value(dur) AS dur, any_value(openings) AS openings,
         sum(CASE WHEN name = 'school' THEN greatest(0.0, least(se, we) - greatest(ss, ws))
             ELSE 0 END) AS school,
         sum(CASE WHEN name = 'post_bedtime_overnight'
             THEN greatest(0.0, least(se, we) - greatest(ss, ws)) ELSE 0 END) AS night
  FROM sess0 s JOIN win USING (child_id, day_index)
  GROUP BY s.child_id, s.day_index, s.session_index
),
day AS (
  SELECT child_id, day_index, CAST(floor(day_index / 7) AS INTEGER) AS week_index,
         sum(dur) AS use, count(*) AS n
  FROM sess0 GROUP BY ALL
),
opens AS (SELECT child_id, day_index, count(*) AS n_open FROM ep GROUP BY ALL),
daym AS (
  SELECT child_id, week_index, avg(use) AS mean_daily_use_minutes,
         avg(n) AS mean_daily_session_count, avg(coalesce(n_open, 0)) AS mean_daily_app_openings,
         sum(use) AS week_use
  FROM day LEFT JOIN opens USING (child_id, day_index) GROUP BY child_id, week_index
),
wsess AS (
  SELECT child_id, CAST(floor(day_index / 7) AS INTEGER) AS week_index,
         quantile_cont(dur, 0.5) AS median_session_duration,
         sum(school) AS school, sum(night) AS night
  FROM sess GROUP BY ALL
),
wcat AS (
  SELECT child_id, CAST(floor(day_index / 7) AS INTEGER) AS week_index,
         coalesce(sum(dur) FILTER (cat = 'games'), 0) AS games,
         coalesce(sum(dur) FILTER (cat = 'social'), 0) AS social,
         coalesce(sum(dur) FILTER (cat = 'entertainment'), 0) AS entertainment,
         coalesce(sum(dur) FILTER (cat = 'education'), 0) AS education,
         coalesce(sum(dur) FILTER (cat = 'other'), 0) AS other
  FROM ept GROUP BY ALL
),
wcat_t AS (SELECT *, nullif(games + social + entertainment + education + other, 0) AS tot FROM wcat),
feat AS (
  SELECT child_id, week_index, age_scaled, mean_daily_use_minutes, mean_daily_session_count,
         median_session_duration, mean_daily_app_openings,
         night / nullif(week_use, 0) AS post_bedtime_use_ratio,
         school / nullif(week_use, 0) AS school_use_ratio,
         games / tot AS games_share, social / tot AS social_share,
         entertainment / tot AS entertainment_share, education / tot AS education_share
  FROM daym JOIN wsess USING (child_id, week_index) JOIN wcat_t USING (child_id, week_index)
       JOIN prof USING (child_id)
),
tgt AS (
  SELECT child_id, week_index, noise AS target_noise, y_star,
         1 + 4 / (1 + exp(-y_star)) AS y
  FROM (SELECT *, 0.02 * (mean_daily_use_minutes - 120) + 0.3 * age_scaled + noise AS y_star
        FROM (SELECT *, (CAST('0x' || substr(md5('target:' || child_id || ':' || week_index), 1, 8)
                         AS BIGINT) / 4294967296.0 - 0.5) * 0.5 AS noise FROM feat))
)
"""

FEATURES = [
    "age_scaled",
    "mean_daily_use_minutes",
    "mean_daily_session_count",
    "median_session_duration",
    "mean_daily_app_openings",
    "post_bedtime_use_ratio",
    "school_use_ratio",
    "games_share",
    "social_share",
    "entertainment_share",
    "education_share",
]


def with_tables(body: str, *extra: str, recursive: bool = False) -> str:
    """WITH <chain>, <extra CTEs> <body>."""
    parts = [CHAIN.strip(), *[e.strip() for e in extra]]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body.strip()


def r6(*columns: str, prefix: str = "") -> str:
    """Rounded select list."""
    return ", ".join(f'round({prefix}"{c}", 6) AS "{c}"' for c in columns)
