"""Sources, sinks and artifacts as round trips of the given tables."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from diurna.operators import intervals, scans, sessions, spans
from diurna.plans import dataset, eventlog, modeling, study, weekly
from diurna.schemas import FEATURES, TARGET, WINDOW_WEIGHTS
from diurna.session import scratch_path, written_table
from diurna.sources import artifacts, files
from diurna.sources.tables import table
from workload.behaviour_sql import with_tables
from workload.models import DATASET_CTES, IDS
from workload.registry import events, longs, query, rounded

LABELS = list(WINDOW_WEIGHTS)


@query(
    "csv_round_trip",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
)
def csv_round_trip(spark, sf_dir):
    """A table written as headered CSV and read back under its schema."""
    rows = table(spark, sf_dir, "orders").select(
        *longs("o_orderkey", "o_custkey"), "o_orderstatus", "o_totalprice", "o_orderpriority"
    )
    path = scratch_path(spark, "csv")
    files.write_csv(rows, path)
    return files.read_csv(spark, path, rows.schema)


@query(
    "csv_discovery",
    "SELECT 'nations.csv' AS found, n_regionkey::BIGINT AS n_regionkey, count(*) AS nations "
    "FROM nation GROUP BY ALL",
)
def csv_discovery(spark, sf_dir):
    """Among three CSV tables the one with the wanted columns is found by its header."""
    folder = scratch_path(spark, "csv-folder")
    for name, source in (("a-regions", "region"), ("nations", "nation"), ("suppliers", "supplier")):
        files.write_csv(table(spark, sf_dir, source), f"{folder}/{name}.csv")
    path = files.discover_csv(spark, folder, ["n_nationkey", "n_regionkey"])
    return (
        files.read_csv(spark, path)
        .groupBy(F.col("n_regionkey").cast("long").alias("n_regionkey"))
        .agg(F.count(F.lit(1)).alias("nations"))
        .withColumn("found", F.lit(path.rstrip("/").rsplit("/", 1)[-1]))
    )


def labelled(spark, sf_dir):
    features = written_table(weekly.from_events(events(spark, sf_dir)), "features")
    return written_table(
        dataset.assemble(features, eventlog.target_rows(features), IDS), "dataset"
    )


@query(
    "x_y_projection",
    with_tables(
        "SELECT "
        + ", ".join(f'round("{c}", 6) AS "{c}"' for c in FEATURES)
        + f', NULL::DOUBLE AS "{TARGET}" FROM ds UNION ALL SELECT '
        + ", ".join(f'NULL AS "{c}"' for c in FEATURES)
        + f', round("{TARGET}", 6) FROM ds',
        *DATASET_CTES,
    ),
)
def x_y_projection(spark, sf_dir):
    """Features and target apart, the id in neither."""
    x, y = dataset.split_x_y(labelled(spark, sf_dir))
    return x.select(*rounded(*FEATURES)).unionByName(
        y.select(*rounded(TARGET)), allowMissingColumns=True
    )


@query(
    "linear_artifact",
    with_tables(
        "SELECT child_id, CAST(week_index AS BIGINT) AS week_index, 0.0::DOUBLE AS gap FROM ds",
        *DATASET_CTES,
    ),
)
def linear_artifact(spark, sf_dir):
    """Linear model saved, checked, loaded; both score every row alike."""
    development = written_table(study.development_rows(events(spark, sf_dir)), "development")
    model = artifacts.linear_model(modeling.final_fit(development), development.count())
    path = scratch_path(spark, "linear-artifact")
    rows = labelled(spark, sf_dir)
    artifacts.save_linear(spark, model, path)
    artifacts.verify_saved(spark, model, path, rows)
    loaded = artifacts.load_linear(spark, path)
    gap = F.round(F.abs(loaded.prediction() - model.prediction()), 12).alias("gap")
    return rows.select(*longs(*IDS), gap)


@query(
    "estimator_artifact",
    with_tables(
        "SELECT child_id, CAST(week_index AS BIGINT) AS week_index, 0.0::DOUBLE AS gap FROM ds",
        *DATASET_CTES,
    ),
)
def estimator_artifact(spark, sf_dir):
    """A fitted estimator saved with its contract, loaded by the contract's type."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(
        labelled(spark, sf_dir).withColumnRenamed(TARGET, "y")
    )
    fitted = LinearRegression(featuresCol="x", labelCol="y", solver="normal").fit(rows)
    path = scratch_path(spark, "estimator-artifact")
    artifacts.save_estimator(spark, fitted, path, "LinearRegressionModel")
    artifacts.verify_saved_estimator(spark, fitted, path, rows)
    _, loaded = artifacts.load_estimator(spark, path)
    ours = fitted.transform(rows).withColumnRenamed("prediction", "ours").select(*IDS, "x", "ours")
    gap = F.round(F.abs(F.col("prediction") - F.col("ours")), 12).alias("gap")
    return loaded.transform(ours).select(*longs(*IDS), gap)


@query(
    "longest_first",
    with_tables(
        """
        SELECT child_id, day_index, session_index::BIGINT AS session_index,
               row_number() OVER (PARTITION BY child_id, day_index
                                  ORDER BY dur DESC, session_index) AS place
        FROM sess0
        """
    ),
)
def longest_first(spark, sf_dir):
    """Sessions of a day from the longest to the shortest."""
    bare = sessions.session_table(eventlog.numbered_starts(events(spark, sf_dir)))
    length = F.col("session_duration_minutes")
    placed = scans.running_index(
        bare, ["child_id", "day_index"], -F.ceil(length), [length.desc(), "session_index"], "place"
    )
    return placed.select(*longs("child_id", "day_index", "session_index", "place"))


@query(
    "overlap_by_label",
    with_tables(
        "SELECT s.child_id, s.day_index, s.session_index::BIGINT AS session_index, "
        + ", ".join(
            f"round(sum(CASE WHEN name = '{label}' THEN greatest(0.0, least(se, we) "
            f"- greatest(ss, ws)) ELSE 0 END), 6) AS {label}_minutes"
            for label in LABELS
        )
        + " FROM sess0 s JOIN win USING (child_id, day_index) "
        "GROUP BY s.child_id, s.day_index, s.session_index"
    ),
)
def overlap_by_label(spark, sf_dir):
    """Minutes of each session in each kind of window, all five labels."""
    bare = sessions.session_table(eventlog.numbered_starts(events(spark, sf_dir)))
    found = intervals.label_minutes(eventlog.with_context(bare), LABELS)
    return found.select(
        *longs("child_id", "day_index", "session_index"),
        *rounded(*[f"{label}_minutes" for label in LABELS]),
    )


@query(
    "overlap_window_table",
    with_tables(
        """
        SELECT event_id, count(*)::BIGINT AS spans, """
        + ", ".join(
            f"round(sum({label}_minutes), 6) AS {label}_minutes" for label in LABELS
        )
        + " FROM (SELECT s.event_id, a, b, "
        + ", ".join(
            f"coalesce(sum(CASE WHEN name = '{label}' THEN least(b, d) - greatest(a, c) END), 0) "
            f"AS {label}_minutes"
            for label in LABELS
        )
        + """
        FROM whole s LEFT JOIN laid w ON s.child_id = w.child_id AND a < d AND c < b
        GROUP BY s.event_id, s.child_id, a, b) GROUP BY event_id
        """,
        """
        whole AS (
          SELECT event_id, child_id, day_index * 1440.0::DOUBLE + s AS a,
                 day_index * 1440.0::DOUBLE + s + value AS b
          FROM ep JOIN (SELECT event_id, value FROM events) USING (event_id)),
        laid AS (
          SELECT child_id, name, day_index * 1440.0::DOUBLE + ws AS c,
                 day_index * 1440.0::DOUBLE + we AS d FROM win)
        """,
    ),
)
def overlap_window_table(spark, sf_dir):
    """Minutes of each use, not cut at midnight, in the windows of a given table."""
    ev = events(spark, sf_dir)
    begin = spans.on_running_axis(F.col("day_index"), F.col("episode_start_minute"))
    uses = eventlog.whole_uses(ev).select(
        "event_id", "child_id", begin.alias("start"), (begin + F.col("use_minutes")).alias("end")
    )
    windows = eventlog.daily_windows(ev).withColumns(
        {c: spans.on_running_axis(F.col("day_index"), F.col(c)) for c in ("window_start", "window_end")}
    )
    found = spans.label_minutes(uses, windows, LABELS)
    total = found.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("spans"),
        *[F.sum(f"{label}_minutes").alias(f"{label}_minutes") for label in LABELS],
    )
    return total.select(
        *longs("event_id", "spans"), *rounded(*[f"{label}_minutes" for label in LABELS])
    )


@query(
    "overlap_severity_corr",
    with_tables(
        """
        SELECT 'post_bedtime_use_ratio' AS ratio, round(corr(nr, "S"), 6) AS corr_with_s FROM dr
        UNION ALL SELECT 'school_use_ratio', round(corr(sr, "S"), 6) FROM dr
        """,
        """
        dr AS (
          SELECT s.child_id, day_index, any_value(p."S") AS "S",
                 sum(night) / nullif(sum(dur), 0) AS nr, sum(school) / nullif(sum(dur), 0) AS sr
          FROM sess s JOIN prof p ON p.child_id = s.child_id GROUP BY s.child_id, day_index)
        """,
    ),
)
def overlap_severity_corr(spark, sf_dir):
    """Correlation of both daily context ratios with the latent severity."""
    daily = eventlog.daily_ratios(events(spark, sf_dir)).withColumn("S", eventlog.latent("S"))
    ratios = ["post_bedtime_use_ratio", "school_use_ratio"]
    row = daily.agg(*[F.corr(r, "S").alias(r) for r in ratios])
    entries = F.array(*[F.struct(F.lit(r).alias("ratio"), F.col(r).alias("corr_with_s")) for r in ratios])
    return row.select(F.explode(entries).alias("e")).select("e.ratio", "e.corr_with_s").select(
        "ratio", *rounded("corr_with_s")
    )
