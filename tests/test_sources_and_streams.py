from __future__ import annotations

import os
import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from diurna import session
from diurna.functions import numeric
from diurna.operators import quality
from diurna.operators.sessions import sessionize
from diurna.plans import checks, eventlog, weekly
from diurna.schemas import POPULATION
from diurna.sources import catalog, files
from diurna.sources.tables import table
from diurna.streaming import history, runs, triggers
from diurna.streaming import weekly as live
from diurna.streaming.sessions import live_sessions
from workload.behaviour_sql import with_tables

# Ten profiles (age, mode, school start/end/shift, bedtimes, delay).
PILOT = [
    (6, "morning", 490, 745, 10, 1343, 1406, 63),
    (10, "morning", 467, 722, -13, 1355, 1361, 6),
    (6, "afternoon", 773, 1028, -7, 1337, 1398, 61),
    (8, "afternoon", 775, 1030, -5, 1342, 1385, 43),
    (7, "morning", 488, 743, 8, 1331, 1374, 43),
    (11, "morning", 491, 746, 11, 1336, 1407, 71),
    (12, "morning", 477, 732, -3, 1335, 1336, 1),
    (7, "morning", 481, 736, 1, 1339, 1370, 31),
    (9, "afternoon", 784, 1039, 4, 1348, 1419, 71),
    (8, "afternoon", 777, 1032, -3, 1336, 1397, 61),
]


def pilot(spark):
    rows = [
        (i, a, (a - 9) / 2, 0.0, 0.0, 0.0, 0.0, mode, s, e, shift, "", "", bs, bn, d, "", "")
        for i, (a, mode, s, e, shift, bs, bn, d) in enumerate(PILOT, 1)
    ]
    return spark.createDataFrame(rows, POPULATION)


def test_pilot_population_passes(spark):
    quality.require(checks.population(pilot(spark)))
    broken = pilot(spark).withColumn("age", F.when(F.col("child_id") == 1, 5).otherwise(F.col("age")))
    with pytest.raises(AssertionError, match="age_range"):
        quality.require(checks.population(broken))
    bad = quality.violations(broken, {"age": ~F.col("age").between(6, 12)}).collect()
    assert [(r.child_id, r.broken_rules) for r in bad] == [(1, ["age"])]


def test_csv_round_trip_and_discovery(spark, tmp_path):
    folder = tmp_path / "final"
    folder.mkdir()
    files.write_csv(pilot(spark).select("child_id", "age"), str(folder / "a.csv"))
    files.write_csv(pilot(spark), str(folder / "b.csv"))
    found = files.discover_csv(spark, str(folder), ["child_id", "school_mode"])
    assert found.endswith("b.csv")
    back = files.read_csv(spark, found, POPULATION)
    assert back.count() == 10 and back.columns == POPULATION.fieldNames()
    assert files.read_csv(spark, found).select("age").schema[0].dataType.simpleString() == "int"
    with pytest.raises(FileNotFoundError):
        files.discover_csv(spark, str(folder), ["nowhere"])


class Session:
    """The parts of a SparkSession that choosing a workspace looks at."""

    def __init__(self, master, settings):
        self.settings = settings
        self.sparkContext = self
        self.master = master
        self.conf = self

    def get(self, key, default=None):
        return self.settings.get(key, default)

    def set(self, key, value):
        self.settings[key] = value

    def getConf(self):
        return self


def test_workspace_prefers_the_clusters_folder():
    cluster = Session("spark://head", {"spark.checkpoint.dir": "hdfs:///shared/"})
    assert session.workspace_dir(cluster) == "hdfs:///shared"
    assert session.scratch_path(cluster, "x").startswith("hdfs:///shared/diurna-x-")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.workspace_dir(Session("spark://head", {}))
    laptop = Session("local[2]", {})
    assert session.workspace_dir(laptop) == session.workspace_dir(laptop)


def test_written_tables_do_not_overwrite(spark):
    a = session.written_table(spark.range(3).toDF("x"), "probe")
    b = session.written_table(spark.range(5).toDF("x"), "probe")
    assert (a.count(), b.count()) == (3, 5)


def test_fused_weekly_features_equal_the_three_table_form(spark, sf_dir):
    ev = table(spark, sf_dir, "events")

    def by_week(df):
        return df.withColumn("week_index", eventlog.week_of(F.col("day_index")))

    general = weekly.weekly_features(
        by_week(eventlog.daily_rows(ev)),
        by_week(eventlog.session_rows(ev)),
        by_week(eventlog.tagged_episodes(ev)),
    )
    fused = weekly.from_events(ev)

    def rounded(df):
        return df.select("child_id", "week_index", *[F.round(c, 8) for c in fused.columns[2:]])

    assert fused.count() == general.count() > 0
    assert rounded(fused).exceptAll(rounded(general)).count() == 0


def test_mean_use_adds_up_days_and_stays_in_its_band(spark):
    """Session minutes in a row give 105.00000000000001, which is the next band."""
    days = [
        [(60, 39.87)],
        [(60, 98.63), (260, 82.58), (460, 2.43)],
        [(60, 20.34), (260, 30.73), (460, 40.42)],
    ]
    rows = [
        (100 * d + s, datetime(2024, 1, 1 + d, s // 60, s % 60), 7, "click", v, None)
        for d, day in enumerate(days)
        for s, v in day
    ]
    row = weekly.from_events(spark.createDataFrame(rows, EVENT)).select(
        "mean_daily_use_minutes", numeric.band(F.col("mean_daily_use_minutes"), 10.0).alias("band")
    )
    assert [tuple(r) for r in row.collect()] == [(105.0, 100.0)]


def test_context_ratios_are_those_of_sql_in_time_order(spark, tmp_path):
    """A week wholly after bedtime: days added up first below, sessions in a row above."""
    rows = [
        (i, datetime(2024, 1, day, start // 60, start % 60), 1101, "click", value, None)
        for i, (day, start, value) in enumerate(
            [(29, 30, 9.72), (29, 224, 42.32), (30, 19, 57.58), (30, 1304, 117.47)]
        )
    ]
    spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(f"{tmp_path}/events")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events/*.parquet'")
    ratios = "post_bedtime_use_ratio, school_use_ratio"
    want = con.execute(with_tables(f"SELECT {ratios} FROM feat")).fetchall()
    got = weekly.from_events(spark.read.parquet(f"{tmp_path}/events")).selectExpr(*ratios.split(", "))
    assert [tuple(r) for r in got.collect()] == want == [(1.0000000000000002, 0.0)]


def test_week_use_does_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(4)
    rows = [
        (child, 0, day, i, rng.randrange(1, 20_000) / 100 + 0.1)
        for child in range(40)
        for day in range(7)
        for i in range(1, 9)
    ]
    schema = (
        "child_id long, week_index int, day_index int, session_index int, "
        "session_duration_minutes double"
    )
    want = {}
    for child in range(40):
        week = 0.0
        for day in range(7):
            total = 0.0
            for r in rows:
                if (r[0], r[2]) == (child, day):
                    total += r[4]
            week += total
        want[child] = week
    for _ in range(2):
        rng.shuffle(rows)
        found = weekly.with_week_use(spark.createDataFrame(rows, schema).repartition(3))
        got = found.select("child_id", "week_use_minutes").distinct().collect()
        assert sorted(tuple(r) for r in got) == sorted(want.items())


def test_one_hot_child_changes_nothing_for_the_others(spark, sf_dir):
    """A third of all events on one child: same rows for everyone else."""
    ev = table(spark, sf_dir, "events").where("user_id < 8")
    extra = ev.where("user_id <> 3").withColumn("user_id", F.lit(3).cast("long"))
    before = {
        (r.child_id, r.week_index): r for r in weekly.from_events(ev).collect() if r.child_id != 4
    }
    after = {
        (r.child_id, r.week_index): r
        for r in weekly.from_events(ev.unionByName(extra)).collect()
        if r.child_id != 4
    }
    assert before == after


EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_stream_equals_batch_and_drops_late_rows(spark, tmp_path):
    monday = datetime(2024, 1, 1)
    first = [(i, monday + timedelta(hours=5 * i), i % 3, "click", 4.0, "") for i in range(40)]
    later = [(100, monday + timedelta(days=40), 1, "view", 2.0, "")]
    latest = [(101, monday + timedelta(days=40, hours=1), 1, "view", 2.0, "")]
    late = [(200, monday + timedelta(hours=1), 1, "view", 9.0, "")]
    for i, rows in enumerate((first, later, latest, late)):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        source = next((tmp_path / f"part{i}").glob("*.parquet"))
        folder = tmp_path / "in" / "events.parquet"
        folder.mkdir(parents=True, exist_ok=True)
        source.rename(folder / f"part-{i}.parquet")
    stream = live.weekly_totals(live.read_events(spark, str(tmp_path / "in"), 1))
    closed = runs.drain(stream, "late").collect()
    batch = live.weekly_totals(live.with_event_time(spark.createDataFrame(first, EVENT)))
    assert sorted(map(tuple, closed)) == sorted(map(tuple, batch.collect()))


def streamed(spark, tmp_path, batches, schema, name):
    """A folder of one file per batch, read one file a trigger in this order."""
    folder = tmp_path / name
    folder.mkdir()
    for i, rows in enumerate(batches):
        part = tmp_path / f"{name}-{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(part))
        next(part.glob("*.parquet")).rename(folder / f"part-{i}.parquet")
        os.utime(folder / f"part-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


def test_weeks_leave_the_state_and_late_rows_are_counted(spark, tmp_path):
    monday = datetime(2024, 1, 1)

    def week(n, users):
        return [(100 * n + u, monday + timedelta(days=7 * n, hours=u), u, "click", 4.0, "") for u in range(users)]

    late = [(900, monday, 1, "click", 1.0, ""), (901, monday, None, "click", 1.0, "")]
    batches = [week(0, 20), week(2, 3), week(2, 1), late]
    folder = tmp_path / "weeks"
    folder.mkdir()
    inner = streamed(spark, folder, batches, EVENT, "events.parquet")
    stream = live.weekly_totals(live.read_events(spark, os.path.dirname(inner), 1))
    closed, reports = runs.drained(stream, "weeks")
    assert closed.count() == 20 and {str(r.week_start)[:10] for r in closed.collect()} == {"2024-01-01"}
    kept = runs.state_rows(reports)
    assert max(kept) >= 20 and kept[-1] == 3
    assert runs.late_rows(reports) == 1


def test_live_sessions_equal_the_daily_table(spark, tmp_path):
    """Out of order within the lateness; sessions end at midnight as in the table."""
    rng = random.Random(6)
    rows = []
    for i in range(600):
        at = datetime(2024, 1, 1) + timedelta(minutes=rng.randint(0, 4 * 1440 - 1), seconds=rng.randint(0, 59))
        rows.append((i, at, rng.randint(1, 3), "click", rng.choice([0.5, 7.25, 45.0]), ""))
    rows += [(700, datetime(2024, 1, 2, 23, 50), 9, "view", 30.0, ""), (701, datetime(2024, 1, 3, 0, 5), 9, "view", 1.0, "")]
    rows.sort(key=lambda r: r[1])
    flush = [(800, datetime(2024, 1, 20), 5, "click", 1.0, ""), (801, datetime(2024, 1, 20, 1), 5, "click", 1.0, "")]
    batches = [rows[0:250:2], rows[1:250:2], rows[250:], [flush[0]], [flush[1]]]
    folder = tmp_path / "log"
    folder.mkdir()
    inner = streamed(spark, folder, batches, EVENT, "events.parquet")
    log = eventlog.episodes(live.read_events(spark, os.path.dirname(inner), 1))
    got, reports = runs.drained(live_sessions(log, lateness="3 days"), "sessions")
    table_ = sessionize(eventlog.episodes(spark.createDataFrame(rows, EVENT)))
    names = ["child_id", "day_index", "session_start_minute", "session_end_minute", "openings"]
    want = sorted(map(tuple, table_.select(*names).collect()))
    assert sorted(map(tuple, got.select(*names).collect())) == want
    assert sum(r[0] == 10 for r in want) == 2
    # The two last events are open sessions, 31 minutes and more apart.
    assert runs.late_rows(reports) == 0 and runs.state_rows(reports)[-1] == 2


BEDTIME = (
    "child_id long, event_id long, current_time timestamp_ntz, bedtime_hour int, "
    "bedtime_minute int, device_in_use boolean"
)


def test_end_of_log_closes_what_is_open(spark, tmp_path):
    """Week by week, a file a trigger: nothing is late, and the last days come out too."""
    rng = random.Random(8)
    batches, every = [], []
    for week in range(3):
        rows = []
        for i in range(80):
            at = datetime(2024, 1, 1) + timedelta(days=7 * week, minutes=rng.randint(0, 7 * 1440 - 1))
            rows.append((1000 * week + i, at, rng.randint(0, 2), "click", rng.choice([0.5, 45.0]), ""))
        batches.append(rows)
        every += rows
    folder = tmp_path / "log"
    folder.mkdir()
    inner = streamed(spark, folder, batches, EVENT, "events.parquet")
    log = live.read_events(spark, os.path.dirname(inner), 1)
    table_ = live.with_event_time(spark.createDataFrame(every, EVENT))
    end = live.end_of_log(spark)

    weeks, reports = runs.drained_to_end(log, end, live.weekly_totals, "weeks")
    want = sorted(map(tuple, live.weekly_totals(table_).collect()))
    assert sorted(map(tuple, weeks.collect())) == want and len(want) == 9
    assert runs.late_rows(reports) == 0 and runs.state_rows(reports)[-1] == 1

    def open_sessions(rows):
        return live_sessions(eventlog.episodes(rows), lateness="8 days")

    got, reports = runs.drained_to_end(log, end, open_sessions, "sessions")
    names = ["child_id", "day_index", "session_start_minute", "session_end_minute", "openings"]
    daily = sessionize(eventlog.episodes(table_)).select(*names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(map(tuple, daily.collect()))
    assert runs.late_rows(reports) == 0 and runs.state_rows(reports)[-1] == 1


def test_triggers_in_any_order_equal_the_replay(spark, tmp_path):
    """Nights of two children, shuffled within the lateness over several triggers."""
    runs.use_rocksdb(spark)
    rng = random.Random(2)
    night = datetime(2024, 1, 1, 21, 0)
    minutes = [0, 5, 10, 59, 60, 64, 69, 1440 + 8, 1440 + 30, 2 * 1440 + 5, 2 * 1440 + 65, 2 * 1440 + 65]
    rows = [
        (child, 100 * child + i, night + timedelta(minutes=m), 22, 5, True)
        for child in (7, 8)
        for i, m in enumerate(minutes)
    ]
    rng.shuffle(rows)
    flush = [(9, 900 + d, night + timedelta(days=20 + d, minutes=15), 22, 5, True) for d in (0, 1)]
    late = [(7, 999, night + timedelta(minutes=10), 22, 5, True)]
    batches = [rows[:5], rows[5:14], rows[14:], flush[:1], flush[1:], late]
    folder = streamed(spark, tmp_path, batches, BEDTIME, "in")
    source = spark.readStream.schema(BEDTIME).option("maxFilesPerTrigger", 1).parquet(folder)
    table_, reports = runs.drained(triggers.bedtime_triggers(source, lateness="5 days"), "t")
    got = {r.event_id: r.reason for r in table_.collect()}
    want = {}
    for child in (7, 8):
        last = None
        # Bedtime is 22:05: 21:00 is too early, at 22:09 it is tomorrow's.
        inside = [(m, 100 * child + i) for i, m in enumerate(minutes) if 5 <= m % 1440 <= 65]
        for m, event in sorted(inside):
            fires = last is None or m - last >= 60
            last = m if fires else last
            want[event] = "bedtime_transition" if fires else "bedtime_cooldown_active"
    assert got == want
    at = {r.event_id: r.event_time for r in table_.collect()}
    assert at[702] == night + timedelta(minutes=10)
    assert runs.late_rows(reports) == 1


RESPONSE = (
    "child_id long, event_time timestamp, source string, context string, "
    "activities_offered array<string>, response string, selected_activity_id string"
)


def test_history_batches_can_be_run_again(spark, tmp_path):
    """Duplicates across batches, however old, and reruns add no line; refusals are kept."""
    known = [r.activity_id for r in catalog.catalog(spark).limit(2).collect()]

    def response(child, day, source="child_initiated"):
        return (child, datetime(2024, 1, day, 10), source, "voluntary", known, "selected", known[0])

    first = [response(1, 1), response(1, 1), response(2, 2), response(0, 2)]
    second = [response(2, 2), response(3, 1), response(4, 28), response(5, 3, "nobody")]
    path, rejected = str(tmp_path / "history"), str(tmp_path / "rejected")

    def lines():
        return sorted((r.child_id, r.timestamp) for r in files.read_records(spark, path).collect())

    frames = [spark.createDataFrame(rows, RESPONSE) for rows in (first, second)]
    history.commit(frames[0], 0, path, rejected)
    assert lines() == [(1, "2024-01-01T10:00:00"), (2, "2024-01-02T10:00:00")]
    for _ in range(2):
        history.commit(frames[1], 1, path, rejected)
        assert [c for c, _ in lines()] == [1, 2, 3, 4]
    history.commit(frames[0], 0, path, rejected)
    history.commit(frames[0].limit(0), 2, path, rejected)
    assert [c for c, _ in lines()] == [1, 2, 3, 4]
    refused = spark.read.json(rejected).collect()
    assert sorted((r.child_id, r.reject_reason) for r in refused) == [
        (0, "child_id_not_positive"),
        (5, "unknown_source"),
    ]
