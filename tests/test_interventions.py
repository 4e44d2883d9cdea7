from __future__ import annotations

import hashlib
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from diurna.functions import clock
from diurna.plans import checks, interventions, recommend
from diurna.sources import catalog, files

REQUEST = (
    "request_id long, context string, interests array<string>, recently_shown_ids array<string>, "
    "n int, random_seed int"
)


def requests(spark, rows):
    return spark.createDataFrame(rows, REQUEST)


def expected_offer(request_id, context, interests, shown, n, seed):
    """Two passes over the scored catalogue, straight from the rules."""
    wanted = {t.strip().lower() for t in interests or [] if t.strip()}
    pool = [
        a
        for a in catalog.ACTIVITIES
        if context in a[5] and (context != "bedtime" or (a[7] and a[6] == "calm"))
    ]
    scored = []
    for a in pool:
        digest = hashlib.md5(f"{seed}:{request_id}:{a[0]}".encode()).hexdigest()
        score = (1.0 if wanted & set(a[4]) else 0.0) - (2.0 if a[0] in (shown or []) else 0.0)
        scored.append((score + int(digest[:8], 16) / 2**32 * 0.25, a))
    scored.sort(key=lambda item: -item[0])
    chosen, seen = [], set()
    for _, a in scored:
        if len(chosen) < n and a[3] not in seen:
            chosen.append(a[0])
            seen.add(a[3])
    for _, a in scored:
        if len(chosen) < n and a[0] not in chosen:
            chosen.append(a[0])
    return chosen


def test_offers_follow_the_two_passes(spark):
    rng = random.Random(0)
    tags = sorted({t for a in catalog.ACTIVITIES for t in a[4]}) + [" Drawing ", "SPORTS", " ", ""]
    rows = []
    for i in range(200):
        context = rng.choice(["voluntary", "bedtime", "general"])
        most = {"voluntary": 16, "general": 17, "bedtime": 10}[context]
        rows.append(
            (
                i,
                context,
                rng.choice([None, [], rng.sample(tags, 3)]),
                rng.choice([None, rng.sample(catalog.ACTIVITY_IDS, 4)]),
                rng.randint(1, most),
                rng.randint(0, 3),
            )
        )
    got = recommend.recommend(requests(spark, rows)).select(
        "request_id", recommend.offered_ids(F.col("offer")).alias("ids")
    )
    offers = {r.request_id: r.ids for r in got.collect()}
    assert offers == {r[0]: expected_offer(*r) for r in rows}


def test_bad_requests_are_rejected(spark):
    rows = [
        (1, "voluntary", None, None, 0, 1),
        (2, "night", None, None, 3, 1),
        (3, "bedtime", None, None, 11, 1),
        (4, "bedtime", None, None, 10, 1),
        (5, None, None, None, 3, 1),
        (6, "general", None, None, None, 1),
    ]
    got = {r.request_id: r for r in recommend.recommend(requests(spark, rows)).collect()}
    assert [got[i].reject_reason for i in (1, 2, 3, 5)] == [
        "n_not_positive",
        "unknown_context",
        "too_few_candidates",
        "unknown_context",
    ]
    assert len(got[4].offer) == 10 and len(got[6].offer) == 3


def test_catalog_sizes_and_suite(spark):
    table = catalog.catalog(spark)
    assert table.count() == 18
    counts = {
        c: sum(c in recommend.allowed(a) for a in catalog.ACTIVITIES)
        for c in ("voluntary", "general", "bedtime")
    }
    assert counts == {"voluntary": 16, "general": 17, "bedtime": 10}
    assert checks.catalog(table).where("failed_rows > 0").count() == 0


def test_voluntary_request_always_fires(spark):
    rows = [(1, "general", ["drawing", "sports"], None, 7, 42)]
    got = interventions.voluntary_decisions(requests(spark, rows)).first()
    assert (got.should_intervene, got.source, got.context, got.reason) == (
        True,
        "child_initiated",
        "voluntary",
        "child_requested_activity",
    )
    assert len(got.activities) == 3


@pytest.mark.parametrize(
    ("now", "device", "last", "reason"),
    [
        ("21:20", True, None, "bedtime_transition"),
        ("21:20", True, "21:00", "bedtime_cooldown_active"),
        ("20:30", True, None, "outside_bedtime_window"),
        ("21:20", False, None, "device_not_in_use"),
        ("22:20", True, None, "outside_bedtime_window"),
        ("21:00", True, None, "bedtime_transition"),
        ("22:00", True, None, "bedtime_transition"),
        ("21:20", True, "20:20", "bedtime_transition"),
        ("20:59", True, "20:30", "outside_bedtime_window"),
    ],
)
def test_bedtime_rules(spark, now, device, last, reason):
    stamp = "timestamp_ntz"
    row = spark.range(1).select(
        F.lit(1).cast("long").alias("request_id"),
        F.lit(f"2026-08-18 {now}:00").cast(stamp).alias("current_time"),
        F.lit(22).alias("bedtime_hour"),
        F.lit(0).alias("bedtime_minute"),
        F.lit(device).alias("device_in_use"),
        (F.lit(f"2026-08-18 {last}:00") if last else F.lit(None)).cast(stamp).alias("last_bedtime_intervention"),
        F.array(F.lit("drawing")).alias("interests"),
        F.array().cast("array<string>").alias("recently_shown_ids"),
        F.lit(42).alias("random_seed"),
    )
    got = interventions.bedtime_decisions(row).first()
    assert got.reason == reason
    assert got.should_intervene == (reason == "bedtime_transition")
    assert (got.activities is not None) == got.should_intervene
    assert got.source == ("system_bedtime" if got.should_intervene else None)


def test_invalid_clock_only_matters_with_the_device_on(spark):
    base = spark.range(1).select(
        F.lit("2026-08-18 21:00:00").cast("timestamp_ntz").alias("current_time"),
        F.lit(24).alias("bedtime_hour"),
        F.lit(0).alias("bedtime_minute"),
        F.lit(None).cast("timestamp_ntz").alias("last_bedtime_intervention"),
    )
    for device, reason in ((True, "invalid_bedtime"), (False, "device_not_in_use")):
        row = base.withColumn("device_in_use", F.lit(device))
        assert row.select(interventions.bedtime_reason().alias("r")).first().r == reason


def brute_replay(rows, cooldown):
    fired, last = set(), {}
    for child, event, at in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if child not in last or at - last[child] >= timedelta(minutes=cooldown):
            last[child] = at
            fired.add(event)
    return fired


@pytest.mark.parametrize(("cooldown", "density"), [(60, 3), (60, 25), (7, 25), (240, 90)])
def test_replay_equals_a_sequential_walk(spark, cooldown, density):
    """Dense candidates need many rounds; one child holds most of them."""
    rng = random.Random(cooldown + density)
    start = datetime(2024, 1, 1)
    rows = [
        (
            1 if rng.random() < 0.7 else rng.randint(2, 4),
            i,
            start + timedelta(minutes=rng.randint(0, density * 60), seconds=rng.choice([0, 0, 30])),
        )
        for i in range(150)
    ]
    df = spark.createDataFrame(rows, "child_id long, event_id long, current_time timestamp_ntz")
    got = {r.event_id for r in interventions.replay_fires(df, cooldown).collect()}
    assert got == brute_replay(rows, cooldown)


@pytest.mark.parametrize(("cooldown", "most"), [(10, 15), (60, 13), (1430, 8)])
def test_replay_rounds_are_logarithmic(spark, cooldown, most):
    """Sixty days with a candidate every five minutes: one island, 17,280 candidates."""
    days = 60
    df = spark.range(days * 288).select(
        F.lit(1).cast("long").alias("child_id"),
        F.col("id").alias("event_id"),
        F.timestamp_micros(F.col("id") * 300_000_000).cast("timestamp_ntz").alias("current_time"),
    )
    nodes, first, links = interventions.replay_links(df, cooldown)
    assert (nodes.count(), first.count()) == (days * 288, 1)
    fires, rounds = interventions.reached(first, links, ["child_id", "island"])
    fired = days * 1440 // cooldown + (days * 1440 % cooldown > 0)
    assert fires.count() == fired
    assert rounds <= most and 2 ** (rounds - 2) < fired


def test_replay_without_candidates(spark):
    df = spark.createDataFrame([], "child_id long, event_id long, current_time timestamp_ntz")
    assert interventions.replay_fires(df).count() == 0


RESPONSE = (
    "child_id long, source string, context string, activities_offered array<string>, "
    "response string, selected_activity_id string, event_time timestamp_ntz"
)
OFFER = ["social_talk_01", "quiet_draw_01"]


def response(**changes):
    base = dict(
        child_id=1,
        source="system_bedtime",
        context="bedtime",
        activities_offered=OFFER,
        response="selected",
        selected_activity_id="quiet_draw_01",
        event_time=datetime(2026, 8, 18, 21, 20, 0, 5),
    )
    return tuple({**base, **changes}.values())


@pytest.mark.parametrize(
    ("changes", "reason"),
    [
        ({}, None),
        ({"child_id": 0}, "child_id_not_positive"),
        ({"source": "robot"}, "unknown_source"),
        ({"context": "night"}, "unknown_context"),
        ({"activities_offered": []}, "nothing_offered"),
        ({"activities_offered": None}, "nothing_offered"),
        ({"activities_offered": ["quiet_draw_01", "quiet_draw_01"]}, "duplicate_offer"),
        ({"activities_offered": ["quiet_draw_01", "x"]}, "unknown_activity"),
        ({"response": "maybe"}, "unknown_response"),
        ({"selected_activity_id": None}, "selection_missing"),
        ({"selected_activity_id": "creative_story_01"}, "selection_not_offered"),
        ({"response": "rejected"}, "selection_without_selected"),
        ({"response": "postponed", "selected_activity_id": None}, None),
    ],
)
def test_record_rules(spark, changes, reason):
    df = spark.createDataFrame([response(**changes)], RESPONSE)
    assert interventions.checked_records(df).first().reject_reason == reason


def test_history_lines(spark, tmp_path):
    path = str(tmp_path / "history")
    first = spark.createDataFrame([response()], RESPONSE)
    second = spark.createDataFrame(
        [response(response="ignored", selected_activity_id=None, event_time=datetime(2026, 8, 19))], RESPONSE
    )
    files.append_records(interventions.build_records(first), path)
    files.append_records(interventions.build_records(second), path)
    rows = files.read_records(spark, path).orderBy("timestamp").collect()
    assert [r.timestamp for r in rows] == ["2026-08-18T21:20:00.000005", "2026-08-19T00:00:00"]
    assert rows[0].activities_offered == OFFER and rows[1].selected_activity_id is None
    assert rows[0].intervention_id != rows[1].intervention_id
    lines = [line for p in (tmp_path / "history").glob("*.json") for line in p.read_text().splitlines()]
    assert all("selected_activity_id" in json.loads(line) for line in lines)
    again = interventions.build_records(first).first().intervention_id
    assert again == rows[0].intervention_id


def test_responses_need_an_intervening_decision(spark):
    decisions = spark.createDataFrame(
        [
            (1, True, "system_bedtime", "bedtime", OFFER),
            (2, False, None, None, None),
            (3, True, "system_bedtime", "bedtime", []),
        ],
        "decision_id long, should_intervene boolean, source string, context string, activities array<string>",
    )
    answers = spark.createDataFrame(
        [(i, 5, "rejected", None) for i in (1, 2, 3, 4)],
        "decision_id long, child_id long, response string, selected_activity_id string",
    )
    got = {
        r.decision_id: r.reject_reason
        for r in interventions.register_responses(decisions, answers).collect()
    }
    assert got == {1: None, 2: "no_intervention", 3: "no_activities", 4: "unknown_decision"}


def test_clock_text(spark):
    values = [(0, "00:00"), (1439, "23:59"), (1440, "00:00 (+1d)"), (2890, "00:10 (+2d)"), (-30, "23:30")]
    df = spark.createDataFrame(values, "m int, want string")
    got = df.select(clock.minutes_to_clock(F.col("m")).alias("c"), "want").collect()
    assert all(r.c == r.want for r in got)
