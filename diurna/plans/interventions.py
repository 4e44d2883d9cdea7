"""Intervention decisions, cooldown replay and response records.

A score never starts an intervention, and a selected activity is not a
completed one: these jobs decide and record, they do not judge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diurna.functions import arrays, clock
from diurna.plans import recommend
from diurna.schemas import (
    BEDTIME_COOLDOWN_MINUTES,
    BEDTIME_WINDOW_MINUTES,
    CONTEXTS,
    OFFER_SIZE,
    RESPONSES,
    SOURCES,
)
from diurna.session import written_table
from diurna.sources import catalog

MICROS = 60_000_000


def _decided(df: DataFrame, fires: Column, source: str, context: str) -> DataFrame:
    return df.withColumns(
        {
            "should_intervene": fires,
            "source": F.when(fires, F.lit(source)),
            "context": F.when(fires, F.lit(context)),
        }
    )


def _with_offer(df: DataFrame, context: str) -> DataFrame:
    """Offer for intervening rows; rows keep their columns."""
    offers = recommend.recommend(
        df.drop("context", "n").withColumns({"context": F.lit(context), "n": F.lit(OFFER_SIZE)})
    )
    return (
        offers.withColumn(
            "activities", F.when(F.col("should_intervene"), recommend.offered_ids(F.col("offer")))
        )
        .withColumn("context", F.when(F.col("should_intervene"), F.lit(context)))
        .drop("offer", "n", "reject_reason")
    )


def voluntary_decisions(requests: DataFrame) -> DataFrame:
    """A child's own request always gets an offer of three."""
    decided = _decided(requests, F.lit(True), "child_initiated", "voluntary")
    return _with_offer(decided, "voluntary").withColumn(
        "reason", F.lit("child_requested_activity")
    )


def elapsed_minutes(now: Column, last: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", last, now) / F.lit(float(MICROS))


def bedtime_reason(
    window: int = BEDTIME_WINDOW_MINUTES, cooldown: int = BEDTIME_COOLDOWN_MINUTES
) -> Column:
    """Ordered rules over one event row.

    A transition fires only if everything it rests on is known: a NULL device
    state counts as not in use, a NULL or impossible clock as an invalid
    bedtime, and without a current time there is no decision. A NULL
    ``last_bedtime_intervention`` means no earlier offer.
    """
    left = clock.minutes_until(
        F.col("current_time"), F.col("bedtime_hour"), F.col("bedtime_minute")
    )
    since = elapsed_minutes(F.col("current_time"), F.col("last_bedtime_intervention"))
    valid = clock.valid_clock(F.col("bedtime_hour"), F.col("bedtime_minute"))
    return (
        F.when(~F.coalesce("device_in_use", F.lit(False)), "device_not_in_use")
        .when(~F.coalesce(valid, F.lit(False)), "invalid_bedtime")
        .when(left.isNull(), "missing_time")
        .when(left > window, "outside_bedtime_window")
        .when(since < cooldown, "bedtime_cooldown_active")
        .otherwise("bedtime_transition")
    )


def bedtime_decisions(bedtime_events: DataFrame) -> DataFrame:
    """Decide every event row and offer activities where a transition fires."""
    reasoned = bedtime_events.withColumn("reason", bedtime_reason())
    fires = F.col("reason") == "bedtime_transition"
    return _with_offer(_decided(reasoned, fires, "system_bedtime", "bedtime"), "bedtime")


# --- cooldown replay --------------------------------------------------------


def reached(starts: DataFrame, links: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int]:
    """(every node on the way from ``starts`` along ``links``, rounds it took).

    ``starts`` holds keys and at, ``links`` keys, at and next; ways do not meet.
    The links double in length each round: what is reached in 2^k steps or fewer
    jumps 2^k further, so a way of n nodes takes about log2(n) rounds.
    """
    found, jumps, rounds = [starts], written_table(links, "jumps"), 0
    node = [*keys, "at"]
    while True:
        rounds += 1
        whole = found[0]
        for part in found[1:]:
            whole = whole.unionByName(part)
        fresh = written_table(
            whole.join(jumps, node).select(*keys, F.col("next").alias("at")), "reached"
        )
        if fresh.isEmpty():
            return whole, rounds
        found.append(fresh)
        further = jumps.select(*keys, F.col("at").alias("next"), F.col("next").alias("__far"))
        jumps = written_table(
            jumps.join(further, [*keys, "next"]).select(*node, F.col("__far").alias("next")),
            "jumps",
        )


def replay_links(
    candidates: DataFrame, cooldown: int = BEDTIME_COOLDOWN_MINUTES
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates that may fire, sure first ones, links from each to the next to fire).

    Times are microseconds, as ``at``. Of a child's candidates at one time only that
    with the smallest event may fire. Candidates are cut into islands wherever a whole
    cooldown passes without one: an island's first always fires, and nothing outside
    decides what fires inside. Should a candidate fire, the next to do so is the first
    of its island at least a cooldown later.
    """
    # Islands: minutes with candidates are at most 1,440 per child and day.
    minutes = candidates.groupBy(
        "child_id", F.date_trunc("minute", F.col("current_time")).alias("minute")
    ).agg(F.min("current_time").alias("first_at"), F.max("current_time").alias("last_at"))
    by_time = Window.partitionBy("child_id").orderBy("minute")
    gap = elapsed_minutes(F.col("first_at"), F.lag("last_at").over(by_time))
    starts = minutes.withColumn(
        "__new", F.when(gap.isNull() | (gap >= cooldown), F.col("first_at"))
    ).withColumn(
        "island", F.last("__new", ignorenulls=True).over(by_time)
    ).select("child_id", "minute", "island")
    # A gap inside a minute is below any cooldown of a minute or more.
    micros = F.unix_micros(F.col("current_time").cast("timestamp"))
    nodes = written_table(
        candidates.withColumn("minute", F.date_trunc("minute", F.col("current_time")))
        .join(starts, ["child_id", "minute"])
        .groupBy("child_id", "island", "current_time")
        .agg(F.min("event_id").alias("event_id"))
        .withColumn("at", micros),
        "candidates",
    )
    key = ["child_id", "island"]
    # Gaps inside an island are below the cooldown, so the next candidate to fire is
    # less than two cooldowns away: it stands in the same stretch of four, or in the
    # first half of the next, whose candidates are shown to both.
    key, step = ["child_id", "island"], cooldown * MICROS
    own = F.floor(F.col("at") / (4 * step))
    shown = F.when(F.pmod("at", F.lit(4 * step)) < 2 * step, F.array(own, own - 1))
    stretches = nodes.select(
        *key, "at", own.alias("own"), F.explode(F.coalesce(shown, F.array(own))).alias("stretch")
    )
    # From the latest candidate back, those at least a cooldown later come first.
    later = (
        Window.partitionBy(*key, "stretch")
        .orderBy(-F.col("at"))
        .rangeBetween(Window.unboundedPreceding, -step)
    )
    linked = stretches.withColumn("next", F.last("at").over(later))
    first = nodes.where(F.col("current_time") == F.col("island")).select(*key, "at")
    usable = (F.col("stretch") == F.col("own")) & F.col("next").isNotNull()
    return nodes, first, linked.where(usable).select(*key, "at", "next")


def replay_fires(
    candidates: DataFrame, cooldown: int = BEDTIME_COOLDOWN_MINUTES
) -> DataFrame:
    """Which candidates fire when every firing starts a new cooldown.

    ``candidates``: child_id, event_id, current_time of events that pass every other
    rule. Sequential by nature, but not walked: every candidate is linked to the one
    that would fire next, and the links are followed with doubling length.
    """
    nodes, first, links = replay_links(candidates, cooldown)
    key = ["child_id", "island"]
    fires, _ = reached(first, links, key)
    return nodes.join(fires, [*key, "at"], "left_semi").select(
        "child_id", "event_id", "current_time"
    )


def bedtime_replay(
    bedtime_events: DataFrame,
    window: int = BEDTIME_WINDOW_MINUTES,
    cooldown: int = BEDTIME_COOLDOWN_MINUTES,
) -> DataFrame:
    """Reason per event when earlier firings of the replay set the cooldown."""
    stateless = bedtime_events.withColumn(
        "last_bedtime_intervention", F.lit(None).cast("timestamp_ntz")
    ).withColumn("reason", bedtime_reason(window, cooldown))
    candidates = stateless.where("reason = 'bedtime_transition'")
    fires = replay_fires(candidates, cooldown).select("event_id", F.lit(True).alias("__fired"))
    return (
        stateless.join(fires, "event_id", "left")
        .withColumn(
            "reason",
            F.when(
                (F.col("reason") == "bedtime_transition") & F.col("__fired").isNull(),
                "bedtime_cooldown_active",
            ).otherwise(F.col("reason")),
        )
        .drop("__fired", "last_bedtime_intervention")
    )


# --- response records -------------------------------------------------------


def record_rules() -> list[tuple[str, Column]]:
    """Ordered (reason, violation) pairs of a response record."""
    offered, selected = F.col("activities_offered"), F.col("selected_activity_id")
    chose = F.col("response") == "selected"
    return [
        ("child_id_not_positive", ~F.coalesce(F.col("child_id") > 0, F.lit(False))),
        ("unknown_source", ~F.coalesce(F.col("source").isin(SOURCES), F.lit(False))),
        ("unknown_context", ~F.coalesce(F.col("context").isin(CONTEXTS), F.lit(False))),
        ("nothing_offered", F.coalesce(F.size(offered), F.lit(0)) <= 0),
        ("duplicate_offer", arrays.has_duplicates(offered)),
        ("unknown_activity", ~arrays.is_subset(offered, catalog.known_ids())),
        ("unknown_response", ~F.coalesce(F.col("response").isin(RESPONSES), F.lit(False))),
        ("selection_missing", chose & selected.isNull()),
        ("selection_not_offered", chose & ~F.coalesce(F.array_contains(offered, selected), F.lit(False))),
        ("selection_without_selected", ~chose & selected.isNotNull()),
    ]


def checked_records(records: DataFrame) -> DataFrame:
    """Add ``reject_reason``: the first rule a record breaks, or NULL."""
    reason = None
    for name, broken in record_rules():
        reason = F.when(broken, name) if reason is None else reason.when(broken, name)
    return records.withColumn("reject_reason", reason)


def iso_timestamp(ts: Column) -> Column:
    """ISO text, microseconds only when there are any."""
    micros = F.date_format(ts, "SSSSSS") != "000000"
    return F.when(micros, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    )


def build_records(responses: DataFrame, keep_time: bool = False) -> DataFrame:
    """Valid response rows -> history records; ``event_time`` is a timestamp.

    The id is a digest of the record's own fields, so replaying a batch gives
    the same ids and duplicates can be recognised.
    """
    stamped = checked_records(responses).where("reject_reason IS NULL").withColumn(
        "timestamp", iso_timestamp(F.col("event_time"))
    )
    digest = F.sha2(
        F.concat_ws(
            "|",
            F.col("child_id").cast("string"),
            "timestamp",
            "source",
            "context",
            F.concat_ws(",", "activities_offered"),
            "response",
            F.coalesce("selected_activity_id", F.lit("")),
        ),
        256,
    )
    return stamped.select(
        digest.alias("intervention_id"),
        "child_id",
        "timestamp",
        "source",
        "context",
        "activities_offered",
        "response",
        "selected_activity_id",
        *(["event_time"] if keep_time else []),
    )


def register_responses(decisions: DataFrame, responses: DataFrame) -> DataFrame:
    """Responses joined to their decision, checked; one row per response.

    Only an intervening decision with source, context and activities can take
    a response. Columns of a record plus ``decision_id``, ``reject_reason``.
    """
    offers = decisions.select(
        "decision_id",
        "should_intervene",
        "source",
        "context",
        F.col("activities").alias("activities_offered"),
    )
    joined = responses.join(offers, "decision_id", "left")
    unusable = (
        F.when(F.col("should_intervene").isNull(), "unknown_decision")
        .when(~F.col("should_intervene"), "no_intervention")
        .when(F.col("source").isNull(), "no_source")
        .when(F.col("context").isNull(), "no_context")
        .when(F.coalesce(F.size("activities_offered"), F.lit(0)) <= 0, "no_activities")
    )
    checked = checked_records(joined)
    return checked.withColumn("reject_reason", F.coalesce(unusable, F.col("reject_reason")))
