"""Diverse top-n recommendation, computed inside each request row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diurna.functions import arrays, hashing
from diurna.schemas import CONTEXTS, OFFER_SIZE
from diurna.sources import catalog

MATCH_BONUS = 1.0
REPEAT_PENALTY = 2.0
JITTER = 0.25


def allowed(activity: tuple) -> list[str]:
    """Contexts an activity may be offered in; bedtime takes calm, suitable ones."""
    _, _, _, _, _, contexts, level, suitable, *_ = activity
    return [c for c in contexts if c != "bedtime" or (suitable and level == "calm")]


def eligible(context: Column, activities: list[tuple] = catalog.ACTIVITIES) -> Column:
    """Array of the activities allowed in a context (NULL for an unknown one).

    The catalogue and the contexts are fixed, so each context's list is a
    constant and a request row only picks one.
    """
    chosen = F.lit(None)
    for name in CONTEXTS:
        entries = [(i, a) for i, a in enumerate(activities) if name in allowed(a)]
        chosen = F.when(context == name, catalog.activity_array(entries)).otherwise(chosen)
    return chosen


def _eligible_count(context: Column, activities: list[tuple]) -> Column:
    count = F.lit(0)
    for name in CONTEXTS:
        count = F.when(
            context == name, F.lit(sum(name in allowed(a) for a in activities))
        ).otherwise(count)
    return count


def _score(activity: tuple) -> Column:
    activity_id, tags = activity[0], [t.lower() for t in activity[4]]
    matches = F.arrays_overlap("__wanted", F.array(*[F.lit(t) for t in tags]))
    shown = F.coalesce(F.array_contains("recently_shown_ids", activity_id), F.lit(False))
    jitter = hashing.unit_interval(
        hashing.hash_text(
            F.col("random_seed").cast("string"), F.col("request_id").cast("string"), F.lit(activity_id)
        )
    )
    return (
        F.when(matches, F.lit(MATCH_BONUS)).otherwise(F.lit(0.0))
        - F.when(shown, F.lit(REPEAT_PENALTY)).otherwise(F.lit(0.0))
        + jitter * F.lit(JITTER)
    )


def recommend(requests: DataFrame, activities: list[tuple] = catalog.ACTIVITIES) -> DataFrame:
    """Add ``reject_reason`` and ``offer`` to request rows.

    Requests hold request_id, context, interests, recently_shown_ids, n
    (NULL = 3) and random_seed. ``offer`` is an ordered array of
    (activity_id, category, score); NULL for rejected requests.

    Best of every category in score order, then the rest by score: the same
    list as sorting by (not the best of its category, score). The catalogue is
    a short fixed list, so its entries are spelled out as columns of the
    request row: no join, no shuffle, all generated code but the final sort.
    """
    n = F.coalesce(F.col("n"), F.lit(OFFER_SIZE))
    reason = (
        F.when(n <= 0, "n_not_positive")
        .when(~F.coalesce(F.col("context").isin(CONTEXTS), F.lit(False)), "unknown_context")
        .when(_eligible_count(F.col("context"), activities) < n, "too_few_candidates")
    )
    marks = [f"__s{i}" for i in range(len(activities))]
    scored = requests.withColumns(
        {"reject_reason": reason, "__wanted": arrays.normalise_terms(F.col("interests"))}
    ).withColumns(
        {
            mark: F.when(
                F.col("reject_reason").isNull() & F.col("context").isin(allowed(a)),
                F.struct(_score(a).alias("score"), F.lit(-i).alias("order")),
            )
            for i, (mark, a) in enumerate(zip(marks, activities, strict=True))
        }
    )
    categories = sorted({a[3] for a in activities})
    tops = {
        f"__top_{c}": F.array_max(
            F.array(*[F.col(m) for m, a in zip(marks, activities, strict=True) if a[3] == c])
        )
        for c in categories
    }
    entries = [
        F.when(
            F.col(mark).isNotNull(),
            F.struct(
                (F.col(mark) < F.col(f"__top_{a[3]}")).alias("repeats"),
                (-F.col(mark)["score"]).alias("neg_score"),
                F.lit(i).alias("position"),
                F.lit(a[0]).alias("activity_id"),
                F.lit(a[3]).alias("category"),
            ),
        )
        for i, (mark, a) in enumerate(zip(marks, activities, strict=True))
    ]
    order = F.sort_array(F.array_compact(F.array(*entries)))
    offer = F.transform(
        F.slice(order, F.lit(1), n),
        lambda a: F.struct(
            a["activity_id"], a["category"], (-a["neg_score"]).alias("score")
        ),
    )
    return (
        scored.withColumns(tops)
        .withColumn("offer", F.when(F.col("reject_reason").isNull(), offer))
        .drop("__wanted", *marks, *tops)
    )


def offered_rows(recommended: DataFrame) -> DataFrame:
    """One row per offered activity with its 1-based place.

    The outer form keeps the planner from deriving a pre-filter on the offer,
    which would compute every offer a second time.
    """
    return recommended.select(
        "request_id", "context", F.posexplode_outer("offer").alias("pos", "a")
    ).where("pos IS NOT NULL").select(
        "request_id",
        "context",
        (F.col("pos") + 1).alias("place"),
        "a.activity_id",
        "a.category",
        "a.score",
    )


def offered_ids(offer: Column) -> Column:
    return F.transform(offer, lambda a: a["activity_id"])
