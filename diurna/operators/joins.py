"""Joins with key contracts, lookups and as-of lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diurna.operators import scans

CONTRACTS = ("one_to_one", "many_to_one")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def require_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Raise ValueError when a key repeats (runs a job)."""
    found = duplicate_keys(df, keys).take(1)
    if found:
        raise ValueError(f"duplicate key {found[0].asDict()} in {list(keys)}")


def enforced_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows; the job that reads them fails when a key repeats.

    The check groups by the join key, so it shares the shuffle of the join that
    follows instead of costing a job of its own.
    """
    others = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(
        F.first(F.struct(*others) if others else F.lit(True)).alias("__row"),
        F.count(F.lit(1)).alias("__rows"),
    )
    message = F.concat(
        F.lit("duplicate key in "),
        F.lit(",".join(keys)),
        F.lit(": "),
        F.concat_ws(",", *[F.col(k).cast("string") for k in keys]),
    )
    checked = grouped.where(
        F.when(F.col("__rows") > 1, F.raise_error(message).cast("boolean")).otherwise(True)
    )
    return checked.select(*keys, *[F.col("__row")[c].alias(c) for c in others])


def validated_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    validate: str = "one_to_one",
) -> DataFrame:
    """Equi-join whose key cardinality is enforced while it runs."""
    if validate not in CONTRACTS:
        raise ValueError(f"validate must be one of {CONTRACTS}")
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    one = enforced_unique(right, keys)
    many = enforced_unique(left, keys) if validate == "one_to_one" else left
    return many.join(one, list(keys), how)


def lookup(
    facts: DataFrame, dimension: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Left many-to-one attribute lookup.

    No broadcast hint: the adaptive planner broadcasts the dimension when its
    measured size allows and shuffles it otherwise.
    """
    return facts.join(dimension.select(*keys, *columns), list(keys), "left")


def complete_lookup(
    facts: DataFrame, dimension: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Left lookup that fails, while it runs, on a row without a match."""
    found = lookup(facts, dimension.withColumn("__hit", F.lit(True)), keys, [*columns, "__hit"])
    complete = F.when(
        F.col("__hit").isNull(), F.raise_error(F.lit("lookup without a match")).cast("boolean")
    ).otherwise(True)
    return found.where(complete).drop("__hit")


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """One row per key: the first in a declared order (combines map-side)."""
    best = df.groupBy(*keys).agg(
        F.min_by(F.struct(*columns), F.struct(*order)).alias("__row")
    )
    return best.select(*keys, *[F.col("__row")[c].alias(c) for c in columns])


def as_of(
    probes: DataFrame,
    history: DataFrame,
    keys: Sequence[str],
    probe_time: str,
    history_time: str,
    out: str,
    payload: Sequence[str] = (),
    chunk: str = "minute",
) -> DataFrame:
    """Latest history row of the same key at or before each probe.

    Both sides are stacked on one time line and scanned in chunks of
    ``chunk`` (a date_trunc unit), so a key with very many rows is spread over
    its chunks. ``out`` is the history time; ``payload`` columns come along.
    Ties in time go to the largest payload. A probe without a key or time finds
    nothing, and stays.
    """
    columns = [c for c in probes.columns if c not in keys]
    entry = F.struct(F.col(history_time).alias("t"), *payload)
    null_entry = F.lit(None).cast(history.select(entry.alias("e")).schema["e"].dataType)
    null_probe = F.lit(None).cast(probes.select(F.struct(*columns).alias("p")).schema["p"].dataType)
    line = probes.select(
        *keys,
        F.col(probe_time).alias("__t"),
        null_entry.alias("__entry"),
        F.struct(*columns).alias("__probe"),
    ).unionByName(
        history.select(
            *keys, F.col(history_time).alias("__t"), entry.alias("__entry"), null_probe.alias("__probe")
        )
    )
    scanned = scans.carried_scan(
        line,
        keys,
        F.date_trunc(chunk, F.col("__t")),
        ["__t"],
        {"__last": ("max", F.col("__entry"))},
        peers=True,
    )
    known = F.lit(True)
    for part in [*keys, "__t"]:
        known = known & F.col(part).isNotNull()
    scanned = scanned.withColumn("__last", F.when(known, F.col("__last")))
    return scanned.where(F.col("__probe").isNotNull()).select(
        *keys,
        *[F.col("__probe")[c].alias(c) for c in columns],
        F.col("__last")["t"].alias(out),
        *[F.col("__last")[c].alias(c) for c in payload],
    )


def unknown_keys(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``df`` that ``known`` does not hold."""
    return df.select(key).distinct().join(known.select(key).distinct(), key, "left_anti")


def by_membership(df: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is among ``members``."""
    return df.join(members.select(*keys), list(keys), "left_semi")
