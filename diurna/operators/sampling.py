"""Exact stratified splits, folds and subsamples by hashed rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diurna.functions import hashing
from diurna.operators.scans import carried_scan, first_by_hash, hashed_rank, join_on_same
from diurna.session import written_table


def stratum_sizes(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    return df.groupBy(*strata).agg(F.count(F.lit(1)).alias("stratum_size"))


def _checked_size(expected: int | None) -> Column:
    size = F.col("stratum_size")
    if expected is None:
        return size
    message = F.format_string(f"stratum holds %d rows, expected {expected}", size)
    return F.when(size == expected, size).otherwise(F.raise_error(message).cast("long"))


def stratified_split(
    df: DataFrame,
    strata: Sequence[str],
    ids: Sequence[str],
    seed: int,
    test_rows: int | None = None,
    test_fraction: float | None = None,
    expected_size: int | None = None,
) -> DataFrame:
    """Add ``split`` ('test' or 'development').

    Exactly ``test_rows`` (or floor(fraction * size)) rows of every stratum go
    to test. With ``expected_size`` the call fails on a stratum of another size.
    """
    if (test_rows is None) == (test_fraction is None):
        raise ValueError("give either test_rows or test_fraction")
    size = _checked_size(expected_size)
    quota = (
        F.when(size >= 0, F.lit(test_rows))
        if test_rows is not None
        else F.floor(size * F.lit(float(test_fraction)))
    )
    chosen = first_by_hash(df, strata, ids, seed, quota, "__test")
    return chosen.withColumn(
        "split", F.when(F.col("__test"), "test").otherwise("development")
    ).drop("__test")


def stratified_folds(
    df: DataFrame, strata: Sequence[str], ids: Sequence[str], k: int, seed: int
) -> DataFrame:
    """Add ``fold`` 1..k; sizes per stratum and overall differ by at most one.

    Ranks continue from stratum to stratum (offset = rows of earlier strata),
    which is what balances the fold totals.
    """
    # Strata in order, cut into ranges: a prefix sum over the ranges' totals gives each
    # range its start. Stored first, as range bounds are drawn anew on every run.
    ordered = written_table(
        stratum_sizes(df, strata)
        .repartitionByRange(*strata)
        .select(*strata, "stratum_size", F.spark_partition_id().alias("__range")),
        "strata",
    )
    offsets = written_table(
        carried_scan(
            ordered, [], F.col("__range"), strata, {"__offset": ("sum", F.col("stratum_size"))}
        ).select(*strata, "__offset"),
        "offsets",
    )
    ranked = hashed_rank(df, strata, ids, seed, "__rank")
    return (
        join_on_same(ranked, offsets, strata)
        .withColumn("fold", ((F.col("__offset") + F.col("__rank") - 1) % k + 1).cast("int"))
        .drop("__rank", "__offset")
    )


def draws_of(fractions: Sequence[float], k: int) -> list[tuple[int, float]]:
    """(validation fold, fraction) of every training subset, by the bit it has."""
    draws = [(fold, float(f)) for fold in range(1, k + 1) for f in fractions]
    if len(draws) > 63:
        raise ValueError(f"{len(draws)} subsets do not fit the bits of a long")
    return draws


def _draw_keys(
    draws: Sequence[tuple[int, float]], ids: Sequence[str], seed: int
) -> dict[int, Column]:
    """Shuffle key per bit; the full fraction needs none."""
    return {
        bit: hashing.hash_key(seed, F.lit(fold), F.lit(round(part * 100)), *[F.col(c) for c in ids])
        for bit, (fold, part) in enumerate(draws)
        if part < 1.0
    }


def _edge(share: str) -> str:
    """SQL: a share of all shuffle keys as the first 15 hex digits of a key."""
    digits = f"lower(hex(CAST(floor(greatest({share}, 0D) * {1 << 60}L) AS BIGINT)))"
    return f"CASE WHEN {share} >= 1 THEN 'g' ELSE lpad({digits}, 15, '0') END"


# How far around the expected cut keys are looked at, in standard deviations; a
# stratum whose cut is not there (ids that repeat) is looked at again, at last whole.
CUT_WIDTHS = (8.0, 64.0, float("inf"))


def subset_cuts(
    folded: DataFrame,
    strata: Sequence[str],
    ids: Sequence[str],
    fractions: Sequence[float],
    k: int,
    seed: int,
) -> DataFrame:
    """Stored table: strata, ``cuts`` (bit -> largest shuffle key that is drawn).

    A key is uniform, so the cut of n keys lies within a few standard deviations
    of the fraction. One wide aggregate counts the keys below that stretch for all
    subsets at once, and only the keys inside it, about sqrt(n), are listed and
    ranked. No row is copied per subset.
    """
    draws = draws_of(fractions, k)
    keys = _draw_keys(draws, ids, seed)
    fold = F.col("fold")
    sizes = stratum_sizes(folded, [*strata, "fold"])
    outside = [F.sum(F.when(fold != v, F.col("stratum_size"))) for v in range(1, k + 1)]
    waiting = written_table(
        sizes.groupBy(*strata).agg(
            F.array(*[F.coalesce(n, F.lit(0).cast("long")) for n in outside]).alias("__n")
        ),
        "subset-sizes",
    )
    found: DataFrame | None = None
    for width in CUT_WIDTHS:
        quota, low, high = [], [], []
        for v, part in draws:
            n = f"__n[{v - 1}]"
            share = f"coalesce(try_divide(floor({n} * {part}D), {n}), 0D)"
            spread = f"double('{width}') * sqrt({share} * (1 - {share}) * {n} + 1)"
            slack = f"coalesce(try_divide({spread}, {n}), 0D)"
            quota.append(f"floor({n} * {part}D)")
            low.append(_edge(f"({share} - {slack})"))
            high.append(_edge(f"({share} + {slack})"))
        edges = written_table(
            waiting.select(
                *strata,
                F.expr(f"array({', '.join(quota)})").alias("__quota"),
                F.expr(f"array({', '.join(low)})").alias("__low"),
                F.expr(f"array({', '.join(high)})").alias("__high"),
            ),
            "subset-edges",
        )
        keyed = folded.select(
            *strata, "fold", *[key.alias(f"__k{bit}") for bit, key in keys.items()]
        )
        rows = join_on_same(keyed, edges, strata)
        counts, near = [], []
        for bit, (v, _) in enumerate(draws):
            if bit not in keys:
                counts.append("0L")
                continue
            counts.append(f"count_if(fold <> {v} AND __k{bit} < __low[{bit}])")
            close = f"fold <> {v} AND __k{bit} >= __low[{bit}] AND __k{bit} < __high[{bit}]"
            near.append(f"CASE WHEN {close} THEN struct({bit} AS bit, __k{bit} AS key) END")
        below = rows.groupBy(*strata).agg(
            F.first("__quota").alias("__quota"),
            F.expr(f"array({', '.join(counts)})").alias("__below"),
        )
        # The outer form: the planner would compute the array twice to filter on its size.
        inside = (
            rows.select(*strata, F.expr(f"explode_outer(array_compact(array({', '.join(near)})))").alias("e"))
            .where("e IS NOT NULL")
            .groupBy(*strata, F.col("e.bit").alias("bit"), F.col("e.key").alias("key"))
            .agg(F.count(F.lit(1)).alias("rows"))
        )
        upto = F.sum("rows").over(Window.partitionBy(*strata, "bit").orderBy("key"))
        ranked = join_on_same(inside.withColumn("upto", upto), written_table(below, "below"), strata)
        reached = F.col("upto") + F.col("__below")[F.col("bit")]
        goal = F.col("__quota")[F.col("bit")]
        cuts = (
            ranked.where((reached >= goal) & (reached - F.col("rows") < goal))
            .groupBy(*strata)
            .agg(F.map_from_entries(F.collect_list(F.struct("bit", "key"))).alias("cuts"))
        )
        none = F.create_map().cast("map<int,string>")
        wanted = " + ".join(f"CAST(__quota[{bit}] > 0 AS INT)" for bit in keys)
        judged = written_table(
            join_on_same(edges.select(*strata, "__quota"), cuts, strata, "left").select(
                *strata,
                F.coalesce("cuts", none).alias("cuts"),
                F.expr(wanted).alias("__wanted"),
            ),
            "subset-cuts",
        )
        whole = F.size("cuts") == F.col("__wanted")
        settled = judged.where(whole).select(*strata, "cuts")
        found = settled if found is None else found.unionByName(settled)
        missed = judged.where(~whole).select(*strata)
        if missed.isEmpty():
            break
        waiting = join_on_same(waiting, missed, strata, "left_semi")
    return found


def with_subsets(
    folded: DataFrame,
    strata: Sequence[str],
    ids: Sequence[str],
    fractions: Sequence[float],
    k: int,
    seed: int,
    out: str = "subsets",
) -> DataFrame:
    """Add ``out``: a bit for every training subset (see ``draws_of``) a row is in.

    Each stratum of a fold's training part gives floor(n * fraction) rows, drawn
    independently per fold and fraction. Rows that repeat an id are drawn together.
    Reads ``folded`` a few times: pass a stored table.
    """
    draws = draws_of(fractions, k)
    keys = _draw_keys(draws, ids, seed)
    placed = folded
    if keys:
        cuts = subset_cuts(folded, strata, ids, fractions, k, seed)
        placed = join_on_same(folded, cuts.withColumnRenamed("cuts", "__cuts"), strata)
        placed = placed.withColumns({f"__k{bit}": key for bit, key in keys.items()})
    bits = ["0L"]
    for bit, (v, _) in enumerate(draws):
        within = f" AND __k{bit} <= try_element_at(__cuts, {bit})" if bit in keys else ""
        bits.append(f"CASE WHEN fold <> {v}{within} THEN {1 << bit}L ELSE 0L END")
    return placed.select(*folded.columns, F.expr(" + ".join(bits)).alias(out))


def fraction_subsamples(
    folded: DataFrame,
    strata: Sequence[str],
    ids: Sequence[str],
    fractions: Sequence[float],
    k: int,
    seed: int,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Training subsets as rows: one per (validation fold, fraction, chosen row).

    Columns: strata, ids, ``validation_fold``, ``train_fraction`` and the columns in
    ``carry``. The draws are those of ``with_subsets``; a consumer that only adds up
    rows should read its bits instead.
    """
    kept = list(dict.fromkeys([*strata, *ids, *carry]))
    marked = with_subsets(folded, strata, ids, fractions, k, seed, "__subsets")
    chosen = ", ".join(
        f"CASE WHEN __subsets & {1 << bit}L <> 0 "
        f"THEN struct({v} AS validation_fold, {part}D AS train_fraction) END"
        for bit, (v, part) in enumerate(draws_of(fractions, k))
    )
    return (
        marked.select(*kept, F.expr(f"explode_outer(array_compact(array({chosen})))").alias("__s"))
        .where("__s IS NOT NULL")
        .select(*kept, "__s.validation_fold", "__s.train_fraction")
    )
