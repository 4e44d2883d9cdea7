"""Ordered scans that stay distributed when one key holds most of the rows.

A plain window puts every row of a key into one task. The scans here cut a key
into ordered chunks (a minute, an hour, an index range, a hash prefix):
each chunk is reduced on its own, a running aggregate over the few chunk totals
gives the value carried into a chunk, and only the rows of one chunk meet in a
task. The result equals the plain window's.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diurna.functions import hashing
from diurna.session import written_table


def join_on_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"):
    """Join in which two NULL keys are the same key; key columns of the left."""
    named = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    same = [left[k].eqNullSafe(named[f"__r_{k}"]) for k in keys]
    return left.join(named, same, how).drop(*[f"__r_{k}" for k in keys])


def _before(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def carried_scan(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[str | Column],
    measures: Mapping[str, tuple[str, Column]],
    inclusive: bool = False,
    peers: bool = False,
) -> DataFrame:
    """Running aggregates within ``keys`` in ``order``, all in one scan.

    ``measures`` maps output names to ('sum' | 'max' | 'min', value); extremes may
    be of any ordered type, structs as well. ``chunk`` must not decrease along
    ``order``. ``inclusive`` adds the row itself; ``peers`` adds all rows equal in
    ``order``. Empty frames give 0 for sums and NULL for extremes.
    """
    aggregates = {"sum": F.sum, "max": F.max, "min": F.min}
    hows = {name: aggregates[how] for name, (how, _) in measures.items()}
    work = df.withColumns(
        {"__chunk": chunk, **{f"__v_{name}": value for name, (_, value) in measures.items()}}
    )

    totals = work.groupBy(*keys, "__chunk").agg(
        *[agg(f"__v_{name}").alias(f"__t_{name}") for name, agg in hows.items()]
    )
    across = _before(Window.partitionBy(*keys).orderBy("__chunk"))
    carried = totals.select(
        *keys,
        "__chunk",
        *[agg(f"__t_{name}").over(across).alias(f"__c_{name}") for name, agg in hows.items()],
    )

    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order)
    if peers:
        inside = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    elif inclusive:
        inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    else:
        inside = _before(inside)
    local = work.withColumns(
        {f"__l_{name}": agg(f"__v_{name}").over(inside) for name, agg in hows.items()}
    )

    def merged(name: str) -> Column:
        before, here = F.col(f"__c_{name}"), F.col(f"__l_{name}")
        if measures[name][0] != "sum":
            # Both leave NULL out.
            return {"max": F.greatest, "min": F.least}[measures[name][0]](before, here)
        return F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))

    joined = join_on_same(local, carried, [*keys, "__chunk"])
    return joined.select(*df.columns, *[merged(name).alias(name) for name in measures])


def running_index(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[str | Column],
    out: str,
) -> DataFrame:
    """1-based position of each row within ``keys`` in ``order``."""
    one = F.lit(1).cast("long")
    return carried_scan(df, keys, chunk, order, {out: ("sum", one)}, inclusive=True)


def sequential_layout(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[str | Column],
    duration: str,
    origin: str,
    index: str = "item_index",
    start: str = "start_minute",
    end: str = "end_minute",
) -> DataFrame:
    """Number items and lay them end to end from ``origin``.

    Item i starts where item i-1 stopped.
    """
    length = F.col(duration).cast("double")
    laid = carried_scan(
        df,
        keys,
        chunk,
        order,
        {"__before": ("sum", F.lit(1).cast("long")), "__ahead": ("sum", length)},
    )
    begin = F.col(origin) + F.col("__ahead")
    return laid.withColumns(
        {index: F.col("__before") + 1, start: begin, end: begin + F.col(duration)}
    ).drop("__before", "__ahead")


def proportional_allocation(
    parts: DataFrame,
    totals: DataFrame,
    keys: Sequence[str],
    weight: str,
    total: str,
    out: str,
) -> DataFrame:
    """Split each key's ``total`` over its parts by ``weight``; parts add up.

    The weight sums are a map-side combined aggregate that meets the totals
    first, so only one rate per key is joined to the parts and a key with very
    many parts is split by the adaptive skew join instead of filling one
    window task.
    """
    sums = parts.groupBy(*keys).agg(F.sum(weight).alias("__weight_sum"))
    rates = totals.select(*keys, F.col(total).alias("__total")).join(sums, list(keys))
    share = F.try_divide(F.col("__total") * F.col(weight), F.col("__weight_sum"))
    return (
        parts.join(rates, list(keys)).withColumn(out, share).drop("__total", "__weight_sum")
    )


# A slice of a stratum's shuffled order holds about this many rows at most.
SLICE_ROWS = 65_536


def _sliced(df: DataFrame, strata: Sequence[str], key: Column) -> DataFrame:
    """Add ``__key``, its leading digits ``__slice`` and ``stratum_size``.

    The number of digits follows from the stratum's counted size: small strata are
    one slice each, a stratum with a third of all rows is cut into as many as it
    needs. Equal lengths within a stratum, so the texts are ordered like the keys.
    """
    sizes = written_table(
        df.groupBy(*strata).agg(F.count(F.lit(1)).alias("stratum_size")), "stratum-sizes"
    )
    # 1e-9: exact powers of 16 must not be rounded up.
    depth = F.ceil(F.log(16.0, F.col("stratum_size") / F.lit(float(SLICE_ROWS))) - F.lit(1e-9))
    digits = F.greatest(depth, F.lit(0).cast("long")).cast("int")
    placed = join_on_same(df.withColumn("__key", key), sizes, strata)
    return placed.withColumn("__slice", F.substring(F.col("__key"), F.lit(1), digits))


def hashed_rank(
    df: DataFrame,
    strata: Sequence[str],
    ids: Sequence[str],
    seed: int | str,
    out: str = "stratum_rank",
    salt: Sequence[Column] = (),
) -> DataFrame:
    """Exact 1-based shuffle rank of every row within its stratum.

    Rows are ordered by md5(seed:salt:ids). The leading hex digits of the hash are
    the chunks, as many as the stratum's size asks for. Reads ``df`` twice.
    """
    keyed = _sliced(df, strata, hashing.hash_key(seed, *salt, *[F.col(c) for c in ids]))
    ranked = running_index(keyed, strata, F.col("__slice"), ["__key", *ids], out)
    return ranked.drop("__key", "__slice", "stratum_size")


def first_by_hash(
    df: DataFrame,
    strata: Sequence[str],
    ids: Sequence[str],
    seed: int | str,
    quota: Column,
    out: str,
    salt: Sequence[Column] = (),
) -> DataFrame:
    """Add ``out``: is the row among the first ``quota`` of its shuffled stratum?

    ``quota`` is an expression over ``stratum_size``. Selecting needs no full
    ranking: a histogram of slices (combined map-side) tells in which one the quota
    is reached. Rows of the other slices are decided where they are; only that one
    slice of a stratum is ranked. The cuts (one row per stratum) are stored, so the
    planner knows their size when it joins.
    """
    keyed = _sliced(df, strata, hashing.hash_key(seed, *salt, *[F.col(c) for c in ids]))
    slices = keyed.groupBy(*strata, "stratum_size", "__slice").agg(
        F.count(F.lit(1)).alias("__rows")
    )
    stratum = Window.partitionBy(*strata)
    upto = stratum.orderBy("__slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = written_table(
        slices.withColumn("__upto", F.sum("__rows").over(upto))
        .withColumn("__quota", F.least(quota, F.col("stratum_size")))
        .where(
            (F.col("__upto") >= F.col("__quota"))
            & (F.col("__upto") - F.col("__rows") < F.col("__quota"))
        )
        .select(
            *strata,
            F.col("__slice").alias("__cut"),
            (F.col("__quota") - F.col("__upto") + F.col("__rows")).alias("__need"),
        ),
        "cuts",
    )
    placed = join_on_same(keyed.drop("stratum_size"), cuts, strata, "left")
    at_cut = F.coalesce(F.col("__slice") == F.col("__cut"), F.lit(False))
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy("__key", *ids))
    decided = placed.where(~at_cut).withColumn(
        out, F.coalesce(F.col("__slice") < F.col("__cut"), F.lit(False))
    )
    ranked = placed.where(at_cut).withColumn(out, rank <= F.col("__need"))
    return decided.unionByName(ranked).drop("__key", "__slice", "__cut", "__need")
