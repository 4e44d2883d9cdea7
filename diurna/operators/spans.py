"""Overlap join of two tables of spans on one running time axis.

Spans are half open, ``[start, end)``, in any unit; they may be short or long, overlap
each other and cross midnight, as bounds count from one origin for all days. A span is
placed in the buckets it touches on a grid that suits its length, and once more on each
coarser grid where the other side has spans, so it is at most two rows per grid. Two
spans meet on the coarser of their grids, in the bucket in which the later one begins,
hence exactly once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diurna.operators import scans
from diurna.schemas import MINUTES_PER_DAY
from diurna.session import written_table

# Grids of 64, 256, 1,024, ... minutes; the last is wider than any log is long.
FINEST_GRID = 64.0
GRID_FACTOR = 4
GRIDS = 12

# Rows of one side that meet in a task; fuller buckets are cut into a grid of parts.
HOT_ROWS = 20_000


def _width(grid: Column) -> Column:
    return F.lit(FINEST_GRID) * F.pow(F.lit(float(GRID_FACTOR)), grid.cast("double"))


def _finite(bound: Column) -> Column:
    return bound.isNotNull() & (F.abs(bound) < F.lit(float("inf")))


def _with_grid(side: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Spans that can meet another, stored with a row id and the finest grid that is
    not finer than their length."""
    real = _finite(F.col(start)) & _finite(F.col(end)) & (F.col(end) > F.col(start))
    for key in keys:
        real = real & F.col(key).isNotNull()
    length = F.col(end) - F.col(start)
    grid = F.lit(GRIDS - 1)
    for k in reversed(range(GRIDS - 1)):
        grid = F.when(length <= FINEST_GRID * GRID_FACTOR**k, F.lit(k)).otherwise(grid)
    numbered = {"__home": grid, "__row": F.monotonically_increasing_id()}
    return written_table(side.where(real).withColumns(numbered), "spans")


def _lengths(side: DataFrame, start: str, end: str) -> dict[int, tuple[int, float]]:
    """{grid: (spans, their minutes)}, at most one entry a grid."""
    found = side.groupBy("__home").agg(
        F.count(F.lit(1)).alias("spans"), F.sum(F.col(end) - F.col(start)).alias("minutes")
    )
    return {r["__home"]: (r["spans"], r["minutes"]) for r in found.collect()}


def _placed_rows(
    own: dict[int, tuple[int, float]], other: dict[int, tuple[int, float]], finest: int
) -> float:
    """About how many rows a side becomes if no grid is finer than ``finest``."""
    met, rows = {max(h, finest) for h in other}, 0.0
    for home, (count, minutes) in own.items():
        home = max(home, finest)
        for grid in {home} | {g for g in met if g > home}:
            rows += count + minutes / (FINEST_GRID * GRID_FACTOR**grid)
    return rows


def _finest_grid(
    left: dict[int, tuple[int, float]], right: dict[int, tuple[int, float]]
) -> int:
    """The finest grid worth having: a span has a row on each grid from its own upwards,
    so with spans of all lengths fewer grids mean fewer rows, while a fine grid means
    fewer rows that meet in vain. The finest within a quarter of the least rows."""
    rows = [
        _placed_rows(left, right, g) + _placed_rows(right, left, g) for g in range(GRIDS)
    ]
    return next(g for g in range(GRIDS) if rows[g] <= 1.25 * min(rows))


def _placed(side: DataFrame, homes: Sequence[int], start: str, end: str) -> DataFrame:
    """One row per grid and bucket in which a span can meet one of the other side,
    whose spans are at home on the grids ``homes``."""
    grids = F.array(F.col("__home"), *[F.lit(h) for h in homes])
    above = F.array_distinct(F.filter(grids, lambda g: g >= F.col("__home")))
    on_grids = side.withColumn("__grid", F.explode(above))
    width = _width(F.col("__grid"))
    first = F.floor(F.col(start) / width)
    last = F.greatest(first, F.ceil(F.col(end) / width) - 1)
    return on_grids.withColumn("__bucket", F.explode(F.sequence(first, last)))


def overlapping(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Every pair of a left and a right row of the same key whose spans overlap.

    Repeated rows pair as often as they occur. A NULL key, a bound that is NULL or not
    finite, and a span without length pair with nothing. Column names other than keys
    must differ between the sides. A key with very many rows spreads over its buckets;
    a bucket with more than ``hot_rows`` rows of a side has these cut into parts, and
    the other side's rows go to every part.
    """
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    a = _with_grid(left, keys, *left_span)
    b = _with_grid(right, keys, *right_span)
    cell = [*keys, "__grid", "__bucket"]
    lengths_a, lengths_b = _lengths(a, *left_span), _lengths(b, *right_span)
    finest = _finest_grid(lengths_a, lengths_b)
    homes_a, homes_b = (
        sorted({max(h, finest) for h in lengths}) for lengths in (lengths_a, lengths_b)
    )
    home = F.greatest(F.col("__home"), F.lit(finest))
    a, b = a.withColumn("__home", home), b.withColumn("__home", home)
    placed_a = _placed(a, homes_b, *left_span).withColumnRenamed("__home", "__home_a")
    placed_b = _placed(b, homes_a, *right_span).withColumnRenamed("__home", "__home_b")

    # A bucket holds a span once, so only keys of many rows can have full buckets.
    busy = written_table(
        a.select(*keys, F.lit(True).alias("__first"))
        .unionAll(b.select(*keys, F.lit(False).alias("__first")))
        .groupBy(*keys)
        .agg(
            F.count_if("__first").alias("__rows_a"), F.count_if(~F.col("__first")).alias("__rows_b")
        )
        .where((F.greatest("__rows_a", "__rows_b") > hot_rows) & (F.least("__rows_a", "__rows_b") > 0))
        .select(*keys),
        "busy-keys",
    )
    counts = (
        placed_a.select(*cell, F.lit(True).alias("__first"))
        .unionAll(placed_b.select(*cell, F.lit(False).alias("__first")))
        .join(busy, list(keys), "left_semi")
        .groupBy(*cell)
        .agg(
            F.count_if("__first").alias("__rows_a"), F.count_if(~F.col("__first")).alias("__rows_b")
        )
    )

    def parts(count: str) -> Column:
        return F.greatest(F.ceil(F.col(count) / hot_rows), F.lit(1)).cast("int")

    full = F.greatest("__rows_a", "__rows_b") > hot_rows
    hot = written_table(
        counts.where(full & (F.least("__rows_a", "__rows_b") > 0)).select(
            *cell, parts("__rows_a").alias("__parts_a"), parts("__rows_b").alias("__parts_b")
        ),
        "hot-buckets",
    )

    def spread(side: DataFrame, own: str, others: str) -> DataFrame:
        """Own part by hash of the row id, one copy for each part of the other side."""
        marked = side.join(hot, cell, "left").fillna(1, ["__parts_a", "__parts_b"])
        mine = F.pmod(F.xxhash64("__row"), F.col(f"__parts_{own}")).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.col(f"__parts_{others}") - 1))
        kept = [c for c in side.columns if c != "__row"]
        return marked.select(
            *kept, mine.alias(f"__part_{own}"), copies.alias(f"__part_{others}")
        )

    one_side = spread(placed_a, "a", "b")
    other_side = spread(placed_b, "b", "a")
    later = F.greatest(F.col(left_span[0]), F.col(right_span[0]))
    sooner = F.least(F.col(left_span[1]), F.col(right_span[1]))
    met = one_side.join(other_side, [*cell, "__part_a", "__part_b"]).where(
        (later < sooner)
        & (F.greatest("__home_a", "__home_b") == F.col("__grid"))
        & (F.floor(later / _width(F.col("__grid"))) == F.col("__bucket"))
    )
    others = [c for side in (left, right) for c in side.columns if c not in keys]
    return met.select(*keys, *others)


def label_minutes(
    spans: DataFrame,
    windows: DataFrame,
    labels: Sequence[str],
    keys: Sequence[str] = ("child_id",),
    span: tuple[str, str] = ("start", "end"),
    window: tuple[str, str] = ("window_start", "window_end"),
    label: str = "window_name",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add <label>_minutes: time of each span inside the windows of each label.

    The windows come as a table of any origin; they may overlap (time in two windows of
    a label counts twice) and need not cover the axis. Spans that meet no window, are
    empty or have a NULL key get 0; a span with a missing bound gets NULL. Equal spans
    of a key are measured once.
    """
    start, end = F.col(span[0]).cast("double"), F.col(span[1]).cast("double")
    marked = spans.withColumns({"__start": start, "__end": end})
    asked = marked.select(*keys, "__start", "__end").distinct()
    laid = windows.where(F.col(label).isin(list(labels))).select(
        *keys,
        F.col(label).alias("__label"),
        F.col(window[0]).cast("double").alias("__from"),
        F.col(window[1]).cast("double").alias("__to"),
    )
    pairs = overlapping(
        asked, laid, keys, ("__start", "__end"), ("__from", "__to"), hot_rows=hot_rows
    )
    shared = F.least("__end", "__to") - F.greatest("__start", "__from")
    identity = [*keys, "__start", "__end"]
    totals = pairs.groupBy(*identity).agg(
        *[
            F.sum(F.when(F.col("__label") == name, shared)).alias(f"__minutes_{i}")
            for i, name in enumerate(labels)
        ]
    )
    joined = scans.join_on_same(marked, totals, identity, "left")
    known = F.col("__start").isNotNull() & F.col("__end").isNotNull()
    return joined.select(
        *spans.columns,
        *[
            F.when(known, F.coalesce(F.col(f"__minutes_{i}"), F.lit(0.0))).alias(f"{name}_minutes")
            for i, name in enumerate(labels)
        ],
    )


def on_running_axis(day_index: Column, minute: Column) -> Column:
    """Minutes since the start of day 0, for a minute of a day."""
    return (day_index * F.lit(MINUTES_PER_DAY)).cast("double") + minute
