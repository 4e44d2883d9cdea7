"""Exact quantiles of columns too large for one task.

Spark's exact ``percentile`` merges every distinct value of a group into one
buffer. Here ranks are found by radix selection: a value's bits, in the order of
the values, are counted digit by digit. The first pass is one histogram of the top
digits for all columns and groups, combined map-side; it tells which bucket holds
each wanted rank. Further passes read only the rows of those buckets, until they
are small enough to be sorted. A row belongs to one bucket, so it is never copied,
however many probabilities are asked for; the result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diurna.session import written_table

# Bits of the digits, from the top: sign, exponent and 8 bits of the fraction first.
DIGITS = (20, 16, 16, 12)
# A bucket of this many rows or fewer is sorted in one task.
SORTED_ROWS = 100_000

_LEAST_NORMAL = 2.0**-1022


def with_ordered_bits(df: DataFrame, value: str, out: str) -> DataFrame:
    """Add the bits of a double as a long ordered like the values; 0 for both zeros.

    Not for NULL or NaN. In steps, so that each part is computed once.
    """
    size = F.abs(value)
    normal = (size >= _LEAST_NORMAL) & (size < float("inf"))
    part, power = F.col("__part"), F.col("__power")
    # The logarithm may be off by its rounding.
    low, high = part < 1, part >= 2
    fraction = F.when(low, part * 2).when(high, part / 2).otherwise(part) - 1
    exponent = power + F.when(low, 1022).when(high, 1024).otherwise(1023)
    bits = exponent.cast("long") * F.lit(1 << 52) + (fraction * 2.0**52).cast("long")
    small = F.when(size < 1, size).otherwise(0.0) * 2.0**537 * 2.0**537
    found = F.when(normal, bits).when(size < 1, (F.when(~normal, small)).cast("long")).otherwise(
        F.lit(2047 << 52)
    )
    return (
        df.withColumn("__safe", F.when(normal, size).otherwise(1.0))
        .withColumn("__power", F.least(F.floor(F.log2("__safe")).cast("int"), F.lit(1023)))
        .withColumn("__part", F.col("__safe") / F.pow(F.lit(2.0), power))
        .withColumn("__bits", found)
        .withColumn(out, F.when(F.col(value) < 0, -F.col("__bits")).otherwise(F.col("__bits")))
        .drop("__safe", "__power", "__part", "__bits")
    )


def melted(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Long form: by..., metric, value; NULL and NaN left out."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    rows = df.select(*by, F.explode(pairs).alias("p")).select(*by, "p.metric", "p.value")
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value"))


def _located(counted: DataFrame, wanted: DataFrame, group: Sequence[str]) -> DataFrame:
    """``wanted`` with the bucket of its rank, the rank within it and the bucket's rows.

    ``counted`` holds group, prefix, digit and rows; ``wanted`` group, rank, prefix and
    ``within``, the rank among the rows of its prefix.
    """
    ordered = Window.partitionBy(*group, "prefix").orderBy("digit")
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = counted.withColumn("upto", F.sum("rows").over(upto))
    hit = (F.col("within") < F.col("upto")) & (F.col("within") >= F.col("upto") - F.col("rows"))
    return wanted.join(spans, [*group, "prefix"]).where(hit).select(
        *group,
        "rank",
        F.col("digit").alias("prefix"),
        (F.col("within") - F.col("upto") + F.col("rows")).alias("within"),
        "rows",
    )


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    by: Sequence[str] = (),
) -> DataFrame:
    """Columns: by..., metric, probability, quantile, with linear interpolation.

    Reads ``df`` twice, and once more for every further digit that very large groups
    need; hand over a stored table when it is costly. Rows with a NULL in ``by`` are
    left out.
    """
    by = list(by)
    group = [*by, "metric"]
    values = melted(df, columns, by)
    if by:
        values = values.dropna(subset=by)
    keyed = with_ordered_bits(values, "value", "key")

    def prefix_of(bits: int) -> Column:
        return F.shiftright("key", 64 - bits)

    # The histogram is stored: sizes, ranks and buckets are read off it.
    counted = written_table(
        keyed.groupBy(*group, prefix_of(DIGITS[0]).alias("digit"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("prefix", F.lit(0).cast("long")),
        "histogram",
    )
    sizes = counted.groupBy(*group).agg(F.sum("rows").alias("n"))
    position = (F.col("n") - 1) * F.col("probability")
    asked = sizes.withColumn(
        "probability", F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))
    ).select(
        *group,
        "probability",
        F.floor(position).cast("long").alias("k0"),
        F.ceil(position).cast("long").alias("k1"),
        (position - F.floor(position)).alias("fraction"),
    )
    ranks = asked.select(*group, F.explode(F.array("k0", "k1")).alias("rank")).distinct()
    wanted = ranks.select(
        *group, "rank", F.lit(0).cast("long").alias("prefix"), F.col("rank").alias("within")
    )
    wanted = written_table(_located(counted, wanted, group), "ranks")
    bits = DIGITS[0]
    for digit in DIGITS[1:]:
        if wanted.where(F.col("rows") > SORTED_ROWS).isEmpty():
            break
        buckets = wanted.select(*group, "prefix").distinct()
        inside = keyed.withColumn("prefix", prefix_of(bits)).join(buckets, [*group, "prefix"])
        bits += digit
        counted = inside.groupBy(*group, "prefix", prefix_of(bits).alias("digit")).agg(
            F.count(F.lit(1)).alias("rows")
        )
        wanted = written_table(_located(counted, wanted.drop("rows"), group), "ranks")
    buckets = wanted.select(*group, "prefix").distinct()
    tally = (
        keyed.withColumn("prefix", prefix_of(bits))
        .join(buckets, [*group, "prefix"])
        .groupBy(*group, "prefix", F.col("key").alias("digit"))
        .agg(F.count(F.lit(1)).alias("rows"), F.min("value").alias("value"))
    )
    # Whole keys are single values (or both zeros), so this ends the search.
    ordered = Window.partitionBy(*group, "prefix").orderBy("digit")
    upto = F.sum("rows").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = (
        tally.withColumn("upto", upto)
        .join(wanted.drop("rows"), [*group, "prefix"])
        .where(
            (F.col("within") < F.col("upto")) & (F.col("within") >= F.col("upto") - F.col("rows"))
        )
        .select(*group, "rank", (F.col("value") + 0.0).alias("x"))
    )
    each = asked.select("*", F.explode(F.array_distinct(F.array("k0", "k1"))).alias("rank"))
    # Both ranks of a probability meet in one row; x1 is x0 where they are the same.
    pairs = each.join(found, [*group, "rank"]).groupBy(*group, "probability", "fraction").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1")
    )
    gap = F.when(F.col("fraction") > 0, (F.col("x1") - F.col("x0")) * F.col("fraction"))
    return pairs.select(
        *group, "probability", (F.col("x0") + F.coalesce(gap, F.lit(0.0))).alias("quantile")
    )


def quantile_row(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """One row: a map column per probability p<percent>, metric -> quantile.

    At most len(columns) x len(probabilities) values, whatever the data size.
    """
    found = exact_quantiles(df, columns, probabilities)
    maps = [
        F.map_from_entries(
            F.array_compact(
                F.collect_list(
                    F.when(F.col("probability") == float(p), F.struct("metric", "quantile"))
                )
            )
        ).alias(percent_name(p))
        for p in probabilities
    ]
    return found.agg(*maps)


def percent_name(p: float) -> str:
    return f"p{p * 100:g}".replace(".", "_")
