"""Check suites: named violations, counted in one aggregate pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = Mapping[str, Column]


def run_rules(df: DataFrame, rules: Rules) -> DataFrame:
    """One row per rule: check, failed_rows.

    A rule that cannot be decided because a value is missing is broken; a rule
    that allows missing values has to say so.
    """
    undecided = F.lit(True)
    row = df.agg(
        *[F.count_if(F.coalesce(broken, undecided)).alias(name) for name, broken in rules.items()]
    )
    entries = F.array(
        *[F.struct(F.lit(n).alias("check"), F.col(n).alias("failed_rows")) for n in rules]
    )
    return row.select(F.explode(entries).alias("e")).select("e.check", "e.failed_rows")


def violations(df: DataFrame, rules: Rules) -> DataFrame:
    """Rows that break at least one rule, with the names of all they break."""
    broken = F.array_compact(
        F.array(
            *[F.when(F.coalesce(cond, F.lit(True)), F.lit(name)) for name, cond in rules.items()]
        )
    )
    return df.withColumn("broken_rules", broken).where(F.size("broken_rules") > 0)


def count_rows(df: DataFrame, check: str) -> DataFrame:
    """A check whose failures are the rows of ``df``."""
    return df.agg(F.count(F.lit(1)).alias("failed_rows")).select(
        F.lit(check).alias("check"), "failed_rows"
    )


def constant(spark, check: str, failed: int) -> DataFrame:
    """A check on the schema, known before any row is read."""
    return spark.range(1).select(
        F.lit(check).alias("check"), F.lit(failed).cast("long").alias("failed_rows")
    )


def duplicate_check(df: DataFrame, keys: Sequence[str], check: str) -> DataFrame:
    """Failures are keys that occur more than once."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return count_rows(repeated, check)


def suite(parts: Sequence[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def require(report: DataFrame) -> None:
    """Raise AssertionError naming every failed check (runs a job)."""
    failed = [(r["check"], r["failed_rows"]) for r in report.where("failed_rows > 0").collect()]
    if failed:
        raise AssertionError("failed checks: " + ", ".join(f"{c} ({n})" for c, n in failed))
