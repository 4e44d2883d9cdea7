"""From the event log to a split and folded study table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diurna.operators import sampling
from diurna.plans import eventlog, weekly
from diurna.schemas import CV_FOLDS, CV_SEED, FEATURES, SPLIT_SEED, TARGET
from diurna.session import written_table

IDS = ["child_id", "week_index"]
STRATA = ["age"]
TEST_FRACTION = 0.2
LATENTS = ["S", "U", "B", "F"]


def labelled_rows(events: DataFrame) -> DataFrame:
    """Features, target, stratum and latents of every child-week, stored once."""
    rows = eventlog.with_target(weekly.from_events(events)).select(
        *IDS,
        (6 + (F.col("child_id") - 1) % 7).cast("int").alias("age"),
        *FEATURES,
        TARGET,
        *[eventlog.latent(z).alias(z) for z in LATENTS],
    )
    return written_table(rows, "labelled")


def split_rows(rows: DataFrame) -> DataFrame:
    """A fifth of every age goes to test."""
    return sampling.stratified_split(rows, STRATA, IDS, SPLIT_SEED, test_fraction=TEST_FRACTION)


def folded_rows(development: DataFrame) -> DataFrame:
    return sampling.stratified_folds(development, STRATA, IDS, CV_FOLDS, CV_SEED)


def development_rows(events: DataFrame) -> DataFrame:
    """Development part with folds, stored once: every protocol reads it."""
    split = written_table(split_rows(labelled_rows(events)), "split")
    return written_table(
        folded_rows(split.where("split = 'development'").drop("split")), "folded"
    )
