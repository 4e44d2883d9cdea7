"""Deterministic pseudo-random values: md5 of 'seed:part:part...'.

The same text hashes the same in every engine and on every retry of a task, so
a split does not change when an executor is lost, unlike ``rand()``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(seed: int | str, *parts: Column) -> Column:
    """32 hex digits of md5('seed:part:...')."""
    return hash_text(F.lit(str(seed)), *[p.cast("string") for p in parts])


def hash_text(*parts: Column) -> Column:
    """32 hex digits of md5('part:part:...')."""
    return F.md5(F.concat_ws(":", *parts))


def hex_prefix(key: Column, digits: int) -> Column:
    """Leading hex digits of a key as a number."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("long")


def unit_interval(key: Column) -> Column:
    """Number in [0, 1) from the first eight hex digits."""
    return hex_prefix(key, 8) / F.lit(4294967296.0)
