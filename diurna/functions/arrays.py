"""Array expressions: interest normalisation and set tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    A plain column reused inside a lambda is evaluated again per element; a
    lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalise_terms(terms: Column) -> Column:
    """Trimmed, lower-cased, blank-free, distinct terms; NULL becomes empty."""
    cleaned = F.transform(terms, lambda t: F.lower(F.trim(t)))
    kept = F.filter(cleaned, lambda t: t.isNotNull() & (t != ""))
    return F.coalesce(F.array_distinct(kept), F.array().cast("array<string>"))


def is_subset(left: Column, right: Column) -> Column:
    return F.size(F.array_except(left, right)) == 0


def has_duplicates(items: Column) -> Column:
    return F.size(F.array_distinct(items)) < F.size(items)
