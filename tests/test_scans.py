"""Chunked scans against plain windows, with one key holding most rows."""

from __future__ import annotations

import hashlib
import math
import random
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from diurna.operators import joins, pairs, quantiles, sampling, scans


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    rows = [
        (1 if rng.random() < 0.7 else rng.randint(2, 9), i, rng.randint(0, 500), rng.random())
        for i in range(4000)
    ]
    return spark.createDataFrame(rows, "k long, id long, t int, v double").cache()


@pytest.mark.parametrize("how", ["sum", "max"])
@pytest.mark.parametrize("inclusive", [True, False])
def test_carried_scan_equals_window(skewed, how, inclusive):
    got = scans.carried_scan(
        skewed, ["k"], F.floor(F.col("t") / 50), ["t", "id"], {"got": (how, F.col("v"))}, inclusive
    )
    window = Window.partitionBy("k").orderBy("t", "id").rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    want = skewed.withColumn("want", getattr(F, how)("v").over(window))
    if how == "sum":
        want = want.withColumn("want", F.coalesce("want", F.lit(0.0)))
    both = got.join(want.select("id", "want"), "id")
    off = both.where(
        (F.col("got").isNull() != F.col("want").isNull()) | (F.abs(F.col("got") - F.col("want")) > 1e-9)
    )
    assert both.count() == 4000 and off.count() == 0


def test_running_index(skewed):
    got = scans.running_index(skewed, ["k"], F.col("t"), ["t", "id"], "i").collect()
    by_key = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.k, r.t, r.id)):
        by_key[r.k].append(r.i)
    assert all(v == list(range(1, len(v) + 1)) for v in by_key.values())


def test_allocation_sums_to_total(skewed):
    totals = skewed.select("k").distinct().withColumn("total", F.col("k") * 10.0)
    parts = scans.proportional_allocation(skewed, totals, ["k"], "v", "total", "a")
    sums = parts.groupBy("k").agg(F.sum("a").alias("s")).collect()
    assert all(r.s == pytest.approx(r.k * 10.0) for r in sums)


def test_hashed_rank_and_selection_agree(skewed):
    ranked = scans.hashed_rank(skewed, ["k"], ["id"], 5, "r")
    chosen = scans.first_by_hash(
        skewed, ["k"], ["id"], 5, F.floor(F.col("stratum_size") * 0.3), "first"
    )
    sizes = skewed.groupBy("k").agg(F.count("*").alias("n"))
    both = ranked.join(chosen.select("id", "first"), "id").join(sizes, "k")
    assert both.where("first <> (r <= floor(n * 0.3D))").count() == 0
    want = sorted(
        (hashlib.md5(f"5:{r.id}".encode()).hexdigest(), r.id) for r in skewed.where("k = 1").collect()
    )
    got = [r.id for r in ranked.where("k = 1").orderBy("r").collect()]
    assert got == [i for _, i in want]


@pytest.mark.parametrize("quota", [0, 1, 10**6])
def test_selection_edges(skewed, quota):
    chosen = scans.first_by_hash(skewed, ["k"], ["id"], 5, F.lit(quota).cast("long"), "first")
    sizes = {r.k: r.n for r in skewed.groupBy("k").agg(F.count("*").alias("n")).collect()}
    got = {r.k: r.n for r in chosen.groupBy("k").agg(F.count_if("first").alias("n")).collect()}
    assert chosen.count() == 4000
    assert got == {k: min(quota, n) for k, n in sizes.items()}


def test_folds_balance(skewed):
    folded = sampling.stratified_folds(skewed, ["k"], ["id"], 5, 42).collect()
    per = Counter((r.k, r.fold) for r in folded)
    for k in {r.k for r in folded}:
        counts = [per[(k, f)] for f in range(1, 6)]
        assert max(counts) - min(counts) <= 1
    total = Counter(r.fold for r in folded)
    assert max(total.values()) - min(total.values()) <= 1


def test_split_rejects_wrong_stratum_size(skewed):
    with pytest.raises(Exception, match="expected 200"):
        sampling.stratified_split(
            skewed, ["k"], ["id"], 42, test_rows=2, expected_size=200
        ).collect()


def test_fraction_subsamples(skewed):
    folded = sampling.stratified_folds(skewed, ["k"], ["id"], 3, 1).cache()
    drawn = sampling.fraction_subsamples(folded, ["k"], ["id"], [0.25, 1.0], 3, 1).collect()
    fold_of = {r.id: (r.k, r.fold) for r in folded.collect()}
    sizes = Counter((r.k, r.validation_fold, r.train_fraction) for r in drawn)
    assert all(fold_of[r.id][1] != r.validation_fold for r in drawn)
    for k in {k for k, _ in fold_of.values()}:
        for f in (1, 2, 3):
            n = sum(1 for kk, ff in fold_of.values() if kk == k and ff != f)
            assert sizes[(k, f, 1.0)] == n
            assert sizes[(k, f, 0.25)] == int(n * 0.25)


def brute_subsets(rows, fractions, k, seed):
    """{(fold, fraction): ids} of rows (id, stratum, fold)."""
    drawn = {}
    for v in range(1, k + 1):
        for part in fractions:
            chosen = set()
            for stratum in {s for _, s, _ in rows}:
                mine = [i for i, s, f in rows if s == stratum and f != v]
                mine.sort(
                    key=lambda i: hashlib.md5(f"{seed}:{v}:{round(part * 100)}:{i}".encode()).hexdigest()
                )
                chosen |= set(mine[: int(len(mine) * part)])
            drawn[v, part] = chosen
    return drawn


@pytest.mark.parametrize("widths", [(8.0, 64.0, float("inf")), (0.0, 0.01, float("inf"))])
def test_subsets_equal_brute_force(spark, monkeypatch, widths):
    """Also where the first guesses miss the cut."""
    monkeypatch.setattr(sampling, "CUT_WIDTHS", widths)
    rng = random.Random(4)
    strata = [None] * 3 + [7] * 900 + [i % 40 for i in range(300)] + [99]
    rows = [(i, s, rng.randint(1, 3)) for i, s in enumerate(strata)]
    folded = spark.createDataFrame(rows, "id long, s long, fold int")
    parts = [0.1, 0.5, 1.0]
    marked = sampling.with_subsets(folded, ["s"], ["id"], parts, 3, 11).collect()
    want = brute_subsets(rows, parts, 3, 11)
    assert len(marked) == len(rows)
    for bit, draw in enumerate(sampling.draws_of(parts, 3)):
        assert {r.id for r in marked if r.subsets >> bit & 1} == want[draw]
    listed = sampling.fraction_subsamples(folded, ["s"], ["id"], parts, 3, 11).collect()
    got = Counter((r.validation_fold, r.train_fraction) for r in listed)
    assert got == {d: len(ids) for d, ids in want.items() if ids}


def test_subsets_with_repeated_ids_and_without_rows(spark):
    """Rows of one id stay together; an empty table gives an empty table."""
    rows = [(1, 0, 1)] * 50 + [(i, 0, 2) for i in range(100, 110)]
    folded = spark.createDataFrame(rows, "id long, s long, fold int")
    marked = sampling.with_subsets(folded, ["s"], ["id"], [0.5], 2, 1).collect()
    assert len(marked) == 60
    assert len({r.subsets for r in marked if r.id == 1}) == 1
    none = sampling.with_subsets(folded.limit(0), ["s"], ["id"], [0.5, 1.0], 2, 1)
    assert none.count() == 0
    with pytest.raises(ValueError, match="do not fit"):
        sampling.draws_of([0.5] * 16, 4)


def test_one_huge_stratum_among_many_small_ones(spark, monkeypatch):
    """Slices follow the stratum's size; ranks and folds stay exact."""
    monkeypatch.setattr(scans, "SLICE_ROWS", 64)
    big, small = 20_000, 100_000
    df = spark.range(big + small).select(
        "id", F.when(F.col("id") < big, -1).otherwise(F.col("id")).alias("s")
    )
    folded = sampling.stratified_folds(df, ["s"], ["id"], 5, 3)
    sizes = folded.groupBy("fold").count().collect()
    assert [r["count"] for r in sizes] == [(big + small) // 5] * 5
    of_big = folded.where("s = -1").groupBy("fold").count().collect()
    assert [r["count"] for r in of_big] == [big // 5] * 5
    # The small strata follow each other: consecutive strata, consecutive folds.
    small_folds = {r.s: r.fold for r in folded.where("s > 0").collect()}
    assert all(small_folds[s] == (s % 5) + 1 for s in range(big, big + 500))
    sliced = scans._sliced(df, ["s"], F.md5(F.col("id").cast("string")))
    per = sliced.groupBy("s", "__slice").count().groupBy("s").agg(
        F.count(F.lit(1)).alias("slices"), F.max("count").alias("most")
    )
    assert per.where("s <> -1 AND slices <> 1").count() == 0
    hot = per.where("s = -1").first()
    assert hot.slices > 64 and hot.most <= 3 * 64


def test_bits_are_ordered_like_values(spark):
    rng = random.Random(8)
    values = [0.0, 5e-324, 1e-310, 2.2250738585072014e-308, 1.0, 2.0, 3.5, 1.7976931348623157e308]
    values += [2.0**k for k in range(-1074, 1024, 37)] + [float("inf")]
    values += [rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(300)]
    values += [math.nextafter(2.0**k, d) for k in range(-1000, 1000, 97) for d in (0, math.inf)]
    values += [-v for v in values]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = quantiles.with_ordered_bits(df, "v", "bits").collect()
    for r in rows:
        bits = struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
        assert r.bits == (-bits if r.v < 0 else bits)


@pytest.mark.parametrize("small", [100_000, 50, 1])
def test_exact_quantiles(spark, monkeypatch, small):
    """Buckets sorted after the first digit, after some, and after all of them."""
    monkeypatch.setattr(quantiles, "SORTED_ROWS", small)
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(size=3000), np.full(2000, 0.5), rng.exponential(size=3000)])
    flat = np.concatenate([np.full(7999, 3.0), [9.0]])
    df = spark.createDataFrame(
        [(float(a), float(b)) for a, b in zip(values, flat, strict=True)], "a double, b double"
    )
    probabilities = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    got = {
        (r.metric, r.probability): r.quantile
        for r in quantiles.exact_quantiles(df, ["a", "b"], probabilities).collect()
    }
    for name, data in (("a", values), ("b", flat)):
        for p in probabilities:
            assert got[(name, p)] == pytest.approx(np.quantile(data, p), abs=1e-12)


def test_quantiles_by_group_skip_missing(spark):
    df = spark.createDataFrame(
        [("x", 1.0), ("x", None), ("x", float("nan")), ("x", 4.0), ("y", 7.0), (None, 1.0)],
        "g string, v double",
    )
    got = {r.g: r.quantile for r in quantiles.exact_quantiles(df, ["v"], [0.5], ["g"]).collect()}
    assert got == {"x": 2.5, "y": 7.0}


def brute_pair(rows, width):
    best = None
    for i, (ia, ga, xa, sa) in enumerate(rows):
        for ib, gb, xb, sb in rows[i + 1 :]:
            if ga == gb and abs(xa - xb) <= width:
                a, b = sorted((ia, ib))
                key = (-abs(sa - sb), a, b)
                best = key if best is None or key < best else best
    return best


@pytest.mark.parametrize("case", range(12))
def test_best_contrast_pair_equals_brute_force(spark, case):
    rng = random.Random(case)
    spread = [2.0, 12.0, 60.0, 400.0][case % 4]
    rows = []
    for i in range(120):
        x = round(rng.uniform(0, spread), 1 if case % 3 else 4)
        rows.append((i, rng.choice([0.0, 0.5]), x, float(rng.randint(0, 5)) if case % 2 else rng.random()))
    df = spark.createDataFrame(rows, "id long, g double, x double, s double")
    got = pairs.best_contrast_pair(df, "g", "x", "s", "id", 3.0).collect()
    want = brute_pair(rows, 3.0)
    assert len(got) == 1
    assert (-got[0].difference, got[0].id_a, got[0].id_b) == want


def test_best_contrast_pair_only_at_the_edge(spark):
    rows = [(1, 0.0, 0.0, 1.0), (2, 0.0, 3.0, 5.0), (3, 0.0, 6.1, 9.0)]
    df = spark.createDataFrame(rows, "id long, g double, x double, s double")
    got = pairs.best_contrast_pair(df, "g", "x", "s", "id", 3.0).collect()
    assert [(r.id_a, r.id_b, r.difference) for r in got] == [(1, 2, 4.0)]
    alone = spark.createDataFrame(rows[:1], df.schema)
    assert pairs.best_contrast_pair(alone, "g", "x", "s", "id", 3.0).count() == 0


def test_as_of_includes_the_instant_itself(spark):
    probes = spark.createDataFrame(
        [(1, 10, "2024-01-01 10:00:00"), (1, 11, "2024-01-01 09:59:59"), (2, 12, "2024-01-02 00:00:00")],
        "k long, id long, at string",
    ).withColumn("at", F.col("at").cast("timestamp_ntz"))
    history = spark.createDataFrame(
        [(1, "2024-01-01 10:00:00", "b"), (1, "2023-12-31 10:00:00", "a")], "k long, t string, what string"
    ).withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = {
        r.id: (None if r["last"] is None else str(r["last"]), r.what)
        for r in joins.as_of(probes, history, ["k"], "at", "t", "last", ["what"]).collect()
    }
    assert got == {
        10: ("2024-01-01 10:00:00", "b"),
        11: ("2023-12-31 10:00:00", "a"),
        12: (None, None),
    }


def test_validated_join_rejects_duplicates(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, a string")
    right = spark.createDataFrame([(1, "x"), (2, "y")], "k long, b string")
    ok = joins.validated_join(left, right, ["k"], validate="many_to_one").collect()
    assert sorted((r.k, r.a, r.b) for r in ok) == [(1, "a", "x"), (1, "b", "x"), (2, "c", "y")]
    with pytest.raises(Exception, match="duplicate key"):
        joins.validated_join(left, right, ["k"], validate="one_to_one").count()
    with pytest.raises(Exception, match="duplicate key"):
        joins.validated_join(right, left, ["k"], validate="many_to_one").select("k").count()
    with pytest.raises(ValueError, match="duplicate key"):
        joins.require_unique(left, ["k"])


def test_complete_lookup_fails_on_gaps(spark):
    left = spark.createDataFrame([(1,), (3,)], "k long")
    right = spark.createDataFrame([(1, 5)], "k long, b long")
    with pytest.raises(Exception, match="without a match"):
        joins.complete_lookup(left, right, ["k"], ["b"]).collect()
