"""Toxicity from character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed byte n-grams it contains, present or not. Each
feature is scaled by the log ratio of its smoothed shares among toxic and other
texts, and a linear classifier is fitted on the scaled features. Both learn from
a bounded sample of the labelled rows (``LEARN_ROWS`` per class, drawn by hash),
so the sample can be broadcast to the scan and no text is shuffled. Scoring adds
up one weight per distinct n-gram of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from diurna.llm import text
from diurna.session import ship_by_value, written_table

SIZES = (3, 4, 5)
BUCKET_BITS = 18
LEARN_ROWS = 8_000
FIT_ROWS = 2_000
SMOOTHING = 1.0
PENALTY = 0.2
STEPS = 100
# Features whose share differs by fewer standard errors than this weigh nothing.
MIN_ERRORS = 4.0


def buckets_by_row(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Distinct n-gram buckets of each row, in row order.

    N-grams run over bytes, so a letter outside ASCII counts as two or more; a
    row shorter than n has none of that size.
    """
    last = np.zeros(1 << BUCKET_BITS, np.int32)
    order = np.arange(1 << 16, dtype=np.int32)
    scramble, shift = np.uint64(0xD6E8FEB86659FD93), np.uint64(64 - BUCKET_BITS)
    for low, high in text.chunks(offsets):
        part = text.byte_values(data[offsets[low] : offsets[high]])
        edges = offsets[low : high + 1] - offsets[low]
        rolled, grams = part.copy(), []
        for size in range(2, max(SIZES) + 1):
            rolled = rolled[:-1] * scramble + part[size - 1 :]
            if size in SIZES:
                grams.append((text.mixed(rolled + np.uint64(size)) >> shift).astype(np.int32))
        for i in range(high - low):
            pieces = [
                g[edges[i] : max(edges[i], edges[i + 1] - n + 1)] for n, g in zip(SIZES, grams)
            ]
            own = np.concatenate(pieces)
            if len(own) > len(order):
                order = np.arange(2 * len(own), dtype=np.int32)
            places = order[: len(own)]
            # The last writer of a bucket is the one that counts it.
            last[own] = places
            yield own[last[own] == places]


def learning_sample(documents: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(share, toxic, text) of at most about ``rows`` labelled texts per class.

    ``labels`` has doc_id and toxic; a document labelled twice is toxic if any
    label says so. Ids are drawn by hash at the rate the class counts give.
    """
    classes = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .withColumn("__share", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30))
    )
    counts = classes.groupBy("toxic").agg(F.count(F.lit(1)).alias("__rows"))
    drawn = classes.join(F.broadcast(counts), "toxic").where(
        F.col("__share") * F.col("__rows") < rows
    )
    drawn = drawn.select(
        "doc_id", "toxic", (F.col("__share") * F.col("__rows")).alias("place"), "__rows"
    )
    # At most about 2 * rows ids, whatever the size of the tables.
    return documents.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select(
        "place", "toxic", "__rows", F.lower(F.coalesce("text", F.lit(""))).alias("text")
    )


def class_counts(sample: DataFrame):
    """pandas rows (bucket, toxic, other): texts of each class that have the n-gram."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False) > 0
            data, offsets = text.text_buffer(batch.column(0))
            for i, own in enumerate(buckets_by_row(data, offsets)):
                found[int(toxic[i]), own] += 1
        some = np.flatnonzero(found.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(found[1, some]), pa.array(found[0, some])],
            ["bucket", "toxic", "other"],
        )

    counted = sample.select("text", "toxic").mapInArrow(
        count, "bucket long, toxic long, other long"
    )
    return counted.groupBy("bucket").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other")
    ).toPandas()


def log_count_ratios(counts, texts: tuple[int, int]) -> np.ndarray:
    """Scale of every bucket; 0 where the classes do not differ clearly."""
    ratios = np.zeros(1 << BUCKET_BITS)
    toxic, other = counts["toxic"].to_numpy(float), counts["other"].to_numpy(float)
    p = (SMOOTHING + toxic) / (SMOOTHING * len(counts) + toxic.sum())
    q = (SMOOTHING + other) / (SMOOTHING * len(counts) + other.sum())
    a, b = toxic / max(1, texts[1]), other / max(1, texts[0])
    both = (toxic + other) / max(1, sum(texts))
    error = np.sqrt(both * (1 - both) * (1 / max(1, texts[0]) + 1 / max(1, texts[1]))) + 1e-12
    clear = np.abs(a - b) / error >= MIN_ERRORS
    ratios[counts["bucket"].to_numpy()] = np.where(clear, np.log(p / q), 0.0)
    return ratios


def fit_linear(features: list[np.ndarray], toxic: np.ndarray, ratios: np.ndarray):
    """(weights by bucket, intercept) of a logistic fit on scaled presences."""
    sizes = np.array([len(f) for f in features])
    index = np.concatenate([*features, np.zeros(0, np.int64)]).astype(np.int64)
    used, column = np.unique(index, return_inverse=True)
    scale = ratios[used]
    value = scale[column]
    row = np.repeat(np.arange(len(features)), sizes)
    target = toxic.astype(float)
    # Each class weighs one half, whatever its size.
    weight = np.where(toxic, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (~toxic).sum()))
    # Accelerated descent; each coordinate steps by a bound on its curvature.
    size = np.abs(value)
    total = np.bincount(row, size, len(features)) + 1.0
    penalty = PENALTY / len(features)
    rate = 1.0 / (0.25 * np.bincount(column, size * (weight * total)[row], len(used)) + penalty)
    bias_rate = 1.0 / (0.25 * (weight * total).sum())
    w, bias = np.zeros(len(used)), 0.0
    ahead_w, ahead_b, pace = w, bias, 1.0
    for _ in range(STEPS):
        margin = np.bincount(row, value * ahead_w[column], len(features)) + ahead_b
        residual = weight * (1.0 / (1.0 + np.exp(-margin)) - target)
        slope = np.bincount(column, value * residual[row], len(used)) + penalty * ahead_w
        new_w, new_b = ahead_w - rate * slope, ahead_b - bias_rate * residual.sum()
        new_pace = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        momentum = (pace - 1) / new_pace
        ahead_w, ahead_b = new_w + momentum * (new_w - w), new_b + momentum * (new_b - bias)
        w, bias, pace = new_w, new_b, new_pace
    weights = np.zeros(len(ratios))
    weights[used] = w * scale
    return weights, bias


@dataclass
class Classifier:
    weights: np.ndarray
    intercept: float


def train(
    documents: DataFrame,
    labels: DataFrame,
    learn_rows: int = LEARN_ROWS,
    fit_rows: int = FIT_ROWS,
) -> Classifier:
    """Classifier learnt from ``labels`` (doc_id, toxic) on their documents' texts.

    NULL ids and labels are left out. Without a row of both classes the score is
    the same for every text.
    """
    sample = written_table(learning_sample(documents, labels, learn_rows), "toxicity-sample")
    sizes = {r["toxic"]: r for r in sample.groupBy("toxic").agg(
        F.count(F.lit(1)).alias("drawn"), F.first("__rows").alias("there")).collect()}
    if 0 not in sizes or 1 not in sizes:
        return Classifier(np.zeros(1 << BUCKET_BITS), -20.0 if 1 not in sizes else 20.0)
    ratios = log_count_ratios(class_counts(sample), (sizes[0]["drawn"], sizes[1]["drawn"]))
    useful = ratios != 0

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, toxic = [], []
        for batch in batches:
            data, offsets = text.text_buffer(batch.column(0))
            toxic.append(batch.column(1).to_numpy(zero_copy_only=False) > 0)
            features += [own[useful[own]] for own in buckets_by_row(data, offsets)]
        if features:
            weights, bias = fit_linear(features, np.concatenate(toxic), ratios)
            yield pa.RecordBatch.from_arrays(
                [pa.array([weights.tolist()]), pa.array([float(bias)])], ["weights", "bias"]
            )

    # A bounded number of rows, so one task can hold them.
    drawn = sample.where(F.col("place") < fit_rows).select("text", "toxic").repartition(1)
    found = drawn.mapInArrow(fit, "weights array<double>, bias double").collect()
    # The fit saw both classes as equally frequent; put the true odds back.
    odds = np.log(max(1, sizes[1]["there"]) / max(1, sizes[0]["there"]))
    return Classifier(np.array(found[0]["weights"]), float(found[0]["bias"] + odds))


def score(docs: DataFrame, model: Classifier, out: str = "score") -> DataFrame:
    """All columns of ``docs`` plus ``out``, 0 to 1; NULL text counts as empty."""
    kept = docs.drop(out)
    shared = text.sent_object(docs.sparkSession, model)
    columns = kept.columns
    width = len(columns)
    given = kept.withColumn("__lowered", F.lower("text"))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        weights, bias = model.weights, model.intercept
        for batch in batches:
            data, offsets = text.text_buffer(batch.column(width))
            margins = np.array([weights[b].sum() for b in buckets_by_row(data, offsets)])
            scores = 1.0 / (1.0 + np.exp(-np.clip(margins + bias, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(width)], pa.array(scores, pa.float64())],
                [*columns, out],
            )

    schema = StructType([*kept.schema.fields, StructField(out, DoubleType())])
    return given.mapInArrow(rate, schema)


ship_by_value(__name__)
