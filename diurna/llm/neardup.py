"""Near-duplicate classes by BagMinHash signatures, banding and exact checks.

Texts are multisets of five-word shingles; two texts are near-duplicates if the
weighted Jaccard similarity of their multisets is 0.8 or more, and a class is a
connected component of such links. Exact copies are one node from the start.
Two nodes are candidates if they share a band of their signatures.

No group of candidates is ever listed pair by pair. First every node of a band
is checked against one pivot of the band, the node that shares bands with most
others. The links found make most large groups one component, and inside a
component further links change nothing. What remains are pairs of one band in
different components: those bands are cut into blocks of bounded size, each
pair of blocks is compared inside a task, and only links leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diurna.llm import bagminhash, text
from diurna.llm.graph import components
from diurna.session import ship_by_value, written_table

SHINGLE_WORDS = 5
SIMILARITY = 0.8
# 25 bands of 5: a pair at 0.8 shares no band once in 20,000 times.
COMPONENTS = 125
BANDS = 25
BLOCK_NODES = 400
TASK_ROWS = 5_000
# Signatures that agree this much less than the threshold (over 5 standard
# errors) need no exact comparison.
SIGNATURE_SLACK = 0.2


def _bags(batch_texts: pa.Array):
    """Per chunk of rows: (low, high, rows, elements, counts) of their shingles."""
    data, offsets = text.text_buffer(batch_texts)
    for low, high in text.chunks(offsets):
        part, edges = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        starts, ends, first = text.word_spans(part, edges)
        words = text.word_hashes(part, starts, ends)
        rows, hashes = text.shingles(words, first, SHINGLE_WORDS)
        yield (low, high, *bagminhash.bags(rows, hashes))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, bands): NULL bands for a text without words."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands: list = []
            for low, high, rows, elements, counts in _bags(batch.column(2)):
                signature = bagminhash.signatures(rows, elements, counts, high - low, COMPONENTS)
                some = np.bincount(rows, minlength=high - low) > 0
                keys = bagminhash.band_keys(signature, BANDS)
                bands += [k if s else None for k, s in zip(keys, some)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "bands"],
            )

    given = docs.select(F.col("doc_id").cast("long"), F.md5("text").alias("text_key"), "text")
    return given.mapInArrow(sketch, "doc_id long, text_key string, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough, compared in full."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for column in (2, 3):
                # Pairs come ordered by b, so equal texts are mostly neighbours.
                encoded = batch.column(column).dictionary_encode()
                bags: list = []
                for low, high, rows, elements, counts in _bags(encoded.dictionary):
                    cut = np.searchsorted(rows, np.arange(high - low + 1))
                    bags += [
                        (elements[x:y], counts[x:y]) for x, y in zip(cut[:-1], cut[1:])
                    ]
                sides.append((bags, encoded.indices.to_numpy(zero_copy_only=False)))
            (left, i), (right, j) = sides
            close = [
                bagminhash.similarity(left[x], right[y]) >= SIMILARITY for x, y in zip(i, j)
            ]
            mask = pa.array(close, pa.bool_())
            yield batch.select(["a", "b"]).filter(mask)

    both = pairs.join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a").join(
        texts.withColumnsRenamed({"id": "b", "text": "text_b"}), "b"
    )
    return both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def pivot_pairs(members: DataFrame) -> DataFrame:
    """(a, b): each node of a band with the band's pivot, each pair once."""
    popular = members.groupBy("node").agg(F.sum("size").alias("popular"))
    pivots = (
        members.join(popular, "node")
        .groupBy("band")
        .agg(F.max(F.struct("popular", (-F.col("node")).alias("last"))).alias("best"))
        .select("band", (-F.col("best.last")).alias("b"))
    )
    return (
        members.join(pivots, "band")
        .where(F.col("node") != F.col("b"))
        .select(F.col("node").alias("a"), "b")
        .distinct()
    )


def _compare(block: pd.DataFrame) -> list[tuple[int, int]]:
    """Links between nodes of different components in one pair of blocks."""
    block = block.sort_values("node").reset_index(drop=True)
    low, high = block["low"].iloc[0], block["high"].iloc[0]
    side = block["block"].to_numpy()
    left, right = np.flatnonzero(side == low), np.flatnonzero(side == high)
    component = block["component"].to_numpy()
    pair = component[left][:, None] != component[right][None, :]
    if low == high:
        pair &= left[:, None] < right[None, :]
    if not pair.any():
        return []
    signature = np.stack([np.frombuffer(s, np.uint8) for s in block["signature"]])
    bands = np.stack([np.asarray(b) for b in block["bands"]])
    band = block["band"].iloc[0]
    x, y = np.nonzero(pair)
    x, y = left[x], right[y]
    links = []
    bags = [np.frombuffer(b, np.uint32) for b in block["bag"]]
    sizes = np.array([len(b) for b in bags])
    for at in range(0, len(x), 50_000):
        i, j = x[at : at + 50_000], y[at : at + 50_000]
        agree = (signature[i] == signature[j]).mean(axis=1) >= SIMILARITY - SIGNATURE_SLACK
        agree &= np.minimum(sizes[i], sizes[j]) >= SIMILARITY * np.maximum(sizes[i], sizes[j]) - 1
        i, j = i[agree], j[agree]
        # A pair that shares several bands is compared in the first of them.
        same = bands[i] == bands[j]
        here = bands[i, same.argmax(axis=1)] == band
        for p, q in zip(i[here], j[here]):
            a, b = bags[p], bags[q]
            both = int(np.isin(a, b, assume_unique=True).sum())
            # Short hashes can only add agreement, so nothing is missed here.
            if both >= SIMILARITY * (len(a) + len(b) - both) - 1:
                links.append((int(block["node"][p]), int(block["node"][q])))
    return links


def _with_bags(texts: DataFrame) -> DataFrame:
    """(id, signature, bag): one byte per component, four per shingle."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signatures, bags = [], []
            for low, high, rows, elements, counts in _bags(batch.column(1)):
                signature = bagminhash.signatures(rows, elements, counts, high - low, COMPONENTS)
                signatures += [s.tobytes() for s in signature.astype(np.uint8)]
                # The n-th copy of a shingle is an element of its own.
                nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                each = text.mixed(np.repeat(elements, counts) + nth.astype(np.uint64))
                cut = np.concatenate([[0], np.cumsum(np.bincount(rows, counts, high - low))])
                short = (each >> np.uint64(32)).astype(np.uint32)
                bags += [
                    np.unique(short[int(u) : int(v)]).tobytes() for u, v in zip(cut[:-1], cut[1:])
                ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(signatures, pa.binary()),
                    pa.array(bags, pa.binary()),
                ],
                ["node", "signature", "bag"],
            )

    return texts.select("id", "text").mapInArrow(
        describe, "node long, signature binary, bag binary"
    )


def remaining_links(members: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame):
    """Candidate links between different components that share a band."""
    labelled = members.join(labels, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    mixed = (
        labelled.groupBy("band")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where(F.col("low") != F.col("high"))
        .select("band")
    )
    blocks = F.ceil(F.col("size") / BLOCK_NODES).cast("int")
    placed = labelled.join(mixed, "band").withColumn(
        "block", F.pmod(F.xxhash64("node"), blocks).cast("int")
    )
    placed = placed.select(
        "band", "node", "component", "block",
        F.explode(F.sequence(F.lit(0), blocks - 1)).alias("partner"),
    )
    placed = written_table(
        placed.select(
            "band", "node", "component", "block",
            F.least("block", "partner").alias("low"), F.greatest("block", "partner").alias("high"),
        ),
        "blocks",
    )
    tasks = max(1, -(-placed.count() // TASK_ROWS))
    described = placed.join(_with_bags(texts), "node").join(
        nodes.select("node", "bands"), "node"
    )
    group = F.pmod(F.xxhash64("band", "low", "high"), F.lit(tasks)).cast("int")

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        links = [
            link
            for _, block in rows.groupby(["band", "low", "high"], sort=False)
            for link in _compare(block)
        ]
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return described.withColumn("task", group).groupBy("task").applyInPandas(
        search, "a long, b long"
    ).distinct()


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id): one row per row of ``docs``, class_id its smallest doc_id.

    A text without words, NULL or empty, is alone in its class, and a text of
    fewer than five words is one shingle. A repeated doc_id is one document: its
    rows share a class. A NULL doc_id gets a NULL class. Other columns are
    ignored, and an empty table gives no rows.
    """
    drawn = written_table(sketches(docs), "sketches")
    worded = drawn.where(F.col("bands").isNotNull() & F.col("doc_id").isNotNull())
    nodes = written_table(
        worded.groupBy("text_key").agg(
            F.min("doc_id").alias("node"), F.first("bands").alias("bands")
        ),
        "nodes",
    )
    keyed = nodes.select(F.explode("bands").alias("band"), "node")
    sizes = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    members = written_table(keyed.join(sizes, "band"), "band-members")
    texts = written_table(
        docs.select(F.col("doc_id").cast("long").alias("id"), "text")
        .join(members.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
        .dropDuplicates(["id"]),
        "band-texts",
    )
    links = written_table(verified(pivot_pairs(members), texts), "links")
    found = remaining_links(members, components(links), nodes, texts)
    more = written_table(verified(found, texts), "links")
    labels = components(links.unionByName(more))
    class_of = nodes.select("text_key", "node").join(labels, "node", "left").select(
        "text_key", F.coalesce("component", "node").alias("class_id")
    )
    classes = drawn.drop("bands").join(class_of, "text_key", "left")
    # Rows of one id share the smallest class of their texts.
    return classes.select(
        "doc_id",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
    )


ship_by_value(__name__)
