"""Repeated spans of words by a compacted de Bruijn graph.

Edges are windows of ``SPAN`` words, and a window that starts at two places is a
repeated edge. Listing every edge would move each word's hash through the
network several times, so paths are compacted before anything is joined: the
least of the short k-mers inside a window is its anchor, windows that follow each
other and share an anchor form one block, and equal blocks are equal paths.

1. Blocks are counted. A repeated block is a nonbranching repeated path: all its
   windows are repeated edges.
2. Blocks are joined by anchor. An anchor that stands once has no repeated edge;
   equal windows have equal anchors, so nothing is lost. An anchor with several
   different blocks is where paths branch: only there one copy of each block is
   taken from its source and its windows are compared one by one.
3. The answer per block is joined back to the blocks' coordinates in the
   documents, overlapping edges merge into spans, and the words are removed.

A block is counted in two steps with map-side partial sums and joined by keys
that the adaptive skew join can split, so a passage in a third of all documents
stays spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diurna.llm import text
from diurna.session import ship_by_value, written_table

SPAN = 35
ANCHOR_WORDS = 8
# A block holds span - ANCHOR_WORDS + 1 windows at most. Its mask of 64 bits is made
# as 2^windows - 1, which fits without overflow up to 62 windows.
MAX_SPAN = ANCHOR_WORDS + 61


def word_blocks(data: np.ndarray, edges: np.ndarray, span: int = SPAN):
    """Blocks of consecutive windows that share an anchor, in text order.

    Returns (row, anchor, block, start, count, windows): per block its row, the
    hashes of its anchor and of its words, its first window's word number in the
    row and how many windows it has; and the hashes of all windows in order.
    """
    starts, ends, first = text.word_spans(data, edges)
    words = text.word_hashes(data, starts, ends)
    at, rows, windows = text.window_hashes(words, first, span)
    size = min(ANCHOR_WORDS, span)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, windows.view(np.int64)
    prefix = text.prefix_hash(words, "word")
    last = len(words) - size + 1
    mers = text.span_hash(prefix, np.arange(last), np.arange(last) + size, "word")
    anchor = text.leftmost_minimum(mers, span - size + 1)[at]
    begin = np.ones(len(at), bool)
    begin[1:] = (anchor[1:] != anchor[:-1]) | (rows[1:] != rows[:-1])
    head = np.flatnonzero(begin)
    count = np.diff(np.append(head, len(at)))
    low, high = at[head], at[head] + count - 1 + span
    content = text.span_hash(prefix, low, high, "word")
    # Length and place of the anchor belong to the path as well.
    block = text.mixed(content ^ ((count << 8) + anchor[head] - low).astype(np.uint64))
    return (
        rows[head],
        mers[anchor[head]].view(np.int64),
        block.view(np.int64),
        low - first[rows[head]],
        count,
        windows.view(np.int64),
    )


def document_blocks(keyed: DataFrame, span: int = SPAN) -> DataFrame:
    """(key, anchor, block, start, count) of every block of (key, text) rows."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            data, offsets = text.text_buffer(batch.column(1))
            for low, high in text.chunks(offsets):
                row, anchor, block, start, count, _ = word_blocks(
                    data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], span
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[low:high][row]),
                        pa.array(anchor),
                        pa.array(block),
                        pa.array(start.astype(np.int32)),
                        pa.array(count.astype(np.int32)),
                    ],
                    ["key", "anchor", "block", "start", "count"],
                )

    return keyed.select("key", "text").mapInArrow(
        find, "key long, anchor long, block long, start int, count int"
    )


def branching_windows(sources: DataFrame, texts: DataFrame, span: int = SPAN) -> DataFrame:
    """(window, block, place, copies) of one copy of each block in ``sources``.

    ``sources`` has key, block and copies; ``texts`` key and packed.
    """
    wanted = sources.groupBy("key").agg(
        F.collect_list("block").alias("blocks"), F.collect_list("copies").alias("copies")
    )

    def list_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blocks, copies, data in zip(
                batch.column(0).to_pylist(),
                batch.column(1).to_pylist(),
                text.unpacked(batch.column(2)),
            ):
                data = data or b""
                copies_of = dict(zip(blocks, copies))
                _, _, block, _, count, windows = word_blocks(
                    np.frombuffer(data, np.uint8), np.array([0, len(data)]), span
                )
                # One copy only, should the document hold several.
                names, where = np.unique(block, return_index=True)
                chosen = where[np.isin(names, np.array(blocks, np.int64))]
                ahead = np.cumsum(count) - count
                size = count[chosen]
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                own = np.repeat(block[chosen], size)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(windows[np.repeat(ahead[chosen], size) + place]),
                        pa.array(own),
                        pa.array(place.astype(np.int32)),
                        pa.array(
                            np.repeat([copies_of[b] for b in block[chosen].tolist()], size).astype(
                                np.int64
                            )
                        ),
                    ],
                    ["window", "block", "place", "copies"],
                )

    return (
        texts.join(wanted, "key")
        .select("blocks", "copies", "packed")
        .mapInArrow(list_windows, "window long, block long, place int, copies long")
    )


def blocks_at_repeated_anchors(blocks: DataFrame) -> DataFrame:
    """(block, anchor, copies, kinds, key, count): each different block once.

    Only blocks whose anchor stands more than once; ``kinds`` is the number of
    different blocks at the anchor, ``key`` a row that holds the block.
    """
    distinct = written_table(
        blocks.groupBy("block").agg(
            F.min("anchor").alias("anchor"),
            F.count(F.lit(1)).alias("copies"),
            F.min("key").alias("key"),
            F.min("count").alias("count"),
        ),
        "blocks",
    )
    anchors = (
        distinct.groupBy("anchor")
        .agg(F.sum("copies").alias("stands"), F.count(F.lit(1)).alias("kinds"))
        .where(F.col("stands") > 1)
        .drop("stands")
    )
    return written_table(distinct.join(anchors, "anchor"), "repeated-anchors")


def repeated_blocks(blocks: DataFrame, texts: DataFrame, span: int = SPAN) -> DataFrame:
    """(block, mask): bit i tells whether the block's i-th window is repeated."""
    found = blocks_at_repeated_anchors(blocks)
    windows = written_table(
        branching_windows(found.where(F.col("kinds") > 1), texts, span), "branching-windows"
    )
    repeated = (
        windows.groupBy("window").agg(F.sum("copies").alias("starts")).where(F.col("starts") > 1)
    )
    single = (
        windows.where(F.col("copies") == 1)
        .join(repeated.select("window"), "window", "left_semi")
        .groupBy("block")
        .agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("mask"))
    )
    whole = found.where(F.col("copies") > 1).select(
        "block", F.expr("shiftleft(1L, count) - 1").alias("mask")
    )
    return whole.unionByName(single)


def covered(size: int, starts: list[int], masks: list[int], span: int) -> np.ndarray:
    """Which of a row's words lie in a repeated window."""
    change = np.zeros(size + 1, np.int64)
    bits = np.arange(64, dtype=np.uint64)
    mask = np.array(masks, np.int64).view(np.uint64)
    which, bit = np.nonzero((mask[:, None] >> bits) & np.uint64(1))
    begin = np.array(starts, np.int64)[which] + bit.astype(np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + span, -1)
    return np.cumsum(change)[:-1] > 0


def remove_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """All columns of ``docs`` plus kept, n_words, n_removed and kept_sha256.

    A word goes if a window of ``span`` consecutive words that covers it also
    starts elsewhere, in the same or another row; rows that are repeated as a
    whole are copies like any other. ``kept`` is the remaining words joined by
    one space, kept_sha256 the hash of its UTF-8 bytes. A NULL text has no
    words and stays NULL; its kept is ''. Columns of ``docs`` with the names of
    the new ones are replaced. A span over ``MAX_SPAN`` raises a ValueError.
    """
    if span > MAX_SPAN:
        raise ValueError(f"span {span} is over {MAX_SPAN}")
    added = ("kept", "n_words", "n_removed", "kept_sha256")
    plain, names = text.set_aside(docs.drop(*added), "text")
    keyed = plain.withColumn("key", text.row_key(*plain.columns))
    blocks = document_blocks(keyed, span)
    texts = text.packed(keyed.select("key", "text"))
    masks = repeated_blocks(blocks, texts, span)
    spans = (
        blocks.select("key", "block", "start")
        .join(masks, "block")
        .groupBy("key")
        .agg(F.collect_set(F.struct("start", "mask")).alias("spans"))
    )
    others = [c for c in plain.columns if c != "text"]
    width = len(others)
    joined = text.packed(keyed).join(spans, "key", "left").select(*others, "packed", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, removed, digests = [], [], [], []
            texts = text.unpacked(batch.column(width))
            for data, spans in zip(texts, batch.column(width + 1).to_pylist()):
                words = (data or b"").split()
                left = words
                if spans:
                    gone = covered(
                        len(words), [s["start"] for s in spans], [s["mask"] for s in spans], span
                    )
                    left = [words[i] for i in np.flatnonzero(~gone)]
                rest = b" ".join(left)
                kept.append(rest.decode())
                sizes.append(len(words))
                removed.append(len(words) - len(left))
                digests.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(width)],
                    pa.array([None if t is None else t.decode() for t in texts], pa.string()),
                    pa.array(kept, pa.string()),
                    pa.array(sizes, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(digests, pa.string()),
                ],
                [*others, "text", *added],
            )

    fields = ", ".join(f"`{n}` {plain.schema[n].dataType.simpleString()}" for n in others)
    schema = (fields + ", " if fields else "") + (
        "text string, kept string, n_words long, n_removed long, kept_sha256 string"
    )
    return text.put_back(joined.mapInArrow(remove, schema), names, added)


ship_by_value(__name__)
