"""Exact removal of repeated byte strings by suffix order.

A string of ``SPAN`` bytes that starts at two places goes wherever it stands.
Texts are first cut into blocks: consecutive windows whose least 32-byte mer, the
anchor, is the same. Equal windows have equal anchors at equal distance, so a
window can only repeat among the blocks of one anchor, and an anchor that stands
once needs no further look. Equal blocks are counted; a block that stands twice
is repeated as a whole.

What is left are different blocks at one anchor. They are laid above each other,
aligned at the anchor; stretches too short to hold a window between bytes that
nobody shares fall away, and neighbouring columns in which the same blocks agree
become one symbol. The suffixes of these short strings are sorted by linear
grouping (``suffix``), and a suffix's longest match is with a neighbour in that
order: it tells how far the bytes from there on repeat elsewhere.

An anchor with very many different blocks (the edge of a passage that very many
texts share) would be one large task, so its blocks are split. Equal windows stand
at equal distance before the anchor: the distances are halved, each half keeps the
bytes its windows need, and those that all its windows share name the part. Equal
stretches of a part are counted and become one; parts that are still large are
split again, and the others sorted like any anchor's blocks. After nine halvings a
stretch is one window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diurna.llm import suffix, text
from diurna.llm.debruijn import blocks_at_repeated_anchors
from diurna.session import ship_by_value, written_table

SPAN = 400
ANCHOR_BYTES = 32
# A part with more different blocks than this is split before it is sorted.
PART_BLOCKS = 2_000
TASK_BLOCKS = 4_000
SORT_BLOCKS = 1_000

RANGES = "array<struct<low:int,high:int>>"


def byte_blocks(data: np.ndarray, edges: np.ndarray, span: int = SPAN):
    """Blocks of consecutive windows that share an anchor, in text order.

    Returns (row, anchor, block, start, count, lead): ``start`` counts bytes of
    the row, ``lead`` from the first window's start to the anchor.
    """
    size = min(ANCHOR_BYTES, span)
    counts = np.maximum(np.diff(edges) - span + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    if not len(rows):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none
    at = np.arange(len(rows)) - (np.cumsum(counts) - counts)[rows] + edges[:-1][rows]
    prefix = text.prefix_hash(text.byte_values(data), "byte")
    places = np.arange(len(data) - size + 1)
    mers = text.span_hash(prefix, places, places + size, "byte")
    anchor = text.leftmost_minimum(mers, span - size + 1)[at]
    begin = np.ones(len(at), bool)
    begin[1:] = (anchor[1:] != anchor[:-1]) | (rows[1:] != rows[:-1])
    head = np.flatnonzero(begin)
    count = np.diff(np.append(head, len(at)))
    low = at[head]
    lead = anchor[head] - low
    content = text.span_hash(prefix, low, low + count - 1 + span, "byte")
    block = text.mixed(content ^ ((count << 32) + lead).astype(np.uint64))
    return (
        rows[head],
        mers[anchor[head]].view(np.int64),
        block.view(np.int64),
        low - edges[:-1][rows[head]],
        count,
        lead,
    )


def document_blocks(keyed: DataFrame, span: int = SPAN) -> DataFrame:
    """(key, anchor, block, start, count) of every block of (key, text) rows."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            data, offsets = text.text_buffer(batch.column(1))
            for low, high in text.chunks(offsets):
                row, anchor, block, start, count, _ = byte_blocks(
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


def block_contents(sources: DataFrame, texts: DataFrame, span: int = SPAN) -> DataFrame:
    """(anchor, block, copies, kinds, lead, content) read from each block's source."""
    wanted = sources.groupBy("key").agg(
        F.collect_list(F.struct("block", "copies", "kinds")).alias("blocks")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for blocks, data in zip(batch.column(0).to_pylist(), text.unpacked(batch.column(1))):
                data = data or b""
                sought = {b["block"]: b for b in blocks}
                _, anchor, block, start, count, lead = byte_blocks(
                    np.frombuffer(data, np.uint8), np.array([0, len(data)]), span
                )
                for a, b, s, n, d in zip(
                    *[v.tolist() for v in (anchor, block, start, count, lead)]
                ):
                    # Taken once, should the document hold several copies.
                    found = sought.pop(b, None)
                    if found:
                        rows.append(
                            (a, b, found["copies"], found["kinds"], d, data[s : s + n - 1 + span])
                        )
            if rows:
                names = ["anchor", "block", "copies", "kinds", "lead", "content"]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.array(c, pa.int64()) for c in list(zip(*rows))[:4]],
                        pa.array([r[4] for r in rows], pa.int32()),
                        pa.array([r[5] for r in rows], pa.binary()),
                    ],
                    names,
                )

    return (
        texts.join(wanted, "key")
        .select("blocks", "packed")
        .mapInArrow(
            read,
            "anchor long, block long, copies long, kinds long, lead int, content binary",
        )
    )


def _long_stretches(cells: np.ndarray, span: int) -> np.ndarray:
    """Cells that stand in a row's stretch of at least ``span`` set cells."""
    rows, width = cells.shape
    flat = np.zeros(rows * (width + 1) + 1, np.int8)
    flat[1:].reshape(rows, width + 1)[:, :width] = cells
    change = np.diff(flat)
    begin, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    if len(end) < len(begin):
        end = np.append(end, len(change))
    long = end - begin >= span
    steps = np.zeros(len(change) + 1, np.int8)
    steps[begin[long]] = 1
    steps[end[long]] -= 1
    return np.cumsum(steps[:-1], dtype=np.int8).astype(bool).reshape(rows, width + 1)[:, :width]


def shared_cells(table: np.ndarray, there: np.ndarray, span: int) -> np.ndarray:
    """Cells that may lie in a string of ``span`` bytes which two rows have in place.

    A byte nobody else has in its column ends every match, so shorter stretches
    between such bytes fall away, and with them the company they gave to others,
    until nothing changes.
    """
    rows, width = table.shape
    active = _long_stretches(there, span)
    columns = np.arange(width)
    while active.any():
        if rows <= 16:
            company = np.zeros((rows, width), np.int8)
            for other in range(rows):
                company += (table == table[other]) & active[other]
        else:
            key = table.astype(np.int32) * np.int32(width) + columns.astype(np.int32)
            counts = np.bincount(key[active], minlength=256 * width).astype(np.int32)
            company = counts[key]
        less = _long_stretches(active & (company > 1), span)
        if (less == active).all():
            break
        active = less
    return active


def aligned_symbols(leads: np.ndarray, contents: list[bytes], span: int):
    """(labels, starts, base): the blocks of one anchor as short strings.

    Column runs begin at ``starts`` (bytes from ``base``, which is before every
    content); labels[i, r] is the first block that agrees with block i over run
    r, or -1 where no window of block i that is worth looking at has a byte.
    """
    lead = int(leads.max())
    sizes = np.array([len(c) for c in contents])
    width = int((lead - leads + sizes).max())
    rows = len(contents)
    table = np.zeros((rows, width), np.uint8)
    there = np.zeros((rows, width), bool)
    for i, content in enumerate(contents):
        at = lead - leads[i]
        table[i, at : at + sizes[i]] = np.frombuffer(content, np.uint8)
        there[i, at : at + sizes[i]] = True
    active = shared_cells(table, there, span)
    if not active.any():
        return None
    first = np.zeros((256, width), np.int32)
    columns = np.arange(width)
    for i in np.flatnonzero(active.any(axis=1))[::-1]:
        own = columns[active[i]]
        first[table[i, own], own] = i
    labels = np.where(active, first[table, columns], -1)
    change = np.ones(width, bool)
    change[1:] = (labels[:, 1:] != labels[:, :-1]).any(axis=0)
    starts = np.flatnonzero(change)
    return labels[:, starts], np.append(starts, width), lead


def _match_lengths(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Longest match of each suffix with another, in symbols; 0 ends a match.

    One linear pass in text order: the match of the next suffix with its
    neighbour is at most one symbol shorter.
    """
    size = len(symbols)
    values = [*symbols.tolist(), 0]
    rank = np.empty(size, np.int64)
    rank[order] = np.arange(size)
    before = np.full(size, -1, np.int64)
    before[order[1:]] = order[:-1]
    match, here = [0] * (size + 1), 0
    for i, (r, j) in enumerate(zip(rank.tolist(), before.tolist())):
        if j < 0:
            here = 0
            continue
        while values[i + here] and values[i + here] == values[j + here]:
            here += 1
        match[r] = here
        if here:
            here -= 1
    both = np.array(match, np.int64)
    longest = np.zeros(size, np.int64)
    longest[order] = np.maximum(both[:-1], both[1:])
    return longest


def repeated_ranges(groups: list[tuple[np.ndarray, list[bytes], np.ndarray]], span: int):
    """Per group and block: [(low, high)] of windows that stand in another block.

    ``groups`` holds (leads, contents, counts). All groups are sorted together;
    their symbols are disjoint.
    """
    laid, parts, ahead = [], [], 1
    for leads, contents, counts in groups:
        symbols = aligned_symbols(leads, contents, span)
        if symbols is None:
            laid.append(None)
            continue
        labels, starts, lead = symbols
        rows, runs = labels.shape
        # One 0 behind every stretch parts it from the next.
        some = np.zeros((rows, runs + 1), bool)
        some[:, :runs] = labels >= 0
        keep = some.copy()
        keep[:, 1:] |= some[:, :-1]
        tagged = np.zeros((rows, runs + 1), np.int64)
        tagged[:, :runs] = np.where(some[:, :runs], ahead + labels + np.arange(runs) * rows, 0)
        ahead += rows * runs
        laid.append((some, keep, starts, lead, leads, counts))
        parts.append(tagged[keep])
    if not parts:
        return [[[] for _ in contents] for _, contents, _ in groups]
    symbols = np.concatenate(parts)
    longest = _match_lengths(symbols, suffix.suffix_order(symbols))
    out, at = [], 0
    for (_, contents, _), group in zip(groups, laid):
        found: list[list[tuple[int, int]]] = [[] for _ in contents]
        out.append(found)
        if group is None:
            continue
        some, keep, starts, lead, leads, counts = group
        size = int(keep.sum())
        reach = np.zeros(keep.shape, np.int64)
        reach[keep] = longest[at : at + size]
        at += size
        block, run = np.nonzero(some & (reach > 0))
        # Bytes that repeat from a window start in a run end where its match ends.
        offset = lead - leads[block]
        low = np.maximum(starts[run] - offset, 0)
        upto = starts[run + reach[block, run]] - span + 1
        high = np.minimum(np.minimum(starts[run + 1], upto) - offset, counts[block])
        good = low < high
        block, low, high = block[good], low[good], high[good]
        if not len(block):
            continue
        # Ranges that touch become one.
        far = np.maximum.accumulate(block * (1 << 32) + high) - block * (1 << 32)
        fresh = np.ones(len(block), bool)
        fresh[1:] = (block[1:] != block[:-1]) | (low[1:] > far[:-1])
        begin = np.flatnonzero(fresh)
        last = np.append(begin[1:], len(block)) - 1
        for i, x, y in zip(block[begin].tolist(), low[begin].tolist(), far[last].tolist()):
            found[i].append((x, y))
    return out


def sorted_groups(pieces: DataFrame, span: int = SPAN) -> DataFrame:
    """(block, ranges) of single pieces, by suffix order among their group's pieces.

    ``pieces``: grp, block, low (its first window's number in the block), copies,
    lead, content. A group has at most ``PART_BLOCKS`` of them.
    """
    tasks = max(1, -(-pieces.count() // TASK_BLOCKS))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        names: list[int] = []
        ranges: list[list] = []
        waiting: list = []
        size = 0

        def settle() -> None:
            found = repeated_ranges([w[0] for w in waiting], span)
            for (_, blocks, lows, copies), spans in zip(waiting, found):
                for block, low, n, own in zip(blocks, lows, copies, spans):
                    if n == 1 and own:
                        names.append(block)
                        ranges.append([{"low": low + a, "high": low + b} for a, b in own])

        for _, group in rows.sort_values(["block", "low"]).groupby("grp", sort=True):
            if len(group) < 2:
                continue
            contents = group["content"].tolist()
            leads = group["lead"].to_numpy(np.int64)
            counts = np.array([len(c) - span + 1 for c in contents])
            waiting.append(
                ((leads, contents, counts), group["block"], group["low"], group["copies"])
            )
            size += len(contents)
            if size > SORT_BLOCKS:
                settle()
                waiting, size = [], 0
        if waiting:
            settle()
        return pd.DataFrame(
            {"block": pd.Series(names, dtype="int64"), "ranges": pd.Series(ranges, dtype="object")}
        )

    task = F.pmod(F.xxhash64("grp"), F.lit(tasks)).cast("int")
    return (
        pieces.withColumn("task", task)
        .groupBy("task")
        .applyInPandas(search, f"block long, ranges {RANGES}")
    )


PIECE = "grp long, block long, low int, copies long, lead int, content binary"


def halved(pieces: DataFrame, bit: int, span: int = SPAN) -> DataFrame:
    """Each piece cut where bit ``bit`` of its windows' distance to the anchor changes.

    The group of a cut piece tells the old group, the range of distances, and the
    bytes around the anchor that every window of that range has.
    """
    most = span - min(ANCHOR_BYTES, span)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for grp, block, low, copies, lead, content in zip(
                *[batch.column(i).to_pylist() for i in range(6)]
            ):
                last = lead - (len(content) - span)
                far = lead
                while far >= last:
                    # Windows whose distance has these upper bits.
                    near = max(last, far >> bit << bit)
                    begin = lead - far
                    own = content[begin : begin + far - near + span]
                    upper = min(most, (far >> bit << bit) + (1 << bit) - 1)
                    lower = far >> bit << bit
                    shared = content[lead - lower : lead - upper + span]
                    name = hashlib.blake2b(
                        f"{grp} {lower} ".encode() + shared, digest_size=8
                    ).digest()
                    rows.append(
                        (int.from_bytes(name, "big", signed=True), block, low + begin, copies,
                         far, own)
                    )
                    far = near - 1
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["grp", "block", "low", "copies", "lead", "content"],
            )

    columns = ("grp", "block", "low", "copies", "lead", "content")
    return pieces.select(*columns).mapInArrow(cut, PIECE)


def _by_size(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pieces of groups that can be sorted, pieces of larger groups)."""
    sizes = pieces.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    large = written_table(sizes.where(F.col("size") > PART_BLOCKS).select("grp"), "large")
    return pieces.join(large, "grp", "left_anti"), pieces.join(large, "grp", "left_semi")


def repeated_windows(blocks: DataFrame, texts: DataFrame, span: int = SPAN) -> DataFrame:
    """(block, ranges): which windows of each block start at another place as well."""
    found = blocks_at_repeated_anchors(blocks)
    branching = found.where(F.col("kinds") > 1)
    pieces = written_table(
        block_contents(branching, texts, span).select(
            F.col("anchor").alias("grp"),
            "block",
            F.lit(0).alias("low"),
            "copies",
            "lead",
            "content",
        ),
        "block-contents",
    )

    def whole(rows: DataFrame, low, high) -> DataFrame:
        ranges = F.array(F.struct(low.alias("low"), high.alias("high"))).cast(RANGES)
        return rows.select("block", ranges.alias("ranges"))

    repeated = whole(found.where(F.col("copies") > 1), F.lit(0), F.col("count"))
    for bit in reversed(range(span.bit_length())):
        usual, large = _by_size(pieces)
        repeated = repeated.unionByName(sorted_groups(usual, span))
        if large.isEmpty():
            break
        parts = written_table(
            halved(large, bit, span).withColumn("stretch", F.xxhash64("lead", "content")), "parts"
        )
        once = written_table(
            parts.groupBy("grp", "stretch").agg(
                F.sum("copies").alias("stands"),
                F.min("block").alias("block"),
                F.max("low").alias("low"),
                F.first("lead").alias("lead"),
                F.first("content").alias("content"),
            ),
            "stretches",
        )
        # A stretch that stands twice is repeated wherever it is not known yet.
        twice = once.where(F.col("stands") > 1).select("grp", "stretch")
        again = parts.where(F.col("copies") == 1).join(twice, ["grp", "stretch"], "left_semi")
        end = F.col("low") + F.length("content") - span + 1
        repeated = repeated.unionByName(whole(again, F.col("low"), end))
        pieces = once.withColumnRenamed("stands", "copies").drop("stretch")
    return repeated


def kept_bytes(data: bytes, spans: list, span: int) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, runs removed) of one text."""
    change = np.zeros(len(data) + 1, np.int64)
    for start, ranges in spans:
        low = np.array([start + r["low"] for r in ranges])
        high = np.array([start + r["high"] - 1 + span for r in ranges])
        np.add.at(change, low, 1)
        np.add.at(change, high, -1)
    gone = np.cumsum(change)[:-1] > 0
    runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    left = np.frombuffer(data, np.uint8)[~gone].tobytes()
    return left, len(data) - len(left), runs


def remove_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """All columns of ``docs`` plus kept, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of ``span`` bytes that covers it also starts
    elsewhere, in the same or another row; matches never cross rows. ``kept`` is
    binary, since a cut may fall inside a character. A NULL text is empty, and stays NULL.
    Columns of ``docs`` with the names of the new ones are replaced.
    """
    added = ("kept", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    plain, names = text.set_aside(docs.drop(*added), "text")
    keyed = plain.withColumn("key", text.row_key(*plain.columns))
    # Read twice: finding the blocks costs far more than storing them.
    blocks = written_table(document_blocks(keyed, span), "document-blocks")
    texts = text.packed(keyed.select("key", "text"))
    ranges = repeated_windows(blocks, texts, span)
    spans = (
        blocks.select("key", "block", "start")
        .join(ranges, "block")
        .groupBy("key")
        .agg(F.collect_list(F.struct("start", "ranges")).alias("spans"))
    )
    others = [c for c in plain.columns if c != "text"]
    width = len(others)
    joined = text.packed(keyed).join(spans, "key", "left").select(*others, "packed", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text.unpacked(batch.column(width))
            rows = []
            for data, found in zip(texts, batch.column(width + 1).to_pylist()):
                data = data or b""
                left, gone, runs = data, 0, 0
                if found:
                    left, gone, runs = kept_bytes(
                        data, [(f["start"], f["ranges"]) for f in found], span
                    )
                rows.append((left, len(data), gone, runs, hashlib.sha256(left).hexdigest()))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(width)],
                    pa.array([None if t is None else t.decode() for t in texts], pa.string()),
                    pa.array(columns[0], pa.binary()),
                    *[pa.array(c, pa.int64()) for c in columns[1:4]],
                    pa.array(columns[4], pa.string()),
                ],
                [*others, "text", *added],
            )

    fields = "".join(f"`{n}` {plain.schema[n].dataType.simpleString()}, " for n in others)
    removed = joined.mapInArrow(
        remove,
        fields + "text string, kept binary, n_bytes long, n_removed long, n_spans long, "
        "kept_sha256 string",
    )
    return text.put_back(removed, names, added)


ship_by_value(__name__)
