"""Best-two-fit packing of tokenized documents into fixed-length sequences.

Every document is tokenized once, inside the scan. A document longer than a
sequence is cut: the rest that is not a whole sequence comes first, then whole
sequences, which need no partner. What remains is at most one shorter piece per
document; pieces are dealt by a hash into groups of a bounded number of pieces,
and each group is packed on its own. A group wastes at most its last bins, so
the loss against one big group is a few bins in tens of thousands.

Tokenizing splits the text the way the byte-level vocabulary prescribes (letters,
digits, other signs, white space, English contractions), as array operations on
code points; the tokenizer itself encodes each distinct part once per Python worker.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diurna.llm import text
from diurna.session import ship_by_value, written_table

SEQUENCE_TOKENS = 2048
GROUP_PIECES = 200_000
KNOWN_PARTS = 1_500_000
CHUNK_POINTS = 1 << 20
SEQUENCES_PER_GROUP = 1 << 32

_LETTER, _DIGIT, _SIGN, _BLANK = 0, 1, 2, 3
# White space of the split rule beyond the categories Z*: fixed values.
_BLANK_CONTROLS = (9, 10, 11, 12, 13, 0x85)
# Contractions that are parts of their own, after an apostrophe: fixed values.
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _classes() -> np.ndarray:
    """Class of every code point under the split rule."""
    kinds = {"L": _LETTER, "N": _DIGIT, "Z": _BLANK}
    table = np.array(
        [kinds.get(unicodedata.category(chr(p))[0], _SIGN) for p in range(0x110000)], np.uint8
    )
    table[list(_BLANK_CONTROLS)] = _BLANK
    return table


def part_starts(points: np.ndarray, edges: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Positions where the parts of the split rule begin.

    ``edges`` are the rows' first positions. A run of letters, digits or signs
    is a part and takes one space before it along; of a longer run of white
    space the last character stands apart from the rest, unless the text ends.
    """
    size = len(points)
    kind = classes[points]
    row_start = np.zeros(size + 1, bool)
    row_start[edges] = True
    row_start[size] = True
    run = np.ones(size, bool)
    run[1:] = kind[1:] != kind[:-1]
    run |= row_start[:size]
    begin = run & (kind != _BLANK)
    blank = kind == _BLANK
    # A blank right before a part of the same row.
    leads = np.zeros(size, bool)
    leads[:-1] = blank[:-1] & ~blank[1:] & ~row_start[1:size]
    space_leads = leads & (points == 32)
    follows_space = np.zeros(size, bool)
    follows_space[1:] = space_leads[:-1]
    out = (begin & ~follows_space) | (run & blank) | leads
    # Contractions: a lone apostrophe that took no space along, then the letters.
    lone = begin & (points == 39) & ~follows_space
    lone[:-1] &= ~row_start[1:size] & (kind[1:] == _LETTER)
    lone[-1:] = False
    for at in np.flatnonzero(lone):
        tail = points[at + 1 : at + 3]
        for short in _CONTRACTIONS:
            stop = at + 1 + len(short)
            if stop > size or any(ord(c) != p for c, p in zip(short, tail)):
                continue
            if row_start[at + 1 : stop].any() or len(tail) < len(short):
                continue
            out[at + 1] = False
            if stop < size and kind[stop] == _LETTER and not row_start[stop]:
                out[stop] = True
            break
    return np.flatnonzero(out)


class Encoder:
    """Token ids of many texts at once, equal to the tokenizer's own.

    Distinct parts are kept as sorted keys next to one flat array of ids, so a
    lookup is a binary search over arrays and a part costs a few dozen bytes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.classes = _classes()
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of all texts, those of text i at bounds[i:i+2]."""
        odd = {
            i: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
            for i, t in enumerate(texts)
            if any(s in t for s in self.special)
        }
        plain = ["" if i in odd else t for i, t in enumerate(texts)] if odd else texts
        points = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
        edges = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in plain], out=edges[1:])
        if len(points) == 0:
            ids, bounds = np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        else:
            inner = edges[:-1]
            starts = part_starts(points, inner[inner < len(points)], self.classes)
            ends = np.append(starts[1:], len(points))
            prefix = text.prefix_hash(points.astype(np.uint64) + np.uint64(1), "word")
            keys = text.span_hash(prefix, starts, ends, "word")
            names, sample, which = np.unique(keys, return_index=True, return_inverse=True)
            place, size = self._parts(names, points, starts[sample], ends[sample])
            each = size[which].astype(np.int64)
            upto = np.zeros(len(each) + 1, np.int64)
            np.cumsum(each, out=upto[1:])
            ids = self.flat[np.arange(upto[-1]) + np.repeat(place[which] - upto[:-1], each)]
            bounds = upto[np.searchsorted(starts, edges)]
        if odd:
            pieces = [odd.get(i, ids[bounds[i] : bounds[i + 1]]) for i in range(len(texts))]
            ids = np.concatenate(pieces)
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        return ids, bounds

    def _parts(self, names, points, starts, ends):
        """(place, size) in ``flat`` of each part; unknown ones are encoded now."""
        if len(self.keys) > KNOWN_PARTS:
            self._forget()
        at = np.searchsorted(self.keys, names)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == names[known]
        new = np.flatnonzero(~known)
        if len(new):
            fresh = [
                points[a:b].tobytes().decode("utf-32-le", "surrogatepass")
                for a, b in zip(starts[new].tolist(), ends[new].tolist())
            ]
            encoded = [
                e.ids for e in self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)
            ]
            size = np.array([len(ids) for ids in encoded], np.int32)
            place = len(self.flat) + np.cumsum(size, dtype=np.int64) - size
            self.flat = np.concatenate(
                [self.flat, np.array([i for ids in encoded for i in ids], np.uint32)]
            )
            self.keys = np.insert(self.keys, at[new], names[new])
            self.place = np.insert(self.place, at[new], place)
            self.size = np.insert(self.size, at[new], size)
            at = np.searchsorted(self.keys, names)
        return self.place[at], self.size[at]


def _row_chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, value in enumerate(texts):
        if i > at and size + len(value) > CHUNK_POINTS:
            yield at, i
            at, size = i, 0
        size += len(value)
    if at < len(texts):
        yield at, len(texts)


def piece_bounds(length: int, limit: int) -> list[int]:
    """Cuts of a document: the odd rest first, then whole sequences."""
    rest = length % limit or min(limit, length)
    return [0, *range(rest, length + 1, limit)]


def tokenized_pieces(
    docs: DataFrame,
    tokenizer: str | None = None,
    limit: int = SEQUENCE_TOKENS,
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: place in its document, length, crc32 of its ids.

    The text's ids end with the id 0. A NULL text counts as empty, so every row
    has at least one token. ``keep_ids`` adds the ids themselves.
    """
    path = tokenizer or default_tokenizer()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text.kept_in_worker(("encoder", path), lambda: Encoder(path))
        for batch in batches:
            names = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows: list[tuple] = []
            kept: list[list[int]] = []
            for low, high in _row_chunks(texts):
                ids, bounds = encoder.encode(texts[low:high])
                for i in range(low, high):
                    own = np.append(ids[bounds[i - low] : bounds[i - low + 1]], np.uint32(0))
                    cuts = piece_bounds(len(own), limit)
                    for k in range(len(cuts) - 1):
                        part = own[cuts[k] : cuts[k + 1]].astype("<u4")
                        rows.append((names[i], k, cuts[k], len(part), zlib.crc32(part.tobytes())))
                        if keep_ids:
                            kept.append(part.astype(np.int32))
            if not rows:
                continue
            columns = list(zip(*rows))
            arrays = [
                pa.array(columns[0], pa.int64()),
                pa.array(columns[1], pa.int32()),
                *[pa.array(c, pa.int64()) for c in columns[2:]],
            ]
            labels = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
                labels.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, labels)

    schema = PIECES + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, schema)


def best_two_fit(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; pieces are longer than 0 and at most ``limit``.

    A bin takes the longest waiting piece that fits, again and again. If a gap
    stays, its smallest piece gives way to two waiting pieces that together are
    longer than it and fit, the longest such pair.
    """
    waiting: list[list[int]] = [[] for _ in range(limit + 1)]
    for i, n in enumerate(lengths.tolist()):
        waiting[n].append(i)
    some = mirror = 0
    # Bit n of `some`: a piece of length n waits; bit limit - n of `mirror` likewise.
    for n, stack in enumerate(waiting):
        if stack:
            some |= 1 << n
            mirror |= 1 << (limit - n)
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)

    def take(n: int) -> int:
        nonlocal some, mirror
        i = waiting[n].pop()
        if not waiting[n]:
            some &= ~(1 << n)
            mirror &= ~(1 << (limit - n))
        return i

    def put_back(n: int, i: int) -> None:
        nonlocal some, mirror
        waiting[n].append(i)
        some |= 1 << n
        mirror |= 1 << (limit - n)

    number = 0
    while some:
        gap, held = limit, []
        while True:
            fits = some & ((1 << (gap + 1)) - 1)
            if not fits:
                break
            n = fits.bit_length() - 1
            held.append((n, take(n)))
            gap -= n
        if gap and some and len(held) > 1:
            smallest, which = held[-1]
            for total in range(smallest + gap, smallest, -1):
                # Lengths n that wait while total - n waits as well.
                pair = some & (mirror >> (limit - total))
                if not pair:
                    continue
                a = pair.bit_length() - 1
                b = total - a
                if a == b and len(waiting[a]) < 2:
                    pair &= ~(1 << a)
                    if not pair:
                        continue
                    a = pair.bit_length() - 1
                    b = total - a
                held[-1:] = [(a, take(a)), (b, take(b))]
                put_back(smallest, which)
                break
        at = 0
        for n, i in held:
            bins[i], offsets[i] = number, at
            at += n
        number += 1
    return bins, offsets


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    limit: int = SEQUENCE_TOKENS,
    group_pieces: int = GROUP_PIECES,
    keep_ids: bool = False,
) -> DataFrame:
    """Every piece of every document with its sequence and place there.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and
    ids with ``keep_ids``. Sequences are gapless from offset 0. A repeated
    document id is packed once per row, a NULL id like any other; an empty table
    gives no rows; other columns are ignored. Whole sequences get numbers below
    0, packed ones 0 or more.
    """
    pieces = written_table(tokenized_pieces(docs, tokenizer, limit, keep_ids), "pieces")
    whole = F.col("length") == limit
    short = pieces.where(~whole)
    groups = max(1, -(-short.count() // group_pieces))
    columns = PLACED + (", ids array<int>" if keep_ids else "")
    order = [c.split()[0] for c in columns.split(", ")]

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "ids_crc32"]).reset_index(drop=True)
        bins, offsets = best_two_fit(rows["length"].to_numpy(np.int64), limit)
        rows["sequence_id"] = int(key[0]) * SEQUENCES_PER_GROUP + bins
        rows["offset"] = offsets
        return rows[order]

    group = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int")
    shared = short.withColumn("__group", group).groupBy("__group").applyInPandas(packed, columns)
    alone = pieces.where(whole).withColumns(
        {
            "sequence_id": -1 - F.monotonically_increasing_id(),
            "offset": F.lit(0).cast("long"),
        }
    )
    return shared.unionByName(alone.select(*order))


ship_by_value(__name__)
