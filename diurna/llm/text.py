"""Vectorised text kernels for Arrow batches: words, hashes, windows.

A batch's texts are one byte buffer with offsets, so splitting into words and
hashing them is array arithmetic over the whole buffer, not a loop over rows.
Words are maximal runs of bytes other than space and the controls 9 to 13.
"""

from __future__ import annotations

import pickle
import sys
import types
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from diurna.session import ship_by_value

CHUNK_BYTES = 1 << 19

_BASES = {
    "byte": 0x9E3779B97F4A7C15,
    "word": 0xC2B2AE3D27D4EB4F,
}


def kept_in_worker(key, make):
    """One object per Python worker process, shared by the tasks it runs."""
    kept = sys.modules.setdefault("diurna_worker_objects", types.ModuleType("diurna_worker_objects"))
    objects = kept.__dict__.setdefault("objects", {})
    if key not in objects:
        objects[key] = make()
    return objects[key]


def sent_object(spark: SparkSession, value):
    """A function for tasks that gives ``value``, broadcast with its class's code.

    A plain broadcast names the class only, and workers may have no copy of it.
    """
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(shared.value)


def learning_fold(id_column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; NULL for a NULL id."""
    return F.crc32(id_column.cast("string").cast("binary")) % F.lit(folds)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one longer row."""
    rows, at = len(offsets) - 1, 0
    while at < rows:
        upto = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        upto = min(rows, max(upto, at + 1))
        yield at, upto
        at = upto


def mixed(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every bit depends on every bit."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _powers(kind: str, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    tables = kept_in_worker("powers", dict)
    have = tables.get(kind)
    if have is None or len(have[0]) < count:
        base = _BASES[kind]
        size = max(count, CHUNK_BYTES + 1)
        both = []
        for factor in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        tables[kind] = have = (both[0], both[1])
    return have


def prefix_hash(values: np.ndarray, kind: str) -> np.ndarray:
    """Running polynomial hash; ``span_hash`` reads any span off it."""
    up, _ = _powers(kind, len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: str) -> np.ndarray:
    _, down = _powers(kind, len(prefix))
    return mixed((prefix[ends] - prefix[starts]) * down[starts])


def byte_values(data: np.ndarray) -> np.ndarray:
    table = kept_in_worker("bytes", lambda: mixed(np.arange(1, 257, dtype=np.uint64)))
    return table[data]


def word_spans(data: np.ndarray, offsets: np.ndarray):
    """(starts, ends, first): byte spans of the words, first word of each row."""
    size = len(data)
    if size == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    before = np.empty(size, bool)
    before[0] = True
    before[1:] = blank[:-1]
    after = np.empty(size, bool)
    after[-1] = True
    after[:-1] = blank[1:]
    starts = np.flatnonzero(~blank & (before | edge[:-1]))
    ends = np.flatnonzero(~blank & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(byte_values(data), "byte"), starts, ends, "byte")


def window_hashes(words: np.ndarray, first: np.ndarray, size: int):
    """(start word, row, hash) of every ``size``-word window inside one row."""
    counts = np.diff(first)
    per_row = np.maximum(counts - size + 1, 0)
    rows = np.repeat(np.arange(len(counts)), per_row)
    ahead = np.cumsum(per_row) - per_row
    at = np.arange(len(rows)) - ahead[rows] + first[:-1][rows]
    hashes = span_hash(prefix_hash(words, "word"), at, at + size, "word")
    return at, rows, hashes


def shingles(words: np.ndarray, first: np.ndarray, size: int):
    """(row, hash) of each row's shingles; a shorter row is one shingle, an empty one none."""
    _, rows, hashes = window_hashes(words, first, size)
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = span_hash(prefix_hash(words, "word"), first[short], first[short + 1], "word")
        rows = np.concatenate([rows, short])
        hashes = np.concatenate([hashes, whole])
        order = np.argsort(rows, kind="stable")
        rows, hashes = rows[order], hashes[order]
    return rows, hashes


def leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of ``width`` values from each place on, the first of equals.

    Values are compared by their upper 32 bits. Stretches that run over the end
    look at what is left. Minima of fixed pieces, run forwards and backwards,
    give every stretch from one end of a piece and one beginning.
    """
    size = len(values)
    tagged = (values & np.uint64(0xFFFFFFFF00000000)) | np.arange(size, dtype=np.uint64)
    pieces = -(-size // width) + 1
    padded = np.full(pieces * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:size] = tagged
    square = padded.reshape(pieces, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:size], ahead[width - 1 : width - 1 + size])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def row_key(*columns: str) -> Column:
    """64-bit key of a row's contents; equal rows share it."""
    return F.xxhash64(*columns)


def packed(rows: DataFrame) -> DataFrame:
    """``rows`` with text as compressed bytes, for a join that has to move texts.

    A NULL text stays NULL.
    """
    names = [c for c in rows.columns if c != "text"]
    width = len(names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(3)
        for batch in batches:
            data = [
                None if t is None else press.compress(t.encode())
                for t in batch.column(width).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(width)], pa.array(data, pa.binary())],
                [*names, "packed"],
            )

    fields = [rows.schema[n] for n in names]
    schema = StructType([*fields, StructField("packed", BinaryType())])
    return rows.select(*names, "text").mapInArrow(pack, schema)


def unpacked(column: pa.Array) -> list[bytes | None]:
    import zstandard

    press = zstandard.ZstdDecompressor()
    return [None if data is None else press.decompress(data) for data in column.to_pylist()]


def set_aside(docs: DataFrame, *used: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with all columns but ``used`` renamed, and the new name of each.

    An operator may then add columns of any name without meeting one of theirs.
    """
    names = {c: c if c in used else f"__own_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def put_back(rows: DataFrame, names: dict[str, str], added: Sequence[str] = ()) -> DataFrame:
    """The columns that were set aside under their own names, then ``added``."""
    return rows.select(*[F.col(n).alias(c) for c, n in names.items() if c not in added], *added)


ship_by_value(__name__)
