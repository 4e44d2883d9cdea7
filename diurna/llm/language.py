"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of depth ``ORDER``: how often each byte
followed each context of 0 to ORDER bytes. A byte costs -log2 of its share of
its longest context that knows it, after the escapes of the longer ones; the
escape probability of a context is d / (n + d) for n bytes of d kinds (method C,
without exclusion), and below order 0 every byte costs 8 bits. The statistics
are frozen when scoring starts, so a text's code length does not depend on
earlier texts, and the shortest code names the language.

The trees of all languages are merged into one automaton over byte strings of up
to ORDER + 1 bytes: a string seen in any language has a number and, per
language, the exact cost of its last byte, escapes included. Scoring reads one
number per byte; only unseen strings fall back to shorter ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from diurna.llm import text
from diurna.session import ship_by_value

ORDER = 3
DOCS_PER_LANGUAGE = 1_500
UNKNOWN = "und"


def labelled_sample(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """At most about ``per_language`` labelled texts per language, by text hash.

    The hash rate of each language follows from its count, so nothing is
    sorted; copies of a text are one text.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", "text", F.xxhash64("text").alias("__key")
    )
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("__rows"))
    share = F.pmod(F.col("__key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # One row per language.
    drawn = labelled.join(F.broadcast(counts), "lang").where(share * F.col("__rows") < per_language)
    return drawn.select("lang", "text")


def string_counts(sample: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, size, code, n): how often each string of 1 to order + 1 bytes occurs.

    ``code`` is the string's bytes as a number, the first byte highest.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text.text_buffer(batch.column(1))
            langs = np.array(batch.column(0).to_pylist(), str)
            for low, high in text.chunks(offsets):
                part = data[offsets[low] : offsets[high]].astype(np.uint64)
                edges = offsets[low : high + 1] - offsets[low]
                row = np.repeat(np.arange(high - low), np.diff(edges))
                inside = np.arange(len(part)) - edges[:-1][row]
                names, owner = np.unique(langs[low:high], return_inverse=True)
                code = np.zeros(len(part), np.uint64)
                for size in range(1, order + 2):
                    code[size - 1 :] |= part[: len(part) - size + 1] << np.uint64(8 * size - 8)
                    whole = inside >= size - 1
                    shift = np.uint64(8 * size)
                    key = (owner[row][whole].astype(np.uint64) << shift) | code[whole]
                    found, n = np.unique(key, return_counts=True)
                    top = found >> shift
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(names[top.astype(np.int64)]),
                            pa.array(np.full(len(found), size, np.int32)),
                            pa.array((found ^ (top << shift)).astype(np.int64)),
                            pa.array(n.astype(np.int64)),
                        ],
                        ["lang", "size", "code", "n"],
                    )

    counted = sample.select("lang", "text").mapInArrow(
        count, "lang string, size int, code long, n long"
    )
    return counted.groupBy("lang", "size", "code").agg(F.sum("n").alias("n"))


@dataclass
class Trees:
    """The merged context trees of all languages.

    ``symbol`` numbers the bytes seen, from 1. ``step[k]`` leads from the number
    of a string of k bytes and the next byte to the number of the longer string,
    0 if no language has it. ``cost[k]`` holds, per string of k + 1 bytes and
    language, the bits of its last byte; ``escape[k]``, per context of k bytes,
    the bits of leaving it.
    """

    languages: list[str]
    symbol: np.ndarray
    step: list[np.ndarray]
    cost: list[np.ndarray]
    escape: list[np.ndarray]

    def code_lengths(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Bits of each row's bytes under each language."""
        rows, count = len(edges) - 1, len(self.languages)
        if len(data) == 0:
            return np.zeros((rows, count))
        kinds = int(self.symbol.max()) + 1
        symbol = self.symbol[data]
        inside = np.arange(len(data)) - np.repeat(edges[:-1], np.diff(edges))
        names = [self.step[0][symbol]]
        bits = self._bits(0, names[0], np.zeros(len(data), np.int32), None)
        for size in range(1, len(self.step)):
            before = np.zeros(len(data), np.int32)
            before[1:] = names[-1][:-1]
            before[inside < size] = 0
            name = self.step[size][before * kinds + symbol]
            bits = self._bits(size, name, before, bits)
            names = [name]
        upto = np.zeros((len(data) + 1, count))
        np.cumsum(bits, axis=0, out=upto[1:])
        return upto[edges[1:]] - upto[edges[:-1]]

    def _bits(self, size, name, context, shorter) -> np.ndarray:
        """Cost of each byte after its context of ``size`` bytes."""
        bits = self.cost[size][name]
        unseen = np.flatnonzero(name == 0)
        if shorter is None:
            bits[unseen] = 8.0 + self.escape[0][0]
        else:
            bits[unseen] = self.escape[size][context[unseen]] + shorter[unseen]
        return bits


def build_trees(counts, order: int = ORDER) -> Trees:
    """Trees from (lang, size, code, n) rows; size bounded by the sample counted."""
    languages = sorted(set(counts["lang"]))
    column = counts["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy(int)
    sizes, codes = counts["size"].to_numpy(), counts["code"].to_numpy(np.int64)
    numbers = counts["n"].to_numpy(np.int64)
    symbol = np.zeros(256, np.int32)
    step, cost, escape = [], [], []
    names_before = np.zeros(1, np.int64)
    for size in range(1, order + 2):
        here = sizes == size
        names = np.unique(codes[here])
        seen = np.zeros((len(names) + 1, len(languages)), np.int64)
        np.add.at(seen, (np.searchsorted(names, codes[here]) + 1, column[here]), numbers[here])
        if size == 1:
            symbol[names] = np.arange(1, len(names) + 1)
            kinds = len(names) + 1
            context = np.zeros(len(names) + 1, np.int64)
            contexts = 1
        else:
            context = np.zeros(len(names) + 1, np.int64)
            context[1:] = np.searchsorted(names_before, names >> 8) + 1
            contexts = len(names_before) + 1
        last = np.concatenate([[0], symbol[names & 255]]).astype(np.int64)
        table = np.zeros(contexts * kinds, np.int32)
        table[(context * kinds + last)[1:]] = np.arange(1, len(names) + 1)
        total = np.zeros((contexts, len(languages)))
        different = np.zeros((contexts, len(languages)))
        np.add.at(total, context[1:], seen[1:])
        np.add.at(different, context[1:], seen[1:] > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            leave = np.where(total > 0, -np.log2(different / (total + different)), 0.0)
            bits = -np.log2(seen / (total + different)[context])
        if size == 1:
            shorter = np.full(bits.shape, 8.0)
        else:
            shorter = cost[-1][np.append(0, np.searchsorted(names_before, names & mask) + 1)]
        bits = np.where(seen > 0, bits, leave[context] + shorter)
        step.append(table)
        cost.append(bits.astype(np.float32))
        escape.append(leave.astype(np.float32))
        names_before, mask = names, (1 << (8 * size)) - 1
    return Trees(languages, symbol, step, cost, escape)


def train(labelled: DataFrame, per_language: int = DOCS_PER_LANGUAGE, order: int = ORDER) -> Trees:
    """Trees learnt from the texts and languages of ``labelled``.

    Rows without text or language are left out. No labelled row at all gives
    trees without a language, which answer ``und`` always.
    """
    sample = labelled_sample(labelled.select("lang", F.lower("text").alias("text")), per_language)
    return build_trees(string_counts(sample, order).toPandas(), order)


def identify(docs: DataFrame, trees: Trees) -> DataFrame:
    """All columns of ``docs`` plus lang_pred and score.

    The score is the language's share of 2**-bits over all languages. A text
    that is NULL or has no letter gets ``und`` and 0; equal code lengths go to
    the first name. Columns of ``docs`` called lang_pred or score are replaced.
    """
    kept = docs.drop("lang_pred", "score")
    shared = text.sent_object(docs.sparkSession, trees)
    lowered, lettered = "__lowered", "__lettered"
    given = kept.withColumns(
        {
            lowered: F.lower("text"),
            lettered: F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)),
        }
    )
    columns = kept.columns
    width = len(columns)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared()
        for batch in batches:
            data, offsets = text.text_buffer(batch.column(width))
            usable = np.array(batch.column(width + 1).to_pylist(), bool)
            bits = np.zeros((len(usable), len(trees.languages)))
            for low, high in text.chunks(offsets):
                part = data[offsets[low] : offsets[high]]
                bits[low:high] = trees.code_lengths(part, offsets[low : high + 1] - offsets[low])
            if trees.languages:
                best = bits.argmin(axis=1)
                share = 1.0 / np.exp2(bits.min(axis=1, keepdims=True) - bits).sum(axis=1)
                names = np.where(usable, np.array(trees.languages, object)[best], UNKNOWN)
            else:
                share, names = np.zeros(len(usable)), np.full(len(usable), UNKNOWN, object)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(width)],
                    pa.array(names.tolist(), pa.string()),
                    pa.array(np.where(usable, share, 0.0)),
                ],
                [*columns, "lang_pred", "score"],
            )

    schema = StructType(
        [
            *kept.schema.fields,
            StructField("lang_pred", StringType()),
            StructField("score", DoubleType()),
        ]
    )
    return given.mapInArrow(predict, schema)


ship_by_value(__name__)
