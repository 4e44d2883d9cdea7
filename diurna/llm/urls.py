"""URL rules as one bit-parallel wildcard automaton.

All glob patterns are packed into the bits of a few 64-bit words, one bit per
pattern position. Reading a byte moves every pattern at once: positions whose
literal fits advance (Shift-And), positions under a wildcard may stay. A batch
of URLs is read in step, longest first, so each step is a few array operations
over the URLs that have not ended.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from diurna.llm import text
from diurna.session import ship_by_value

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for ``host``, its subdomains, and paths starting with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        """Pattern over '.' + host + path: any subdomain, then any rest."""
        literal = (self.host + self.path).replace("\\", "\\\\")
        for sign in "*?":
            literal = literal.replace(sign, "\\" + sign)
        return f"*.{literal}**"


def parsed_glob(glob: str) -> list[tuple[str, int]]:
    """Steps of a pattern: ('byte', value), ('any', 0), ('star', 0), ('stars', 0).

    ``?`` is one byte other than a slash, ``*`` any run of those, ``**`` any run
    of bytes; a backslash takes the next sign literally.
    """
    steps: list[tuple[str, int]] = []
    data, i = glob.encode(), 0
    while i < len(data):
        sign = data[i : i + 1]
        if sign == b"\\" and i + 1 < len(data):
            i += 1
            steps.append(("byte", data[i]))
        elif data[i : i + 2] == b"**":
            i += 1
            steps.append(("stars", 0))
        elif sign == b"*":
            steps.append(("star", 0))
        elif sign == b"?":
            steps.append(("any", 0))
        else:
            steps.append(("byte", data[i]))
        i += 1
    return steps


class Automaton:
    """Masks of many globs; ``matches`` tells which fit each string as a whole."""

    def __init__(self, globs: Sequence[str]):
        parsed = [parsed_glob(g) for g in globs]
        widths = [1 + sum(kind in ("byte", "any") for kind, _ in steps) for steps in parsed]
        self.words = max(1, -(-sum(widths) // 64))
        self.advance = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.begin = np.zeros(self.words, np.uint64)
        self.accept: list[tuple[int, np.uint64]] = []
        slash = ord("/")
        at = 0
        for steps, width in zip(parsed, widths):
            state = at
            self._set(self.begin, state)
            for kind, value in steps:
                if kind == "byte":
                    state += 1
                    self._set(self.advance[value], state)
                elif kind == "any":
                    state += 1
                    for b in range(256):
                        if b != slash:
                            self._set(self.advance[b], state)
                else:
                    for b in range(256):
                        if kind == "stars" or b != slash:
                            self._set(self.stay[b], state)
            self.accept.append((state // 64, np.uint64(1 << (state % 64))))
            at += width

    @staticmethod
    def _set(words: np.ndarray, bit: int) -> None:
        words[bit // 64] |= np.uint64(1 << (bit % 64))

    def matches(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Row x pattern: does the pattern fit the whole row?"""
        lengths = np.diff(edges)
        order = np.argsort(-lengths, kind="stable")
        starts, sizes = edges[:-1][order], lengths[order]
        state = np.tile(self.begin, (len(order), 1))
        live = len(order)
        one, top = np.uint64(1), np.uint64(63)
        for step in range(int(sizes[0]) if live else 0):
            live = int(np.searchsorted(-sizes, -step, side="left"))
            byte = data[starts[:live] + step]
            now = state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:live] = (moved & self.advance[byte]) | (now & self.stay[byte])
        out = np.zeros((len(order), len(self.accept)), bool)
        for p, (word, bit) in enumerate(self.accept):
            out[order, p] = (state[:, word] & bit) != 0
        return out


def host_of(url: Column) -> Column:
    """What follows the first '://', up to a slash, '?', '#' or the end; A-Z lowered."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to '?', '#' or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: Sequence[Rule], default: str = "allow") -> DataFrame:
    """All columns of ``pages`` plus host, path, rule and verdict.

    The longest fitting rule decides (equal lengths: the longer host, then the
    name); without one, rule is NULL and the verdict ``default``. A NULL url, or
    one without '://', has an empty host and path and fits no rule. Columns of
    ``pages`` with the names of the new ones are replaced.
    """
    kept = pages.drop("host", "path", "rule", "verdict")
    columns = kept.columns
    width = len(columns)
    ranked = sorted(set(rules), key=lambda r: (-len(r.name), -len(r.host), r.name))
    given = kept.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    given = given.withColumn("__whole", F.concat(F.lit("."), F.col("host"), F.col("path")))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([r.glob for r in ranked])
        names = np.array([*[r.name for r in ranked], None], object)
        verdicts = np.array([*[r.verdict for r in ranked], default], object)
        for batch in batches:
            data, offsets = text.text_buffer(batch.column(width + 2))
            fits = automaton.matches(data, offsets)
            none = np.ones((len(fits), 1), bool)
            first = np.concatenate([fits, none], axis=1).argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(width + 2)],
                    pa.array(names[first].tolist(), pa.string()),
                    pa.array(verdicts[first].tolist(), pa.string()),
                ],
                [*columns, "host", "path", "rule", "verdict"],
            )

    added = [StructField(n, StringType()) for n in ("host", "path", "rule", "verdict")]
    return given.mapInArrow(decide, StructType([*kept.schema.fields, *added]))


ship_by_value(__name__)
