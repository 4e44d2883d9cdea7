"""Token counts of a byte-level BPE vocabulary by the whole-token shortcut.

Offline, on the driver, every vocabulary string is merged from its bytes; those
that end as one token are proven whole. The vocabulary is of fixed size, and so
is the proof. A task splits its texts into pre-tokens, as array operations on
code points, and looks every pre-token up among the proven strings: up to 16 bytes
are compared as two machine words, so a hit is exact. A hit is one token; only the
rest is merged, all new pre-tokens of a batch side by side, and remembered in a table
of fixed size.

A text is looked at in windows that end at a pre-token's edge, so memory does not
grow with the longest text, only with its longest pre-token.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diurna.llm import packing, text
from diurna.session import ship_by_value

LIMIT = 1024
WINDOW_POINTS = 1 << 18
# Slots for merged pre-tokens of up to SHORT_BYTES, which are looked up as two
# words, and entries for longer ones.
SLOT_BITS = 20
KNOWN_LONG = 100_000
SHORT_BYTES = 16
# Longer pre-tokens than this are merged one by one.
ROW_BYTES = 64

Merges = dict[tuple[int, int], tuple[int, int]]


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary file.

    Bytes with a visible Latin-1 sign stand for themselves; the others take the
    letters from 256 on, in order.
    """
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in visible}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(visible))
    return [letters[b] for b in range(256)]


def merged_size(symbols: list[int], merges: Merges) -> int:
    """Number of tokens after all merges: least rank first, leftmost of equals."""
    size = len(symbols)
    symbols = list(symbols)
    after = [*range(1, size), -1]
    before = [-1, *range(size - 1)]
    waiting = []
    for i in range(size - 1):
        found = merges.get((symbols[i], symbols[i + 1]))
        if found:
            waiting.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
    heapq.heapify(waiting)
    left = size
    while waiting:
        _, i, a, b, joined = heapq.heappop(waiting)
        j = after[i]
        # Stale: one of the two has been merged since. -1 marks what is gone.
        if symbols[i] != a or j < 0 or symbols[j] != b:
            continue
        symbols[i], symbols[j] = joined, -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        left -= 1
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y >= 0:
                found = merges.get((symbols[x], symbols[y]))
                if found:
                    heapq.heappush(waiting, (found[0], x, symbols[x], symbols[y], found[1]))
    return left


class MergeTable:
    """The merge rules as sorted arrays, for many strings side by side."""

    NONE = np.int32(np.iinfo(np.int32).max)

    def __init__(self, byte_ids: list[int], merges: Merges):
        pairs = np.array(list(merges), np.int64).reshape(-1, 2)
        found = np.array(list(merges.values()), np.int64).reshape(-1, 2)
        keys = (pairs[:, 0] << 32) | pairs[:, 1]
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.rank = np.append(found[order, 0], self.NONE).astype(np.int32)
        self.joined = np.append(found[order, 1], -1).astype(np.int32)
        self.byte_ids = np.array(byte_ids, np.int32)
        every = np.arange(256)
        self.byte_rank, _ = self.look_up(
            self.byte_ids[np.repeat(every, 256)], self.byte_ids[np.tile(every, 256)]
        )

    def look_up(self, left: np.ndarray, right: np.ndarray):
        """(rank, joined symbol) of each pair; NONE where it cannot be merged.

        A symbol of -1 is no symbol.
        """
        keys = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        at = np.searchsorted(self.keys, keys)
        rank = np.where((self.keys[at] == keys) & (right >= 0), self.rank[at], self.NONE)
        return rank, self.joined[at]

    def sizes(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each row of bytes, of which the first ``lengths`` count.

        Like ``merged_size``: each round merges every row's least pair.
        """
        count, width = rows.shape
        out = lengths.astype(np.int64)
        places = np.arange(width)
        there = places < lengths[:, None]
        symbols = np.where(there, self.byte_ids[rows], -1)
        rank = np.full((count, width), self.NONE, np.int32)
        if width > 1:
            pairs = self.byte_rank[(rows[:, :-1].astype(np.int64) << 8) | rows[:, 1:]]
            rank[:, :-1] = np.where(there[:, 1:], pairs, self.NONE)
        live = np.arange(count)
        while len(live):
            at = rank.argmin(axis=1)
            every = np.arange(len(live))
            more = rank[every, at] < self.NONE
            if not more.all():
                live, symbols, rank, at = live[more], symbols[more], rank[more], at[more]
                every = np.arange(len(live))
            if not len(live):
                break
            _, joined = self.look_up(symbols[every, at], symbols[every, at + 1])
            # What stands behind the pair moves up by one.
            source = np.minimum(places + (places > at[:, None]), width - 1)
            symbols = np.take_along_axis(symbols, source, 1)
            rank = np.take_along_axis(rank, source, 1)
            symbols[:, -1], rank[:, -1] = -1, self.NONE
            symbols[every, at] = joined
            rank[every, at], _ = self.look_up(
                joined, np.where(at + 1 < width, symbols[every, np.minimum(at + 1, width - 1)], -1)
            )
            inner = np.flatnonzero(at > 0)
            rank[inner, at[inner] - 1], _ = self.look_up(
                symbols[inner, at[inner] - 1], joined[inner]
            )
            out[live] -= 1
        return out


@dataclass
class Vocabulary:
    """Merge rules over byte strings, and which strings are special."""

    strings: list[bytes]
    byte_ids: list[int]
    merges: Merges
    special: list[str]


def read_vocabulary(path: str) -> Vocabulary:
    """A tokenizer file, if it is of the kind that this operator counts exactly."""
    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    model, split = given["model"], given["pre_tokenizer"] or {}
    plain = (
        model["type"] == "BPE"
        and not any(
            model.get(k)
            for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix")
        )
        and not model.get("ignore_merges")
        and split.get("type") == "ByteLevel"
        and split.get("use_regex", True)
        and not split.get("add_prefix_space")
        and given["normalizer"] is None
        and not any(
            t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]
            for t in given["added_tokens"]
        )
    )
    if not plain:
        raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
    vocab = model["vocab"]
    letters = byte_letters()
    value = {c: b for b, c in enumerate(letters)}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    return Vocabulary(
        [bytes(value[c] for c in s) for s in vocab if all(c in value for c in s)],
        [vocab[c] for c in letters],
        {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)},
        [t["content"] for t in given["added_tokens"]],
    )


def whole_tokens(vocabulary: Vocabulary) -> list[bytes]:
    """The vocabulary strings that encode alone as one token, each proven by merging."""
    ids, merges = vocabulary.byte_ids, vocabulary.merges
    return [s for s in vocabulary.strings if merged_size([ids[b] for b in s], merges) == 1]


def _words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """(low, high): the first 16 bytes of each string as two words, 0 beyond its end.

    ``data`` must go on for 16 bytes behind the last string.
    """
    every = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,))
    masks = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    low = every[starts] & masks[np.minimum(sizes, 8)]
    high = every[starts + 8] & masks[np.clip(sizes - 8, 0, 8)]
    return low, high


def _keys(low: np.ndarray, high: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return text.mixed(low ^ text.mixed(high + (sizes.astype(np.uint64) << np.uint64(59))))


class WholeTokens:
    """The proven strings as arrays sorted by a key; what is too long as a set."""

    def __init__(self, strings: list[bytes]):
        short = [s for s in strings if len(s) <= SHORT_BYTES]
        sizes = np.array([len(s) for s in short], np.int64)
        data = np.frombuffer(b"".join(short) + bytes(SHORT_BYTES), np.uint8)
        low, high = _words(data, np.cumsum(sizes) - sizes, sizes)
        keys = _keys(low, high, sizes)
        order = np.argsort(keys)
        self.keys, self.low, self.high = keys[order], low[order], high[order]
        self.sizes = sizes[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two vocabulary strings have one key")
        self.long = frozenset(s for s in strings if len(s) > SHORT_BYTES)

    def has(self, low, high, sizes, keys) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return (self.low[at] == low) & (self.high[at] == high) & (self.sizes[at] == sizes)


def _point_classes() -> tuple[np.ndarray, np.ndarray]:
    """(class under the split rule, whether Python's tables know it) of every code point."""
    known = np.array([unicodedata.category(chr(p)) != "Cn" for p in range(0x110000)], bool)
    return packing._classes(), known


class Counter:
    """Counts the tokens of texts; one per Python worker."""

    def __init__(self, path: str, whole: WholeTokens):
        self.path = path
        self.vocabulary = read_vocabulary(path)
        self.whole = whole
        self.classes, self.known = _point_classes()
        self.table = MergeTable(self.vocabulary.byte_ids, self.vocabulary.merges)
        self.sizes: dict[bytes, int] = {}
        slots = 1 << SLOT_BITS
        self.low, self.high = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.length, self.tokens = np.zeros(slots, np.int8), np.zeros(slots, np.int8)
        self.library = None

    def _merged(self, parts: list[bytes]) -> np.ndarray:
        """Tokens of distinct pre-tokens."""
        lengths = np.array([len(p) for p in parts])
        sizes = np.zeros(len(parts), np.int64)
        for least, most in ((0, SHORT_BYTES), (SHORT_BYTES, ROW_BYTES)):
            these = np.flatnonzero((lengths > least) & (lengths <= most))
            if len(these):
                data = b"".join(parts[i].ljust(most, b"\0") for i in these.tolist())
                rows = np.frombuffer(data, np.uint8).reshape(-1, most)
                sizes[these] = self.table.sizes(rows, lengths[these])
        ids = self.vocabulary.byte_ids
        for i in np.flatnonzero(lengths > ROW_BYTES).tolist():
            sizes[i] = merged_size([ids[b] for b in parts[i]], self.vocabulary.merges)
        return sizes

    def _long_parts(self, parts: list[bytes]) -> list[int]:
        """Tokens of pre-tokens that are too long for the slots."""
        new = [p for p in dict.fromkeys(parts) if p not in self.sizes]
        whole = [p in self.whole.long for p in new]
        rest = [p for p, one in zip(new, whole) if not one]
        merged = iter(self._merged(rest).tolist() if rest else [])
        here = {p: 1 if one else next(merged) for p, one in zip(new, whole)}
        found = [here[p] if p in here else self.sizes[p] for p in parts]
        if len(self.sizes) + len(here) > KNOWN_LONG:
            self.sizes.clear()
        self.sizes.update((p, n) for p, n in here.items() if len(p) <= ROW_BYTES)
        return found

    def _short_parts(self, data, low_at, low, high, sizes, keys) -> np.ndarray:
        """Tokens of pre-tokens of up to SHORT_BYTES that are not whole."""
        slot = (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

        def kept(i):
            at = slot[i]
            return (self.low[at] == low[i]) & (self.high[at] == high[i]) & (
                self.length[at] == sizes[i]
            )

        every = np.arange(len(keys))
        known = kept(every)
        found = np.where(known, self.tokens[slot], 0).astype(np.int64)
        new = np.flatnonzero(~known)
        if len(new):
            _, sample, which = np.unique(keys[new], return_index=True, return_inverse=True)
            first = new[sample]
            merged = self._merged(
                [data[a : a + n] for a, n in zip(low_at[first].tolist(), sizes[first].tolist())]
            )
            found[new] = merged[which]
            # One key for two strings: each is then merged for itself.
            like = first[which]
            same = (low[new] == low[like]) & (high[new] == high[like]) & (sizes[new] == sizes[like])
            for i in new[~same].tolist():
                found[i] = self._merged([data[low_at[i] : low_at[i] + sizes[i]]])[0]
            at = slot[first]
            self.low[at], self.high[at] = low[first], high[first]
            self.length[at], self.tokens[at] = sizes[first], merged
            # Two strings for one slot: all arrays keep the last of them.
        return found

    def _sizes_of(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token points[start:end]."""
        data = points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        width = np.ones(len(points), np.int64)
        for least in (0x80, 0x800, 0x10000):
            width += points >= least
        offset = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=offset[1:])
        low_at, sizes = offset[starts], offset[ends] - offset[starts]
        padded = np.frombuffer(data + bytes(SHORT_BYTES), np.uint8)
        low, high = _words(padded, low_at, sizes)
        short = sizes <= SHORT_BYTES
        keys = _keys(low, high, sizes)
        found = np.ones(len(starts), np.int64)
        rest = np.flatnonzero(short & ~self.whole.has(low, high, sizes, keys))
        if len(rest):
            found[rest] = self._short_parts(
                data, low_at[rest], low[rest], high[rest], sizes[rest], keys[rest]
            )
        long = np.flatnonzero(~short)
        if len(long):
            found[long] = self._long_parts(
                [data[a : a + n] for a, n in zip(low_at[long].tolist(), sizes[long].tolist())]
            )
        return found

    def _long(self, points: np.ndarray) -> int:
        """Tokens of one text, window by window."""
        at, total, width = 0, 0, WINDOW_POINTS
        while at < len(points):
            window = points[at : at + width]
            starts = packing.part_starts(window, np.zeros(1, np.int64), self.classes)
            if at + width >= len(points):
                return total + int(self._sizes_of(window, starts, _ends(starts, window)).sum())
            # The last two may go on, or be a contraction, behind the window.
            if len(starts) < 3:
                width *= 2
                continue
            stop = starts[-2]
            total += int(self._sizes_of(window[:stop], starts[:-2], starts[1:-1]).sum())
            at, width = at + int(stop), WINDOW_POINTS
        return total

    def _library(self, value: str) -> int:
        """For texts with signs newer than Python's tables: the tokenizer itself."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return len(self.library.encode(value, add_special_tokens=False).ids)

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, special strings counting as one."""
        total = np.zeros(len(texts), np.int64)
        segments: list[tuple[int, str]] = []
        for i, value in enumerate(texts):
            parts = [value]
            for special in self.vocabulary.special:
                if special in value:
                    parts = [x for p in parts for x in p.split(special)]
                    total[i] = len(parts) - 1
            segments += [(i, p) for p in parts if p]
        at = 0
        while at < len(segments):
            # At least one segment, and at most a window of points if there are more.
            upto, size = at, 0
            while upto < len(segments) and (upto == at or size <= WINDOW_POINTS):
                size += len(segments[upto][1])
                upto += 1
            if upto > at + 1 and size > WINDOW_POINTS:
                upto -= 1
            self._add(segments[at:upto], texts, total)
            at = upto
        return total

    def _add(self, segments: list[tuple[int, str]], texts: list[str], total: np.ndarray) -> None:
        rows = np.array([i for i, _ in segments])
        lengths = np.array([len(p) for _, p in segments])
        points = np.frombuffer(
            "".join(p for _, p in segments).encode("utf-32-le", "surrogatepass"), np.uint32
        )
        edges = np.cumsum(lengths) - lengths
        strange = np.flatnonzero(~self.known[points])
        if len(strange):
            for k in np.unique(np.searchsorted(edges, strange, side="right") - 1):
                total[rows[k]] += self._library(segments[k][1])
            fine = [s for k, s in enumerate(segments) if self.known[
                points[edges[k] : edges[k] + lengths[k]]].all()]
            if fine:
                self._add(fine, texts, total)
        elif len(segments) == 1 and len(points) > WINDOW_POINTS:
            total[rows[0]] += self._long(points)
        else:
            starts = packing.part_starts(points, edges, self.classes)
            sizes = self._sizes_of(points, starts, _ends(starts, points))
            owner = rows[np.searchsorted(edges, starts, side="right") - 1]
            total += np.bincount(owner, weights=sizes, minlength=len(total)).astype(np.int64)


def _ends(starts: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.append(starts[1:], len(points))


def prove(path: str) -> WholeTokens:
    return WholeTokens(whole_tokens(read_vocabulary(path)))


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """All columns of ``docs`` plus n_bytes, n_tokens and over_limit (n_tokens > limit).

    Counts are those of the tokenizer without added special tokens; a special
    string inside a text is one token. A NULL or empty text has no token. Columns
    of ``docs`` with the names of the new ones are replaced. ``tokenizer`` is a
    file that the executors have as well. Nothing is shuffled.
    """
    path = tokenizer or packing.default_tokenizer()
    whole = prove(path)

    @F.arrow_udf("long")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = text.kept_in_worker(("counter", path), lambda: Counter(path, whole))
        for batch in batches:
            yield pa.array(counter.count([t or "" for t in batch.to_pylist()]), pa.int64())

    given = docs.drop("n_bytes", "n_tokens", "over_limit")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    counted = given.withColumns({"n_bytes": size, "n_tokens": tokens("text")})
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


ship_by_value(__name__)
