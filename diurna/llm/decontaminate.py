"""Benchmark decontamination by SimHash windows and exact checks, all in Spark SQL.

An item of L words is compared with all windows of L words of the documents. Each
is a multiset of five-word shingles, of L-word ones if L is below five; the match that counts is a weighted Jaccard
similarity of 0.8 or more.

1. Two multisets of n and m shingles at similarity t have t (n + m) / (1 + t) in
   common at least. Every window that holds as many positions with a shingle of
   items of its length is taken, wherever it starts; the rest of the corpus
   leaves the plan after one hash join.
2. Windows and items get a 64-bit SimHash: each bit is the sign of the sum of
   that bit over the weighted shingles.
3. Fingerprints of equal window length meet in a multi-index: cut into radius + 1
   blocks, two fingerprints within the radius agree in at least one block, so
   joining on (length, block number, block value) misses none of them.
4. Candidates within the radius are verified by the exact similarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diurna.session import written_table

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BITS = 64
# Two multisets at 0.8 differ in 9.7 of 64 bits on average, with a standard
# deviation of 2.9; over 20 bits is more than 3.5 of those away.
RADIUS = 20
# Items are taken in parts of at most about so many shingles, about 40 bytes each
# in the hash table that every executor gets.
PART_SHINGLES = 500_000


def words_of(text: Column) -> Column:
    """Lower-case words between spaces and the controls 9 to 13."""
    return F.filter(
        F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != ""
    )


def shingle_hashes(words: str, width: int = SHINGLE_WORDS) -> Column:
    """Hashes of the shingles of ``width`` words, in order; a shorter text is one shingle."""
    size = F.size(words)
    last = F.greatest(size - width, F.lit(0))
    each = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.xxhash64(F.array_join(F.slice(F.col(words), i + 1, width), " ")),
    )
    return F.when(size > 0, each).otherwise(F.array().cast("array<long>"))


def simhash(shingles: Column) -> Column:
    """64-bit fingerprint; a shingle weighs as often as it occurs."""

    def signed(bit: Column) -> Column:
        total = F.aggregate(
            shingles,
            F.lit(0),
            lambda sum_, s: sum_ + F.getbit(s, bit).cast("int") * 2 - 1,
        )
        return F.when(total > 0, F.lit("1")).otherwise(F.lit("0"))

    # Bits as two numbers of 32, joined: a literal of 64 would overflow.
    def half(low: int) -> Column:
        text = F.array_join(
            F.transform(F.sequence(F.lit(low), F.lit(low + 31)), signed), ""
        )
        return F.conv(text, 2, 10).cast("long")

    # Never NULL, and said to be: a NULL check would be pushed below and computed twice.
    return F.coalesce(F.shiftleft(half(0), 32).bitwiseOR(half(32)), F.lit(0).cast("long"))


def _cuts(radius: int) -> list[tuple[int, int]]:
    """(shift, mask) of the radius + 1 blocks of a fingerprint."""
    ends = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return [(low, (1 << (high - low)) - 1) for low, high in zip(ends, ends[1:])]


def block_of(fingerprint: Column, cut: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(fingerprint, cut[0]).bitwiseAND(F.lit(cut[1]).cast("long"))


def block_values(fingerprint: Column, radius: int = RADIUS) -> Column:
    """Array of (block number, bits): the blocks make up the fingerprint."""
    return F.array(
        *[
            F.struct(F.lit(i).alias("index"), block_of(fingerprint, cut).alias("bits"))
            for i, cut in enumerate(_cuts(radius))
        ]
    )


def first_equal_block(a: Column, b: Column, radius: int = RADIUS) -> Column:
    """Number of the first block in which two fingerprints agree."""
    different = a.bitwiseXOR(b)
    return F.coalesce(
        *[F.when(block_of(different, cut) == 0, F.lit(i)) for i, cut in enumerate(_cuts(radius))]
    )


def weighted_similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two arrays of shingle hashes as multisets."""
    both = F.aggregate(
        F.array_distinct(a),
        F.lit(0),
        lambda sum_, s: sum_
        + F.least(F.size(F.filter(a, lambda x: x == s)), F.size(F.filter(b, lambda x: x == s))),
    )
    return F.try_divide(both, F.size(a) + F.size(b) - both)


def dense_starts(at: Column, needed: Column, steps: Column, last: Column) -> Column:
    """Ranges (low, high) of the starts up to ``last`` of windows of ``steps``
    shingles that hold ``needed`` or more of the positions ``at``, an ascending
    array of at least so many.

    A start belongs to the first position it does not exceed, so ranges are disjoint.
    """

    def of(j: Column) -> Column:
        low = F.greatest(
            F.lit(0),
            F.element_at(at, j + needed - 1) - steps + 1,
            F.when(j > 1, F.element_at(at, F.greatest(j - 1, F.lit(1))) + 1),
        )
        return F.struct(low.alias("low"), F.least(F.element_at(at, j), last).alias("high"))

    ranges = F.transform(F.sequence(F.lit(1), F.size(at) - needed + 1), of)
    return F.filter(ranges, lambda r: r["low"] <= r["high"])


def shared_windows(
    docs: DataFrame, items: DataFrame, width: int, similarity: float
) -> DataFrame:
    """(doc_id, start, length, window): all windows that may match an item.

    ``window`` is the shingles of as many words as the items of this length
    have; a document shorter than that is one window as a whole.
    """
    sought = items.select(
        F.explode("shingles").alias("shingle"), "length", F.size("shingles").alias("steps")
    ).distinct()
    # The outer form keeps the planner from computing the array twice.
    placed = _shingled(docs, width).select(
        "key", "shingles", F.posexplode_outer("shingles").alias("at", "shingle")
    )
    size = F.least("steps", "there") + F.col("steps")
    needed = F.ceil(similarity * size / (1 + similarity) - 1e-9).cast("int")
    dense = (
        placed.join(F.broadcast(sought), "shingle")
        .select("key", "length", "steps", F.size("shingles").alias("there"), "at")
        .groupBy("key", "length", "steps", "there")
        .agg(F.sort_array(F.collect_set("at")).alias("at"))
        .withColumn("needed", F.greatest(needed, F.lit(1)))
        .where(F.size("at") >= F.col("needed"))
        .select(
            "key",
            "length",
            "steps",
            dense_starts(
                F.col("at"),
                F.col("needed"),
                F.col("steps"),
                F.greatest(F.col("there") - F.col("steps"), F.lit(0)),
            ).alias("ranges"),
        )
    )
    # Stored, so that its real size is known to the join with the texts.
    hits = written_table(dense.where(F.size("ranges") > 0), "dense-windows")
    starts = F.flatten(F.transform("ranges", lambda r: F.sequence(r["low"], r["high"])))
    return (
        _shingled(docs.join(hits, "key"), width, "length", "steps", "ranges")
        .select("doc_id", "length", "steps", "shingles", F.explode(starts).alias("start"))
        .select(
            "doc_id",
            "start",
            "length",
            F.slice("shingles", F.col("start") + 1, F.col("steps")).alias("window"),
        )
    )


def _shingled(docs: DataFrame, width: int, *carry: str) -> DataFrame:
    return docs.select("key", "doc_id", *carry, words_of(F.col("text")).alias("words")).select(
        "key", "doc_id", *carry, shingle_hashes("words", width).alias("shingles")
    )


def _matches(
    docs: DataFrame, items: DataFrame, width: int, radius: int, similarity: float
) -> DataFrame:
    windows = (
        shared_windows(docs, items, width, similarity)
        .withColumn("print", simhash(F.col("window")))
        .withColumn("block", F.explode(block_values(F.col("print"), radius)))
    )
    index = items.select(
        "item_id",
        "length",
        "shingles",
        F.col("print").alias("item_print"),
        F.explode(block_values(F.col("print"), radius)).alias("block"),
    )
    apart = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    near = windows.join(F.broadcast(index), ["length", "block"]).where(
        (apart <= radius)
        & (first_equal_block(F.col("print"), F.col("item_print"), radius) == F.col("block.index"))
    )
    return near.select(
        "doc_id",
        "item_id",
        "start",
        "length",
        weighted_similarity(F.col("window"), F.col("shingles")).alias("similarity"),
    ).where(F.col("similarity") >= similarity)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY
) -> DataFrame:
    """(doc_id, item_id, start, length, similarity) of every matching window.

    ``start`` is the window's first word in the document. Texts without words,
    NULL or empty, match nothing. Rows that repeat a document or an item count
    once. Other columns are ignored. The items go to every executor in parts of
    a bounded size; more of them mean more passes, not larger parts.
    """
    items = written_table(
        benchmark.select("item_id", words_of(F.col("text")).alias("words"))
        .where(F.size("words") > 0)
        .select(
            "item_id", F.size("words").alias("length"), shingle_hashes("words").alias("shingles")
        )
        .withColumn("print", simhash(F.col("shingles"))),
        "items",
    )
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    found = None
    widths = items.groupBy(F.least("length", F.lit(SHINGLE_WORDS)).alias("width")).agg(
        F.sum(F.size("shingles")).alias("total")
    )
    for width, total in sorted(widths.collect()):
        parts = -(-total // PART_SHINGLES)
        of_width = items.where(F.least("length", F.lit(SHINGLE_WORDS)) == width)
        for part in range(parts):
            own = of_width.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
            more = _matches(keyed, own, width, radius, similarity)
            found = more if found is None else found.unionByName(more)
    if found is None:
        found = _matches(keyed, items, SHINGLE_WORDS, radius, similarity)
    return found.distinct()
