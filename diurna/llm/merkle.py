"""Merkle manifest of a table: a root, and for every row the witness that leads to it.

Rows become leaves, ordered within their tree (a source). While a tree has several
nodes, every 16 consecutive ones become their hash; the trees' roots are hashed
likewise, in the order of the trees. Witnesses grow incrementally: a node appended
to an open run holds on to that run, so every sibling that completes later extends
the partial witness of all leaves below.

Spark sorts the leaves once by range, so a tree with a third of all rows lies in
many partitions, and counts give every leaf its place. Blocks of 256 aligned places
are appended in tasks of their own; the block roots are appended in turn as nodes
of the next round, 256 times fewer, until each tree has its root. Back down, each
block gets what its root's witness has gained, as one short row.

A witness is stored as bytes: for each level, from the leaf up, the place in the
run, the number of siblings, and their digests from left to right.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType

from diurna.operators.single import with_row
from diurna.session import ship_by_value, written_table

ARITY = 16
BLOCK_LEVELS = 2
BLOCK = ARITY**BLOCK_LEVELS
# 16 ** 15 leaves are more than a long row number counts up to in practice.
MOST_LEVELS = 15

Step = tuple[int, list[str]]


def combined(digests: Sequence[str]) -> str:
    """The hash of a run: lowercase hex sha256 of its members' hex digests."""
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class OpenTree:
    """Aligned append of nodes, ``levels`` levels high; see the module's text."""

    def __init__(self, levels: int):
        self.runs: list[list[str]] = [[] for _ in range(levels)]
        # First leaf below each open run.
        self.first = [0] * levels
        self.witnesses: list[list[Step]] = []
        self.root: str | None = None

    def append(self, digest: str) -> None:
        self.witnesses.append([])
        self._place(0, digest, len(self.witnesses) - 1)

    def _place(self, level: int, digest: str, low: int) -> None:
        """Put a complete subtree, of the leaves from ``low`` on, into its run."""
        if level == len(self.runs):
            self.root = digest
            return
        run = self.runs[level]
        if not run:
            self.first[level] = low
        for witness in self.witnesses[low:]:
            witness.append((len(run), run))
        run.append(digest)
        if len(run) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        self._place(level + 1, combined(run), self.first[level])

    def close(self) -> str:
        """Complete what is open, from below; returns the root."""
        for level in range(len(self.runs)):
            if self.runs[level]:
                self._complete(level)
        return self.root


def grown(digests: Sequence[bytes], levels: int) -> OpenTree:
    tree = OpenTree(levels)
    for digest in digests:
        tree.append(digest.hex())
    tree.close()
    return tree


def stored(steps: Sequence[Step]) -> bytes:
    return b"".join(
        bytes((at, len(run) - 1)) + bytes.fromhex("".join(run[:at] + run[at + 1 :]))
        for at, run in steps
    )


def steps_of(witness: bytes) -> Iterator[tuple[int, str]]:
    """(place, siblings as one hex text) of each level of a stored witness."""
    at = 0
    while at < len(witness):
        place, count = witness[at], witness[at + 1]
        yield place, witness[at + 2 : at + 2 + 32 * count].hex()
        at += 2 + 32 * count


def folded(leaf: str, steps: Sequence[tuple[int, str]]) -> str:
    """The root that a leaf and the siblings of its witness give."""
    for place, siblings in steps:
        cut = 64 * place
        leaf = hashlib.sha256((siblings[:cut] + leaf + siblings[cut:]).encode()).hexdigest()
    return leaf


@F.arrow_udf(BinaryType())
def _block_root(digests: pa.Array, levels: pa.Array) -> pa.Array:
    both = zip(digests.to_pylist(), levels.to_pylist())
    return pa.array([bytes.fromhex(grown(d, n).root) for d, n in both], pa.binary())


@F.arrow_udf(ArrayType(BinaryType()))
def _block_witnesses(digests: pa.Array, levels: pa.Array, above: pa.Array) -> pa.Array:
    """Each node's witness within its block, and behind it the block's own."""
    out = []
    for d, n, rest in zip(digests.to_pylist(), levels.to_pylist(), above.to_pylist()):
        out.append([stored(w) + rest for w in grown(d, n).witnesses])
    return pa.array(out, pa.list_(pa.binary()))


def _settled(shape: str, with_witness: bool):
    """Per block: proof digest and folded root of each leaf, its witness if asked for."""

    @F.arrow_udf(shape)
    def settle(
        digests: pa.Array, presented: pa.Array, levels: pa.Array, above: pa.Array
    ) -> pa.Array:
        bounds, proofs, roots, kept = [0], [], [], []
        columns = [c.to_pylist() for c in (digests, presented, levels, above)]
        for own, shown, n, rest in zip(*columns):
            upper = list(steps_of(rest))
            for leaf, other, witness in zip(own, shown, grown(own, n).witnesses):
                steps = [(at, "".join(run[:at] + run[at + 1 :])) for at, run in witness] + upper
                proof = "".join(siblings for _, siblings in steps)
                proofs.append(hashlib.sha256(proof.encode()).hexdigest())
                roots.append(folded((leaf if other is None else other).hex(), steps))
                if with_witness:
                    kept.append(stored(witness) + rest)
            bounds.append(len(proofs))
        fields = {"proof": pa.array(proofs, pa.string()), "folded": pa.array(roots, pa.string())}
        if with_witness:
            fields["witness"] = pa.array(kept, pa.binary())
        flat = pa.StructArray.from_arrays(list(fields.values()), list(fields))
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat)

    return settle


def _hex_leaf(values: Sequence[Column]) -> Column:
    """sha256 of all values, each as its byte length, a colon and itself, or as ``-``."""
    parts = []
    for value in values:
        written = value.cast("string")
        size = F.octet_length(written).cast("string")
        parts.append(F.coalesce(F.concat(size, F.lit(":"), written), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _placed(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """``nodes`` of (tree, digest, ...) plus ``place`` in the tree, from 0, and ``depth``.

    One sort by range; a tree that goes over several partitions starts in each at
    the count of those before.
    """
    by = ["tree", *order]
    numbered = written_table(
        nodes.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("number", F.monotonically_increasing_id()),
        "ordered",
    )
    # The id is the partition, and behind it the row in 33 bits.
    number = F.col("number")
    numbered = numbered.withColumns(
        {"part": F.shiftright(number, 33), "row": number.bitwiseAND((1 << 33) - 1)}
    ).drop("number")
    parts = numbered.groupBy("tree", "part").agg(
        F.min("row").alias("first"), F.count(F.lit(1)).alias("here")
    )
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    size = F.sum("here").over(tree)
    depth = reduce(
        lambda total, k: total + (size > ARITY**k).cast("int"), range(MOST_LEVELS), F.lit(0)
    )
    starts = parts.select(
        "tree",
        "part",
        (F.coalesce(F.sum("here").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        depth.alias("depth"),
    )
    return (
        numbered.join(starts, ["tree", "part"])
        .withColumn("place", F.col("row") + F.col("shift"))
        .drop("part", "row", "shift")
    )


def _blocks(nodes: DataFrame, label: str) -> DataFrame:
    """(tree, block, depth, levels, items, root) of (tree, place, depth, digest, ...) rows."""
    rest = [c for c in nodes.columns if c not in ("tree", "place", "depth")]
    grouped = nodes.groupBy("tree", F.floor(F.col("place") / BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("place", *rest))).alias("items"),
        F.max("depth").alias("depth"),
    )
    levels = F.least("depth", F.lit(BLOCK_LEVELS))
    with_levels = grouped.withColumn("levels", levels)
    root = _block_root(F.col("items.digest"), F.col("levels"))
    return written_table(with_levels.withColumn("root", root), label)


def _forest(nodes: DataFrame, label: str) -> tuple[list[DataFrame], DataFrame]:
    """(the blocks of each round, (tree, digest) of every tree's root)."""
    rounds = [_blocks(nodes, f"{label}-0")]
    while True:
        last = rounds[-1]
        more = last.where(F.col("depth") > BLOCK_LEVELS)
        if more.isEmpty():
            break
        nodes = more.select(
            "tree",
            F.col("block").alias("place"),
            (F.col("depth") - BLOCK_LEVELS).alias("depth"),
            F.col("root").alias("digest"),
        )
        rounds.append(_blocks(nodes, f"{label}-{len(rounds)}"))
    done = [
        blocks.where(F.col("depth") <= BLOCK_LEVELS).select("tree", F.col("root").alias("digest"))
        for blocks in rounds
    ]
    return rounds, reduce(DataFrame.unionByName, done)


def _with_witness(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The blocks of the first round, each with its root's witness as ``above``.

    ``above`` holds (tree, above, subroot) of every tree.
    """
    reached = None
    for blocks in reversed(rounds):
        tops = blocks.where(F.col("depth") <= BLOCK_LEVELS).join(above, "tree")
        if reached is None:
            here = tops
        else:
            lower = blocks.where(F.col("depth") > BLOCK_LEVELS).join(reached, ["tree", "block"])
            here = tops.unionByName(lower)
        if blocks is rounds[0]:
            return here
        each = here.select(
            "tree",
            "subroot",
            (F.col("block") * BLOCK).alias("from"),
            F.posexplode(_block_witnesses("items.digest", "levels", "above")),
        )
        reached = written_table(
            each.select(
                "tree",
                (F.col("from") + F.col("pos")).alias("block"),
                F.col("col").alias("above"),
                "subroot",
            ),
            "witnesses",
        )
    raise ValueError("no rounds")


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    tree: str = "source",
    order: str = "doc_id",
    presented: Mapping[str, Column] | None = None,
    with_witness: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: ``order``, ``tree``, leaf, subroot, root,
    proof_sha256, folded_root, verified, and witness if asked for.

    Leaves of a tree ascend by ``order``, NULL first; rows of one id by their leaf,
    so repeated rows lie side by side. Rows with a NULL ``tree`` form a tree of their
    own, the first; trees are ordered by their UTF-8 bytes. A tree of one leaf is
    that leaf. ``presented`` gives columns as they are found at verifying time, in
    place of the given ones; folded_root is what the leaf of these values and the
    original witness give, and verified tells whether it is the root. An empty table
    gives no row. Other columns of ``docs`` are not looked at.
    """
    given = [F.col(f"`{c}`") for c in fields]
    shown = [(presented or {}).get(c, g) for c, g in zip(fields, given)]
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{tree}`").cast("string")), F.lit(""))
    leaves = docs.select(
        F.col(f"`{order}`").alias("id"),
        key.alias("tree"),
        _hex_leaf(given).alias("leaf"),
        _hex_leaf(shown).alias("shown"),
    ).select(
        "id",
        "tree",
        F.unhex("leaf").alias("digest"),
        F.when(F.col("shown") != F.col("leaf"), F.unhex("shown")).alias("presented"),
    )
    # Written first: the sort samples its input, and texts are hashed once.
    nodes = _placed(written_table(leaves, "leaves"), ["id", "digest", "presented"])
    rounds, subroots = _forest(nodes, "blocks")
    listed = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    top_rounds, tops = _forest(_placed(listed, ["name"]), "top")
    start = F.lit(b"").alias("above")
    summit = _with_witness(top_rounds, tops.select("tree", start, F.lit(b"").alias("subroot")))
    above = written_table(
        summit.select(
            F.posexplode(_block_witnesses("items.digest", "levels", "above")), "items"
        ).select(
            F.col("items")[F.col("pos")]["name"].alias("tree"),
            F.col("col").alias("above"),
            F.col("items")[F.col("pos")]["digest"].alias("subroot"),
        ),
        "above",
    )
    shape = "proof:string,folded:string" + (",witness:binary" if with_witness else "")
    settle = _settled(f"array<struct<{shape}>>", with_witness)
    found = _with_witness(rounds, above).select(
        "tree",
        "subroot",
        "items",
        settle("items.digest", "items.presented", "levels", "above").alias("settled"),
    )
    each = found.select(
        "tree", "subroot", F.explode(F.arrays_zip("items", "settled")).alias("row")
    )
    flat = each.select(
        F.col("row.items.id").alias(order),
        F.expr("substring(nullif(tree, ''), 2)").alias(tree),
        F.lower(F.hex("row.items.digest")).alias("leaf"),
        F.lower(F.hex("subroot")).alias("subroot"),
        F.col("row.settled.proof").alias("proof_sha256"),
        F.col("row.settled.folded").alias("folded_root"),
        *([F.col("row.settled.witness").alias("witness")] if with_witness else []),
    )
    root = tops.select(F.lower(F.hex("digest")).alias("root"))
    return with_row(flat, root).withColumn("verified", F.col("folded_root") == F.col("root"))


ship_by_value(__name__)
