"""The manifest against a plain recursive version, and its witnesses."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from diurna.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string"


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    queries.prepared(spark)


def h(values):
    return hashlib.sha256("".join(values).encode()).hexdigest()


def leaf_of(values):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def climb(nodes):
    """(root, [siblings per node]) of nodes in order, level by level."""
    proofs, owners = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(owners):
            run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
            proofs[k].append((at % 16, run[: at % 16] + run[at % 16 + 1 :]))
            owners[k] = at // 16
        nodes = [h(nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], proofs


def expected(rows, shown=lambda row: row):
    """Counter of (doc_id, leaf, subroot, root, proof, folded root)."""
    trees = defaultdict(list)
    for row in rows:
        trees[row[1]].append((row[0], leaf_of(row[:5]), leaf_of(shown(row)[:5])))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    below = {}
    for name in names:
        trees[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        below[name] = climb([x[1] for x in trees[name]])
    root, tops = climb([below[n][0] for n in names])
    out = Counter()
    for name, top in zip(names, tops):
        for (doc_id, leaf, other), steps in zip(trees[name], below[name][1]):
            at = other
            for place, siblings in steps + top:
                at = h(siblings[:place] + [at] + siblings[place:])
            proof = h(s for _, run in steps + top for s in run)
            out[doc_id, leaf, below[name][0], root, proof, at] += 1
    return out


def table_of(spark, sizes, seed=1):
    rng = random.Random(seed)
    rows, at = [], 0
    for source, size in sizes.items():
        for _ in range(size):
            at += 1
            text = rng.choice([None, "", "Some Text", "é ß", f"row {at}"])
            rows.append((at * 7919 % 10_007, source, None, rng.randrange(9), text, "theirs"))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, SCHEMA)


def digests(found):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root")
    return Counter(tuple(r[n] for n in names) for r in found.collect())


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 1},
        {None: 2, "": 17},
        {"hot": 4500, "b": 256, "é": 257, "Z": 16, None: 15, "": 1, "=": 33},
        {f"s{i:03}": 1 + i % 3 for i in range(300)},
    ],
)
def test_equals_the_plain_version(spark, sizes):
    rows, docs = table_of(spark, sizes)
    found = merkle.manifest(docs)
    assert digests(found) == expected(rows)
    assert all(r.verified for r in found.collect())


def test_changed_rows_are_found(spark):
    rows, docs = table_of(spark, {"a": 300, None: 3}, 5)
    lower = F.when(F.col("doc_id") % 2 == 0, F.lower("text")).otherwise(F.col("text"))
    found = merkle.manifest(docs, presented={"text": lower})

    def shown(row):
        text = row[4].lower() if row[0] % 2 == 0 and row[4] is not None else row[4]
        return (*row[:4], text)

    assert digests(found) == expected(rows, shown)
    changed = {r[0] for r in rows if shown(r) != r[:5]}
    assert changed and {r.doc_id for r in found.collect() if not r.verified} == changed


def test_witness_proves_its_row(spark):
    _, docs = table_of(spark, {"a": 290, "b": 2}, 7)
    for r in merkle.manifest(docs, with_witness=True).collect():
        steps = list(merkle.steps_of(bytes(r.witness)))
        assert merkle.folded(r.leaf, steps) == r.root
        assert h(s for _, s in steps) == r.proof_sha256


def test_repeated_rows_and_missing_ids(spark):
    rows = [(None, "a", None, None, None, "x"), (None, "a", None, None, "t", "x"),
            *[(1, "a", "en", 2, "same", "x")] * 20, (1, "a", "en", 2, "other", "x")]
    assert digests(merkle.manifest(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_partial_witnesses_grow_with_later_siblings():
    tree = merkle.OpenTree(2)
    leaves = [h([str(i)]) for i in range(40)]
    for i, leaf in enumerate(leaves):
        tree.append(leaf)
        at, run = tree.witnesses[i // 16 * 16][0]
        assert at == 0 and run == leaves[i // 16 * 16 : i + 1]
    assert tree.close() == climb(leaves)[0]
