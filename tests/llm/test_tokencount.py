"""Token counts against the tokenizer itself."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from diurna.llm import packing, queries, tokencount
from diurna.sources.tables import table
from tests.llm.test_operators import documents

PATH = packing.default_tokenizer()
MARKS = (
    "a b 's 're ' 'll 'LL 've 'd don't the 1 23 १ é ж 漢字 ! ?! <|endoftext|> <|endof 𝒳 😀 Ɤ - _ qzx"
).split(" ") + [" ", "  ", "\n", "\t", "\x85", "\x1c", "　", " the", "\U0001e5f7", "Ɤ"]


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    queries.prepared(spark)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def whole():
    return tokencount.prove(PATH)


def mixed_texts(seed, count):
    rng = random.Random(seed)
    return ["".join(rng.choice(MARKS) for _ in range(rng.randrange(30))) for _ in range(count)]


def sizes(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("window", [1 << 18, 60, 5])
def test_counts_equal_the_tokenizer(library, whole, monkeypatch, window):
    """Whole texts, and texts cut into windows as the longest ones are."""
    monkeypatch.setattr(tokencount, "WINDOW_POINTS", window)
    texts = mixed_texts(window, 2000)
    got = tokencount.Counter(PATH, whole).count(texts)
    assert got.tolist() == sizes(library, texts)


def test_long_texts_and_long_parts(library, whole):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdeé ") for _ in range(700_000)), "ab" * 40_000, " " * 300_000]
    texts += ["the cat\n\n" * 60_000, "ж" * 50, "".join(rng.choice("tion") for _ in range(64))]
    assert tokencount.Counter(PATH, whole).count(texts).tolist() == sizes(library, texts)


def test_proof_holds(library, whole):
    """Proven strings are one token, all other vocabulary strings are more."""
    vocabulary = tokencount.read_vocabulary(PATH)
    proven = set(tokencount.whole_tokens(vocabulary))
    assert len(proven) == len(whole.keys) + len(whole.long)
    checked = 0
    for string in vocabulary.strings:
        try:
            text = string.decode()
        except UnicodeDecodeError:
            continue
        parts = library.pre_tokenizer.pre_tokenize_str(text)
        if len(parts) == 1:
            checked += 1
            one = len(library.encode(text, add_special_tokens=False).ids) == 1
            assert one == (string in proven)
    assert checked > 40_000


def test_side_by_side_equals_one_by_one():
    vocabulary = tokencount.read_vocabulary(PATH)
    table_ = tokencount.MergeTable(vocabulary.byte_ids, vocabulary.merges)
    rng = np.random.default_rng(4)
    rows = rng.integers(97, 104, (500, 16)).astype(np.uint8)
    rows[:100] = 97
    lengths = rng.integers(1, 17, 500)
    want = [
        tokencount.merged_size([vocabulary.byte_ids[b] for b in r[:n]], vocabulary.merges)
        for r, n in zip(rows.tolist(), lengths)
    ]
    assert table_.sizes(rows, lengths).tolist() == want


def test_slots_that_collide(library, whole, monkeypatch):
    monkeypatch.setattr(tokencount, "SLOT_BITS", 2)
    monkeypatch.setattr(tokencount, "KNOWN_LONG", 3)
    counter = tokencount.Counter(PATH, whole)
    texts = mixed_texts(9, 300)
    for _ in range(2):
        assert counter.count(texts).tolist() == sizes(library, texts)


def test_whole_table(spark, sf_dir, library):
    """The registered query on every row, and odd rows with clashing names."""
    texts = {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").collect()}
    want = dict(zip(texts, sizes(library, list(texts.values()))))
    for r in queries.QUERIES["op12_whole_tokens"](spark, sf_dir).collect():
        assert r.n_tokens == want[r.doc_id] and r.over_limit == (want[r.doc_id] > 1024)
        assert r.n_bytes == len(texts[r.doc_id].encode())
    rows = [(1, None), (1, ""), (None, "a b"), (None, "a b"), (2, " x" * 2000)]
    docs = documents(spark, rows).withColumn("n_tokens", F.lit("x")).withColumn("b.c", F.lit(1))
    got = tokencount.count_tokens(docs, limit=2000).collect()
    assert sorted((r.n_tokens, r.n_bytes, r.over_limit) for r in got) == [
        (0, 0, False), (0, 0, False), (2, 3, False), (2, 3, False), (2000, 4000, False)]
    assert tokencount.count_tokens(documents(spark, [])).count() == 0


def test_other_tokenizers_are_refused(tmp_path):
    given = json.load(open(PATH))
    given["model"]["dropout"] = 0.1
    path = tmp_path / "other.json"
    path.write_text(json.dumps(given))
    with pytest.raises(ValueError):
        tokencount.read_vocabulary(str(path))
