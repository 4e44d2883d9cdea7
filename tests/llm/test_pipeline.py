"""The pipeline stage by stage: what must go goes, what is clean stays."""

from __future__ import annotations

import random

import corpus_pipeline as pipeline
from pyspark.sql import functions as F
from tests.llm import brute
from tests.llm.test_operators import DOCS, corpus, documents, sentence


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    rng = random.Random(20)
    item = sentence(rng, 40)
    rows = [(i, t) for i, t in corpus(rng) if t and len(t) < 20000]
    rows += [(100, sentence(rng, 80) + " " + item), (101, sentence(rng, 90)), (102, "12 34"),
             (103, None)]
    sf_dir = str(tmp_path)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(
        f"{sf_dir}/benchmark.parquet"
    )
    clashing = ("score", "lang_pred", "key", "kept", "packed", "spans", "n_words", "class_id")
    docs = documents(spark, rows).withColumns({c: F.lit("theirs") for c in clashing})
    stages = dict(pipeline.STAGES)

    kept = stages["language"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert {r.score for r in kept.collect()} == {"theirs"}
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {i for i, t in rows if t and any(c.isalpha() for c in t)}

    classes = brute.classes(rows)
    unique = stages["near_duplicates"](spark, docs, sf_dir)
    assert unique.columns == docs.columns
    assert {r.doc_id for r in unique.collect()} == set(classes.values())

    cut = stages["repeated_spans"](spark, docs, sf_dir)
    assert cut.columns == docs.columns
    assert {(r.key, r.kept, r.spans) for r in cut.collect()} == {("theirs",) * 3}
    left = {r.doc_id: r.text for r in cut.collect()}
    want = brute.without_repeats(rows, 35, brute.words, b" ".join)
    assert set(left) == {i for i, n, gone, _, _ in want if n == 0 or gone < n}
    assert all(left[i] == dict(rows)[i] for i, _, gone, _, _ in want if not gone)

    clean = stages["decontamination"](spark, docs, sf_dir)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {
        i for i, _ in brute.leaks(rows, [(1, item)])
    }

    for name in ("language", "near_duplicates", "repeated_spans", "decontamination"):
        left = stages[name](spark, docs.limit(0), sf_dir)
        assert left.columns == docs.columns and left.count() == 0


def test_run_and_empty_input(spark, tmp_path, sf_dir):
    packed = pipeline.run(spark, sf_dir)
    assert packed.count() > 0 and "sequence_id" in packed.columns
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    assert pipeline.run(spark, str(tmp_path)).count() == 0
