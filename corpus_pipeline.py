"""The corpus pipeline: stages over ``documents``, each written and read again."""

from __future__ import annotations

from diurna.llm import debruijn, decontaminate, language, neardup, packing, text
from diurna.llm.queries import prepared
from diurna.session import scratch_path
from diurna.sources.tables import table
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those no language clearly explains.

    The trees learn from the labelled documents of three of four hash folds.
    """
    prepared(spark)
    fold = text.learning_fold(F.col("doc_id"), 4)
    trees = language.train(docs.where(fold != 2))
    given, names = text.set_aside(docs, "text")
    judged = language.identify(given, trees)
    kept = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return text.put_back(judged.where(kept), names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each near-duplicate class.

    A row that repeats a kept id goes as well. Rows without an id stay.
    """
    prepared(spark)
    classes = neardup.near_duplicate_classes(docs)
    kept = classes.where(F.col("class_id") == F.col("doc_id")).select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)


def remove_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated spans of words out of the texts; drop what has no word left.

    A text that loses nothing stays as it is, white space included.
    """
    prepared(spark)
    given, names = text.set_aside(docs, "text", "n_chars")
    cut = debruijn.remove_repeats(given)
    changed = F.col("n_removed") > 0
    rest = F.when(changed, F.col("kept")).otherwise(F.col("text"))
    length = F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    left = cut.where((F.col("n_words") == 0) | (F.col("n_removed") < F.col("n_words")))
    return text.put_back(left.withColumns({"text": rest, "n_chars": length}), names)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    prepared(spark)
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every remaining document in training sequences."""
    prepared(spark)
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_spans", remove_repeated_spans),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

# Trained statistics, signatures and tokenizers are beyond SQL; tests/llm holds
# each stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each stage's result stored in between."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
