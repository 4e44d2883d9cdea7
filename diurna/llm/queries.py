"""Registered queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diurna.llm import (
    debruijn,
    decontaminate,
    fim,
    language,
    merkle,
    neardup,
    packing,
    pages,
    suffixdedup,
    text,
    tokencount,
    topk,
    toxicity,
    urls,
)
from diurna.session import tune
from diurna.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Texts differ in length by orders of magnitude; smaller Arrow batches bound
# what a task holds. A few hundred texts are enough to fill the kernels.
ARROW_ROWS = "500"


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings that the corpus operators are written for."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        @wraps(fn)
        def ready(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepared(spark), sf_dir)

        QUERIES[name] = ready
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    fold = text.learning_fold(F.col("doc_id"), 5)
    model = toxicity.train(docs, labels.where(fold != 0).select("doc_id", "toxic"))
    held_out = F.coalesce(fold == 0, F.lit(False))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op2_bag_minhash")
def op2_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_classes(table(spark, sf_dir, "documents"))


@query("op3_site_templates")
def op3_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


URL_RULES = (
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
)


@query(
    "op4_url_automaton",
    """
    WITH parts AS (
        SELECT page_id,
               translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
        FROM pages),
    ruled AS (
        SELECT page_id, host, path, CASE
            WHEN (host = 'example.org' OR host LIKE '%.example.org')
                 AND starts_with(path, '/en/1') THEN 'example.org/en/1'
            WHEN (host = 'example.org' OR host LIKE '%.example.org')
                 AND starts_with(path, '/es/') THEN 'example.org/es/'
            WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
            WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
            WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
        END AS rule FROM parts)
    SELECT page_id, host, path, rule,
           CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/')
                THEN 'block' ELSE 'allow' END AS verdict
    FROM ruled
    """,
)
def op4_url_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


@query("op5_simhash_decontamination")
def op5_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


@query("op6_debruijn")
def op6_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return debruijn.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op7_linear_grouping")
def op7_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixdedup.remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


@query(
    "op8_no_random_access",
    """
    WITH whole AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id,
               list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
        FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
    ranked AS (
        SELECT query_id, vec_id, score, row_number() OVER (
            PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS "rank" FROM scored)
    SELECT query_id, "rank", vec_id, score FROM ranked WHERE "rank" <= 5
    """,
)
def op8_no_random_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").where(
        F.forall(
            "embedding",
            lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))),
        )
    )
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    return topk.top_k(
        vectors.select("vec_id", scaled.alias("vector")), F.col("vec_id") % 50 == 0, 5
    )


@query("op9_best_two_fit")
def op9_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op10_language")
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = text.learning_fold(F.col("doc_id"), 4)
    trees = language.train(docs.where(fold != 2))
    return language.identify(docs.select("doc_id", "text"), trees).select(
        "doc_id",
        F.coalesce(fold == 2, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )


def _merkle_sql(levels: int = 5) -> str:
    """SQL of op11 for trees of up to 16 ** ``levels`` leaves and as many sources."""

    def leaf(text_sql: str) -> str:
        values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text_sql]
        return "sha256(" + " || ".join(
            f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values
        ) + ")"

    crc = (
        "list_reduce(list_concat([4294967295::BIGINT], list_transform("
        "string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda acc, x: "
        "list_reduce(list_concat([xor(acc, x)], range(8)), "
        "lambda a, i: xor(a >> 1, 3988292384 * (a & 1))))"
    )
    lower = "translate(\"text\", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        f"""leaves AS (
        SELECT row_number() OVER () AS rid, doc_id,
               CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree,
               {leaf('"text"')} AS leaf,
               CASE WHEN doc_id IS NOT NULL AND xor({crc}, 4294967295) % 5 = 0
                    THEN {leaf(lower)} ELSE {leaf('"text"')} END AS shown
        FROM documents)""",
        """s0 AS (
        SELECT rid, tree, row_number() OVER (
                   PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS i,
               leaf AS h, count(*) OVER (PARTITION BY tree) AS n
        FROM leaves)""",
        "f0 AS (SELECT s0.rid, s0.tree, s0.i, shown AS cur, '' AS proof FROM s0 JOIN leaves USING (rid))",
    ]

    def climb(v: str, f: str) -> None:
        for k in range(levels):
            ctes.append(
                f"""{v}r{k} AS MATERIALIZED (
        SELECT tree, i // 16 AS g, list(h ORDER BY i) AS hs, any_value(n) AS n
        FROM {v}{k} GROUP BY tree, i // 16)"""
            )
            ctes.append(
                f"""{v}{k + 1} AS (
        SELECT tree, g AS i, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h,
               count(*) OVER (PARTITION BY tree) AS n FROM {v}r{k})"""
            )
            ctes.append(
                f"""{f}{k + 1} AS MATERIALIZED (
        SELECT rid, f.tree, f.i // 16 AS i,
               CASE WHEN n = 1 THEN cur ELSE sha256(array_to_string(hs[1:f.i % 16], '') || cur
                    || array_to_string(hs[f.i % 16 + 2:], '')) END AS cur,
               CASE WHEN n = 1 THEN proof ELSE proof || array_to_string(hs[1:f.i % 16], '')
                    || array_to_string(hs[f.i % 16 + 2:], '') END AS proof
        FROM {f}{k} f JOIN {v}r{k} r ON f.tree = r.tree AND f.i // 16 = r.g)"""
            )

    climb("s", "f")
    ctes.append(
        f"""t0 AS (
        SELECT tree AS name, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, h,
               count(*) OVER () AS n FROM s{levels})"""
    )
    ctes.append(
        f"""u0 AS (
        SELECT rid, t0.tree, t0.i, cur, proof FROM f{levels} f JOIN t0 ON f.tree = t0.name)"""
    )
    climb("t", "u")
    return f"""
    WITH {", ".join(ctes)}
    SELECT l.doc_id, l.leaf, t0.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256,
           cur AS folded_root, cur = t.h AS verified
    FROM u{levels} u JOIN leaves l USING (rid) JOIN t0 ON l.tree = t0.name, t{levels} t
    """


@query("op11_incremental_witnesses", _merkle_sql())
def op11_incremental_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth document (by crc32 of its id) is presented with its capitals lowered."""
    docs = table(spark, sf_dir, "documents")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate("text", capitals, capitals.lower())
    found = merkle.manifest(
        docs, presented={"text": F.when(changed, lowered).otherwise(F.col("text"))}
    )
    return found.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )


@query("op12_whole_tokens")
def op12_whole_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query(
    "op13_counted_units",
    r"""
    WITH drawn AS (
        SELECT doc_id, coalesce("text", '') AS t,
               regexp_extract_all(coalesce("text", ''), '[^\n]*\n|[^\n]+') AS units,
               sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS digest
        FROM documents),
    cut AS (
        SELECT doc_id, t, units, len(units) AS n,
               ('0x' || substr(digest, 1, 8))::BIGINT % (len(units) + 1) AS c1,
               ('0x' || substr(digest, 9, 8))::BIGINT % (len(units) + 1) AS c2,
               CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                    THEN 'plain'
                    WHEN ('0x' || substr(digest, 25, 8))::BIGINT % 100 < 50 THEN 'spm'
                    ELSE 'psm' END AS form
        FROM drawn),
    parts AS (
        SELECT doc_id, t, n, form,
               coalesce(array_to_string(units[1:least(c1, c2)], ''), '') AS pre,
               coalesce(array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], ''), '') AS mid,
               coalesce(array_to_string(units[greatest(c1, c2) + 1:], ''), '') AS suf
        FROM cut)
    SELECT doc_id, n::BIGINT AS n, form,
           CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t
                  WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                  ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM parts
    """,
)
def op13_counted_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fim.fill_in_middle(docs).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )
