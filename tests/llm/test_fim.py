"""Fill-in-middle against plain Python, on odd texts, ids and columns."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from diurna.llm import fim, queries
from tests.llm.test_operators import documents


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    queries.prepared(spark)


def expected(doc_id, text, rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in fim.SENTINELS) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def odd_texts():
    rng = random.Random(13)
    marks = ["a", "\n", "\n\n", "é\n", "𝒳", "<", ">", "<P", "S>", "$1", "\\", "\r\n", "  "]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(12))) for _ in range(200)]
    texts += [None, "", "one", "a<M>b\nc", "x\n" * 30_000, "y" * 200_000, "\n" * 5_000]
    return [*enumerate(texts), (None, "a\nb\nc\n"), (None, "a\nb\nc\n"), (3, "other\ntext")]


@pytest.mark.parametrize("rate, spm_rate", [(100, 50), (60, 0)])
def test_equals_plain_python(spark, rate, spm_rate):
    rows = odd_texts()
    docs = documents(spark, rows).withColumn("form", F.lit("theirs")).withColumn("given", F.lit(1))
    found = fim.fill_in_middle(docs, rate=rate, spm_rate=spm_rate)
    assert set(found.columns) == {*docs.columns, *fim.ADDED}
    got = sorted(
        (
            (r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.given)
            for r in found.collect()
        ),
        key=str,
    )
    want = sorted(((i, t, *expected(i, t, rate, spm_rate), 1) for i, t in rows), key=str)
    assert got == want
    assert all(r.restored == (r.text or "") for r in found.collect())


def test_other_units_and_sentinels(spark):
    docs = documents(spark, [(i, "one two  three four" * (i % 3)) for i in range(30)])
    marks = ("$1", "\\", "|m|")
    found = fim.fill_in_middle(docs, unit=r"\S++\s*+", sentinels=marks).collect()
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert all(r.restored == r.text for r in found)
    assert all(r.n == len(r.text.split()) for r in found)


def test_empty_table_and_plan(spark):
    docs = documents(spark, []).withColumn("a.b", F.lit(1))
    found = fim.fill_in_middle(docs)
    assert found.count() == 0 and "a.b" in found.columns
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
