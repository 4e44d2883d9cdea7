"""Corpus operators against brute force, and on awkward inputs."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from diurna.llm import (
    bagminhash,
    debruijn,
    decontaminate,
    graph,
    language,
    neardup,
    packing,
    pages,
    queries,
    suffix,
    suffixdedup,
    text,
    topk,
    toxicity,
    urls,
)
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    queries.prepared(spark)


def sentence(rng, size, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(size))


def corpus(rng):
    """Copies, near copies, shared passages, repeats inside a text, odd texts."""
    base = sentence(rng, 120)
    passage = sentence(rng, 60)
    texts = [base, base, base + " one more", passage]
    for change in (1, 2, 5, 20):
        tokens = base.split()
        for at in rng.sample(range(len(tokens)), change):
            tokens[at] = f"x{at}"
        texts.append(" ".join(tokens))
    for _ in range(6):
        texts.append(f"{sentence(rng, 40)} {passage}\n{sentence(rng, 30)}")
    texts += [f"{passage} {passage}", "a " * 300, "ab" * 900, "é ß ñ " * 90, "few words only"]
    texts += ["few words only", "", None, " \n\t ", sentence(rng, 34), sentence(rng, 3000)]
    return list(enumerate(texts))


def documents(spark, rows):
    full = [(i, t, "en" if i is None or i % 2 else None, None, len(t or "")) for i, t in rows]
    return spark.createDataFrame(full, DOCS)


# --- kernels ---------------------------------------------------------------


def test_words_and_windows_follow_rows():
    rows = ["a bb  c", "", "\td\n", "é e f g"]
    data, offsets = text.text_buffer(pa.array(rows))
    starts, ends, first = text.word_spans(data, offsets)
    raw = data.tobytes()
    assert [raw[s:e] for s, e in zip(starts, ends)] == [w for r in rows for w in r.encode().split()]
    hashes = text.word_hashes(data, starts, ends)
    at, row, _ = text.window_hashes(hashes, first, 2)
    assert row.tolist() == [0, 0, 3, 3, 3] and at.tolist() == [0, 1, 4, 5, 6]


def test_leftmost_minimum():
    rng = np.random.default_rng(1)
    for width in (1, 2, 5, 40):
        values = rng.integers(0, 6, 33).astype(np.uint64) << np.uint64(40)
        want = [int(np.argmin(values[i : i + width])) + i for i in range(33)]
        assert text.leftmost_minimum(values, width).tolist() == want


def test_suffix_order():
    rng = np.random.default_rng(2)
    for _ in range(300):
        s = rng.integers(0, rng.integers(1, 4), rng.integers(0, 25))
        want = sorted(range(len(s)), key=lambda i: tuple(s[i:]))
        assert suffix.suffix_order(s).tolist() == want


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 6, 200), rng.integers(0, 6, 200)
    elements = rng.integers(1, 1 << 60, 200).astype(np.uint64)
    rows = np.repeat([0, 1], 200)
    counts = np.concatenate([a, b])
    some = counts > 0
    signature = bagminhash.signatures(
        rows[some], np.tile(elements, 2)[some], counts[some], 2, 4000
    )
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((signature[0] == signature[1]).mean() - want) < 0.04


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)]
    found = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {(r.node, r.component) for r in found} == {(i, 0) for i in range(21)} | {
        (100 + i, 100) for i in range(30)
    }


# --- 1 toxicity, 10 language -------------------------------------------------


def test_toxicity_is_learnt_and_generalises(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.01")
    rows = queries.QUERIES["op1_toxicity"](spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    judged = rows.join(labels, "doc_id").toPandas()
    held = judged[judged.held_out]
    assert (held.predicted == held.toxic).mean() > 0.93
    assert ((rows.toPandas().score >= 0) & (rows.toPandas().score <= 1)).all()
    folds = {r.doc_id: r.held_out for r in rows.collect()}
    assert all(folds[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in folds)


def test_toxicity_without_both_classes(spark):
    docs = documents(spark, [(1, "x y"), (2, None), (None, "z")])
    labels = spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    scores = [r.score for r in toxicity.score(docs, model).collect()]
    assert len(scores) == 3 and max(scores) < 0.5


def test_language_held_out_accuracy(spark, sf_dir):
    rows = queries.QUERIES["op10_language"](spark, sf_dir).drop("score")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    held = rows.where("held_out").join(docs, "doc_id").toPandas()
    assert (held.lang == held.lang_pred).mean() > 0.95


def test_language_code_lengths_are_exact(spark):
    """Against escape-by-escape coding over the same counts."""
    learnt = ["abracadabra", "abc abd", "ba"]
    sample = spark.createDataFrame([("x", t) for t in learnt], "lang string, text string")
    trees = language.build_trees(language.string_counts(sample).toPandas())
    counts = {}
    for t in learnt:
        for i in range(len(t)):
            for k in range(min(language.ORDER, i) + 1):
                own = counts.setdefault(t[i - k : i], {})
                own[t[i]] = own.get(t[i], 0) + 1
    for t in ["abracadabra", "abdb zz", "b", "qbra"]:
        bits = 0.0
        for i in range(len(t)):
            for k in range(min(language.ORDER, i), -1, -1):
                own = counts.get(t[i - k : i])
                if own is None:
                    continue
                total = sum(own.values()) + len(own)
                if t[i] in own:
                    bits -= np.log2(own[t[i]] / total)
                    break
                bits -= np.log2(len(own) / total)
            else:
                bits += 8.0
        data = np.frombuffer(t.encode(), np.uint8)
        assert abs(trees.code_lengths(data, np.array([0, len(data)]))[0, 0] - bits) < 1e-3


def test_language_without_letters_or_labels(spark):
    docs = documents(spark, [(1, None), (2, ""), (3, "12 !"), (4, "the")])
    nothing = language.train(docs.where("false"))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    trees = language.train(spark.createDataFrame([("en", "the the")], "lang string, text string"))
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, trees).collect()}
    assert found == {1: ("und", 0.0), 2: ("und", 0.0), 3: ("und", 0.0), 4: ("en", 1.0)}


# --- 2 near duplicates -------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_all_pairs(spark, seed):
    rows = corpus(random.Random(seed))
    found = neardup.near_duplicate_classes(documents(spark, rows)).collect()
    assert {r.doc_id: r.class_id for r in found} == brute.classes(rows)


def test_near_duplicates_of_a_dense_group(spark, monkeypatch):
    """Many copies changed at random: stars, blocks and checks have to agree."""
    monkeypatch.setattr(neardup, "BLOCK_NODES", 16)
    rng = random.Random(5)
    base = sentence(rng, 150).split()
    rows = []
    for i in range(70):
        tokens = list(base)
        for at in rng.sample(range(150), rng.randrange(0, 9)):
            tokens[at] = f"x{rng.randrange(9999)}"
        rows.append((i, " ".join(tokens)))
    found = neardup.near_duplicate_classes(documents(spark, rows)).collect()
    assert {r.doc_id: r.class_id for r in found} == brute.classes(rows)


def test_near_duplicates_repeat_and_miss_ids(spark):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (9, None)]
    found = neardup.near_duplicate_classes(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in found) == [
        ("7", "7"), ("7", "7"), ("9", "9"), ("None", "None"),
    ]


# --- 3 pages -----------------------------------------------------------------

PAGE = (
    "<html><head><title>t</title><script>var a='</p>';</script></head><body>"
    "<nav><a href=x>menu {n}</a></nav>{top}<article><h1>Head &amp; more</h1>"
    "<p>One <b>bo</b>ld<br>line &lt;x&gt;<p>Two {n}&am</article>"
    "<div class='comments'><p>first!</p></div><footer>foot</footer>"
)


def test_article_text():
    assert pages.main_text(PAGE.format(n=1, top=""), set()) == (
        "Head & more One bold line <x> Two 1&am"
    )


@pytest.mark.parametrize(
    "source, want",
    [
        ("", ""),
        ("plain", "plain"),
        ("a<b", "a"),
        ("<p>cut <b", "cut"),
        ("<!-- x --><p>y<!-- open", "y"),
        ("<script>never", ""),
        ("<ul><li>a<li>b</ul>", "a b"),
        ("<p>&#233;&nbsp;x</p><p>y", "é x y"),
        ('<div class="Side-Bar sidebar">z</div><div>k</div>', "k"),
        ("<div>" * 5000 + "deep", "deep"),
    ],
)
def test_broken_pages(source, want):
    assert pages.main_text(source, set()) == want


@pytest.mark.parametrize(
    "attributes, stays",
    [
        ('style="overflow:hidden"', True),
        ('class="overflow-hidden"', True),
        ('title="hidden gems"', True),
        ("data-x='a hidden b' id=hidden", True),
        ('href=a/hidden/b', True),
        ("hidden", False),
        ('class="x" HIDDEN=""', False),
        ('style="color:red; visibility: hidden"', False),
        ("style='display:none'", False),
        ("style=display:none", False),
        ('aria-hidden="true"', False),
        ('aria-hidden="false"', True),
    ],
)
def test_only_hidden_elements_are_hidden(attributes, stays):
    for tag in ("article", "div"):
        source = f"<{tag} {attributes}>text</{tag}><p>k</p>"
        want = "text" if tag == "article" else "text k"
        assert pages.main_text(source, set()) == (want if stays else "k")


def test_template_is_what_recurs_on_a_host(spark):
    """Pages without an article: only counting tells the template from the text."""
    top = "<div class='x'>Welcome to <i>our</i> site</div>"
    rows = [
        (i, f"http://H.org/{i}", f"<body>{top}<p>text number {i}</p><p>same</p></body>")
        for i in range(8)
    ]
    rows += [(20, "http://other.org/", rows[0][2]), (21, None, None), (22, "x", "")]
    rows += [(30, "http://copy.org/", "<p>one and the same</p>")] * 9
    given = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {(r.page_id): r.text for r in pages.extract(given).collect()}
    assert found[3] == "text number 3"
    assert found[20] == "Welcome to our site text number 0 same"
    assert found[21] == found[22] == "" and found[30] == "one and the same"


def test_blocks_that_recur_inside_articles_go(spark):
    """Unmarked blocks by their counts; shared paragraphs and bodies stay."""
    box = "<div>Read <b>also</b> our <span>weekly letter</span></div>"
    body = "<div><p>" + "syndicated words " * 50 + "</p></div>"

    def page(i):
        own = f"<p>text <b>so</b> number {i}</p><div>own {i}</div>"
        return f"<div id=a><article><h1>Head</h1>{own}<p>shared passage</p>{box}</article></div>"

    rows = [(i, f"http://h.org/{i}", page(i)) for i in range(8)]
    rows += [(10, "http://h.org/m", f"<main><p>short</p><ul>x</ul>{box}</main>")]
    rows += [(11, "http://h.org/n", f"<p>no article</p>{box}")]
    rows += [(12, "http://h.org/o", f"<article>{box}</article>")]
    rows += [(20 + i, "http://b.org/", f"<article>{body}<p>Nr. {i}</p></article>") for i in range(6)]
    rows += [
        (30 + i, "http://c.org/", f"<article><p>news {i}</p></article><article>card</article>")
        for i in range(6)
    ]
    given = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in pages.extract(given).collect()}
    assert found[3] == "Head text so number 3 own 3 shared passage"
    assert found[10] == "short x" and found[11] == "no article"
    assert found[12] == "Read also our weekly letter"
    assert found[21] == "syndicated words " * 50 + "Nr. 1"
    assert found[31] == "news 1"


# --- 4 URL rules -------------------------------------------------------------


@pytest.mark.parametrize(
    "page",
    [
        '<div class="page has-sidebar"><article><p>real text</p></article></div>',
        '<article class="post header-fixed"><p>real text</p></article>',
        '<div class="content-with-sidebar"><p>real text</p></div>',
        '<div id="search-results"><p>real text</p></div>',
        '<section class="related-work"><p>real text</p></section>',
        '<div class="form-text"><p>real text</p></div>',
        '<form id="aspnet"><div>real text</div><input value="x"></form>',
        '<div class="sidebar"><article>real text</article></div>',
        '<div class="header"><p>real</p> text</div><div class="footer-links">c 2024</div>',
        '<article>real<div class="cookie-notice">c</div><ul id="comment_list2"><li>c</li></ul>'
        ' text</article>',
        '<main>real<form>c</form><div class="adBox">c</div> text</main><article class="comment">c'
        "</article>",
    ],
)
def test_classes_remove_only_what_they_name(page):
    assert pages.main_text(page, set()) == "real text"


def test_counts_equal_plain_counting(spark):
    """The template of every page, by a dictionary per host over all its pages."""
    rng = random.Random(31)
    blocks = ["<div>about us</div>", '<div class="has-promo">buy</div>', "<ul><li>a<li>b</ul>"]
    rows = []
    for i in range(60):
        own = "".join(b for b in blocks if rng.random() < 0.35)
        body = f"<p>{sentence(rng, 8)}</p>" + rng.choice(["", "<section>note</section>"])
        body = body if i % 3 else f"<article>{body}{rng.choice(blocks)}</article>"
        rows.append((i, f"http://h{i % 3 if i < 57 else 3}.org/{i}", own + body))
    rows += [(100, rows[0][1], rows[0][2]), (101, None, None), (102, None, "")]
    prints = {}
    for _, url, source in rows:
        host = (url or "").split("://")[-1].split("/")[0]
        prints[host, source] = dict(pages.candidate_hashes(source or ""))
    want = {}
    for host in {h for h, _ in prints}:
        own = {p: found for (h, p), found in prints.items() if h == host}
        for source, found in own.items():
            gone = set()
            for subtree in found:
                stands = sum(subtree in other for other in own.values())
                named = any(other.get(subtree) for other in own.values())
                least, share = (3, 0.1) if named else (5, 0.3)
                if stands >= least and stands >= share * len(own):
                    gone.add(subtree)
            if gone:
                want[host, source] = gone
    given = spark.createDataFrame(rows, "page_id long, url string, html string")
    keyed = given.select(F.xxhash64("html").alias("print"), "html").distinct()
    found = pages.template_subtrees(given).join(keyed, "print")
    assert {(r.host, r.html): set(r.template) for r in found.collect()} == want
    assert want and any(len(v) > 1 for v in want.values())


def test_page_columns_keep_their_names(spark):
    names = ("template", "host", "print", "subtrees", "text", "__own_0", "n_chars", "a.b")
    given = spark.createDataFrame([(1, None, "<p>x")], "page_id long, url string, html string")
    found = pages.extract(given.withColumns({n: F.lit("theirs") for n in names}))
    row = found.first()
    assert [row[n] for n in names] == ["theirs"] * 4 + ["x", "theirs", 1, "theirs"]


def test_globs_match_like_patterns():
    import re

    rng = random.Random(4)
    globs = ["*.org/**", "a?c*", "**x**", "\\*a", "", "**", "a/*/b", "*" * 1, "é**"] * 3
    strings = ["", "x.org/", "abc", "a/c", "*a", "a/zz/b", "a/z/z/b", "éa", "y.org", ".org/q"]
    strings += ["".join(rng.choice("ac/x.*org") for _ in range(rng.randrange(12)))
                for _ in range(200)]
    data, edges = text.text_buffer(pa.array(strings))
    found = urls.Automaton(globs).matches(data, edges)
    forms = {"byte": lambda v: re.escape(bytes([v])), "any": lambda v: b"[^/]",
             "star": lambda v: b"[^/]*", "stars": lambda v: b".*"}
    for j, glob in enumerate(globs):
        pattern = re.compile(b"".join(forms[k](v) for k, v in urls.parsed_glob(glob)), re.S)
        for i, string in enumerate(strings):
            assert found[i, j] == bool(pattern.fullmatch(string.encode())), (glob, string)


def test_longest_rule_wins_and_odd_urls(spark):
    rows = [
        (1, "http://A.Example.org/en/12?x"), (2, "https://notexample.org/es/"),
        (3, "http://example.org"), (4, None), (5, "org/"), (6, "x://org/#"),
        (7, "http://b.com/fr/1"), (8, "http://com.net/fr/"), (9, "http://x.org/" + "a" * 9000),
    ]
    given = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit(1))
    found = {r.page_id: (r.rule, r.verdict) for r in urls.judge(given, queries.URL_RULES).collect()}
    assert found == {
        1: ("example.org/en/1", "block"), 2: ("org/", "allow"), 3: (None, "allow"),
        4: (None, "allow"), 5: (None, "allow"), 6: ("org/", "allow"), 7: ("com/fr/", "allow"),
        8: (None, "allow"), 9: ("org/", "allow"),
    }


# --- 5 decontamination -------------------------------------------------------


def test_leaks_equal_all_windows(spark):
    rng = random.Random(6)
    items = [(k, sentence(rng, 8 + 7 * k)) for k in range(6)]
    items += [(10, "tiny item"), (11, ""), (12, None), (13, items[3][1])]
    docs = []
    for i, (_, t) in enumerate(items[:6]):
        tokens = t.split()
        docs.append((2 * i, f"{sentence(rng, 30)} {t.upper()} {sentence(rng, 9)}"))
        tokens[len(tokens) // 2] = "changed"
        docs.append((2 * i + 1, " ".join(["start", *tokens, "end"])))
    docs += [(50, items[5][1]), (51, " ".join(items[5][1].split()[:-3])), (52, None), (53, "")]
    docs += [(54, sentence(rng, 400)), (55, "tiny item"), (56, f"{items[2][1]} {items[2][1]}")]
    given = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(documents(spark, docs), given).collect()
    assert {(r.doc_id, r.item_id) for r in found} == brute.leaks(docs, items)


def test_leaks_in_any_order_and_every_window(spark):
    """Halves that changed places share no aligned window with the item."""
    rng = random.Random(16)
    items = [(k, sentence(rng, size, 5000)) for k, size in enumerate((55, 56, 90, 4, 1))]
    docs = []
    for k, (_, t) in enumerate(items[:3]):
        tokens = t.split()
        half = len(tokens) // 2
        swapped = " ".join(tokens[half:] + tokens[:half])
        docs.append((10 * k, f"{sentence(rng, 40)} {swapped} {sentence(rng, 40)}"))
        docs.append((10 * k + 1, f"{swapped} {sentence(rng, 3)}"))
        docs.append((10 * k + 2, f"{sentence(rng, 3)} {t}"))
        docs.append((10 * k + 3, " ".join(tokens[half:] + tokens[: half - 5])))
    docs += [(50, f"a {items[3][1]} b"), (51, f"x {items[4][1]} y"), (None, items[0][1])]
    given = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(documents(spark, docs), given).collect()
    assert (0, 0) in brute.leaks(docs, items)
    assert {(r.doc_id, r.item_id) for r in found} == brute.leaks(docs, items)
    every = set()
    for item, t in items:
        own = t.split()
        for doc, text_ in docs:
            there = text_.split()
            for k in range(max(1, len(there) - len(own) + 1)):
                if brute.jaccard(brute.bag(there[k : k + len(own)]), brute.bag(own)) >= 0.8:
                    every.add((doc, item, k))
    assert {(r.doc_id, r.item_id, r.start) for r in found} == every


def test_blocks_find_every_fingerprint_within_the_radius(spark):
    rng = random.Random(8)
    pairs = []
    for _ in range(200):
        a, b = rng.getrandbits(64), 0
        for bit in rng.sample(range(64), rng.randrange(0, decontaminate.RADIUS + 1)):
            b |= 1 << bit
        pairs.append(tuple(x - (1 << 64) if x >= 1 << 63 else x for x in (a, a ^ b)))
    found = spark.createDataFrame(pairs, "a long, b long").select(
        decontaminate.first_equal_block(F.col("a"), F.col("b")).alias("i"),
        decontaminate.block_values(F.col("a")).alias("x"),
        decontaminate.block_values(F.col("b")).alias("y"),
    ).collect()
    assert all(r.i is not None and r.x[r.i] == r.y[r.i] for r in found)


# --- 6 and 7 repeats ---------------------------------------------------------


@pytest.mark.parametrize("seed, span", [(1, 35), (2, 35), (3, 6), (4, 2)])
def test_word_repeats_equal_brute_force(spark, seed, span):
    rows = corpus(random.Random(seed))
    want = brute.without_repeats(rows, span, lambda t: (t or "").encode().split(), b" ".join)
    found = debruijn.remove_repeats(documents(spark, rows), span).collect()
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found}
    assert got == {(i, n, gone, digest) for i, n, gone, _, digest in want}


@pytest.mark.parametrize("seed, span, large", [(1, 400, 512), (2, 60, 512), (3, 60, 2), (4, 3, 8)])
def test_byte_repeats_equal_brute_force(spark, monkeypatch, seed, span, large):
    monkeypatch.setattr(suffixdedup, "PART_BLOCKS", large)
    rows = [(i, (t or "")[:2500] if t is not None else None) for i, t in corpus(random.Random(seed))]
    want = brute.without_repeats(rows, span, lambda t: (t or "").encode(), bytes)
    found = suffixdedup.remove_repeats(documents(spark, rows), span).collect()
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found}
    assert got == set(want)


# --- 8 top-k -----------------------------------------------------------------


@pytest.mark.parametrize("scale", [3, 300, 1 << 29])
def test_top_k_equals_all_products(spark, scale):
    rng = np.random.default_rng(scale)
    vectors = rng.integers(-scale, scale, (300, 7))
    vectors[100:130] = vectors[100]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(999, None), (998, [1, 2])]
    given = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    found = topk.top_k(given, F.col("vec_id") % 50 == 0, 5, block_rows=64, block_queries=2)
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()}
    want = set()
    for q in range(0, 300, 50):
        scores = sorted((-int(vectors[q] @ vectors[i]), i) for i in range(300) if i != q)
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])}
    assert got == want


# --- 9 packing ---------------------------------------------------------------


def test_tokens_equal_the_tokenizer():
    rng = random.Random(9)
    encoder = packing.Encoder(packing.default_tokenizer())
    signs = "ab é ñ'sdlmrtve'' \n\t  12½!?.,’ü漢 x  'll've\u00a0\u2028🙂"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += ["", "'", "''s", "a's", " 's", "'re", "x<|endoftext|>y", "it's 'split", "\n 'd"]
    ids, bounds = encoder.encode(texts)
    for i, t in enumerate(texts):
        want = encoder.tokenizer.encode(t, add_special_tokens=False).ids
        assert ids[bounds[i] : bounds[i + 1]].tolist() == want, t


def test_packing_round_trip(spark):
    rng = random.Random(10)
    rows = corpus(rng) + [(1, "again"), (None, "no id"), (500, sentence(rng, 4000))]
    found = packing.pack(documents(spark, rows), limit=256, keep_ids=True).toPandas()
    assert (found.length <= 256).all() and (found.ids.map(len) == found.length).all()
    for _, pieces in found.groupby("sequence_id"):
        at = 0
        for p in pieces.sort_values("offset").itertuples():
            assert p.offset == at
            at += p.length
        assert at <= 256
    encoder = packing.Encoder(packing.default_tokenizer())
    own = found[found.doc_id == 500].sort_values("piece")
    ids = [i for part in own.ids for i in part]
    assert ids == [*encoder.tokenizer.encode(rows[-1][1], add_special_tokens=False).ids, 0]
    for p in own.itertuples():
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
    assert len(found[found.doc_id == 1]) >= 2
    waste = found.sequence_id.nunique() - found.length.sum() / 256
    assert waste < 2


def test_two_for_one_fills_a_gap():
    bins, _ = packing.best_two_fit(np.array([60, 30, 25, 14]), 100)
    # 60 + 30 leaves 10; 25 + 14 = 39 takes the place of 30 and fits better.
    assert bins.tolist() == [0, 1, 0, 0]


# --- all ---------------------------------------------------------------------

BOTH = {
    "toxicity": lambda s, d: toxicity.score(d, toxicity.Classifier(np.zeros(1 << 18), 0.0)),
    "neardup": lambda s, d: neardup.near_duplicate_classes(d),
    "language": lambda s, d: language.identify(d, language.train(d)),
    "debruijn": lambda s, d: debruijn.remove_repeats(d),
    "suffixdedup": lambda s, d: suffixdedup.remove_repeats(d),
    "packing": lambda s, d: packing.pack(d),
    "decontaminate": lambda s, d: decontaminate.contaminated(
        d, s.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    ),
}


@pytest.mark.parametrize("name", sorted(BOTH))
def test_clashing_columns_and_empty_tables(spark, name):
    extra = ("score", "lang_pred", "key", "kept", "packed", "spans", "band", "block", "node")
    docs = documents(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, None)])
    for column in extra:
        docs = docs.withColumn(column, F.lit("theirs"))
    few = BOTH[name](spark, docs).collect()
    assert len(few) == (1 if name == "decontaminate" else 3)
    assert BOTH[name](spark, docs.where("false")).collect() == []


def test_empty_pages_and_vectors(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert pages.extract(none).collect() == [] and urls.judge(none, queries.URL_RULES).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, vector array<long>")
    assert topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5).collect() == []


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    from tests.compare import compare, connect

    found = queries.QUERIES[name](spark, sf_dir)
    assert compare(found, connect(sf_dir), queries.ORACLES[name]) is None


def test_word_spans_beyond_a_mask_are_refused(spark):
    rng = random.Random(9)
    passage = sentence(rng, 150)
    rows = [(i, f"{sentence(rng, 20)} {passage} {sentence(rng, 20)}") for i in range(3)]
    docs = documents(spark, rows)
    with pytest.raises(ValueError, match="span"):
        debruijn.remove_repeats(docs, debruijn.MAX_SPAN + 1)
    found = debruijn.remove_repeats(docs, debruijn.MAX_SPAN).collect()
    want = brute.without_repeats(rows, debruijn.MAX_SPAN, brute.words, b" ".join)
    assert {(r.doc_id, r.n_removed) for r in found} == {(w[0], w[2]) for w in want}
