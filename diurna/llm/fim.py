r"""Fill-in-middle transformation of texts, cut between units of a regular expression.

``regexp_count`` gives a text's number n of units (here lines). Two cuts follow
from the document's id, and a pattern made for the row takes all three parts in
one match:

    \A((?:unit){a}+)((?:unit){b-a}+)(.*+)\z

The counted quantifiers are possessive: the matcher steps from unit to unit and
keeps no way back, so neither time nor stack grows with anything but the text.
Everything is a column expression; rows do not meet, nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE = r"[^\n]*+\n|[^\n]++"
SENTINELS = ("<P>", "<S>", "<M>")
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output", "restored")


def seeded_numbers(seed: int, identity: Column, count: int) -> list[Column]:
    """The first ``count`` 8-digit groups of the sha256 of ``seed:identity`` as numbers.

    A missing identity counts as the empty string.
    """
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit("")))
    digest = F.sha2(name.cast("binary"), 256)
    return [
        F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(count)
    ]


def _literal(replacement: str) -> str:
    """``replacement`` with the signs that refer to groups made plain."""
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def _named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def fill_in_middle(
    docs: DataFrame,
    identity: str = "doc_id",
    unit: str = LINE,
    seed: int = 7,
    rate: int = 100,
    spm_rate: int = 50,
    sentinels: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """All columns of ``docs`` plus n, form, prefix_chars, middle_chars, output, restored.

    ``rate`` per cent of the texts are cut, ``spm_rate`` per cent of those put the
    suffix first. Forms, with the sentinels P, S and M: psm is P prefix S suffix M
    middle, spm is S suffix P prefix M middle, plain is the text as it is. A text
    that is empty (NULL counts as empty, n is 0 then) or holds a sentinel stays
    plain, and has NULL for the lengths of its parts. ``unit`` must match without
    gaps from the beginning of any text to its end, and no empty string. A NULL id
    is drawn as the empty id; rows of one id and text get one result. Columns of
    ``docs`` with the names of the new ones are replaced; all others stay.
    """
    first, second, third = sentinels
    kept = [c for c in docs.columns if c not in ADDED]
    text = F.col("text")
    rows = docs.select(
        F.struct(*[_named(c) for c in kept]).alias("given"),
        F.coalesce(_named("text"), F.lit("")).alias("text"),
        *[h.alias(f"h{i}") for i, h in enumerate(seeded_numbers(seed, _named(identity), 4), 1)],
    )
    counted = rows.withColumn("n", F.regexp_count("text", F.lit(f"(?s){unit}")).cast("long"))
    cuts = [F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")]
    whole = (text == "") | (F.col("h3") % 100 >= rate)
    for sentinel in sentinels:
        whole = whole | F.contains(text, F.lit(sentinel))
    drawn = counted.select(
        "given",
        "text",
        "n",
        F.least(*cuts).alias("a"),
        F.greatest(*cuts).alias("b"),
        F.when(whole, "plain")
        .when(F.col("h4") % 100 < spm_rate, "spm")
        .otherwise("psm")
        .alias("form"),
    )
    pattern = F.concat(
        F.lit(rf"(?s)\A((?:{unit}){{"),
        F.col("a").cast("string"),
        F.lit(rf"}}+)((?:{unit}){{"),
        (F.col("b") - F.col("a")).cast("string"),
        F.lit(r"}+)(.*+)\z"),
    )
    p, s, m = map(_literal, sentinels)
    order = F.when(F.col("form") == "psm", f"{p}$1{s}$3{m}$2").otherwise(f"{s}$3{p}$1{m}$2")
    written = drawn.select(
        "given",
        "n",
        "form",
        F.when(F.col("form") == "plain", text)
        .otherwise(F.regexp_replace(text, pattern, order))
        .alias("output"),
    )
    # The sentinels stand once each, so their places give the parts back.
    output, psm = F.col("output"), F.col("form") == "psm"
    at = written.select(
        "*",
        *[F.locate(x, output).alias(k) for x, k in zip(sentinels, ("p", "s", "m"))],
        F.char_length("output").alias("size"),
    )
    p, s, m = F.col("p"), F.col("s"), F.col("m")
    prefix_chars = F.when(psm, s - p).otherwise(m - p) - len(first)
    suffix_chars = F.when(psm, m - s).otherwise(p - s) - len(second)
    middle_chars = F.col("size") - m - len(third) + 1
    restored = F.concat(
        output.substr(p + len(first), prefix_chars),
        output.substr(m + len(third), middle_chars),
        output.substr(s + len(second), suffix_chars),
    )
    cut = F.col("form") != "plain"
    return at.select(
        *[F.col("given")[c].alias(c) for c in kept],
        "n",
        "form",
        F.when(cut, prefix_chars).cast("long").alias("prefix_chars"),
        F.when(cut, middle_chars).cast("long").alias("middle_chars"),
        "output",
        F.when(cut, restored).otherwise(output).alias("restored"),
    )
