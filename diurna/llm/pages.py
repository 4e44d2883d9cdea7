"""Main text of web pages, with site templates removed.

A page is parsed into elements and every element subtree is hashed. Spark counts
per host on how many different pages each hash stands, and subtrees that recur
on many pages of their host are deleted: that is what the site's template puts
on every page. Furniture that differs from page to page (menus, footers, adverts,
forms, ...) is known by its tag or role, or by a class that names nothing else, and
goes as well, unless it holds most of the text. A class or id that only mentions
furniture removes nothing; it lowers the bar for a subtree that recurs. Inside what
the page marks as its article, containers (div, section, ul, table, ...) are counted
and deleted like everywhere; paragraphs, headings, items and text-level markup
are not, so a passage that several articles share stays.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from diurna.llm.text import put_back, set_aside
from diurna.llm.urls import host_of
from diurna.session import ship_by_value, written_table

# A subtree is template if it stands on this many different pages of its host
# and on this share of them.
MIN_PAGES = 5
MIN_SHARE = 0.3
# The same for a subtree whose class or id mentions furniture.
MENTIONED_PAGES = 3
MENTIONED_SHARE = 0.1
# A recurring container with more than half of an article's text and at least
# this many characters is the body of an article published several times.
BODY_CHARS = 500

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_ATTRIBUTE = re.compile(
    r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?"
    r"|\"[^\"]*\"|'[^']*'"
)
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title svg xmp noembed".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q "
    "s samp small span strike strong sub sup time tt u var wbr".split()
)
_PASSAGES = frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption caption tr td th".split()
)
_FURNITURE_TAGS = frozenset(
    "nav header footer aside form head script style noscript template iframe textarea title "
    "svg button select input menu dialog object canvas audio video".split()
)
_FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion "
    "banner nav navbar navigation menu header masthead footer sidebar aside comment comments "
    "reply replies disqus cookie cookies consent notice notices alert popup modal newsletter "
    "subscribe subscription signup login share sharing social related recommended breadcrumb "
    "breadcrumbs pagination pager search form widget toolbar skip".split()
)
# What a class of furniture may say besides: fixed values.
_NEUTRAL_WORDS = frozenset(
    "area bar block bottom box button buttons container global icons inner item items left "
    "link links list right section site thread top unit wrap wrapper".split()
)
_FURNITURE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar dialog alert".split()
)
# A new p or heading ends an open p; the other items end their own kind.
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


@dataclass
class Element:
    tag: str
    furniture: bool
    # Furniture by class, or a form: not if it holds most of the text.
    doubtful: bool
    # A class or id mentions furniture.
    mentioned: bool
    hidden: bool = False
    # Strings and child elements in page order; None is a line break.
    content: list = field(default_factory=list)


def is_hidden(attributes: str) -> bool:
    """Whether the element is hidden by attribute or style; other values say nothing."""
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden":
            return True
        if name == "aria-hidden" and value.strip().lower() == "true":
            return True
        if name == "style" and _UNSEEN.search(value):
            return True
    return False


def named_furniture(value: str) -> tuple[bool, bool]:
    """(a token names furniture and nothing else, some part names furniture)."""
    named = mentioned = False
    for token in value.split():
        parts = [w.lower() for w in _PARTS.findall(token)]
        words = [w for w in parts if w in _FURNITURE_WORDS]
        mentioned |= bool(words)
        named |= bool(words) and all(
            w in _FURNITURE_WORDS or w in _NEUTRAL_WORDS or w.isdigit() for w in parts
        )
    return named, mentioned


def judged(tag: str, attributes: str) -> Element:
    """A new element with what its tag and attributes say about it."""
    sure, doubtful, mentioned = tag in _FURNITURE_TAGS, tag == "form", False
    if attributes and tag not in ("html", "body"):
        for name, *values in _NAMED.findall(attributes):
            value = "".join(values)
            if name.lower() == "role":
                sure |= value.strip().lower() in _FURNITURE_ROLES
            elif tag != "main":
                named, some = named_furniture(value)
                mentioned |= some
                doubtful |= named
        if is_hidden(attributes):
            return Element(tag, True, False, mentioned, True)
    return Element(tag, sure or doubtful, doubtful and (tag == "form" or not sure), mentioned)


def parse(source: str) -> Element:
    """Element tree of a page; broken, cut or empty markup gives what can be read."""
    root = Element("html", False, False, False)
    stack, at, size = [root], 0, len(source)

    def close_until(tags: set, fence: set) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in fence:
                return
            if stack[i].tag in tags:
                del stack[i:]
                return

    while at < size:
        found = _MARKUP.search(source, at)
        upto = found.start() if found else size
        if upto > at:
            stack[-1].content.append(html.unescape(source[at:upto]))
        if not found:
            break
        at = found.end()
        closing, name, attributes = found.group(1, 2, 3)
        if name is None:
            closing, name, attributes = found.group(4, 5, 6)
        if name is None:
            continue
        tag = name.lower()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                # A closing tag of text-level markup does not close blocks.
                if tag in _INLINE and stack[i].tag not in _INLINE:
                    break
            continue
        if tag in ("html", "body"):
            continue
        if tag in _ENDS_P:
            close_until({"p"}, {"article", "section", "div", "td", "li", "main", "button"})
        if tag in _SIBLINGS:
            close_until(*_SIBLINGS[tag])
        if tag == "br":
            stack[-1].content.append(None)
            continue
        if tag in _VOID:
            if tag not in _INLINE:
                stack[-1].content.append(None)
            continue
        element = judged(tag, attributes)
        stack[-1].content.append(element)
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else size
        elif not attributes.rstrip().endswith("/") or tag in _ENDS_P:
            stack.append(element)
    return cleared(root)


def cleared(root: Element) -> Element:
    """Doubtful furniture with more than half of the text around it is none.

    From the outside in: the text around is that of the nearest element that counts.
    """
    order = list(_walk(root))
    if not any(e.doubtful for e in order):
        return root
    # Characters below each element, as if no doubtful one were furniture.
    sizes: dict[int, int] = {}
    for element in reversed([root, *order]):
        total = 0
        for child in element.content:
            if isinstance(child, str):
                total += sum(map(len, child.split()))
            elif child is not None and (child.doubtful or not child.furniture):
                total += sizes[id(child)]
        sizes[id(element)] = total
    todo = [(root, sizes[id(root)])]
    while todo:
        element, around = todo.pop()
        if element.doubtful and 2 * sizes[id(element)] > around:
            element.furniture = False
        if not element.furniture:
            around = sizes[id(element)]
            todo += [(c, around) for c in element.content if isinstance(c, Element)]
    return root


def _walk(element: Element) -> Iterator[Element]:
    """All elements below, in page order; no recursion."""
    todo = [element]
    while todo:
        here = todo.pop()
        todo += [c for c in reversed(here.content) if isinstance(c, Element)]
        if here is not element:
            yield here


def article_roots(root: Element) -> list[Element]:
    """The page's article elements, else its main elements, in page order.

    Those inside furniture count only if there are no others at all.
    """
    for inside in (False, True):
        for tag in ("article", "main"):
            found, todo = [], [root]
            while todo:
                here = todo.pop()
                if here.hidden:
                    continue
                if here.tag == tag and (inside or not here.furniture):
                    found.append(here)
                    continue
                todo += [
                    c
                    for c in reversed(here.content)
                    if isinstance(c, Element) and (inside or not c.furniture)
                ]
            if found:
                return found
    return []


def subtree_hashes(root: Element) -> dict[int, int]:
    """Hash of tag, text and children of each element, by its ``id()``; post-order."""
    hashes: dict[int, int] = {}
    todo = [(root, False)]
    while todo:
        element, ready = todo.pop()
        if not ready:
            todo.append((element, True))
            todo += [(c, False) for c in element.content if isinstance(c, Element)]
            continue
        digest = hashlib.blake2b(element.tag.encode(), digest_size=8)
        for child in element.content:
            if isinstance(child, Element):
                digest.update(b"<%d>" % hashes[id(child)])
            elif child is not None:
                digest.update(" ".join(child.split()).encode("utf-8", "replace"))
        hashes[id(element)] = int.from_bytes(digest.digest(), "big", signed=True)
    return hashes


def removable(root: Element, roots: list[Element]) -> list[Element]:
    """The elements that may be template; ``roots`` are the page's articles.

    An element around an article is none, nor is an article that stands alone.
    """
    inside = {id(e) for a in roots for e in (a, *_walk(a))}
    starts = {id(a) for a in roots}
    elements = list(_walk(root))
    around: set[int] = set()
    for element in reversed(elements):
        below = {id(c) for c in element.content if isinstance(c, Element)}
        if id(element) not in inside and (below & starts or below & around):
            around.add(id(element))

    def may_go(element: Element) -> bool:
        if not element.content or id(element) in around:
            return False
        if id(element) in starts:
            return len(roots) > 1
        return id(element) not in inside or element.tag not in _INLINE | _PASSAGES

    return [e for e in elements if may_go(e)]


def candidate_hashes(source: str) -> list[tuple[int, bool]]:
    """(hash, mentions furniture) of the subtrees that may be template, each once."""
    root = parse(source)
    hashes = subtree_hashes(root)
    found: dict[int, bool] = {}
    for element in removable(root, article_roots(root)):
        own = hashes[id(element)]
        found[own] = found.get(own, False) or element.mentioned
    return sorted(found.items())


def _weight(element: Element) -> int:
    """Characters of text without white space and furniture."""
    total, todo = 0, [element]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            total += sum(map(len, item.split()))
        elif item is not None and not item.furniture:
            todo += item.content
    return total


def template_elements(root: Element, roots: list[Element], template: set[int]) -> set[int]:
    """``id()`` of the elements whose hash is in ``template``, but for article bodies."""
    hashes = subtree_hashes(root)
    found = [e for e in removable(root, roots) if hashes[id(e)] in template]
    if found and roots:
        total = sum(map(_weight, roots))
        weights = [(e, _weight(e)) for e in found]
        found = [e for e, w in weights if w < BODY_CHARS or 2 * w <= total]
    return {id(e) for e in found}


def _text(starts: list[Element], gone: set[int]) -> str:
    blocks: list[str] = []
    for start in starts:
        todo: list = [start]
        while todo:
            item = todo.pop()
            if item is None:
                blocks.append(" ")
            elif isinstance(item, str):
                blocks.append(item)
            elif id(item) not in gone and (item is start or not item.furniture):
                breaks = item.tag not in _INLINE
                if breaks:
                    todo.append(None)
                todo += reversed(item.content)
                if breaks:
                    todo.append(None)
            else:
                blocks.append(" ")
    return " ".join("".join(blocks).split())


def main_text(source: str, template: set[int]) -> str:
    """Text of the page without furniture and without subtrees in ``template``.

    An article that is nothing but such subtrees keeps them.
    """
    root = parse(source)
    roots = article_roots(root)
    gone = template_elements(root, roots, template) if template else set()
    text = _text(roots or [root], gone)
    return text or (_text(roots, set()) if roots and gone else "")


def template_subtrees(
    pages: DataFrame,
    min_pages: int = MIN_PAGES,
    min_share: float = MIN_SHARE,
    mentioned_pages: int = MENTIONED_PAGES,
    mentioned_share: float = MENTIONED_SHARE,
) -> DataFrame:
    """(host, print, template): the recurring subtree hashes of each page.

    ``print`` is the hash of the page's html; copies of a page count once. Only
    pages that have a template subtree appear.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [candidate_hashes(source or "") for source in batch.column(2).to_pylist()]
            hashes = [[h for h, _ in page] for page in found]
            mentioned = [[h for h, named in page if named] for page in found]
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(hashes, lists), pa.array(mentioned, lists)],
                ["host", "print", "subtrees", "mentioned"],
            )

    given = pages.select(
        host_of(F.col("url")).alias("host"),
        F.xxhash64("html").alias("print"),
        "html",
    )
    each = given.mapInArrow(
        hashes, "host string, print long, subtrees array<long>, mentioned array<long>"
    )
    # Copies of a page are one page before anything is listed.
    once = written_table(
        each.groupBy("host", "print").agg(
            F.first("subtrees").alias("subtrees"), F.first("mentioned").alias("mentioned")
        ),
        "page-subtrees",
    )
    sizes = once.groupBy("host").agg(F.count(F.lit(1)).alias("there"))
    listed = once.select(
        "host",
        F.xxhash64("host", "print").alias("page"),
        "mentioned",
        F.explode("subtrees").alias("subtree"),
    ).withColumns(
        {
            "key": F.xxhash64("host", "subtree"),
            "mentioned": F.array_contains("mentioned", F.col("subtree")),
        }
    )
    bar_pages = F.when(F.col("mentioned"), mentioned_pages).otherwise(min_pages)
    bar_share = F.when(F.col("mentioned"), mentioned_share).otherwise(min_share)
    recurring = (
        listed.groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("stands"),
            F.min("host").alias("host"),
            F.bool_or("mentioned").alias("mentioned"),
        )
        .where(F.col("stands") >= bar_pages)
        .join(sizes, "host")
        .where(F.col("stands") >= bar_share * F.col("there"))
        .select("key")
    )
    found = (
        listed.select("key", "page", "subtree")
        .join(recurring, "key")
        .groupBy("page")
        .agg(F.collect_set("subtree").alias("template"))
    )
    pages_of = once.select("host", "print", F.xxhash64("host", "print").alias("page"))
    return pages_of.join(found, "page").select("host", "print", "template")


def extract(
    pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE
) -> DataFrame:
    """All columns of ``pages`` but html, plus text and n_chars.

    The text is the article's, blocks joined by one space, character references
    decoded; n_chars counts its code points. A NULL or empty html gives ''. A
    NULL url belongs to the host ''. Columns called text or n_chars are replaced.
    """
    kept, names = set_aside(pages.drop("text", "n_chars"), "url", "html")
    columns = [c for c in kept.columns if c != "html"]
    templates = template_subtrees(kept, min_pages, min_share)
    keyed = kept.withColumns(
        {"__host": host_of(F.col("url")), "__print": F.xxhash64("html")}
    ).join(
        templates.select(
            F.col("host").alias("__host"), F.col("print").alias("__print"), "template"
        ),
        ["__host", "__print"],
        "left",
    )
    width = len(columns)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = batch.column(width).to_pylist()
            found = [
                main_text(source or "", set(template or ()))
                for source, template in zip(sources, batch.column(width + 1).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(width)],
                    pa.array(found, pa.string()),
                    pa.array([len(t) for t in found], pa.int64()),
                ],
                [*columns, "text", "n_chars"],
            )

    fields = [kept.schema[c] for c in columns]
    schema = StructType(
        [*fields, StructField("text", StringType()), StructField("n_chars", LongType())]
    )
    found = keyed.select(*columns, "html", "template").mapInArrow(texts, schema)
    del names["html"]
    return put_back(found, names, ("text", "n_chars"))


ship_by_value(__name__)
