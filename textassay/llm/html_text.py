"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags and line breaks; scripts, styles, comments and other unseen elements are
left out whole. The first pass classifies each block by where it stands (menus, headers, footers, sidebars, notices,
adverts, forms and reader comments are known by their element, role, class or id), by its link density, and by its
stop-word density and length; blocks too short or too plain to tell stay undecided. In the second pass an undecided
block takes the label of the nearest decided block of the same article, or of the page where there is no article;
between two equally near it is good if either is. A section with no decided block is good inside an article and,
elsewhere, good unless it is made of links. A form, and a class or id of layout (a side, a header, a widget), are weighed
against the page: where one holds far more prose than all that stands elsewhere it is not believed, so a page framework's
form around everything costs nothing. Where a page has no good block at all but prose under any class or id that would set
it apart, that name is not believed either. Where articles hold most of the good text the rest of the page is left out. A
link ends where it is closed or where the element around it ends.

Defined results: a null or blank page has an empty text; unclosed and cut-off markup ends with the page; character
references are decoded once; very long pages are read whole; ties in distance go to good; repeated rows get equal rows; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Frequent function words of the four languages.
STOP_WORDS = frozenset(
    """
    the of and to in is that it was for on are with as at be this have from or by an not but they which you his her had has were their will would there been
    der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie
    de la le les et en un une du que est pour dans qui par sur au pas avec ce il plus ne se son sont cette mais ou comme aux leur
    el los las del se con no su para es al lo como más o pero sus le ya este sí porque esta entre cuando muy sin sobre también me hasta hay donde y a
    """.split()
)

#: Elements that start and end blocks.
BLOCK = frozenset(
    """address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul""".split()
)
UNSEEN = frozenset("script style noscript template iframe object embed svg math canvas audio video head textarea select button noframes".split())
RAW = frozenset("script style textarea title noframes iframe".split())
#: Elements that are never part of the main text.
APART = frozenset("nav footer aside menu dialog".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
APART_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|nav\w*|menu|breadcrumbs?|sidebar|side|"
    r"widget|footer|header|masthead|comments?|comment\w*|replies|respond|disqus|discussion|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|"
    r"search|pagination|pager|toolbar|copyright|disclaimer|skip)(?:$|[\s_-])",
    re.I,
)
#: Of these, names of layout: they may stand around the main text as well.
LAYOUT_NAMES = re.compile(r"(?:banner|notice|alert|popup|modal|overlay|sidebar|side|widget|header|masthead)$", re.I)
#: How surely an element is apart: layout, a name, or a rule of the language.
LAYOUT, NAME, RULE = 1, 2, 3
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TAG = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|$)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: A paragraph ends where one of these begins.
ENDS_P = BLOCK - {"br", "option", "body", "html"}
CUT_OFF = re.compile(r"<(?:/?[a-zA-Z][^<>]*|/|!-?)?$")


@dataclass(slots=True)
class Block:
    text: str
    linked: int = 0
    apart: int = 0  # LAYOUT, NAME or RULE
    holder: int = 0  # the innermost element of layout around it
    article: int = 0  # 0: the page; else the number of the article that holds it
    heading: bool = False
    label: str = ""


@dataclass(slots=True)
class _Open:
    name: str
    apart: int
    holder: int
    article: int
    unseen: bool


@dataclass
class BlockRules:
    """Thresholds of the first pass."""

    most_links: float = 0.5
    short: int = 70
    low_stops: float = 0.12
    stops: float = 0.2
    misnamed: int = 200  # characters of prose that outvote their containers' names where a page has no other
    outweighs: float = 2.0  # times the prose elsewhere that prose under a name of layout must have to outvote it
    words: frozenset = field(default=STOP_WORDS)

    def first(self, b: Block) -> str:
        if b.apart:
            return "bad"
        size = len(b.text)
        if b.linked > self.most_links * size:
            return "bad" if not b.article else "unsure"
        tokens = [w.strip(".,;:!?()\"'»«*#$%&").lower() for w in b.text.split()]
        density = sum(w in self.words for w in tokens) / max(1, len(tokens))
        if size >= self.short and density >= self.low_stops or density >= self.stops and size >= self.short // 2:
            return "good"
        return "unsure"

    def classify(self, blocks: list[Block]) -> None:
        for b in blocks:
            b.label = self.first(b)
        prose = lambda found: sum(len(b.text) for b in found if self.first(replace(b, apart=0)) == "good")

        def believe_not(found: list[Block]) -> None:
            for b in found:
                b.apart = 0
                b.label = self.first(b)

        held: dict[int, list[Block]] = {}
        for b in blocks:
            if b.apart == LAYOUT:
                held.setdefault(b.holder, []).append(b)
        if held:
            largest = max(held.values(), key=prose)
            if prose(largest) >= max(self.misnamed, self.outweighs * sum(len(b.text) for b in blocks if b.label == "good")):
                believe_not(largest)
        if not any(b.label == "good" for b in blocks):  # all prose may stand under a name that misleads
            named = [b for b in blocks if b.apart in (LAYOUT, NAME)]
            if prose(named) >= self.misnamed:
                believe_not(named)
        by: dict[int, list[int]] = {}
        for i, b in enumerate(blocks):
            if not b.apart:
                by.setdefault(b.article, []).append(i)
        for article, members in by.items():
            decided = [(k, blocks[i].label) for k, i in enumerate(members) if blocks[i].label != "unsure"]
            at = 0
            for k, i in enumerate(members):
                b = blocks[i]
                if b.label != "unsure":
                    continue
                while at < len(decided) and decided[at][0] < k:
                    at += 1
                near = [(abs(decided[j][0] - k), decided[j][1] != "good", decided[j][1]) for j in (at - 1, at) if 0 <= j < len(decided)]
                b.label = min(near)[2] if near else "good" if article or b.linked <= self.most_links * len(b.text) else "bad"
        inside, outside = (sum(len(b.text) for b in blocks if b.label == "good" and bool(b.article) == x) for x in (True, False))
        if inside >= outside and inside:
            for b in blocks:
                if not b.article:
                    b.label = "bad"


def _apart(name: str, attributes: str, inside: bool) -> int:
    """How surely an element is never part of the main text: 0, LAYOUT, NAME or RULE."""
    found = LAYOUT if name == "form" else 0
    if name in APART or name == "header" and not inside:
        return RULE
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "role" and value.lower() in APART_ROLES or key == "style" and HIDDEN.search(value) or key == "aria-hidden" and value.lower() == "true":
            return RULE
        if key in ("class", "id") and name not in ("body", "html", "article", "main"):
            names = [m[0].strip(" \t\r\n_-") for m in APART_NAMES.finditer(value)]
            if names:
                found = max(found, LAYOUT if all(map(LAYOUT_NAMES.match, names)) else NAME)
    return found


def blocks(page: str) -> list[Block]:
    """The page's blocks in order; blank ones are left out."""
    out: list[Block] = []
    stack: list[_Open] = []
    articles = holders = 0
    run: list[str] = []
    linked = links = depth = 0  # depth: elements open around the current link
    heading = False
    page = CUT_OFF.sub("", page)

    def top() -> _Open:
        return stack[-1] if stack else _Open("", 0, 0, 0, False)

    def close_block() -> None:
        nonlocal run, linked
        if text := " ".join("".join(run).split()):
            t = top()
            out.append(Block(text, linked, t.apart, t.holder, t.article, heading))
        run, linked = [], 0

    def data(raw: str) -> None:
        nonlocal linked
        if raw and not top().unseen:
            text = html.unescape(raw)
            run.append(text)
            if links:
                linked += len(" ".join(text.split()))

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            data(page[at:])
            break
        data(page[at : m.start()])
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], "")
        if not name:
            continue
        name = name.lower()
        if name == "a":
            links, depth = int(not closing and "href" in attributes.lower()), len(stack)
        if name in BLOCK or name in UNSEEN:
            close_block()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
            links = links if len(stack) >= depth else 0  # a link ends with the element that it is in
            continue
        if name in EMPTY:
            continue
        k = len(stack) - 1
        while k >= 0 and stack[k].name not in BLOCK:
            k -= 1
        if k >= 0 and (name in ENDS_P and stack[k].name == "p" or name == "li" and stack[k].name == "li"):
            del stack[k:]
            links = links if len(stack) >= depth else 0
        t = top()
        article = t.article
        if name in ("article", "main") and not t.article:
            articles += 1
            article = articles
        if name in BLOCK or name in UNSEEN or attributes:
            why = _apart(name, attributes, bool(t.article))
            holders += why == LAYOUT
            stack.append(_Open(name, max(t.apart, why), holders if why == LAYOUT else t.holder, article, t.unseen or name in UNSEEN or name == "title"))
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            stack.pop()
    close_block()
    return out


def main_text(page: str, rules: BlockRules | None = None) -> str:
    found = blocks(page)
    (rules or BlockRules()).classify(found)
    return " ".join(b.text for b in found if b.label == "good")


def extract_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), rules: BlockRules | None = None) -> DataFrame:
    """keep's columns and text of every row."""
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py() or "", rules) for x in batch.column(len(keep))], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), texts], [*keep, "text"])

    return pages.select(*keep, html_col).mapInArrow(run, f"{schema}, text string")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
