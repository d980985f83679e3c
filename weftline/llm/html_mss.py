"""Main text of web pages as a maximum-scoring subsequence.

A page is a row of words and tags. Each scores the log ratio of how often its class stands inside and outside the main
region of labelled pages (`labelled_pages.json`, or pages of one's own): words positive, tags negative, and words
negative that stand in menus, adverts, comments and the like, or outside the article of a page that has one. Kadane's linear
scan finds the contiguous run with the largest sum, the main region. A best run begins and ends with blocks of positive
score; blocks of negative score between them, such as adverts within an article, are left out.

A word's class is evidence from the elements around it. An element's name or class speaks against its words unless it
encloses the page's article or first heading, as a body with a class "has-sidebar" does: then it says nothing.

Edge cases: null html counts as empty; a page without words gives the empty text; very long pages are read whole; unclosed,
crossed and truncated tags are closed by the elements around them; an unclosed script, style or comment reaches to the
page's end; of equal sums the first and longest run wins; repeated pages give equal rows; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import html as entities
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|title)\b[^>]*(?:>.*?(?:</\1\s*>|\Z)|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_CLOSED = re.compile(r"(?:^|[\s\"'])/$")  # the slash of a closed tag, not one that ends an unquoted value
#: Elements by their part in a page.
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav footer aside form header menu dialog button fieldset head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTIONS = frozenset("article main".split())
BLOCK_CLOSERS = frozenset("p h1 h2 h3 h4 h5 h6 div ul ol dl li table section article blockquote pre form nav footer header aside main hr figure".split())
#: Parts of class, id and role names that mark menus, adverts, notices, comments and the like.
MARKED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|promo\w*|sponsor\w*|nav\w*|menu\w*|breadcrumbs?|footer|header|masthead|sidebar|aside|widget\w*|cookies?|consent|notices?|popup|modal|newsletter|subscribe|signup|login|search|share|social|related|recommended|comments?|comment-list|respond|disqus|pagination|pager|toolbar|copyright|complementary|contentinfo|navigation)(?:$|[\s_-])", re.IGNORECASE)
#: Names of an article's own header, and the parts that mark an article element as a reader's comment.
TITLE = re.compile(r"(?:post|entry|article|story|content|title)[_-]?(?:header|heading)", re.IGNORECASE)
COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|respond|disqus)(?:$|[\s_-])", re.IGNORECASE)


@dataclass
class Element:
    """An element of a page. `mark` is None, 'hidden', 'element' (what it is) or 'name' (how it is called)."""

    tag: str
    mark: str | None
    parent: int
    words: int = 0
    encloses: bool = False


@dataclass
class Block:
    """Text between block boundaries. `text` is raw until the page's blocks are joined; `kind` is its words' class."""

    text: str
    words: int
    linked: bool
    element: int
    kind: str = "word"


@dataclass
class Page:
    items: list[tuple[str, object]] = field(default_factory=list)
    elements: list[Element] = field(default_factory=lambda: [Element("", None, -1)])

    def around(self, k: int) -> Iterator[Element]:
        while k >= 0:
            yield self.elements[k]
            k = self.elements[k].parent


def _mark(tag: str, attributes: str, in_section: bool) -> str | None:
    """What an element's own name and attributes say against its words."""
    found = {}
    for name, value in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), value.strip("\"'"))
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return "hidden"
    if tag in ("html", "body"):
        return None
    names = TITLE.sub("", " ".join(found.get(k, "") for k in ("class", "id", "role")))
    if tag in SECTIONS:
        return "name" if COMMENT.search(names) else None
    if tag in BOILERPLATE and not (tag == "header" and in_section):
        return "element"
    if tag in HEADINGS:
        names = re.sub(r"header|masthead", "", names, flags=re.IGNORECASE)
    return "name" if MARKED.search(names) else None


def tokens(page: str) -> Iterator[tuple[str, str, tuple[str, ...]]]:
    """('text', raw, ()) and ('open' or 'close', tag, attributes) in page order; scripts, styles and comments are left out."""
    at = 0
    for found in _MARKUP.finditer(page):
        if found.start() > at:
            yield "text", page[at : found.start()], ()
        at = found.end()
        if found[3]:
            yield "close" if found[2] else "open", found[3].lower(), (found[4],)
    if at < len(page):
        yield "text", page[at:], ()


def read(page: str) -> Page:
    """The page as a row of ('tag', name) and ('block', Block), with the elements that blocks stand in."""
    out = Page()
    stack: list[int] = []
    parts, linked = [], 0

    def flush() -> None:
        nonlocal linked
        text = "".join(parts)
        n = len(text.split())
        if n:
            here = stack[-1] if stack else 0
            out.items.append(("block", Block(text, n, 2 * linked > n, here)))
            for element in out.around(here):
                element.words += n
        parts.clear()
        linked = 0

    for kind, value, more in tokens(page):
        if kind == "text":
            parts.append(value)
            if any(out.elements[k].tag == "a" for k in stack):
                linked += len(value.split())
            continue
        inline = value in INLINE
        if value == "br":
            parts.append(" ")
        if kind == "open":
            marks = None if value in VOID else _mark(value, more[0], any(out.elements[k].tag in SECTIONS for k in stack))
            if not inline or marks:
                flush()
            if value in BLOCK_CLOSERS:  # an open paragraph ends where a block begins
                for k in range(len(stack) - 1, -1, -1):
                    if out.elements[stack[k]].tag == "p":
                        del stack[k:]
                        break
                    if out.elements[stack[k]].tag not in INLINE:
                        break
            out.items.append(("tag", value))
            if value not in VOID and not _CLOSED.search(more[0]):
                if (value in SECTIONS or value == "h1") and not marks and not any(out.elements[k].mark in ("hidden", "element") and out.elements[k].tag != "form" for k in stack):
                    for k in stack:
                        out.elements[k].encloses = True
                out.elements.append(Element(value, marks, stack[-1] if stack else 0))
                stack.append(len(out.elements) - 1)
        else:
            place = next((k for k in range(len(stack) - 1, -1, -1) if out.elements[stack[k]].tag == value), None)
            if place is not None:
                if not inline or any(out.elements[k].mark for k in stack[place:]):
                    flush()
                del stack[place:]
            elif not inline:
                flush()
            out.items.append(("tag", "/" + value))
    flush()
    _classify(out)
    return out


def _classify(page: Page) -> None:
    """The class of each block's words, from the elements around it."""
    whole = page.elements[0].words
    headed = any(e.encloses for e in page.elements)

    def against(e: Element) -> bool:
        if e.mark in (None, "hidden"):
            return e.mark == "hidden"
        if e.mark == "element" and e.tag != "form":
            return True
        return not (e.encloses if headed else 2 * e.words > whole)

    speaks = [against(e) for e in page.elements]
    blocks = [x for kind, x in page.items if kind == "block"]
    places = [(b, any(speaks[k] for k in _path(page, b.element)), any(e.tag in SECTIONS and e.mark is None for e in page.around(b.element))) for b in blocks]
    sections = any(inside and not out for _, out, inside in places)
    for block, out, inside in places:
        block.kind = "boilerplate word" if out else "outer word" if sections and not inside else "linked word" if block.linked else "word"


def _path(page: Page, k: int) -> Iterator[int]:
    while k >= 0:
        yield k
        k = page.elements[k].parent


def _class(item: tuple[str, object]) -> str:
    return str(item[1]) if item[0] == "tag" else item[1].kind


def plain(raw: str) -> str:
    """A block's text: character references decoded, white space runs as one space, trimmed."""
    return _SPACE.sub(" ", entities.unescape(raw)).strip()


#: Shares of their log ratios that tags and words against the main text may weigh; the fit takes the best pair.
SCALES = (1.0, 0.5, 0.25, 0.1, 0.05)


def fit_weights(labelled: list[tuple[str, list[str]]], smooth: float = 0.5) -> dict[str, float]:
    """Weights from pages whose main blocks are given: log ratios of a class inside and outside the main region.

    Ratios add up as if words and tags were independent, which tags and the words of one advert are least of all. So the
    share of the ratio that they weigh is fitted as well: the pair under which most labelled pages come out exactly.
    """
    ratios = _ratios(labelled, smooth)

    def scaled(tags: float, words: float) -> dict[str, float]:
        return {k: v * (words if k.endswith(" word") else 1.0 if k == "word" else tags) for k, v in ratios.items()}

    pairs = [(t, w) for t in SCALES for w in SCALES]
    right = [sum(extract(page, scaled(t, w)) == "\n".join(main) for page, main in labelled) for t, w in pairs]
    return scaled(*pairs[right.index(max(right))])


def _ratios(labelled: list[tuple[str, list[str]]], smooth: float) -> dict[str, float]:
    inside, outside = Counter(), Counter()
    for page, main in labelled:
        items, wanted = read(page).items, set(main)
        hits = [k for k, (kind, x) in enumerate(items) if kind == "block" and plain(x.text) in wanted]
        for k, item in enumerate(items):
            within = bool(hits) and hits[0] <= k <= hits[-1]
            if item[0] == "block" and plain(item[1].text) not in wanted:
                within = False
            (inside if within else outside)[_class(item)] += item[1].words if item[0] == "block" else 1
    totals = sum(inside.values()), sum(outside.values())
    out = {}
    for name in {*inside, *outside, "word", "boilerplate word", "outer word", "linked word"}:
        ratio = math.log((inside[name] + smooth) / totals[0]) - math.log((outside[name] + smooth) / totals[1])
        out[name] = max(ratio, 0.1) if name == "word" else ratio if name == "linked word" else min(ratio, -0.05)
    return out


@cache
def default_weights(path: str | None = None) -> tuple[tuple[str, float], ...]:
    """Weights fitted on a file of labelled pages: a list of {"html": page, "main": [text of each main block]}."""
    pages = json.loads(Path(path or Path(__file__).with_name("labelled_pages.json")).read_text(encoding="utf-8"))
    return tuple(sorted(fit_weights([(p["html"], p["main"]) for p in pages]).items()))


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and end of the run with the largest sum; (0, 0) if no score is positive. Of equal sums the first, longest."""
    best, run, start, found = 0.0, 0.0, 0, (0, 0)
    for k, score in enumerate(scores):
        if run < 0:
            run, start = 0.0, k
        run += score
        if run > best or run == best and best > 0 and start == found[0]:
            best, found = run, (start, k + 1)
    return found


def _score(item: tuple[str, object], weights: dict[str, float]) -> float:
    """Words for the main text count one by one; those against it less the more there are, as they stand there together."""
    weight = weights.get(_class(item), -0.5)  # tags that no labelled page has
    if item[0] == "tag":
        return weight
    return weight * (item[1].words if weight > 0 else math.sqrt(item[1].words))


def extract(page: str, weights: dict[str, float] | None = None) -> str:
    """The main text of a page, a line for each block."""
    weights = dict(default_weights()) if weights is None else weights
    items = read(page).items
    scores = [_score(x, weights) for x in items]
    first, end = best_run(scores)
    blocks = [k for k in range(first, end) if items[k][0] == "block"]
    good = [k for k in blocks if scores[k] > 0]
    chosen = [k for k in blocks if scores[k] > 0 or not good or not good[0] < k < good[-1]]
    return "\n".join(filter(None, (plain(items[k][1].text) for k in chosen)))


def main_text(pages: DataFrame, labelled: str | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page. The driver fits the weights on the file `labelled`, by default this module's."""
    weights = dict(default_weights(labelled))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py() or "", weights) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col("html")).mapInArrow(rows, "page_id long, url string, text string, n_chars long")


def op4(pages: DataFrame) -> DataFrame:
    return main_text(pages)
