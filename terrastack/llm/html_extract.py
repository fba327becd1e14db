"""Main text of web pages by maximum-scoring subsequence.

A page is read as a sequence of words and tags (Pasternack and Roth, "Extracting article text from the web with maximum subsequence segmentation"). Words score
by how likely they are text of an article, given whether they stand in a link, heading, list item, or in or outside of an article element; tags score below zero, the more
the less often their kind stands in articles (kinds that no labelled page has: as any tag in, or outside of, an article element). Both weights are learned from labelled pages. One linear scan finds the contiguous region with the greatest sum. Elements that are never
part of an article (menus, forms, scripts, comments, whatever their names or roles tell) count as a single tag and leave no words, within the region too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastack.llm.labelled_pages import PAGES

_TOKEN = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+>?|/(?![a-zA-Z])[^>]*+>?|(/?)([a-zA-Z][^\s/>]*+)((?:[^>="']++|=\s*+(?:"[^"]*+"|'[^']*+')|[="'])*+)>?)|[^<]++|<""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style title textarea noscript iframe xmp noembed noframes".split()}
#: Inline markup that neither nests nor tells anything.
PLAIN = frozenset("b i em strong u s small font tt code big nobr strike sub sup mark abbr cite q kbd samp var time".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre "
    "search section summary table tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are no part of an article.
OUT = frozenset("nav footer aside form button select option fieldset input menu dialog search head template svg canvas audio video object applet map".split()) | RAW.keys()
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Names (parts of class and id) that tell of such elements: the first of any element, the others unless it holds an article element.
NAMES_OUT = frozenset("kommentar kommentare comentario comentarios responses reactions discussion disqus respond reply replies related nav navbar navigation menu breadcrumb breadcrumbs pagination pager share sharing social footer".split())
NAMES_ASIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot anzeige werbung publicite publicidad sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert sidebar sidebars masthead header "
    "aside topbar newsletter subscribe subscription signup login paywall popup modal overlay toolbar recommended recommendations".split()
)
#: Names that tell only when they stand alone.
NAMES_ALONE = frozenset({("widget",), ("widgets",)})
#: Names of either kind by how they begin, and one that begins so and isn't.
BEGINS_OUT, BEGINS_ASIDE, COMMENTARY = "comment", "cookie", "commentary"
_NEGATED = frozenset("no not with without has have is js".split())
#: Of a header of this kind, or one within an article element, the headings stay.
NAMES_OWN = frozenset("post entry article story content".split())
_CLOSES = {"li": ("li", {"ul", "ol", "menu", "dir"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
FEATURES = ("bias", "inside", "outside", "link", "heading", "item")


def _names(attributes: dict[str, str]) -> list[tuple[str, ...]]:
    """The parts of each class and id, without names such as no-sidebar."""
    found = [tuple(p.lower() for p in _PART.findall(name)) for key in ("class", "id") for name in attributes.get(key, "").split()]
    return [n for n in found if n and n[0] not in _NEGATED]


def _verdict(tag: str, attributes: dict[str, str]) -> int:
    """2: the element is no part of an article; 1: unless it holds an article element; 0: it may be."""
    if tag in OUT:
        return 2
    if not attributes:
        return int(tag == "header")
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or _HIDES.search(attributes.get("style", "")):
        return 2
    if attributes.get("role", "").lower() in ROLES:
        return 2
    if tag in ("html", "body", "main"):
        return 0
    found = _names(attributes)
    if tag != "span" and any(not NAMES_OUT.isdisjoint(n) or any(p.startswith(BEGINS_OUT) and p != COMMENTARY for p in n) for n in found):  # spans of this name are comments in program text
        return 2
    aside = any(n in NAMES_ALONE or not NAMES_ASIDE.isdisjoint(n) or n[0].startswith(BEGINS_ASIDE) for n in found)
    return int(tag == "header" or aside and tag not in HEADINGS and tag != "th")


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), unescape(double or single or bare))
    return found


class _Element:
    __slots__ = ("tag", "verdict", "zone", "main", "heading", "item", "own_header", "open_at")

    def __init__(self, tag: str, verdict: int, above: _Element | None, attributes: dict[str, str], open_at: int):
        self.tag, self.verdict, self.open_at = tag, verdict, open_at
        article = not verdict and (tag in ("article", "main") or attributes.get("role", "").lower() == "main" or attributes.get("itemprop", "").lower() == "articlebody")
        self.zone = article or bool(above and above.zone)
        self.main = "data-main" in attributes or bool(above and above.main)
        self.heading = tag in HEADINGS or bool(above and above.heading)
        self.item = tag == "li" or bool(above and above.item)
        parts = {p for n in _names(attributes) for p in n} if verdict == 1 else set()
        self.own_header = verdict == 1 and (tag == "header" or not parts.isdisjoint(("header", "masthead"))) and (self.zone or not parts.isdisjoint(NAMES_OWN))


def read_items(html: str) -> list[tuple]:
    """The page as items in order: (text or tag, whether text, block number, in an article element, link, heading, list item, marked as main). Left-out elements are one tag each.

    Comments, declarations and the content of raw elements are left out; a tag cut off by the end of the page is dropped; unclosed paragraphs, items and cells end where the next begins.
    """
    items: list[tuple] = []
    stack: list[_Element] = []
    block, link_depth, at, end = 0, -1, 0, len(html)

    def pop(depth: int) -> None:
        nonlocal link_depth
        while len(stack) > depth:
            gone = stack.pop()
            if gone.verdict == 2 or gone.verdict == 1 and not gone.own_header:
                del items[gone.open_at :]
                items.append((f"out {gone.tag}", False, block, gone.zone, False, False, False, gone.main))
            elif gone.verdict == 1:
                items[gone.open_at :] = [x for x in items[gone.open_at :] if x[5] or not x[1]]
        if link_depth > len(stack):
            link_depth = -1

    while at < end:
        token = _TOKEN.match(html, at)
        at = token.end()
        tag = token[2]
        if tag is None:
            text = token[0]
            if text[0] != "<" or text == "<":
                top = stack[-1] if stack else None
                if not text.isspace():
                    items.append((text, True, block, bool(top and top.zone), link_depth >= 0, bool(top and top.heading), bool(top and top.item), bool(top and top.main)))
                else:
                    items.append((" ", True, block, False, False, True, False, False))
            continue
        if at == end and html[-1] != ">":
            break
        tag = tag.lower()
        if tag in BLOCKS:
            block += 1
        if token[1]:
            if tag == "a":
                link_depth = -1
            elif tag not in PLAIN:
                depth = next((d for d in range(len(stack) - 1, -1, -1) if stack[d].tag == tag), None)
                if depth is not None:
                    main = stack[depth].main
                    pop(depth)
                    top = stack[-1] if stack else None
                    items.append((tag, False, block, bool(top and top.zone), False, False, False, main))
            continue
        if tag == "br":
            items.append((" ", True, block, False, False, True, False, False))
        if tag in PLAIN:
            continue
        if tag == "a":
            link_depth = len(stack)
            continue
        if tag in _CLOSES:
            names, stops = _CLOSES[tag]
            for d in range(len(stack) - 1, -1, -1):
                if stack[d].tag in stops:
                    break
                if stack[d].tag in names.split():
                    pop(d)
        elif tag in BLOCKS and stack and stack[-1].tag == "p":
            pop(len(stack) - 1)
        attributes = _attributes(token[3]) if token[3] and not token[3].isspace() else {}
        verdict = _verdict(tag, attributes)
        top = stack[-1] if stack else None
        element = _Element(tag, verdict, top, attributes, len(items))
        if element.zone and not (top and top.zone):
            for above in stack:  # what holds an article is not left out by a name such as header or banner
                if above.verdict == 1:
                    above.verdict = 0
        if tag in RAW:
            close = RAW[tag].search(html, at)
            at = end if close is None else close.start()
            stack.append(element)
            continue
        if tag not in VOID:
            items.append((tag, False, block, element.zone, False, False, False, element.main))
            stack.append(element)
    block += 1
    pop(0)
    return items


def _word_features(item: tuple, marked: bool) -> tuple[bool, ...]:
    """FEATURES of an item; `marked` tells whether the page has an article element."""
    return True, item[3], marked and not item[3], item[4], item[5], item[6]


def _has_article(items: list[tuple]) -> bool:
    return any(x[1] and x[3] for x in items)


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and one past the end of the contiguous stretch with the greatest positive sum, the first of equal ones; (0, 0) without any."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, region = total, (start, i + 1)
    return region


class Weights:
    """Scores of words by their features and of tags by their kind, learned from labelled pages."""

    def __init__(self, pages: list[str]):
        read = [read_items(p) for p in pages]
        rows, marks, counts = [], [], []
        tags: dict[tuple[str, bool], list[float]] = {}
        for items in read:
            marked = _has_article(items)
            for x in items:
                if x[1]:
                    rows.append(_word_features(x, marked))
                    marks.append(x[7])
                    counts.append(len(x[0].split()))
                else:
                    for kind in ((x[0], x[3]), ("", x[3])):  # the empty name: any tag in, or outside of, an article element
                        tags.setdefault(kind, [0, 0])
                        tags[kind][0] += x[7]
                        tags[kind][1] += 1
        # logistic regression, weakly held to zero, by Newton's steps; weighted by words
        x, y, n = np.array(rows, float), np.array(marks, float), np.array(counts, float)
        w = np.zeros(x.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-(x @ w)))
            w += np.linalg.solve((x.T * (n * p * (1 - p))) @ x + 0.5 * np.eye(len(w)), x.T @ (n * (y - p)) - 0.5 * w)
        self.word = {f: 2 / (1 + float(np.exp(-(np.array(f, float) @ w)))) - 1 for f in np.ndindex(*(2,) * len(w))}
        any_tag = {zone: tags[("", zone)][0] / tags[("", zone)][1] for zone in (False, True)}
        self.tag = {(t, zone): (a + 2 * any_tag[zone]) / (b + 2) - 1 for (t, zone), (a, b) in tags.items()}
        agreement = {c: round(sum(self._agreement(items, c) for items in read), 9) for c in (0.25, 0.5, 1.0, 2.0, 3.0, 5.0, 8.0, 12.0)}
        best = [c for c, a in agreement.items() if a == max(agreement.values())]
        self.cost = best[len(best) // 2]

    def _agreement(self, items: list[tuple], cost: float) -> float:
        """F1 of the words that the region at this cost of a tag holds."""
        start, end = best_region(self.scores(items, cost))
        size = lambda part, want: sum(len(x[0].split()) for x in part if x[1] and x[7] in want)
        both = size(items[start:end], (True,))
        return 2 * both / max(1, size(items[start:end], (True, False)) + size(items, (True,)))

    def scores(self, items: list[tuple], cost: float | None = None) -> list[float]:
        cost = self.cost if cost is None else cost
        marked = _has_article(items)
        return [self.word[tuple(map(int, _word_features(x, marked)))] * len(x[0].split()) if x[1] else cost * self.tag.get((x[0], x[3]), self.tag["", x[3]]) for x in items]


@cache
def weights() -> Weights:
    return Weights(PAGES)


def main_text(html: str | None, learned: Weights | None = None) -> str:
    """The main text: blocks joined by line ends, white space within a block turned into one space, character references decoded. Blocks that the region cuts are whole."""
    items = read_items(html or "")
    start, end = best_region((learned or weights()).scores(items))
    blocks: dict[int, list[str]] = {x[2]: [] for x in items[start:end] if x[1] and not x[0].isspace()}
    for text, is_text, block, *_ in items:
        if is_text and block in blocks:
            blocks[block].append(unescape(text) if "&" in text else text)
    found = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return "\n".join(x for x in found if x)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of `pages`, weights learned from PAGES alone, so that equal pages give equal texts.

    A null or empty page, and one without words, gives an empty text; pages of any length are read whole (some 30 bytes of memory a byte). Repeated rows and rows with a null page_id or
    url are read each; of regions with equal sums the first counts; an empty table gives none; other columns, whatever their names, are left out.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py()) for html in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(work, "page_id long, url string, text string, n_chars long")
