"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block. A line weighs as many characters as it has outside links. Weights are summed
over sliding windows of lines: where the sum rises to the threshold a text surges, where it falls back it dives, and the
lines in between are the page's text. Markup changes weights only: lines of menus, notices and the like weigh nothing, lines
of an article or main element surge by themselves, and on such a page other lines weigh a part of their characters, so that
only a long text outside surges too. A class or id counts as a notice or menu if all its words say so; if only some do
(``related-work``), its lines weigh less and the distribution decides.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size

#: Lines per window, and the characters in a window at which a text surges. It dives where a window has none, on a page
#: with a main element where it has less than a quarter of that.
WINDOW = 3
SURGE = 86
#: Characters that count as one: outside a page's main element, and in elements whose name says in part that they are no text.
OUTSIDE, DOUBTFUL = 8, 4

# Public element names and common names of classes, ids and roles.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object", "textarea", "select", "math", "canvas", "head"}
CHROME = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu"}
MAIN = {"article", "main"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
    "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt",
    "u", "var", "wbr",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements with optional or often forgotten end tags; they carry no context.
LOOSE = {"p", "li", "dt", "dd", "tr", "td", "th", "option", "html", "body", "br", "hr"}
CHROME_NAMES = {
    "ad", "ads", "advert", "advertisement", "adverts", "alert", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu",
    "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "promoted",
    "recommended", "related", "replies", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored",
    "subscribe", "toolbar", "widget",
}
#: Words that say nothing about what an element holds.
PLAIN_NAMES = {
    "area", "bar", "block", "bottom", "box", "button", "buttons", "card", "col", "column", "container", "group", "icon",
    "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "page", "panel", "post", "posts",
    "right", "row", "section", "side", "site", "slot", "this", "top", "unit", "wrap", "wrapper", "zone",
}
CHROME_ROLES = {"alert", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "navigation", "search"}
TITLES = {"header", "masthead"}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([A-Za-z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


@dataclass
class Line:
    text: str
    plain: int
    main: bool
    doubtful: bool


def named(value: str) -> str | None:
    """What a class or id says of an element: ``title`` or ``other`` if a name's words all do, ``part`` if only some do."""
    found = None
    for name in value.split():
        parts = {p.lower() for p in NAME_PART.findall(name)}
        hits = parts & CHROME_NAMES
        if not hits:
            continue
        if parts - CHROME_NAMES - PLAIN_NAMES:
            found = found or "part"
        elif hits <= TITLES:
            found = "title" if found != "other" else found
        else:
            found = "other"
    return found


def chrome(tag: str, attributes: str) -> str | None:
    """Why an element is not part of a text: ``title`` for headers, ``other``, ``part`` if that is in doubt, or None."""
    found = "title" if tag == "header" else "other" if tag in CHROME else None
    if not attributes:
        return found
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            said = named(value)
            if said and found != "other" and not (said == "part" and found):
                found = said
        elif name == "role" and value.lower() in CHROME_ROLES or name == "hidden":
            found = "other"
        elif name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            found = "other"
    return found


def lines(page: str) -> list[Line]:
    """The page's blocks as lines, with their characters outside links and what holds them."""
    out: list[Line] = []
    texts: list[str] = []
    plain = 0  # characters outside links in the current line
    stack: list[tuple[str, str | None]] = []  # open elements with context, and why they are no text
    bare = mains = links = 0  # depths: not text at all, main elements, links
    titles = doubts = 0
    heading = False
    at, size = 0, len(page)

    def take(piece: str) -> None:
        nonlocal plain
        if piece and not bare and (not titles or heading and mains):
            piece = html.unescape(piece) if "&" in piece else piece
            texts.append(piece)
            if not links:
                plain += len(piece)

    def close() -> None:
        nonlocal plain
        text = " ".join("".join(texts).split())
        if text:
            out.append(Line(text, min(plain, len(text)), mains > 0, doubts > 0))
        texts.clear()
        plain = 0

    def leave(n: int) -> None:
        nonlocal bare, titles, mains, doubts
        while len(stack) > n:
            tag, why = stack.pop()
            bare -= why == "other"
            titles -= why == "title"
            doubts -= why == "part"
            mains -= tag in MAIN

    while at < size:
        hit = TAG.search(page, at)
        if hit is None:
            take(page[at:])
            break
        take(page[at : hit.start()])
        at = hit.end()
        tag = (hit[2] or hit[5] or "").lower()
        if not tag:
            continue
        ending, attributes = bool(hit[1] or hit[4]), hit[3] or hit[6] or ""
        if tag in INLINE:
            if tag == "a":
                links = 0 if ending else 1
            continue
        close()
        links = 0
        if tag in HEADINGS:
            heading = not ending
        if ending:
            places = [i for i, (name, _) in enumerate(stack) if name == tag]
            if places:
                leave(places[-1])
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else size
        elif tag not in VOID and tag not in LOOSE and tag not in HEADINGS and not attributes.endswith("/"):
            why = chrome(tag, attributes)
            stack.append((tag, why))
            bare += why == "other"
            titles += why == "title"
            doubts += why == "part"
            mains += tag in MAIN
    close()
    return out


def between(weights: list[int], threshold: int, window: int = WINDOW, dive: int = 1) -> list[tuple[int, int]]:
    """The runs of lines from a surge (the window from a line on sums to the threshold) to the dive after it (to less
    than ``dive``)."""
    sums = [sum(weights[i : i + window]) for i in range(len(weights))]
    runs, start = [], None
    for i, total in enumerate(sums):
        if start is None and total >= threshold:
            start = i
        elif start is not None and total < dive:
            runs.append((start, i))
            start = None
    if start is not None:
        runs.append((start, len(weights)))
    return runs


def weighed(found: list[Line], surge: int) -> list[int]:
    """The weight of every line."""
    marked = any(line.main for line in found)
    out = []
    for line in found:
        weight = len(line.text) if line.main else line.plain
        if line.doubtful:
            weight //= DOUBTFUL
        elif line.main:
            weight += surge
        if marked and not line.main:
            weight //= OUTSIDE
        out.append(weight)
    return out


def main_text(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """The text of a page: blocks in page order, white space collapsed, joined by one space.

    Lines at the edges of a run go if they weigh nothing, on a page with a main element if they weigh less than a
    dive. On a page whose lines never reach the threshold, which has a short text or none, any weighted line surges.
    """
    found = lines(page)
    texts, weights = [line.text for line in found], weighed(found, surge)
    dive = max(1, surge // 4) if any(line.main for line in found) else 1
    return kept(texts, weights, window, surge, dive) or kept(texts, weights, window, 1, 1)


def kept(texts: list[str], weights: list[int], window: int, threshold: int, dive: int) -> str:
    """The text between surges and dives, without lines below ``dive`` at either end of a run."""
    out = []
    for a, b in between(weights, threshold, window, dive):
        held = [i for i in range(a, b) if weights[i] >= dive]
        if held:
            out += texts[held[0] : held[-1] + 1]
    return " ".join(out)


def extracted(pages: DataFrame, window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """Per page (``page_id``, ``url``, ``html``) its ``page_id``, ``url``, main ``text`` and ``n_chars`` (code points).

    A null or empty page has an empty text. Pages are read whole and one by one, so nulls, repeated ids and
    repeated rows stay; other columns are not read; an empty table gives an empty result.
    """

    def work(batches):
        for batch, texts in by_size(batches, "html", 2_000_000):
            done = [main_text(page, window, surge) for page in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(done, pa.string()), pa.array([len(t) for t in done], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    read = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return read.mapInArrow(work, "page_id bigint, url string, text string, n_chars bigint")
