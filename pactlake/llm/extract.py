"""HTML extraction by the distribution of text over lines: the main text lies between a surge and a dive."""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import TextChunk, map_texts

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)""", re.S)
# A name without a value is taken whole as well, so that a long one isn't tried again from each of its letters.
ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++)))?+""")

RAW = frozenset({"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "noframes", "xmp"})
BLOCKS = frozenset({
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header",
    "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
})
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
VOID = frozenset({
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
})
#: Elements that never hold main text.
OUTSIDE = frozenset({"nav", "header", "footer", "aside", "form", "menu", "head", "button", "select", "dialog", "fieldset", "label", "datalist", "audio", "video", "canvas", "map"})
ROLES = frozenset({"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert", "alertdialog", "form", "toolbar", "tablist"})
#: Words in a class or id that mark menus, notices, adverts, comments and the like.
MARKS = frozenset({
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "advertorial", "sponsor", "sponsored",
    "sponsors", "promo", "promos", "promotion", "promotions", "sidebar", "sidebars", "aside", "menu", "menus", "nav",
    "navbar", "navigation", "navigations", "breadcrumb", "breadcrumbs", "crumbs", "footer", "footers", "header",
    "headers", "masthead", "topbar", "toolbar", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
    "notification", "notifications", "alert", "alerts", "banner", "banners", "popup", "popups", "modal", "modals",
    "overlay", "newsletter", "newsletters", "subscribe", "subscription", "signup", "login", "signin", "search",
    "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "discussion", "related",
    "recommended", "recommendations", "share", "sharing", "social", "pagination", "pager", "paging", "widget",
    "widgets", "skip", "copyright", "colophon", "form", "forms", "paywall",
})
#: Beside one of these a mark describes a page's layout, as in "content-with-sidebar", and removes nothing.
LAYOUT = frozenset({
    "article", "main", "content", "body", "wrapper", "container", "layout", "has", "no", "with", "without", "page",
})
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SKIPS_CLOSED_BY = frozenset({"article", "main", "body", "html"})


def _marked(attributes: str) -> bool:
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "role" and value.strip().lower() in ROLES:
            return True
        if name == "aria-hidden" and value.strip().lower() == "true":
            return True
        if name in ("class", "id"):
            for token in value.split():
                parts = {p.lower() for p in PARTS.findall(token)}
                if parts & MARKS and not parts & LAYOUT:
                    return True
    return bool(re.search(r"(?i)(?:^|\s)hidden(?:\s|$)|display\s*:\s*none", attributes))


def lines_of(page: str, gap: int) -> tuple[list[str], list[int], list[bool]]:
    """A page's lines in order: text, characters outside links, and whether a line lies in an article.

    Markup is stripped; a line is the text between two block tags. Menus, headers, footers and the like
    become ``gap`` lines without text, or one line inside an article.
    """
    texts: list[str] = []
    weights: list[int] = []
    inside: list[bool] = []
    held: list[str] = []
    loose = [0]
    state = {"link": 0, "article": 0}

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                texts.append(text)
                weights.append(min(loose[0], len(text)))
                inside.append(state["article"] > 0)
        loose[0] = 0

    def blank(n: int) -> None:
        texts.extend([""] * n)
        weights.extend([0] * n)
        inside.extend([False] * n)

    skip, depth = "", 0
    at, end = 0, len(page)
    while at < end:
        m = MARKUP.search(page, at)
        text_end = m.start() if m else end
        if text_end > at and not skip:
            piece = page[at:text_end]
            held.append(piece)
            if not state["link"]:
                loose[0] += len(piece.strip())
        if not m:
            break
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(m.group(1))
        alone = tag in VOID or m.group(3).endswith("/")
        if tag in RAW and not closing and not alone:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if skip:
            if tag == skip and not alone:
                depth += -1 if closing else 1
            if depth == 0 or closing and tag in SKIPS_CLOSED_BY:
                skip, depth = "", 0
            elif state["article"] and skip == "header" and tag in HEADINGS and not closing:
                # A heading in an article's own header is part of the article.
                close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                stop = close.start() if close else end
                held.append(MARKUP.sub(" ", page[at:stop]))
                loose[0] += stop - at
                flush()
                at = close.end() if close else end
                continue
            else:
                continue
            if tag not in SKIPS_CLOSED_BY:
                continue
        if tag == "br":
            held.append(" ")
        elif tag in BLOCKS:
            flush()
            state["link"] = 0
        if tag == "a":
            state["link"] = 0 if closing else 1
        if tag in ("article", "main"):
            state["article"] = max(0, state["article"] + (-1 if closing else 1))
        elif not closing and not alone and tag not in ("body", "html") and (tag in OUTSIDE or _marked(m.group(3))):
            flush()
            blank(1 if state["article"] else gap)
            skip, depth = tag, 1
    flush()
    return texts, weights, inside


def main_span(weights: np.ndarray, width: int, surge: int) -> list[tuple[int, int]]:
    """Half-open ranges of lines between a surge and the dive after it.

    The distribution is the sum of ``width`` lines from each line on. It surges where it exceeds ``surge``
    (half its peak, if that is less) and dives where it comes to nothing.
    """
    n = len(weights)
    if not n or not weights.any():
        return []
    total = np.concatenate([[0], np.cumsum(np.concatenate([weights, np.zeros(width, weights.dtype)]))])
    block = total[width : width + n] - total[:n]
    high = block > min(surge, int(block.max()) // 2)
    spans, at = [], 0
    while at < n:
        if not high[at]:
            at += 1
            continue
        end = at
        while end < n and block[end] > 0:
            end += 1
        spans.append((at, end))
        at = end
    return spans


def main_text(page: str, width: int = 3, surge: int = 86) -> str:
    """The main text of one page: its blocks in order, joined by an empty line; empty if there is none."""
    texts, weights, inside = lines_of(page, width)
    size = np.array(weights, dtype=np.int64)
    within = np.array(inside, dtype=bool)
    if within.any():
        # Markup names the article: only its lines weigh, and each of them enough to surge alone.
        filled = np.array([bool(t) for t in texts])
        size = np.where(within & filled, np.array([len(t) for t in texts]) + 2 * surge, 0)
    kept: list[str] = []
    for a, b in main_span(size, width, surge):
        while not within.any() and a > 0 and texts[a - 1] and size[a - 1] and (a < 2 or not texts[a - 2]):
            a -= 1  # a title just before the surge
        kept.extend(t for t, keep in zip(texts[a:b], size[a:b] > 0 if within.any() else np.ones(b - a, bool), strict=True) if t and keep)
    return "\n\n".join(kept)


def extract_pages(pages: DataFrame, width: int = 3, surge: int = 86) -> DataFrame:
    """Pages with ``text``, the main text of the whole html, and ``n_chars``, its code points.

    Defined cases: null or empty html and pages without main text give an empty text; unclosed and misplaced
    tags, comments, scripts and quotes in attributes are read as browsers mostly do; an element that is cut
    off at the end of the page counts up to there; repeated rows are treated alike; the rows' other columns
    are kept, and one called text or n_chars is replaced. One page is handled inside its own row: no shuffle.
    """

    def kernel(chunk: TextChunk) -> dict[str, object]:
        texts = [main_text(p, width, surge) for p in chunk.texts.to_pylist()]
        return {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    return map_texts(pages, "html", kernel, {"text": "string", "n_chars": "bigint"})
