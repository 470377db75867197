"""Main text of web pages: nearest-URL page differencing on top of what the markup itself says.

Pages of one host are paired with their nearest neighbour by URL path, their text blocks aligned by longest common
subsequence and the shared ones deleted. Differencing alone is wrong on pages that mark their article: menus and
adverts vary from page to page of a host, and passages that two articles quote are shared. So markup decides first:
blocks inside menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles go, by tag, role or
a whole class name, unless the element holds the article (a name that only contains such a word leaves the block to the
difference); if the page marks an article (article, main, or such a role), all its other blocks stay and everything outside goes; only the
blocks of pages without such a mark are judged by the difference to the neighbour, or to the one on the other side if
the nearest is a copy of the page.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsift.llm.common import repeats, shared_lines, table
from tarnsift.llm.ordered import in_order, triples

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
DROPPED = {"head", "nav", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "svg", "canvas", "object", "embed", "button", "select", "textarea", "dialog", "menu", "title", "math", "audio", "video", "map"}
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "alertdialog", "menu", "menubar", "toolbar", "tablist"}
#: Words of class and id names. As a whole name they drop an element; as a part of one ("right-sidebar", "related-work") they only make it doubtful.
FRAME_NAMES = {
    "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "foot", "sidebar", "aside",
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertisements", "advertising", "adsense", "adbox", "sponsor", "sponsored", "promo", "promotion", "banner",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login",
    "social", "share", "sharing", "pagination", "pager", "widget", "toolbar", "search", "copyright", "skip",
}
#: Names of places that hold other articles or articles of readers.
OTHER_NAMES = {"related", "recommended", "recommendations", "comment", "comments", "commentlist", "reply", "replies", "respond", "disqus"}
DROPPED_NAMES = FRAME_NAMES | OTHER_NAMES
#: Compounds that mean nothing but a frame; "right-sidebar", "has-menu" and the like may stand on the wrapper of the article.
WHOLE_NAME = re.compile(r"(?:ad|ads|adv|advert|adverts|advertisement|sponsor|sponsored|cookie|cookies|consent|gdpr|newsletter|breadcrumb|breadcrumbs|skip)(?:[_-]+(?:slot|box|unit|banner|container|wrapper|block|label|notice|bar|popup|modal|overlay|signup|form|list|nav|link|links|content|\d+))+")
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "center", "details"}
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: An open tag of these ends an open one of the same (or of the list's) kind.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PARAGRAPH_ENDERS = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}


#: What an element's mark does to its blocks: nothing; leave them to the page difference; drop them unless it holds an
#: article; unless it holds the page's only ones; unless nothing else is left of the page.
KEPT, DOUBTFUL, SOFT, HARD, OTHERS = range(5)


def _kind(tag: str, attributes: str, in_article: bool) -> tuple[int, bool]:
    """(mark, article) of an element by its name, role, class and id."""
    named: dict[str, str] = {}
    if attributes:
        for name, value in ATTRIBUTE.findall(attributes):
            named.setdefault(name.lower(), html_lib.unescape(value.strip("\"'")))
    role = named.get("role", "").lower().strip()
    article = tag in ("article", "main") or role in ("main", "article") or named.get("itemprop", "").lower() == "articlebody"
    if tag in DROPPED or tag == "header" and not in_article:
        return SOFT if tag == "form" else HARD, False
    if role in DROPPED_ROLES or "hidden" in named or named.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", named.get("style", ""), re.I):
        return SOFT if role in ("form", "search") else HARD, article
    if tag in ("html", "body", "main"):
        return KEPT, article
    classes, key = set(named.get("class", "").lower().split()), named.get("id", "").lower().strip()
    if in_article and not (article and classes & OTHER_NAMES):
        classes.discard("header")
    # an id names what a heading or a section of the text is about as often as what the element is for
    if key in (OTHER_NAMES if in_article else DROPPED_NAMES) and tag in CONTAINERS or not in_article and tag in CONTAINERS and WHOLE_NAME.fullmatch(key):
        classes.add(key)
    if classes & OTHER_NAMES:
        return OTHERS, article
    if not article and (classes & FRAME_NAMES or any(WHOLE_NAME.fullmatch(c) for c in classes)):
        return SOFT, False
    names = set(re.split(r"[\s_\-:.]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", f"{named.get('class', '')} {named.get('id', '')}").lower()))
    if not article and names & DROPPED_NAMES - ({"header"} if in_article else set()):
        return DOUBTFUL, False
    return KEPT, article


class _Element:
    """An element that marks its blocks. holds: it or an element in it is an article (1) or main (2); verdict: (in an article, dropped) of its blocks."""

    __slots__ = ("mark", "article", "holds", "above", "verdict")

    def __init__(self, mark: int, article: bool, main: bool, above: "_Element | None"):
        self.mark, self.article, self.holds, self.above, self.verdict = mark, article, 0, above, (False, False)
        bit = 2 if main and mark == KEPT else 1
        e = self if article else None
        while e is not None and not e.holds & bit:
            e.holds |= bit
            e = e.above

    def judge(self, revived: int) -> None:
        """dropped is None if doubtful. An element up to the mark `revived` that holds an article, or any that holds main, drops nothing."""
        article, dropped = self.above.verdict if self.above else (False, False)
        own = self.mark > DOUBTFUL and not (self.holds & 2 or self.holds and self.mark <= revived)
        dropped = True if own or dropped else None if dropped is None or self.mark == DOUBTFUL and not self.holds else False
        self.verdict = article or self.article, dropped


def blocks(page: str | None) -> list[tuple[str, bool, bool | None]]:
    """(text, in an article, in a dropped element) of every non-empty block, in page order; None instead of the last for
    blocks of elements that are only doubtful."""
    elements: list[_Element] = []
    out: list[tuple[str, _Element | None]] = []
    stack: list[tuple[str, _Element | None, bool, bool]] = []  # name, innermost marked element, in an article, dropped with an inline element
    open_tags: Counter = Counter()  # names on the stack
    parts: list[str] = []
    page = page or ""

    def flush() -> None:
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((text, next((place for _, place, _, mute in reversed(stack) if not mute), None)))

    def pop_to(i: int) -> None:
        if any(tag not in INLINE for tag, *_ in stack[i:]):
            flush()
        for tag, *_ in stack[i:]:
            open_tags[tag] -= 1
        del stack[i:]

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        if m is None:  # a tag that never ends
            parts.append(page[at])
            at += 1
            continue
        at = m.end()
        close, tag, attributes, text = m.groups()
        if text is not None:
            if not (stack and stack[-1][3]):
                parts.append(text)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if close:
            if not open_tags[tag]:
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            enders = ENDS.get(tag, set()) | ({"p"} if tag in PARAGRAPH_ENDERS else set())
            if enders:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in enders:
                        pop_to(i)
                        break
                    if stack[i][0] not in INLINE and stack[i][0] not in ("td", "th") :
                        break
            flush()
        if tag in VOID or attributes.rstrip().endswith("/") and tag in ("svg", "path", "circle", "rect"):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}[\s>/]", re.I).search(page, at)
            at = page.find(">", stop.start()) + 1 if stop else end
            at = at or end
            continue
        place, in_article, mute = stack[-1][1:] if stack else (None, False, False)
        mark, article = _kind(tag, attributes, in_article)
        if tag in INLINE and mark == DOUBTFUL:
            mark = KEPT  # a few words inside a block, which have no line of their own to compare
        if mark or article:
            place = _Element(mark, article, tag == "main" or article and "main" in attributes.lower() and re.search(r"\brole\s*=\s*[\"']?\s*main\b", attributes, re.I) is not None, place)
            elements.append(place)
        # text right in a dropped inline element is left out; blocks inside it are judged by their place
        stack.append((tag, place, in_article or article, (mute or mark > DOUBTFUL) if tag in INLINE else False))
        open_tags[tag] += 1
    flush()
    plain = any(place is None for _, place in out)
    for revived in (SOFT, HARD, OTHERS):
        for e in elements:  # outer ones stand before inner ones
            e.judge(revived)
        kept = [place.verdict[0] for _, place in out if place is not None and place.verdict[1] is not True]
        if any(kept) or revived == HARD and (kept or plain):
            break
    return [(text, *(place.verdict if place else (False, False))) for text, place in out]


def _alike(left: list[str], right: list[str]) -> bool:
    """Three quarters of the words in common."""
    a, b = (set(" ".join(lines).casefold().split()) for lines in (left, right))
    return 4 * len(a & b) >= 3 * len(a | b)


def frame_lines(own: list[str], others: list[list[str]]) -> list[bool]:
    """Which lines of own are the frame that it shares with its neighbours, the nearest first: all False without any, or if they are copies.

    Two pages of one frame each have lines of their own; two copies have none, or versions of the same lines. With two
    neighbours that are no copies the nearest decides, unless more text is common with it alone than sets it apart
    (a copy with some new line): then the second. With one neighbour, lines that differ in numbers only (dates,
    counters) beside a longer shared line are taken as those of a copy too.
    """
    found = []
    for other in others:
        same = shared_lines(own, other)
        rest = [x for x, s in zip(own, same) if not s]
        theirs = list((Counter(other) - Counter(x for x, s in zip(own, same) if s)).elements())
        if not any(same) or not rest or not theirs or _alike(rest, theirs):
            continue
        bare = [[re.sub(r"\d+", "0", x) for x in lines] for lines in (rest, theirs)]
        if len(others) == 1 and _alike(*bare) and max(len(x) for x, s in zip(own, same) if s) > sum(map(len, rest)):
            continue
        found.append(same)
    if len(found) == 2:
        alone = sum(len(x) for x, s, t in zip(own, *found) if s and not t)
        return found[alone > sum(len(x) for x, s in zip(own, found[0]) if not s)]
    return found[0] if found else [False] * len(own)


def judged(own: list[tuple[str, bool, bool | None]], partner: list[tuple[str, bool, bool | None]] | None, second: list[tuple[str, bool, bool | None]] | None = None) -> tuple[str, int | None]:
    """The article's blocks, without the doubtful ones of the frame, if one is marked; else all blocks but the frame's. And how
    many blocks the difference deleted; None if the markup decided alone."""
    kept = [x for x in own if not x[2]]
    marked = any(article for _, article, _ in kept)
    doubtful = not marked or any(article and dropped is None for _, article, dropped in kept)
    frame = frame_lines([x[0] for x in kept], [[x[0] for x in other if not x[2]] for other in (partner, second) if other]) if doubtful else [False] * len(kept)
    gone = [f and (not marked or article and dropped is None) for (_, article, dropped), f in zip(kept, frame)]
    return "\n".join(text for (text, article, _), g in zip(kept, gone) if not g and (article or not marked)), sum(gone) if doubtful else None


def main_text(own, partner, second=None) -> str:
    return judged(own, partner, second)[0]


def host_and_path(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").removeprefix("www.")
        return host, unquote(parts.path).rstrip("/")
    except ValueError:
        return "", url or ""


def _nearest(batches):
    out, size = [], 0
    columns = ["page_id", "url", "text", "n_chars", "partner_id", "differenced"]
    kinds = {"page_id": "Int64", "partner_id": "Int64", "differenced": "Int64"}
    for before, (row, own), after in triples(batches, lambda r: blocks(r.html)):
        near = [x for x in (after, before) if x is not None and x[0].host == row.host]

        def closeness(x) -> int:
            a, b = x[0].path.split("/"), row.path.split("/")
            return next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))

        near.sort(key=closeness, reverse=True)  # the next one first if both are as near
        partner, second = [*near, None, None][:2]
        text, deleted = judged(own, partner and partner[1], second and second[1])
        out.append((row.page_id, row.url, text, len(text), partner and partner[0].page_id, deleted))
        size += len(text)
        if size > 4_000_000:
            yield pd.DataFrame(out, columns=columns).astype(kinds)
            out, size = [], 0
    if out:
        yield pd.DataFrame(out, columns=columns).astype(kinds)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, partner_id, differenced (blocks that the difference deleted; null where the markup alone
    decided) for every row. Null html: empty text; null or malformed url: a host of its own (""), paired by what is left of
    the path. The only page of a host has no partner. Rows of one host and path go by page_id (null first); repeated rows
    are pages of their own.
    """
    @F.pandas_udf("host string, path string")
    def places(url: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([host_and_path(u) for u in url], columns=["host", "path"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", places("url").alias("at"))
    rows = rows.select("page_id", "url", "html", "at.host", "at.path", F.coalesce("page_id", F.lit(-(1 << 63))).alias("order_id"))
    keys = ["host", "path", "order_id"]
    if repeats(pages, "page_id"):
        rows, keys = rows.withColumn("order_html", F.xxhash64("html")), [*keys, "order_html"]
    return in_order(rows, keys, text="html").mapInPandas(_nearest, "page_id long, url string, text string, n_chars long, partner_id long, differenced long")


def op9_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
