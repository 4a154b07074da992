"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. First pass: text length, link density and stop-word
density class each block as good, bad, or undecided: short, near-good, or plain (long, with few stop words, as
figures or an unknown language are); elements and attributes that name page furniture (navigation, footer,
advert, comments, forms) make a block bad outright, and an element that names the article makes it good. Of an
article's own header only the headings stay. A list item of links within an article is undecided, since menus
and references look alike. Second pass: undecided blocks take the label of their nearest decided neighbours.

A name of furniture on what holds the whole article (`<div class="widget"><article>`) says nothing, so the first
article voids it, where the page has no article outside such names. A later article, as of a reader's comment or a
teaser, voids nothing. Link density counts characters as they are in the text that comes out.

Stop words are those of English, French, German and Spanish. A page on which nothing is good, as one in
another language or of a single short paragraph, keeps its blocks that are neither furniture nor links.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm._util import bound_batches

# Frequent function words of the languages served.
STOP_WORDS = frozenset(
    "a an and are as at be by for from has he in is it its not of on only or that the their then this to was were when which will with "
    "au aux avec ce dans de des du elle en est et la le les leur mais ne ou par pas pour que qui se sur un une "
    "als auf aus bei das dem den der die ein eine er es für ich im ist mit nach nicht sich sie um und von war wie zu zum "
    "al como con del el era ha las lo los más no para pero por se sin sus una y ya".split()
)
SKIPPED = {"script", "style", "noscript", "template", "svg", "head", "iframe", "object", "canvas", "audio", "video", "select", "textarea", "button"}
FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog", "header", "fieldset"}
CONTENT = {"article", "main"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
#: Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements whose end tags are commonly left out: a new one of the kind, or the parent's end, ends them.
LOOSE = {"p", "li", "dd", "dt", "td", "th", "tr", "option", "thead", "tbody", "tfoot", "b", "i", "em", "strong", "span", "font", "u", "a"}
ITEMS = {"li", "dd", "dt", "td", "th"}
_NAMES = (
    r"(?:ad|ads|advert[^\W_]*|banner|sponsor[^\W_]*|promo[^\W_]*|nav[^\W_]*|menu[^\W_]*|breadcrumbs?|sidebar|side|widget|footer|foot|header|masthead|cookie[^\W_]*|consent|notice|popup|modal|newsletter|subscribe|"
    r"share|sharing|social|related|recommend[^\W_]*|comments?|commentlist|disqus|respond|replies|pagination|pager|toolbar|login|signup|copyright|legal)"
)
#: A class or id that as a whole names furniture: names, with words before and after that do not change what it is.
_NAMED = re.compile(
    r"(?:(?:site|global|primary|secondary|top|bottom)[_-]|(?:page|post|entry|article)[_-](?!header|banner))?"
    rf"{_NAMES}(?:[_-](?:{_NAMES}|box|block|list|items?|links?|bar|area|section|inner|form|body|slot|unit))*",
    re.I,
)
_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
#: Names of furniture on these judge nothing inside an article: `<p class="legal">` there is a paragraph on law.
TEXT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "caption", "figcaption", "figure", "q", "cite", "b", "i", "em", "strong", "span", "font", "u", "a", "code", "mark", "small", "abbr", "time", "br"}
_MARKUP = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_NEXT = re.compile(r"=\s*[\"']|>")
_ATTR = re.compile(r"""(?<![a-zA-Z:_-])([a-zA-Z:_-]++)\s*+=\s*+("[^"]*"|'[^']*'|[^\s>]+)""")
#: Character references beyond any code point, however long.
_BEYOND = re.compile(r"&#(?:0*+[0-9]{8,}+|[xX]0*+[0-9a-fA-F]{7,}+);?")
_SPACE, _WORD = re.compile(r"\s+"), re.compile(r"[^\W\d_]+")

LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.12, 0.22
MAX_LINKS = 0.4


class Tags:
    """Finds the ends of a page's tags, front to back, in time linear in the page.

    A quote after `=` hides a `>` up to its closing quote. Once that reading has run to the page's end
    without an end of a tag, quotes hide nothing any more.
    """

    __slots__ = ("page", "last", "quoted", "open")

    def __init__(self, page: str):
        self.page, self.last, self.quoted, self.open = page, page.rfind(">"), True, {}

    def _closing(self, quote: str, at: int) -> int:
        """Where a quote closes; looked for at most once a page if it never does."""
        if at >= self.open.get(quote, len(self.page) + 1):
            return -1
        found = self.page.find(quote, at)
        if found < 0:
            self.open[quote] = at
        return found

    def end(self, at: int) -> int:
        """Behind the `>` of a tag whose name ends at a position; -1 if there is none."""
        if at > self.last:
            return -1
        now = at
        while self.quoted:
            m = _NEXT.search(self.page, now)
            if m is None:
                self.quoted = False
            elif m[0] == ">":
                return m.end()
            else:
                closing = self._closing(m[0][-1], m.end())
                now = m.end() if closing < 0 else closing + 1
        return self.page.find(">", at) + 1


class Verdict:
    """An element judged by its class or id; may be void, with those around it, if it holds the first article."""

    __slots__ = ("void", "around")

    def __init__(self, around: Verdict | None):
        self.void, self.around = False, around


class Block:
    __slots__ = ("parts", "links", "linked", "bad", "content", "heading", "item", "named", "text", "label")

    def __init__(self, bad: bool, content: bool, heading: bool = False, item: bool = False, named: Verdict | None = None):
        self.parts, self.links, self.bad, self.content, self.heading, self.item, self.named = [], [], bad, content, heading, item, named
        self.text, self.linked, self.label = "", 0, ""


def _furniture(name: str, attrs: str) -> tuple[bool, bool]:
    """Whether an element is furniture by its kind or role, and whether by its class or id."""
    hard = name in FURNITURE
    if hard and name != "header" or name in ("html", "body") or "=" not in attrs:
        return hard, False
    named = False
    for key, value in _ATTR.findall(attrs):
        value, key = value.strip("\"'"), key.lower()
        named = named or key in ("class", "id") and any(map(_NAMED.fullmatch, value.split()))
        hard = hard or key == "role" and value.lower() in _ROLE or key == "aria-hidden" and value == "true"
    return name not in CONTENT and (hard or "hidden" in attrs.lower().split()), named


def _folded(parts: list[str]) -> str:
    """Pieces of a page as text: references decoded, white space folded and trimmed."""
    return _SPACE.sub(" ", html.unescape(_BEYOND.sub("\ufffd", "".join(parts)))).strip()


def split_blocks(page: str) -> list[Block]:
    """The non-empty blocks of a page, in order."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool, Verdict | None]] = []  # name, bad, content, named
    bad = 0  # 1: in an article's header, where headings stay; 2: in furniture
    content = met = False  # met: an article has begun
    named: Verdict | None = None
    links, items, at, n = 0, 0, 0, len(page)
    fresh = True  # a link has begun or ended since the last linked piece
    tags = Tags(page)
    # Open elements by name; those that LOOSE end tags may end are counted since the last other element.
    opened: Counter[str] = Counter()
    loose: list[Counter[str]] = [Counter()]
    unclosed: set[str] = set()  # skipped elements of which no end tag follows any more
    now = Block(False, False)

    def leave(keep: int):
        """Ends the open elements beyond the first `keep`."""
        nonlocal bad, content, named, items
        while len(stack) > keep:
            gone, bad, content, named = stack.pop()
            opened[gone] -= 1
            items -= gone in ITEMS
            if gone in LOOSE:
                loose[-1][gone] -= 1
            else:
                loose.pop()

    def close(heading: bool = False):
        nonlocal now
        if now.parts:
            now.text = _folded(now.parts)
            if now.text:
                now.linked = sum(len(_folded(run)) for run in now.links)
                out.append(now)
        now = Block(bad > 1 or bad == 1 and not heading, content, heading, items > 0, named)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            now.parts.append(page[at:lt])
            if links:
                if fresh or not now.links:
                    now.links.append([])
                now.links[-1].append(page[at:lt])
                fresh = False
        if lt == n:
            break
        if m := _MARKUP.match(page, lt):
            at = m.end()
            if m[0].startswith("<![CDATA["):
                now.parts.append(m[0][9:].removesuffix("]]>"))
            continue
        m = _NAME.match(page, lt) if lt < tags.last else None
        end = tags.end(m.end()) if m else -1
        if end < 0:
            now.parts.append("<")
            at = lt + 1
            continue
        at, attrs = end, page[m.end() : end - 1]
        name, ending = m[1].lower(), page[lt + 1] == "/"
        if name == "br":
            now.parts.append(" ")
            continue
        if name in SKIPPED:
            if not ending and not attrs.endswith("/"):
                end = None if name in unclosed else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif name in ("script", "style"):
                    at = n
                else:
                    unclosed.add(name)
            continue
        if name == "a":
            links, fresh = max(0, links + (-1 if ending else 1 - links)), True
        block = name in BLOCKS
        if not ending:
            if block and name == "p" or name in ("li", "dd", "dt", "td", "th", "tr", "option"):
                while stack and stack[-1][0] in LOOSE and stack[-1][0] not in ("tr", "td"):
                    gone = stack[-1][0]
                    leave(len(stack) - 1)
                    if gone == name:
                        break
            if name not in VOID and not attrs.endswith("/"):
                stack.append((name, bad, content, named))
                opened[name] += 1
                items += name in ITEMS
                if name in LOOSE:
                    loose[-1][name] += 1
                else:
                    loose.append(Counter())
                hard, by_name = _furniture(name, attrs)
                by_name = by_name and not (content and name in TEXT)
                # The first article is not judged by its own name. Later ones, as of comments and teasers, are, and
                # leave the verdict on what holds them.
                if by_name and (met or name not in CONTENT):
                    named = Verdict(named)
                elif name in CONTENT and not by_name and not met:
                    holder = named
                    while holder and not holder.void:
                        holder.void, holder = True, holder.around
                met = met or name == "article"
                bad = max(bad, 1 if name == "header" and content else 2 if hard else 0)
                content = content or name in CONTENT
        elif (loose[-1] if name in LOOSE else opened)[name]:
            k = len(stack) - 1
            while stack[k][0] != name:
                k -= 1
            leave(k)
        if block:
            links = 0 if name in ("p", "div", "li") and not ending else links
            close(not ending and re.fullmatch("h[1-6]", name) is not None)
    close()
    plainly = any(b.content and b.named is None and not b.bad for b in out)  # an article outside all names
    for b in out:
        b.bad = b.bad or b.named is not None and (plainly or not b.named.void)
    return out


def classify(blocks: list[Block]) -> None:
    """First pass: good, bad, or undecided: short, near, plain, and links (items of links within an article)."""
    for b in blocks:
        n = len(b.text)
        words = _WORD.findall(b.text)
        stop = sum(w.lower() in STOP_WORDS for w in words) / max(1, len(words))
        links = b.linked / max(1, n)
        if b.bad:
            b.label = "bad"
        elif b.content:
            b.label = "links" if b.item and links > MAX_LINKS else "good"
        elif links > MAX_LINKS:
            b.label = "bad"
        elif n < LENGTH_LOW:
            b.label = "short"
        elif stop >= STOP_HIGH:
            b.label = "good" if n > LENGTH_HIGH else "near"
        elif stop >= STOP_LOW:
            b.label = "near"
        else:
            b.label = "plain"
    if any(b.content and not b.bad for b in blocks):
        # Where the page names its article, what is outside must be good by itself, or a heading before it.
        for b in blocks:
            if not b.content and not b.heading and (b.label in ("short", "plain") or b.label == "near" and len(b.text) < LENGTH_HIGH):
                b.label = "bad"
    elif not any(b.label in ("good", "near") for b in blocks):
        for b in blocks:
            if not b.bad and b.linked <= MAX_LINKS * len(b.text):
                b.label = "good" if len(b.text) >= LENGTH_LOW else "short"
        if not any(b.label == "good" for b in blocks):
            for b in blocks:
                if b.label == "short" and not b.linked:
                    b.label = "good"


def inherit(blocks: list[Block]) -> None:
    """Second pass: undecided blocks take the label of their nearest decided neighbours. Where both sides
    disagree, a near-good block is good, items of links are bad, and a short or plain one takes the nearer side, at
    equal distance that before it, or the bad one if much of it is linked; a heading looks ahead."""
    n = len(blocks)
    before, after = [(None, n)] * n, [(None, n)] * n
    for order, side in ((range(n), before), (range(n - 1, -1, -1), after)):
        label, gap = None, n
        for k in order:
            side[k] = (label, gap + 1)
            if blocks[k].label in ("good", "bad"):
                label, gap = blocks[k].label, 0
            else:
                gap += 1
    for k, b in enumerate(blocks):
        if b.label in ("good", "bad"):
            continue
        (x, dx), (y, dy) = before[k], after[k]
        if b.label == "links":
            b.label = "bad" if "bad" in (x, y) else "good"
        elif x is None and y is None:
            b.label = "good" if b.label == "near" else "bad"
        elif x is None or y is None:
            b.label = (x or y) if b.label != "near" else "good"
        elif x == y:
            b.label = x
        elif b.label == "near":
            b.label = "good"
        elif dx == dy and not b.heading and b.linked > MAX_LINKS / 2 * len(b.text):
            b.label = "bad"
        else:
            b.label = y if b.heading or dy < dx else x
        if b.label == "bad" and b.heading and y == "good" and b.content:
            b.label = "good"


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks = split_blocks(page)
    classify(blocks)
    inherit(blocks)
    return "\n".join(b.text for b in blocks if b.label == "good")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every page; null or empty html gives an empty text.

    Rows are independent: repeated rows repeat their result, null ids and urls pass through, other
    columns are ignored. Time and memory are in proportion to a page.
    """

    def run(batches):
        for batch in batches:
            text = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    bound_batches(pages.sparkSession)
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
