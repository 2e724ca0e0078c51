"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped and each block of the page becomes a line.  Lines of menus, headers,
footers, sidebars, notices, adverts, forms and reader comments, told by their
elements, roles and names, and lists of links count as empty, and so do lines outside the
article where a page marks one.  A line block is ``WIDTH`` lines from a line on,
and its size the characters in them.  Text starts where sizes surge from nothing and
ends where they dive back to it; what lies between is kept, unless, on a page that
marks no article, no block in it reaches ``SURGE`` or half of the page's largest.

Pages are independent, so the work needs no exchange; a batch is read in
slices, and time grows with a page's length only.

Defined results: no html, or none with text, gives an empty text; pages of equal id each keep a
row; broken markup (elements left open, references cut short, a page that ends in a tag) is read as browsers
read it; all blank characters of Unicode are white space; ``<br>`` is white space, a table cell a block.
"""
from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Lines of a block, and characters that a block has to reach where no article is marked.
WIDTH, SURGE = 3, 86
#: Rows of a batch held as Python strings at once.
SLICE = 128

# Element and attribute names of HTML.
BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select
    summary table tbody td template textarea tfoot th thead title tr ul video audio canvas object svg math""".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
NEVER = frozenset("""script style template noscript iframe noembed noframes xmp textarea title head svg math canvas object video audio select option optgroup
    button dialog form nav menu aside footer search fieldset legend""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar note".split())
#: Elements that a new one of the same set ends.
ENDS = {"p": ("p",), "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: An end tag inside one of these doesn't reach out of it.
SCOPES = frozenset("article main section td th table body html".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<[A-Za-z][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([A-Za-z:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: Parts of class and id names that tell other matter from the article.
OTHER = re.compile(r"""(?:ads?|adv|advert\w*|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|privacy|notices?|alerts?|notification\w*|popup|modal|overlay|newsletter|
    subscri\w*|signup|signin|login|register|menu\w*|nav|navbar|navigation|breadcrumbs?|sidebar\w*|aside|rail|widgets?|footer|foot|header|masthead|topbar|toolbar|
    share|sharing|social|related|recommend\w*|trending|popular|more|pagination|pager|paging|search|copyright|legal|disclaimer|skip|hidden)""".replace("\n", "").replace(" ", ""))
READERS = re.compile(r"comment\w*|respond|response\w*|repl(?:y|ies)|disqus|discussion|reader\w*|guestbook|reviews?")
OWN = frozenset("article content main post entry story body text page wrapper container layout has with site".split())


class Element:
    __slots__ = ("name", "other", "article", "link", "header")

    def __init__(self, name: str, other: bool, article: int, link: bool, header: bool):
        self.name, self.other, self.article, self.link, self.header = name, other, article, link, header


def sorts(name: str, attributes: str) -> tuple[bool, bool]:
    """Does an element hold other matter than the article, and does it hold readers' comments?"""
    if not attributes.strip(" /"):
        return False, False
    given = {a.lower(): b or c or d for a, b, c, d in ATTRIBUTE.findall(attributes)}
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in given.get("style", "").replace(" ", "").lower():
        return True, False
    parts = {p.lower() for key in ("class", "id") for p in NAME_PART.findall(html.unescape(given.get(key, "")))}
    readers = any(READERS.fullmatch(p) for p in parts)
    if name in ("html", "body", "main") or (name == "article" and not readers):
        return False, False
    return readers or given.get("role", "").lower() in ROLES or (not parts & OWN and any(OTHER.fullmatch(p) for p in parts)), readers


def lines(page: str) -> Iterator[tuple[str, int, bool, bool, int]]:
    """The page's lines: text, characters of it in links, other matter, an item of a list, how the article is marked (2, 1 or 0)."""
    stack, places, scopes, readers = [Element("", False, 0, False, False)], {}, [0], 0
    parts, linked, at, end = [], 0, 0, len(page)

    def flush(top: Element) -> tuple[str, int, bool, bool, int] | None:
        nonlocal parts, linked
        text, was = " ".join("".join(parts).split()), linked
        parts, linked = [], 0
        return (text, was, top.other, bool(places.get("li")), top.article) if text else None

    def close(name: str) -> None:
        nonlocal readers
        found = places.get(name)
        if not found or (name not in SCOPES and found[-1] < scopes[-1]):
            return
        low = found[-1]
        while len(stack) > low:
            places[stack.pop().name].pop()
            if scopes[-1] == len(stack):
                scopes.pop()
        if readers >= len(stack):
            readers = 0

    def opened(name: str, attributes: str) -> None:
        nonlocal readers
        top = stack[-1]
        other, comments = sorts(name, attributes)
        article = max(top.article, 2 if name == "article" or "articleBody" in attributes else 1 if name == "main" or re.search(r"""role\s*=\s*["']?main""", attributes) else 0)
        header = name == "header" or (top.header and name not in ("article", "main"))
        if name not in ("article", "main") or readers:  # an article inside a menu that was left open is one all the same
            other = other or name in NEVER or name == "header" or top.other
        if header and article and name in HEADINGS and not readers:
            other = False  # the article's own title
        places.setdefault(name, []).append(len(stack))
        if name in SCOPES:
            scopes.append(len(stack))
        stack.append(Element(name, other, article, top.link or name == "a", header))
        if comments and not readers:
            readers = len(stack)

    while at < end:
        token = TOKEN.search(page, at)
        text = page[at:token.start() if token else end]
        if text:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if stack[-1].link:
                linked += len(text.strip())
        if token is None:
            break
        at, name = token.end(), token.group(2)
        if name is None:
            continue
        name, closing = name.lower(), bool(token.group(1))
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS and (line := flush(stack[-1])):
            yield line
        if closing:
            close(name)
        elif name not in EMPTY:
            for ended in ENDS.get(name, ("p",) if name in BLOCKS else ()):
                close(ended)
            if name in RAW:  # nothing inside is markup
                over = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                at = over.start() if over else end  # it isn't opened, so its end tag ends nothing
            else:
                opened(name, token.group(3))
    if line := flush(stack[-1]):
        yield line


def kept(found: list[tuple[str, int, bool, bool, int]]) -> list[int]:
    """The lines between surges and dives."""
    marked = max((mark for _, _, other, _, mark in found if not other), default=0)
    sizes = np.array([0 if other or mark < marked or 10 * linked > (9 if item else 10 if marked else 5) * len(text) else len(text)
                      for text, linked, other, item, mark in found] + [0] * WIDTH, np.int64)
    sums = np.concatenate([[0], np.cumsum(sizes)])
    blocks = sums[WIDTH:] - sums[:-WIDTH]  # the block from each line on
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (blocks > 0).astype(np.int8), [0]])))
    least = 1 if marked else min(SURGE, int(blocks.max(initial=0) + 1) // 2)
    return [i for surge, dive in zip(edges[::2], edges[1::2]) if blocks[surge:dive].max() >= least
            for i in range(surge, min(dive + WIDTH - 1, len(found))) if sizes[i]]


def main_text(page: str | None) -> str:
    found = list(lines(page or ""))
    return "\n".join(found[i][0] for i in sorted(set(kept(found))))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows ``page_id, url, text, n_chars``, one for each page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = [main_text(p) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 names=["page_id", "url", "text", "n_chars"])

    return map_arrow(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), run,
                     "page_id long, url string, text string, n_chars long")
