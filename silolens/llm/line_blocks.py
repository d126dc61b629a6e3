"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element. A line weighs its text
length, or nothing if it stands in a menu, notice, form or the like, or is
mostly links. Inside an article or main element, words that may name a topic
and link-heavy lines lower the weight; both together take it. Sums over
sliding line windows surge where the main text starts and dive where it ends;
the lines between are kept, short ones included. The surge follows the page's
own lines, and after a dive the text resumes with the next line that weighs.
Lines of an article or main element surge alone; beside them, other runs have
to surge themselves.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW_LINES = 3
#: A window sum over half of SURGE, or of the page's median window if that is less, starts a text; one under DIVE ends it.
SURGE, DIVE = 90, 1
LINK_PART = 0.6

# Element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = "script|style|noscript|template|svg|iframe|textarea|title|select|object|math|canvas|audio|video"
BOILERPLATE = frozenset("nav footer aside form menu dialog button fieldset head".split())
MAIN = frozenset(("article", "main"))
NEVER = frozenset(
    "ad ads adbox adslot adunit adsbygoogle adv advert advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead "
    "topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login register search searchbox share sharing social "
    "related recommended recommendations comment comments disqus reply replies respond discussion pagination pager widget toolbar copyright legal disclaimer skip hidden tags tagcloud".split())
STEMS = ("comment", "sidebar", "cookie", "advert", "newsletter", "breadcrumb", "navbar", "navigation", "masthead", "disqus", "sponsor")
#: Inside the main element these are boilerplate as class words; the other words only lower a weight there.
FIXTURES = frozenset("ad ads adbox adslot adunit adsbygoogle adv advert advertisement adsense nav navbar breadcrumb breadcrumbs sidebar masthead topbar gdpr popup modal newsletter share disqus pagination pager widget toolbar skip tagcloud".split())
DOUBT = 4  # a doubted line weighs a quarter of its text
MILD = frozenset(("header", "head", "site", "top", "bottom"))  # boilerplate only outside the main element
GOOD = frozenset("article articlebody content post entry story".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + RAW + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>", re.DOTALL | re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[a-z]+")
_HEADING = re.compile(r"h[1-6]")
_THREAD = re.compile(r"(?:comments|disqus)|(?:comments?|disqus)(?:[-_]?(?:list|area|section|thread|form|respond|wrap|wrapper|container|box|body|content|\d+))+")  # how comments are built, not what a text is about
_LAYOUT = re.compile(r"\b(?:has|with|no|without|show|hide)[-_]\w[\w-]*")  # says what stands beside an element, not what it is
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BLOCK_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


@dataclass
class Line:
    text: str
    weight: int
    inside: bool


def _evidence(name: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is boilerplate, and whether its text is doubted."""
    if name in BOILERPLATE or (name == "header" and not inside):
        return True, False
    if not attributes.strip(" /"):
        return False, False
    words: set[str] = set()
    classes: set[str] = set()
    thread = False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id"):
            names = _LAYOUT.sub(" ", html.unescape(value))
            words.update(found := _WORD.findall(names))
            classes.update(found if key == "class" else ())
            thread = thread or any(_THREAD.fullmatch(part) for part in names.split())
        elif key == "role" and value in ROLES:
            return True, False
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return True, False
    if name in MAIN or name in ("body", "html"):
        return False, False
    doubted = bool(words & NEVER) or any(stem in word and word != "commentary" for word in words for stem in STEMS)
    if not inside:
        return doubted or (bool(words & MILD) and not words & GOOD), False
    if _HEADING.fullmatch(name):
        return False, False  # named after its own words
    return thread or bool(classes & FIXTURES), doubted


def lines(page: str) -> list[Line]:
    """The page's blocks in order, with their weights."""
    out: list[Line] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # element, made its content boilerplate, made it main, doubted it
    parts: list[str] = []
    linked = total = 0
    dropped = main = anchors = doubts = 0

    def flush() -> None:
        nonlocal linked, total
        text = " ".join("".join(parts).split())
        if text:
            against = bool(total and linked >= LINK_PART * total) + (doubts > 0)
            if dropped or against == 2 or (against and not main):
                weight = 0
            else:
                weight = -(-len(text) // DOUBT) if against else len(text)
            out.append(Line(text, weight, main > 0 and not against))
        parts.clear()
        linked = total = 0

    def add(piece: str) -> None:
        nonlocal linked, total
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            n = len(piece.strip())
            total += n
            linked += n if anchors else 0

    def pop() -> None:
        nonlocal dropped, main, anchors, doubts
        name, bad, good, doubted = stack.pop()
        dropped -= bad
        main -= good
        doubts -= doubted
        anchors -= name == "a"

    at = 0
    for token in _TOKEN.finditer(page):
        add(page[at : token.start()])
        at = token.end()
        name = token[3].lower() if token[3] else ""
        if not name:
            continue
        if name not in INLINE:
            flush()
        if token[2]:
            if any(e[0] == name for e in stack):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in VOID or token[4].endswith("/"):
            continue
        if name in _BLOCK_ENDS_P and "p" in (open_ := [e[0] for e in stack[-6:]]):
            last = len(open_) - 1 - open_[::-1].index("p")
            if all(e in INLINE for e in open_[last + 1 :]):
                for _ in range(len(open_) - last):
                    pop()
        if stack and stack[-1][0] in _CLOSES.get(name, ()):
            pop()
        if name in MAIN and dropped and not any(e[1] and e[0] in BOILERPLATE for e in stack):
            while any(e[1] for e in stack):  # a notice that was never closed ends where the main text starts
                pop()
        bad, doubted = _evidence(name, token[4], main > 0)
        good = not dropped and not bad and (name in MAIN or bool(re.search(r"""(?:role\s*=\s*["']?main|itemprop\s*=\s*["']?articleBody)""", token[4])))
        stack.append((name, bad, good, doubted))
        dropped += bad
        main += good
        doubts += doubted
        anchors += name == "a"
    add(page[at:])
    flush()
    return out


def between_surge_and_dive(weights: np.ndarray, surge: float, dive: int = DIVE, window: int = WINDOW_LINES, resume: bool = False) -> np.ndarray:
    """Which lines lie in a run between dives of the window sums that surges; with ``resume`` also those of later runs."""
    n = len(weights)
    total = np.concatenate([[0], np.cumsum(weights)])
    sums = total[np.minimum(np.arange(n) + window, n)] - total[:n]
    run = np.cumsum(sums < dive)  # a dive starts the next run
    surges = np.zeros(run[-1] + 1 if n else 0, bool)
    surges[run[sums > surge]] = True
    if resume:
        surges = np.maximum.accumulate(surges)
    return surges[run] & (weights > 0)


def page_surge(weights: np.ndarray) -> float:
    """Half of SURGE, or of three median lines of the page if they are shorter."""
    return min(SURGE, WINDOW_LINES * float(np.median(weights[weights > 0]))) / 2 if weights.any() else SURGE / 2


def main_text(page: str | None) -> str:
    found = lines(page or "")
    weights = np.array([line.weight for line in found], np.int64)
    main = np.array([line.inside for line in found], bool) & (weights > 0)
    keep = between_surge_and_dive(weights + SURGE * main, page_surge(weights), resume=not main.any())
    if not keep.any() and weights.sum() > 1:  # no window is long enough; a lone character is no text
        keep = weights > 0
    return " ".join(line.text for line, k in zip(found, keep) if k)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``: one row per row of ``pages``, by one pass without a shuffle.

    Null or empty html, and pages without a text, give an empty text. Unclosed
    elements, comments and scripts end with the page; the whole page is read,
    however long. Repeated rows are extracted alike, null ids and addresses are
    passed on, an empty table gives an empty result, other columns are not read.
    """
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return slim.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
