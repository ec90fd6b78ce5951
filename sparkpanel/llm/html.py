"""Main text of HTML pages by line-block distribution.

Markup is stripped to lines, one for each block element. A line weighs as many
code points as its text outside links; an article mark doubles that, a furniture
mark halves it. Lines are of the kind of their block: of an article element, of text elements
(paragraphs, list items, cells) or of bare boxes. The kind of the page's heaviest
window gives the distribution, in which lines of other kinds are blank, but for those
as long as its typical line. Weights are summed over sliding windows of
lines: text is what lies between a rise from nothing to a surge and the dive to nothing
after it. Of that, lines that markup names as furniture, and boxes
beside an article, are taken out.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Lines in a window; part of a typical line's weight that a window holds where text surges, and its most.
LINES, SHARE, SURGE = 3, 0.25, 80
#: Kinds of lines, by what they are in; windows of text elements count so many times those of boxes, and those of articles so many times again, when the page's kind is found.
BOX, TEXT, ARTICLE = range(3)
PREFER = 8

_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9-]*)")
#: Attributes up to the end of the tag; quotes count after an equals sign only.
_REST = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+)>")
_RAW = {"script", "style", "noscript", "template", "textarea", "svg", "math", "iframe", "object", "title", "xmp", "noembed", "noframes"}
_FURNITURE = {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "fieldset", "audio", "video", "canvas"}
#: Furniture outside articles only.
_OUTER = {"header", "label", "map"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "blockquote", "body", "br", "caption", "center", "dd", "details", "dir", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "html", "legend", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
} | _FURNITURE | {"label", "map"}
_CELLS = {"table", "td", "th", "caption"}
_SECTIONS = {"article", "main", "section", "blockquote", "nav", "aside", "form", "details", "fieldset"}
#: Elements whose end tag may be missing: those that a start tag ends, and those that such an end doesn't reach across.
_ENDS = {t: ({"p"}, _CELLS | {"article", "main", "button"}) for t in _BLOCK - {"br", "body", "caption", "dd", "dt", "html", "label", "legend", "li", "map", "tbody", "td", "tfoot", "th", "thead", "tr"}} | {
    "li": ({"li", "p"}, _CELLS | _SECTIONS | {"ul", "ol", "menu", "dir", "dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), **dict.fromkeys(("td", "th"), ({"td", "th"}, {"table", "tr"})), **dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot"}, {"table"})),
    **dict.fromkeys(("dd", "dt"), ({"dd", "dt", "p"}, _CELLS | _SECTIONS | {"dl", "ul", "ol", "menu", "dir"})),
}
_TEXT = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dd", "dt", "blockquote", "pre", "figcaption", "td", "th", "caption", "summary")
_TABLE = {"table", "tbody", "td", "tfoot", "th", "thead", "tr", "caption"}
_HEADING = re.compile("h[1-6]")
_ROLE = re.compile(r"(?<![\w-])(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
#: Words that name furniture when a name ends in them, and words that may follow them or deny them.
_WORDS = set(
    "ad ads advert adverts advertisement advertising advertorial adsense banner sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr notice notices notification notifications "
    "alert alerts popup modal overlay newsletter subscribe subscription signup comment comments commentlist disqus respond replies reply menu menus nav navbar navigation breadcrumb breadcrumbs sidebar side "
    "widget widgets footer siteheader pageheader masthead topbar toolbar share sharing social related recommended recommendations readmore pager pagination copyright legal disclaimer search login contentinfo complementary".split()
)
_AFTER = set("area areas bar bars block blocks box boxes button buttons bottom container containers form forms inner item items left link links list lists main outer post posts primary right secondary section sections slot slots top unit units wrap wrapper".split())
_DENY = set("has no not with without is hide".split())
#: Elements that hold other blocks; a name on a paragraph or a heading of an article is about its text.
_CONTAINER = {"div", "section", "ul", "ol", "dl", "table", "center", "details", "figure", "header", "span", "ins"}


def names_furniture(name: str) -> bool:
    """Whether a class, id or label names furniture: ``related-posts`` and ``main-nav`` do, ``social-history`` and ``has-sidebar`` don't.

    The last word tells what a name is about, but for words of place and form.
    """
    words = re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower().replace("_", "-").split("-")
    words = [w for w in words if w and not w.isdigit()]
    if not words or words[0] in _DENY:
        return False
    while len(words) > 1 and words[-1] in _AFTER:
        words.pop()
    return words[-1] in _WORDS or "".join(words[-2:]) in _WORDS


def _furniture(tag: str, attributes: str, inside: bool, names: bool) -> bool:
    if tag in _FURNITURE or (tag in _OUTER and not inside):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    if _HIDDEN.search(attributes):
        return True
    if not names or (inside and tag not in _CONTAINER):
        return False
    for m in _ROLE.finditer(attributes):
        kind, value = m[1].lower(), next(filter(None, m.groups()[1:]), "")
        if inside and kind not in ("class", "role"):
            continue
        if any(map(names_furniture, ["-".join(value.split())] if kind == "aria-label" else value.split())):
            return True
    return False


class _Open:
    """Open block elements, with the places of each tag, so that no step scans them."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.places: dict[str, list[int]] = {}

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def push(self, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        self.tags.append(tag)

    def cut(self, size: int) -> None:
        while len(self.tags) > size:
            self.places[self.tags.pop()].pop()

    def start(self, tag: str) -> None:
        """End what a start tag ends without an end tag."""
        ended, barriers = _ENDS.get(tag, ((), ()))
        at = self.last(ended)
        while at >= 0 and at > self.last(barriers):
            self.cut(at)
            at = self.last(ended)

    def end(self, tag: str) -> None:
        """Close the element of an end tag and all in it; nothing where it has none in reach."""
        at = self.last((tag,))
        barriers = {"table"} if tag in _TABLE else _CELLS
        if tag not in ("article", "main"):
            barriers = barriers | {"article", "main"}
        if tag == "li":
            barriers = barriers | {"ul", "ol", "menu", "dir"}
        if at >= 0 and (tag in ("table", "article", "main") or at > self.last(barriers - {tag})):
            self.cut(at)


class Line(NamedTuple):
    text: str
    plain: int  #: code points outside links
    kind: int = BOX
    heading: bool = False
    furniture: bool = False
    article: int = -1  #: number of the article element
    depth: int = 0  #: open boxes around it


#: What parts an article from its surroundings.
GAP = [Line("", 0)] * LINES


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """Text before each tag, the tag's name (with a slash if it ends an element) and its attributes, in linear time.

    Comments, declarations and the content of raw elements are left out. A ``<``
    that no tag follows is text.
    """
    at, start, size, last, quoted = 0, 0, len(page), page.rfind(">"), True
    while (at := page.find("<", at)) >= 0 and at < last:
        end = -1
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            yield page[start:at], "", ""
            at = start = end + 3 if end >= 0 else size
            continue
        if page[at + 1] in "!?":
            yield page[start:at], "", ""
            at = start = page.find(">", at) + 1
            continue
        m = _NAME.match(page, at)
        if not m:
            at += 1
            continue
        rest = _REST.match(page, m.end()) if quoted else None
        if rest is None:
            quoted = False  # a quote is open to the page's end; from here on tags end at the next >
            end = page.find(">", m.end())
        attributes, after = (rest[1], rest.end()) if rest else (page[m.end() : end], end + 1)
        tag, closing = m[1].lower(), page[at + 1] == "/"
        yield page[start:at], "/" * closing + tag, attributes
        at = start = after
        if tag in _RAW and not closing and not attributes.endswith("/"):
            end = re.compile(rf"</{tag}(?![\w-])", re.I).search(page, at)
            at = start = page.find(">", end.end()) + 1 or size if end else size
    yield page[start:], "", ""


def lines_of(page: str, names: bool = True) -> list[Line]:
    """Lines of a page; those of furniture elements (named ones too, if ``names``) say so. Blank lines part articles from what is around them.

    Furniture ends with its end tag, with that of an enclosing element, or where
    HTML ends its element without a tag. An article or main element that begins
    inside ends it, as it was never closed.
    """
    out: list[Line] = []
    text: list[str] = []
    plain: list[str] = []
    skip, links, block, articles = -1, 0, "", 0  # skip: place of the furniture element that is passed over, or -1
    inside = False
    elements = _Open()

    def flush() -> None:
        nonlocal inside, articles
        line = " ".join("".join(text).split())
        if line:
            now = elements.last(("article", "main")) >= 0
            if now != inside:
                out.extend(GAP)
                inside, articles = now, articles + now
            kind = ARTICLE if now else TEXT if elements.last(_TEXT) >= 0 else BOX
            open_text = sum(len(elements.places.get(t, ())) for t in _TEXT)
            out.append(Line(line, len(line if now else " ".join("".join(plain).split())), kind, bool(_HEADING.fullmatch(block)), skip >= 0, articles if now else -1, len(elements.tags) - open_text))
        text.clear()
        plain.clear()

    for raw, name, attributes in tokens(page):
        if raw:
            raw = html.unescape(raw)
            text.append(raw)
            if not links:
                plain.append(raw)
        if not name:
            continue
        tag, closing = name.lstrip("/"), name[0] == "/"
        void = tag in _VOID or attributes.endswith("/")
        if tag in _RAW and not closing:
            continue
        if tag in _BLOCK:
            flush()
            links = 0
        elif tag == "a":
            links = 0 if closing else 1
        kept = skip >= 0 and not void and not closing and tag == elements.tags[skip]  # an inline element counts within one of its kind
        if closing and tag in ("article", "main") and elements.places.get(tag):
            flush()
            inside = False
        if closing:
            elements.end(tag)
        elif skip >= 0 and tag in ("article", "main"):
            elements.cut(skip)
        else:
            elements.start(tag)
        if skip >= 0 and len(elements.tags) > skip:
            if not closing and not void and (tag in _BLOCK or tag == "option" or kept):
                elements.push(tag)
            continue
        if skip >= 0:
            # the element's own end tag, that of an enclosing element, or the start of what follows it
            flush()
            skip = -1
        if tag in _BLOCK and tag != "br":
            block = "" if closing else tag
        if not closing and not void and _furniture(tag, attributes, elements.last(("article", "main")) >= 0, names):
            flush()
            skip = len(elements.tags)
            elements.push(tag)
            continue
        if not closing and not void and tag in _BLOCK - {"html", "body"}:
            elements.push(tag)
    flush()
    return out


def windows_of(weight: np.ndarray) -> np.ndarray:
    """The weight of LINES lines from each line on."""
    total = np.cumsum(np.append(0, weight))
    return total[np.minimum(np.arange(len(weight)) + LINES, len(weight))] - total[:-1]


def weights_of(lines: list[Line]) -> np.ndarray:
    """Weights of the lines in the distribution of the page's kind.

    That is the kind of the heaviest window, where those of text elements count PREFER times those of boxes, and those of articles PREFER times more. Headings
    are of any kind. A line of another kind weighs nothing unless it is as long as the
    typical line of the page's kind and as a window of text.
    """
    weight = np.array([x.plain * (2 if x.kind == ARTICLE else 1) / (2 if x.furniture else 1) for x in lines])
    kinds, plain = np.array([x.kind for x in lines]), np.array([x.plain for x in lines])
    headings = np.array([x.heading for x in lines])
    if not weight.any():
        return weight
    heaviest = [windows_of(np.where((kinds == k) | headings, weight, 0)).max() * PREFER**k if plain[kinds == k].any() else 0 for k in (BOX, TEXT, ARTICLE)]
    most = int(np.argmax(heaviest))
    other = (kinds != most) & ~(headings & (most != ARTICLE)) & (plain < max(typical(plain[kinds == most]), LINES * SURGE))
    return np.where(other, 0, weight)


def typical(weight: np.ndarray) -> float:
    """The weight that lines of half of all weight have at least."""
    order = np.sort(weight)[::-1]
    return float(order[np.searchsorted(np.cumsum(order), order.sum() / 2)]) if len(order) else 0.0


def between_surge_and_dive(lines: list[Line], weight: np.ndarray) -> np.ndarray:
    """Which lines are text by their weights.

    A stretch of lines begins and ends with lines of weight, and within it no window
    of LINES lines is empty. It is text if a window of it surges: if it holds SHARE of the typical weight.
    What weighs nothing within a stretch is text if it is of the page's kind (all of it in links). So are the few
    linked lines next to a stretch, and a linked heading before it; a heading with nothing after it is not.
    """
    keep = np.zeros(len(lines), bool)
    heavy = np.flatnonzero(weight)
    if not len(heavy):
        return keep
    surge = min(typical(weight) * SHARE, SURGE)
    window = windows_of(weight)
    linked = np.array([bool(x.text) and not x.plain for x in lines])
    for stretch in np.split(heavy, np.flatnonzero(np.diff(heavy) > LINES) + 1):
        first, last = int(stretch[0]), int(stretch[-1])
        if window[first : last + 1].max() < surge:
            continue
        while last > first and lines[last].heading and lines[last].kind != ARTICLE and not all(x.heading for x in lines[first:last]):
            last -= 1
        keep[first : last + 1] = (weight[first : last + 1] > 0) | linked[first : last + 1]
        for step, at in ((-1, first - 1), (1, last + 1)):
            kind, end = lines[at - step].kind, at
            while 0 <= end < len(lines) and linked[end]:
                end += step
            few = abs(end - at) < LINES
            while 0 <= at < len(lines) and linked[at] and lines[at].kind >= kind and (few or (lines[at].heading and step < 0)):
                keep[at] = True
                at += step
    return keep


def taken_out(lines: list[Line], keep: np.ndarray) -> np.ndarray:
    """Which lines go whatever they weigh: furniture by its mark, and on pages with an article what is boxed beside it, and articles of less than SHARE of the largest one's text."""
    gone = np.array([x.furniture for x in lines], bool)
    held: dict[int, int] = {}
    for x, kept in zip(lines, keep & ~gone, strict=True):
        if kept and x.article >= 0:
            held[x.article] = held.get(x.article, 0) + len(x.text)
    if not held:
        return gone
    level = min(x.depth for x in lines if x.article in held) - 1
    small = {a for a, n in held.items() if n < SHARE * max(held.values())}
    return gone | np.array([x.article in small or (x.article < 0 and x.depth > level) for x in lines])


def text_lines(lines: list[Line]) -> list[str]:
    """Lines between surge and dive without what is taken out; where that leaves nothing, of the other lines alone."""
    keep = between_surge_and_dive(lines, weights_of(lines)) if lines else np.zeros(0, bool)
    gone = taken_out(lines, keep)
    if lines and not (keep & ~gone).any():
        lines = [x for x in lines if not x.furniture]
        keep = between_surge_and_dive(lines, weights_of(lines)) if lines else np.zeros(0, bool)
        gone = taken_out(lines, keep)
    return [x.text for x, kept in zip(lines, keep & ~gone, strict=True) if kept]


def main_text(page: str | None) -> str:
    """The page's text lines joined by one space; empty if there are none.

    Where names leave no text at all (a wrapper of the whole page is named like furniture), they don't count.
    """
    for names in (True, False):
        kept = text_lines(lines_of(page or "", names))
        if kept:
            return " ".join(kept)
    return ""


def extract(pages: DataFrame) -> DataFrame:
    """pages with text and n_chars (code points) of the main text in place of html.

    A null or empty page, or one without any text, gives an empty text; repeated rows
    give the same text each, an empty table an empty table. Whole
    pages are read whatever their length, and only they go to Python; columns
    named text or n_chars are replaced.
    """
    bounded_batches(pages.sparkSession)

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py()) for x in column], pa.string())

    rest = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    # not deterministic: else Spark runs it once more for each use of its result
    return pages.select(*rest, run.asNondeterministic()("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
