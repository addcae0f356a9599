"""Main text of web pages by the line-block distribution.

Markup is stripped into lines: every block element starts and ends one. A line weighs as many characters as it has outside links; lines in
menus, headers, footers, sidebars, notices, adverts, forms and comments weigh nothing. Weights are summed over windows of BLOCK lines.
A run of text begins where the sum surges to SURGE and ends where it dives to zero. The text goes from the first surge to the last dive, and every line between that
is in no such part is kept, weightless lines (link lists of the article) included. A dive inside the element that holds the run's long lines does not end the text: later lines
with characters outside links in that element still count, and so do earlier ones unless the element is the whole body. Where a page marks its ``article`` or ``main``, that is
the surge and the dive: a line inside weighs at least SURGE and one outside nothing.

References are decoded, white space in a line (Unicode's, no-break space too) becomes one space, lines are joined by a line feed; ``br`` is white space. Headings
of an article's own header stay. Broken markup: an unclosed element ends with its parent, ``li``, ``dt``, ``dd``, ``tr``, ``td``, ``th`` and ``option`` also where the next of their kind begins, an unfinished tag or comment at the end of
the page is dropped, a ``<`` that starts no tag is text. Null or empty html gives an empty text. Repeated rows are extracted each on its
own; an empty table gives no rows. Further columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from flowsieve.llm.common import slices, table, texts

BLOCK, SURGE = 3, 86
# Element names of the HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style noscript template svg math iframe object canvas select textarea button title xmp noembed noframes audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("nav aside footer form dialog menu head".split())
# Words in class, id or role that name a part of the page other than its article.
ROLES = re.compile(
    r"(?:^|[^a-z])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo(?:tion)?|banner|side-?bar|menu|nav(?:bar|igation)?|breadcrumbs?|footer|masthead|site-?header|page-?header|comments?|disqus|replies|"
    r"cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|social|share|sharing|related|recommended|widget|toolbar|pagination|search|contentinfo|complementary)(?:$|[^a-z])"
)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/><]*)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>""")
HIDDEN = re.compile(r"""\bhidden\b|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that end where another of their kind begins: which ones they end, and the elements that shield an outer one.
LISTS, CELLS, TABLE = ("ul", "ol", "menu", "dir", "dl", "table"), ("td", "th"), ("table",)
IMPLIED = {
    "li": (("li",), LISTS), "dt": (("dt", "dd"), LISTS), "dd": (("dt", "dd"), LISTS), "option": (("option",), ("select",)),
    "td": (CELLS, TABLE), "th": (CELLS, TABLE), "tr": (("tr",), TABLE), **{name: (("tbody", "thead", "tfoot"), TABLE) for name in ("tbody", "thead", "tfoot")},
}
ROOTS = frozenset(("html", "body"))


class Line(NamedTuple):
    text: str
    plain: int  # characters outside links
    masked: bool  # outside the article by markup
    inside: bool  # in an article or main element
    node: int  # number of its block element


class Element(NamedTuple):
    name: str
    masked: bool
    inside: bool
    linked: bool
    node: int


def outside(name: str, attributes: str, in_article: bool) -> bool:
    if name in OUTSIDE or name == "header" and not in_article:
        return True
    if not attributes:
        return False
    if name not in ("html", "body", "main") and any(ROLES.search("".join(v).lower()) for v in NAMED.findall(attributes)):
        return True
    return bool(HIDDEN.search(re.sub(r'"[^"]*"', '""', attributes) if "style" not in attributes.lower() and "aria" not in attributes.lower() else attributes))


def lines(html: str) -> tuple[list[Line], list[tuple[int, bool]]]:
    """The lines of a page, and per block element the number of its parent (itself for the page) and whether it is the body or above it."""
    out: list[Line] = []
    blocks: list[tuple[int, bool]] = [(0, True)]
    text: list[str] = []
    plain = 0
    bottom = Element("", False, False, False, 0)
    stack: list[Element] = []
    places: dict[str, list[int]] = {}  # of open elements in the stack, by name
    here = bottom
    pos, size = 0, len(html)
    ended: dict[str, int] = {}

    def find(what: str, start: int) -> int:
        """``html.find`` that does not look again for what is not there."""
        if ended.get(what, -1) >= 0 and start >= ended[what]:
            return -1
        at = html.find(what, start)
        if at < 0:
            ended[what] = start
        return at

    def flush() -> None:
        nonlocal text, plain
        joined = " ".join("".join(text).split())
        if joined or here.masked:
            out.append(Line(joined, min(plain, len(joined)), here.masked, here.inside, here.node))
        text, plain = [], 0

    def put(raw: str) -> None:
        nonlocal plain
        if raw:
            raw = unescape(raw)
            text.append(raw)
            if not here.linked:
                plain += len(raw.strip())

    def last(names: tuple[str, ...]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    def close(depth: int) -> None:
        """Ends the elements from this place of the stack on."""
        nonlocal here
        while len(stack) > depth:
            places[stack.pop().name].pop()
        here = stack[-1] if stack else bottom

    while pos < size:
        at = find("<", pos)
        if at < 0:
            put(html[pos:])
            break
        put(html[pos:at])
        following = html[at + 1 : at + 2]
        if following in ("!", "?"):
            comment = html.startswith("<!--", at)
            end = find("-->" if comment else ">", at + 2)
            if end < 0:
                break
            pos = end + (3 if comment else 1)
            continue
        tag = TAG.match(html, at)
        if tag is None:
            if not (following.isascii() and following.isalpha() or following == "/"):
                put("<")
                pos = at + 1
                continue
            end = find(">", at)
            if end < 0:
                break
            pos = end + 1
            continue
        pos = tag.end()
        closing, name, attributes = tag[1], tag[2].lower(), tag[3]
        if name == "br":
            text.append(" ")
            continue
        if name in RAW and not closing:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, pos)
                pos = end.end() if end else size
            continue
        block = name in BLOCKS
        if block:
            flush()
        if closing:
            if places.get(name):
                close(places[name][-1])
        elif name not in VOID and not attributes.endswith("/") and (block or name == "a" or "class" in attributes or "id=" in attributes):
            if name in IMPLIED:
                ends, shields = IMPLIED[name]
                if last(ends) > last(shields):
                    close(last(ends))
            while block and stack and (here.name in ("p", "a") or here.name in HEADINGS):
                close(len(stack) - 1)
            article = name in ("article", "main")
            masked = outside(name, attributes, here.inside) or (here.masked and not article)
            inside = here.inside or article and not masked
            if here.name == "header" and inside and block and name not in HEADINGS:
                masked = True
            if block:
                blocks.append((here.node, name in ROOTS))
            here = Element(name, masked, inside, here.linked or name == "a", len(blocks) - 1 if block else here.node)
            places.setdefault(name, []).append(len(stack))
            stack.append(here)
    flush()
    return out, blocks


def below(blocks: list[tuple[int, bool]], tops: set[int]) -> np.ndarray:
    """Which elements are one of ``tops`` or inside one. Parents come before their children."""
    found = np.zeros(len(blocks), bool)
    for node, (parent, _) in enumerate(blocks):
        found[node] = node in tops or found[parent]
    return found


def main_text(html: str | None) -> str:
    found, blocks = lines(html or "")
    if not found:
        return ""
    marked = any(x.inside and x.text and not x.masked for x in found)
    weight = np.array([0 if x.masked or marked and not x.inside else max(x.plain, SURGE) if marked else x.plain for x in found])
    sums = np.convolve(weight, np.ones(BLOCK, int))[BLOCK - 1 :]  # of a line and those after it
    run = np.zeros(len(found), bool)
    within = False
    for i in range(len(found)):
        if not within and sums[i] >= SURGE and weight[i]:
            within = True
        elif within and not sums[i]:
            within = False
        run[i] = within and weight[i] > 0
    if not run.any():  # no surge at all: a short page
        return "\n".join(x.text for x, w in zip(found, weight) if w)
    # The elements around the long lines, or around all lines of the runs where none is long.
    held = {blocks[found[i].node][0] for i in np.flatnonzero(run & (weight >= SURGE) if (run & (weight >= SURGE)).any() else run)}
    after, before = below(blocks, held), below(blocks, {node for node in held if not blocks[node][1]})
    nodes = np.array([x.node for x in found])
    first = np.flatnonzero(run | (weight > 0) & before[nodes])[0]
    last = np.flatnonzero(run | (weight > 0) & after[nodes] & (np.arange(len(found)) >= np.flatnonzero(run)[0]))[-1]
    return "\n".join(x.text for x in found[first : last + 1] if x.text and not x.masked and (x.inside or not marked))


def extract(pages: DataFrame) -> DataFrame:
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            out = [main_text(h) for h in texts(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op8_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages"))
