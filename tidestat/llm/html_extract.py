"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of text; what a page does not show (scripts, styles, hidden elements) goes
with it. A line weighs as many characters as it has outside links, times what the names around it say: names of boilerplate weigh
it down, an article (or main) element weighs down what is beside it. Weights are summed over sliding windows of lines. A surge
is where a window reaches the threshold, a dive where windows fall to nothing; the text between a surge and its dive is
kept, and in an article all from its first surge to its last dive, but for lines that are dips (far lighter for their length than
the windows of the surge). Borders of containers are empty lines, so that no window counts the lines of two.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField

from tidestat.llm.common import map_rows

WINDOW = 3
THRESHOLD = 86
#: A stretch goes on while its windows have more than this share of the threshold.
DIVE = 0.01
#: What a character weighs among names of boilerplate, and beside the article of a page that has one; elsewhere it is 1.
BOILERPLATE_WEIGHT = 0.001
BESIDE_WEIGHT = 0.1
#: A line is a dip if its characters weigh less than this share of those in the windows of the surge.
DIP = 0.5

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^\"'>])*)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")

# Element names of the HTML standard by what they do to text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_SHOWN = frozenset("head script style noscript template datalist iframe svg canvas object applet audio video title noframes noembed map".split())
BOILERPLATE = frozenset("nav header footer aside form button select textarea input label menu dialog search".split())
MAIN = frozenset(("article", "main"))
HOLDERS = frozenset("article body div main section td".split())
# Roles and class or id names of what is not the article.
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
_NOT_TEXT = (
    r"ad|ads|adv|advert\w*|adsense|adbox|banner\w*|sponsor\w*|promo\w*|sidebar\w*|menu\w*|nav|navbar|navigation|breadcrumbs?|cookies?|"
    r"consent|gdpr|notice\w*|popup|modal|overlay|newsletter|subscribe\w*|signup|login|share|sharing|social\w*|related\w*|recommend\w*|"
    r"comments?|commentlist|disqus\w*|repl(?:y|ies)|respond|footer\w*|masthead|toolbar|pagination|pager|widget\w*|hidden|skip-link|tags"
)
_COMMENTS = re.compile(r"comments?|comment[-_]\S*|\S+[-_]comments?", re.I)
_CLASS = re.compile(rf"(?:{_NOT_TEXT})(?:[-_]\S*)?|(?:site|page|top|global)[-_]?header|header|\S+[-_](?:{_NOT_TEXT})", re.I)


@dataclass
class _Open:
    name: str
    shown: bool
    names: bool
    region: int
    holder: int


@dataclass
class Line:
    """A block's text (empty at borders), its characters outside links, whether names of boilerplate surround it, and the number of the
    article or main element that holds it (0 outside)."""

    text: str
    plain: int = 0
    names: bool = False
    region: int = 0


def _shown(name: str, attrs: dict[str, str]) -> bool:
    if name in NOT_SHOWN or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return name in ("html", "body")
    return not re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I) or name in ("html", "body")


def _boilerplate(name: str, attrs: dict[str, str], inside_main: bool) -> bool:
    if name in BOILERPLATE:
        return not (name == "header" and inside_main) or attrs.get("role", "").lower() in ROLES
    if name in ("html", "body"):
        return False
    known = _COMMENTS if name in MAIN else _CLASS
    return attrs.get("role", "").lower() in ROLES or any(known.fullmatch(c) for k in ("class", "id") for c in attrs.get(k, "").split())


def _attributes(attrs: str) -> dict[str, str]:
    if not attrs or attrs.isspace():
        return {}
    found = {k.lower(): "".join(v) for k, *v in reversed(_ATTR.findall(attrs))}
    return found | ({"hidden": ""} if re.search(r"(?:^|\s)hidden(?:\s|$|/)", re.sub(_ATTR, " ", attrs)) else {})


def lines_of(page: str, window: int = WINDOW) -> list[Line]:
    """The lines of a page. `window` empty ones stand at the borders of articles and of boilerplate outside them, one fewer where
    the text outside articles goes on in another container (a window then still reaches from one to the other, and none
    from the one before)."""
    out: list[Line] = []
    stack: list[_Open] = [_Open("", True, False, 0, 0)]
    parts: list[str] = []
    linked = links = regions = holders = was_in = 0

    def flush() -> None:
        nonlocal linked, was_in
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            top = stack[-1]
            if not top.region and top.holder != was_in and out and out[-1].text:
                out.extend([Line("")] * (window - 1))
            was_in = top.holder
            out.append(Line(text, max(0, len(text) - linked), top.names, top.region))
        parts.clear()
        linked = 0

    def border() -> None:
        if out and out[-1].text:
            out.extend([Line("", region=out[-1].region)] * window)

    def close(depth: int) -> None:
        nonlocal links
        while len(stack) > depth:
            if stack[-1].name in BLOCKS:
                flush()
            was = stack.pop()
            links -= was.name == "a"
            if was.name in MAIN or was.names and not stack[-1].names and not was.region:
                border()

    def text(piece: str) -> None:
        nonlocal linked
        if piece and stack[-1].shown:
            parts.append(piece)
            if links:
                linked += len(" ".join(html.unescape(piece).split()))

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            text(m["cdata"])
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["end"] or m["end2"]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), None)
            if depth is not None:
                close(depth)
            elif name in BLOCKS:
                flush()
            continue
        raw = m["attrs"] if m["name"] else m["attrs2"]
        if name in BLOCKS:
            # A block ends an open paragraph; an item ends an open item of its list.
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p" or stack[i].name == name and name in ("li", "dt", "dd", "option", "tr", "td", "th"):
                    close(i)
                    break
                if stack[i].name in ("ul", "ol", "dl", "table", "div", "article", "section", "main", "select", "nav", "body", "blockquote"):
                    break
            flush()
        top, attrs = stack[-1], _attributes(raw)
        shown = top.shown and _shown(name, attrs)
        names = top.names or shown and _boilerplate(name, attrs, top.region > 0)
        if names and not top.names and name not in VOID or name in RAW:
            flush()
        if name == "br" and shown:
            parts.append(" ")
        if name in VOID or raw.endswith("/") and name not in BLOCKS | RAW | {"a", "b", "i", "span"}:
            continue
        region = top.region
        if name in MAIN and shown:
            regions += 1
            region = region or regions
            border()
        elif names and not top.names and not region:
            border()
        if name in RAW:
            e = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = e.end() if e else n
            continue
        holders += name in HOLDERS
        stack.append(_Open(name, shown, names, region, holders if name in HOLDERS else top.holder))
        links += name == "a"
    close(1)
    flush()
    return out


def line_weights(lines: list[Line]) -> list[float]:
    """What a character of each line weighs, by the names around it."""
    article = any(x.region and not x.names and x.text for x in lines)
    return [BOILERPLATE_WEIGHT if x.names else BESIDE_WEIGHT if article and not x.region else 1.0 for x in lines]


def window_sums(weights: list[float], window: int = WINDOW) -> list[float]:
    """The sum of each window of lines, by its first line."""
    return [sum(weights[i : i + window]) for i in range(len(weights))]


def stretches(sums: list[float], n: int, surge: float, dive: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """[first, end) of the lines that lie in a chain of windows over `dive` of which one at least reaches `surge`."""
    out, start, strong = [], None, False
    for i, s in enumerate([*sums, -1.0]):
        if s > dive:
            start = i if start is None else start
            strong = strong or s >= surge
        elif start is not None:
            if strong:
                out.append((start, min(n, i - 1 + window)))
            start, strong = None, False
    return out


def _kept(lines: list[Line], per_char: list[float], threshold: float, least: float, window: int, whole: bool) -> list[str]:
    """The text between surges and dives of a region's lines; if `whole`, from its first surge to its last dive. Nothing of a region
    whose windows have no more than `least`."""
    weights = [x.plain * c for x, c in zip(lines, per_char, strict=True)]
    sums = window_sums(weights, window)
    top = max(range(len(sums)), key=sums.__getitem__)
    if sums[top] <= least:
        return []
    surge = min(threshold, sums[top]) if whole else threshold
    found = stretches(sums, len(lines), surge, surge * DIVE, window)
    at = slice(top, top + window)
    level = DIP * sum(weights[at]) / max(1, sum(x.plain for x in lines[at]))
    out: list[tuple[int, int]] = []
    for a, b in found:
        # Windows reach over the ends: a stretch begins and ends with text, neither links nor dips.
        while a < b and not (lines[a].text and per_char[a] >= level and 2 * lines[a].plain >= len(lines[a].text)):
            a += 1
        while a < b and not (lines[b - 1].text and per_char[b - 1] >= level and 2 * lines[b - 1].plain >= len(lines[b - 1].text)):
            b -= 1
        if a < b:
            out.append((a, b))
    if whole and out:
        out = [(out[0][0], out[-1][1])]
    return [x.text for a, b in out for x, c in zip(lines[a:b], per_char[a:b], strict=True) if x.text and c >= level]


def main_text(page: str | None, window: int = WINDOW, threshold: int = THRESHOLD) -> str:
    """The main text of a page: blocks joined by a line feed; empty for null, empty or text-free pages. Where no window of the page
    (of an article: of its own) reaches the threshold, the greatest is the surge; an article of links alone is kept whole."""
    lines = lines_of(page or "", window)
    per_char = line_weights(lines)
    sums = window_sums([x.plain * c for x, c in zip(lines, per_char, strict=True)], window)
    most = max(sums, default=0.0)
    if most <= 0:
        return "\n".join(x.text for x in lines if x.region and not x.names and x.text)
    surge = min(threshold, most)
    kept: list[str] = []
    for region, part in groupby(zip(lines, per_char, strict=True), key=lambda x: x[0].region):
        own, weighs = map(list, zip(*part, strict=True))
        kept += _kept(own, weighs, threshold if region else surge, surge * DIVE, window, region > 0)
    return "\n".join(kept)


def extract(pages: DataFrame, html_column: str = "html", window: int = WINDOW, threshold: int = THRESHOLD) -> DataFrame:
    """pages with text and n_chars (code points) of the main text; both replace columns of that name.

    Null and empty pages, and pages without text, give an empty text; malformed markup is read as far as it goes; long pages
    are read whole; repeated rows and extra columns pass through.
    """

    def make():
        def each(_: pa.RecordBatch, texts: list[bytes | None]) -> dict[str, pa.Array]:
            found = [main_text(t.decode() if t else None, window, threshold) for t in texts]
            return {"text": pa.array(found, pa.string()), "n_chars": pa.array([len(t) for t in found], pa.int64())}

        return each

    return map_rows(pages, html_column, [StructField("text", StringType()), StructField("n_chars", LongType())], make)
