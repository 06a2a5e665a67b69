"""Operator 3: main text of web pages.

The standard library's parser streams a page's tags and texts, which are cut into lines, one for each block.
A line's ratio is its characters over its tags; the ratios are smoothed with a Gaussian, and
a threshold that clusters them in two marks lines of content. Navigation, headers, footers, sidebars, forms, scripts,
adverts, notices and reader comments, known by their elements, roles and
class names, are never content. The region is every article, where articles hold half of the content's characters, else the main element, else the
smallest element that holds all lines of content, paragraphs and first-level headings; all its lines are the text, short ones too. Where that is
no smaller than the page's body, lines between the first and the last of these are.

A class or id drops an element if one of its words is a name of NAMES and all others only say where or of what shape it is:
``share-buttons`` and ``site-footer`` go, ``share-price``, ``article-header`` and ``with-sidebar`` stay. Headings and paragraphs are
never judged by their class or id. Time and memory are linear in the page, however deep its elements nest.

Edge cases: a null or empty page has the empty text, as has one without content; unclosed and
unmatched tags are accepted as browsers do, and a page cut off within a tag or a comment ends there; repeated rows give equal
rows; an empty table gives an empty result; pages of any length are read whole. Only page_id, url and html are read.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ingot.llm.common import prepare, ships

ships(__name__)

# Element, role and class names of HTML and of common practice.
DROPPED = set("head script style noscript template nav header footer aside form button select textarea input iframe svg math canvas object audio video dialog menu".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - {"body", "html"}
REGIONS = set("article main section div td body".split())
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NAMES = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer"
    " gdpr header login masthead menu modal nav navbar navigation newsletter notice popup promo related replies reply search share sharing sidebar"
    " signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
PLACES = set(
    "area articles bar block bottom box btn button buttons c class col column container desktop fixed form global group icons id inner item items left"
    " line links list main mobile module outer page panel policy posts right row section side site slot sticky stories strip thread top unit web wrap wrapper".split()
)
KEPT_ANYWAY = set("html body main article p h1 h2 h3 h4 h5 h6".split())
COMMENT_NAMES = set("comment comments commentlist commentform reply replies respond disqus".split())

SIGMA, RADIUS = 1.0, 2
CUT_OFF = re.compile(r"<[A-Za-z/!?]")


def _named(attrs) -> set[str]:
    """The names of NAMES that an element's classes and id are, words for place and shape aside."""
    out = set()
    for label in " ".join(attrs.get(k) or "" for k in ("class", "id")).lower().split():
        parts = {re.sub(r"\d+$", "", x) for x in re.split(r"[^a-z0-9]+", label)} - {""}
        names = parts & (NAMES | COMMENT_NAMES)
        if names and parts <= NAMES | COMMENT_NAMES | PLACES:
            out |= names
    return out


class _Lines(HTMLParser):
    """Collects lines: text, tags, the innermost region, and whether it is a paragraph or first-level heading.

    A region knows the one around it, so a line carries one number and not a chain; of each tag the open
    places are kept, so that nothing walks through the open elements.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines = []  # (text, tags, region, prose)
        self.stack = []  # (tag, dropped, region)
        self.open = {}  # tag -> its places in the stack
        self.regions = [("", 0)]  # by number: tag, the region around it; 0 is the page
        self.parts, self.tags = [], 0

    def end_line(self):
        text = " ".join("".join(self.parts).split())
        if text:
            tag, _, region = self.stack[-1] if self.stack else ("", False, 0)
            self.lines.append((text, self.tags, region, tag in ("p", "h1")))
            self.tags = 0
        self.parts = []

    def _dropped(self, tag, attrs):
        if tag in DROPPED:
            return "header" if tag == "header" and self.open.get("article") else True
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "")
        if tag in KEPT_ANYWAY:
            return (hidden and tag not in ("html", "body")) or (tag == "article" and bool(_named(attrs) & COMMENT_NAMES))
        return hidden or (attrs.get("role") or "").lower() in ROLES or bool(_named(attrs))

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCKS:
            self.end_line()
        elif tag in ("td", "th"):
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self._close("p", within=BLOCKS - {"p"})
        if tag in ("li", "tr", "dt", "dd"):
            self._close(tag, within={"ul", "ol", "menu", "table", "dl"})
        dropped = self._dropped(tag, dict(attrs))
        if tag in BLOCKS or tag in REGIONS or dropped:
            _, above, region = self.stack[-1] if self.stack else ("", False, 0)
            if above == "header" and (dropped is False):
                dropped = False if tag in HEADINGS else "header"
            else:
                dropped = dropped or above
            if tag in REGIONS:
                self.regions.append((tag, region))
                region = len(self.regions) - 1
            self.open.setdefault(tag, []).append(len(self.stack))
            self.stack.append((tag, dropped, region))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, tag, within=()):
        """End the innermost open ``tag``, unless an element of ``within`` is nearer."""
        at = self.open.get(tag)
        if not at or any(self.open[w][-1] > at[-1] for w in within if self.open.get(w)):
            return
        for _ in range(len(self.stack) - at[-1]):
            self.open[self.stack.pop()[0]].pop()

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        if tag not in ("br",):
            self._close(tag)

    def handle_data(self, data):
        if not (self.stack and self.stack[-1][1]):
            self.parts.append(data)


def smoothed(ratios: np.ndarray) -> np.ndarray:
    kernel = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    around = np.pad(ratios, RADIUS, mode="edge")
    return np.convolve(around, kernel / kernel.sum(), mode="valid")


def threshold(values: np.ndarray) -> float:
    """The border between two clusters: halfway between their means, from the overall mean on."""
    t = float(values.mean())
    for _ in range(50):
        low, high = values[values < t], values[values >= t]
        if not len(low) or not len(high):
            break
        new = (float(low.mean()) + float(high.mean())) / 2
        if new == t:
            break
        t = new
    return t


def _tops(regions, tag: str) -> list[int]:
    """By region: the outermost region of that tag it lies in, or 0."""
    out = [0] * len(regions)
    for r, (name, around) in enumerate(regions):
        out[r] = out[around] or (r if name == tag else 0)  # a region comes after the one around it
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    end = html.rfind(">") + 1
    cut = CUT_OFF.search(html, end)  # the parser would look for the end of each such tag anew
    p = _Lines()
    p.feed(html[: cut.start()] if cut else html)
    p.close()
    p.end_line()
    if not p.lines:
        return ""
    size = np.array([len(x[0]) for x in p.lines], float)
    ratio = smoothed(size / np.array([max(1, x[1]) for x in p.lines], float))
    content = ratio >= threshold(ratio)
    at = np.array([x[2] for x in p.lines])
    for tag in ("article", "main"):
        top = np.array(_tops(p.regions, tag))[at]
        if size[content & (top > 0)].sum() >= 0.5 * size[content].sum():
            return "\n".join(x[0] for x, t in zip(p.lines, top, strict=True) if t)
    content |= np.array([x[3] for x in p.lines])
    held = np.bincount(at[content], minlength=len(p.regions)).tolist()
    for r in range(len(held) - 1, 0, -1):
        held[p.regions[r][1]] += held[r]
    # those that hold all content lie in each other; the last opened is the smallest
    region = max(r for r, n in enumerate(held) if n == content.sum())
    if p.regions[region][0] not in ("", "body"):
        inside = [False] * len(held)
        for r, (_, around) in enumerate(p.regions):
            inside[r] = r == region or (r > 0 and inside[around])
        return "\n".join(x[0] for x in p.lines if inside[x[2]])
    first, last = np.flatnonzero(content)[[0, -1]]
    return "\n".join(x[0] for x in p.lines[first : last + 1])


def page_batches(batches):
    """For mapInArrow over (page_id, url, html): page_id, url, text, n_chars."""
    for b in batches:
        texts = [main_text(h.as_py()) for h in b.column(2)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per page."""
    prepare(pages.sparkSession)
    pages = pages.select("page_id", "url", F.col("html").cast("string"))
    kinds = [f.dataType.simpleString() for f in pages.schema.fields]
    return pages.mapInArrow(page_batches, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
