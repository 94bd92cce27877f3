"""Main text of web pages.

The standard library's parser streams a page as events; block borders cut it
into lines.  A line has its text and the number of tags in it; the ratio of the
two is high in articles and low in menus.  Ratios are smoothed along the page
by a Gaussian and lines at or above a threshold form the content regions.
Lines inside elements that say what they are (navigation, footers, forms,
adverts, notices, comments ...) have no ratio.  Regions widen to the block
around them: an outermost ``article`` or ``main`` that a region reaches is
content as a whole, and a line whose own ratio reaches the threshold takes the
other lines of its ``div``, ``section`` or page (headings, list items) along,
except those that are mostly links.

Defined cases: null or blank html gives empty text; unclosed elements end with
their parent; a page without elements is one region; repeated rows are alike.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame

from .common import per_text

#: Width of the smoothing (standard deviation in lines) and threshold in deviations.
SIGMA, THRESHOLD = 1.0, 0.5

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br".split()
)
SILENT = frozenset(
    "head script style noscript template iframe object embed canvas svg math audio video map form button select option "
    "textarea input nav footer aside menu dialog".split()
)
#: Silent elements that do not end the line they stand in.
QUIET = frozenset(["script", "style", "noscript", "template"])
CONTENT = frozenset(["article", "main"])
#: Elements a region widens to; lines outside all of them have the page as their block.
GROUPS = frozenset(["article", "main", "section", "div"])
#: Share of a line's text inside links beyond which a block does not take it along.
LINKED = 0.5
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side menu nav navbar "
    "navigation header masthead footer cookie cookies consent notice notices gdpr comment comments disqus reply replies share "
    "sharing social breadcrumb breadcrumbs related recommended newsletter subscribe signup login popup modal overlay widget "
    "search toolbar pagination pager".split()
)
#: Elements whose start ends an open paragraph are all blocks; these end their own kind.
SAME_KIND = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

SPLIT_NAME = re.compile(r"[^a-z]+").split


def _named(attrs: dict[str, str]) -> bool:
    """Whether class, id, role or visibility mark an element as beside the text."""
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in ROLES:
        return True
    if "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    return any(part in NAMES for key in ("class", "id") for part in SPLIT_NAME(attrs.get(key, "").lower()))


class Lines(HTMLParser):
    """Collects (text, tags, inside content, block, share of links) per line of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool, int, float]] = []
        self.open: list[tuple[str, bool, bool, int]] = []  # tag, silent, content, block
        self.parts: list[str] = []
        self.tags = self.blocks = self.linked = 0
        self.link: int | None = None  # elements open around the link

    def _state(self) -> tuple[bool, bool, int]:
        return self.open[-1][1:] if self.open else (False, False, 0)

    def cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, content, block = self._state()
            self.lines.append((text, self.tags, content, block, self.linked / len("".join(text.split()))))
        self.parts, self.tags, self.linked = [], 0, 0

    def _close(self, at: int) -> None:
        self.cut()
        self._drop(at)

    def _drop(self, at: int) -> None:
        del self.open[at:]
        if self.link is not None and at < self.link:
            # a link left open ends with the element around it
            self.link = None

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "a":
            self.link = len(self.open)
        if tag in INLINE and tag not in SILENT:
            if tag == "br":
                self.parts.append(" ")
            if tag in VOID:
                return
            if not any(key in ("class", "id", "role", "hidden", "style", "aria-hidden") for key, _ in attrs):
                # plain inline elements change nothing but the count of tags
                return
        elif tag not in QUIET:
            self.cut()
            for closes in SAME_KIND.get(tag, ()) if tag in SAME_KIND else ("p",):
                for at in range(len(self.open) - 1, -1, -1):
                    if self.open[at][0] == closes:
                        self._close(at)
                        break
                    if self.open[at][0] not in INLINE and self.open[at][0] != "p":
                        break
        if tag in VOID:
            return
        silent, content, block = self._state()
        if tag in CONTENT:
            # an element left open before it does not hide an article
            inside = any(t in CONTENT for t, *_ in self.open)
            silent, content = (silent, content) if inside else (False, True)
        named = _named({k: v or "" for k, v in attrs}) and tag not in CONTENT and tag not in ("html", "body")
        header = tag == "header" and not content
        if tag in GROUPS and not (content and self._state()[1]):
            self.blocks += 1
            block = self.blocks
        self.open.append((tag, silent or tag in SILENT or named or header, content and not named, block))

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a":
            self.link = None
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                if tag in INLINE:
                    del self.open[at]
                elif tag in QUIET:
                    self._drop(at)
                else:
                    self._close(at)
                return
            if self.open[at][0] in CONTENT and tag not in ("body", "html"):
                break
        if tag not in INLINE:
            self.cut()

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_data(self, data):
        if not self._state()[0]:
            self.parts.append(data)
            if self.link is not None:
                self.linked += len("".join(data.split()))


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing, weights normalised at the borders."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(ratios, kernel)[reach:reach + len(ratios)]
    return total / np.convolve(np.ones(len(ratios)), kernel)[reach:reach + len(ratios)]


def main_text(html: str) -> str:
    """Blocks of the content regions, joined by line feeds."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.cut()
    lines = parser.lines
    if not lines:
        return ""
    own = np.array([len(text) / max(tags, 1) for text, tags, *_ in lines])
    ratios = smooth(own)
    least = min(THRESHOLD * ratios.std(), ratios.max())
    keep = ratios >= least
    inside = np.array([line[2] for line in lines])
    block = np.array([line[3] for line in lines])
    text = np.array([line[4] for line in lines]) <= LINKED
    keep |= inside & np.isin(block, block[keep & inside])
    keep |= ~inside & text & np.isin(block, block[keep & ~inside & text & (own >= least)])
    return "\n".join([line[0] for line, k in zip(lines, keep) if k])


def extract_pages(pages: DataFrame, keep=("page_id", "url")) -> DataFrame:
    """``keep``, text and n_chars per row of ``pages`` (html)."""

    def compute(texts: list[bytes]):
        found = [main_text(t.decode()) for t in texts]
        return [found, [len(t) for t in found]]

    return per_text(pages, lambda: compute, [("text", "string"), ("n_chars", "bigint")], keep, "html")
