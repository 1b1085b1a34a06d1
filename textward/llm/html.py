"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags.  The first pass classifies each block: what stands in menus, headers,
footers, sidebars, forms, notices, adverts or comments is boilerplate; elsewhere link density, length and the share
of function words, measured against that of the page, decide, and short or middling blocks stay open.  The second pass
gives open blocks the label of their nearest decided neighbours.

Pages without an article or main element rest on that alone.  A heading goes with what follows and vouches for nothing
before it, and elements that are set apart count as neighbours only where there are no others.  If no block of such a
page is long enough to be certain, prose from SHORT characters on under a heading is, or else whatever stands there.
Inside an article or main element boilerplate needs its own evidence: open blocks there count as text, but for those
up to LONG characters whose neighbours in it are both boilerplate, if the article has certain text at all.  Outside it,
on pages that have one, both neighbours must be text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters from which a block can decide alone, and from which it is text for certain.
SHORT, LONG = 70, 200
#: Shares of function words for open and for certain text, and the parts of the page's own share that do as well (a
#: page in a language without listed words has none); share of characters in links that marks boilerplate.
STOPS_LOW, STOPS_HIGH, LINKS = 0.30, 0.32, 0.20
PART_LOW, PART_HIGH = 0.35, 0.60

_BLOCKS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tags may be missing; they are not kept on the stack of open elements.
_LOOSE = frozenset("p li dt dd option optgroup tr td th thead tbody tfoot col colgroup body html caption".split())
#: Elements whose content is no text at all.
_HIDDEN = frozenset("head script style noscript template iframe object svg math canvas audio video select textarea "
                    "button datalist title".split())
_APART = frozenset("nav footer aside form menu dialog fieldset search".split())
_APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar "
                         "alertdialog toolbar".split())
_APART_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies "
    "consent gdpr notice notices popup modal overlay sidebar side widget widgets related recommended share sharing "
    "social comment comments reply replies respond disqus nav navbar navigation menu breadcrumb breadcrumbs footer "
    "masthead subscribe subscription newsletter signup login register pagination pager copyright disclaimer toolbar "
    "skip outbrain taboola".split())
_RAW = r"script|style|noscript|template|iframe|object|svg|math|textarea|title|select|button|canvas|audio|video"
_MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.DOTALL | re.IGNORECASE)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.IGNORECASE)
_HEADING = re.compile(r"h[1-6]\Z")
_WORD = re.compile(r"[^\W\d_]+")

#: Frequent function words of the languages at hand.
_STOPS = frozenset(
    "the of and to in a is that it was for on are with as be this by from or an at not he she they have has had but "
    "which you we his her their its were been one all there would will can if what when who so no "
    "de la que el en y los se del las un por con una para es al lo como más o pero sus le ya este sí porque "
    "les et des une du dans est qui au sur pas pour ne ce il sont plus par je avec ou mais nous vous elle aux "
    "der die und das den von zu mit sich auf für ist im dem nicht ein eine als auch an werden aus er hat dass sie "
    "nach wird bei einer um am noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch".split())


@dataclass
class Block:
    """A run of text between block-level tags; ``main`` and ``apart`` tell what it stands in."""

    main: bool
    apart: bool
    heading: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _sets_apart(attributes: str, in_main: bool) -> bool:
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            if not _APART_NAMES.isdisjoint(re.split(r"[^a-z]+", value)):
                return True
        elif name == "role" and value in _APART_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def blocks(page: str) -> Iterator[Block]:
    """Blocks with text, in page order.  Tags may be unclosed, misnested or cut off."""
    opened: list[tuple[str, bool, bool]] = []  # tag, in main, apart
    depth: Counter[str] = Counter()  # open elements by tag, so that an unmatched end tag costs nothing
    links, at, heading = 0, 0, False
    link_depth, link_loose = 0, False  # where the link began: elements open, and whether in a paragraph or the like
    in_loose = False
    hidden = 0  # depth of the stack at which hidden content began
    block = Block(False, False, False)
    loose_apart = False

    def text_until(end: int) -> None:
        if end > at and not hidden:
            part = page[at:end]
            block.parts.append(part)
            if links:
                block.linked += len(part.strip())

    for m in _MARKUP.finditer(page):
        text_until(m.start())
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:  # comment, declaration, or an element without text
            continue
        closing, attributes = bool(m[2] or m[5]), m[4] or m[7] or ""
        if tag == "a":
            links = 0 if closing else 1
            link_depth, link_loose = len(opened), in_loose
            continue
        if tag not in _BLOCKS and tag not in _HIDDEN:
            if tag == "br":
                block.parts.append(" ")
            continue
        if closing:
            while depth[tag]:
                last = opened.pop()[0]
                depth[last] -= 1
                if last == tag:
                    break
            if hidden > len(opened):
                hidden = 0
            heading = heading and not _HEADING.match(tag)
            loose_apart = False
        in_main = opened[-1][1] if opened else False
        apart = opened[-1][2] if opened else False
        if not closing and tag not in _VOID:
            own = _sets_apart(attributes, in_main) if attributes else False
            loose_apart = own if tag in _LOOSE else False
            if tag not in _LOOSE:
                apart = apart or own or tag in _APART or tag == "header" and not in_main
                in_main = in_main or tag in ("article", "main") and not apart
                opened.append((tag, in_main, apart))
                depth[tag] += 1
                if tag in _HIDDEN and not hidden:
                    hidden = len(opened)
            if _HEADING.match(tag):
                heading = True
        yield block
        if len(opened) < link_depth or link_loose and tag in _LOOSE:
            links = 0  # its element ended without an end tag of the link
        in_loose = not closing and tag in _LOOSE
        link_loose = link_loose and bool(links)
        block = Block(in_main, apart or loose_apart, heading)
    text_until(len(page))
    yield block


def _stop_words(text: str) -> tuple[int, int]:
    """Function words and words of a text; signs around words do not matter."""
    words = _WORD.findall(text.lower())
    return sum(w in _STOPS for w in words), len(words)


def _first_pass(b: Block, low: float, high: float, length: int = LONG) -> str:
    """"text", "other", or "open" for a block that its neighbours decide."""
    links = b.linked / max(len(b.text), 1)
    if b.apart or links > LINKS and not (b.main and links < 0.5):
        return "other"
    if b.main and links > LINKS:
        return "open"
    if not b.main and ("©" in b.text or b.text.lower().startswith("copyright")):
        return "other"
    if b.heading or len(b.text) < SHORT:
        return "open" if not b.linked or b.main else "other"
    stops, words = _stop_words(b.text)
    share = stops / max(words, 1)
    if share >= high and len(b.text) > length:
        return "text"
    return "open" if share >= low or b.main else "other"


def _thresholds(found: list[Block]) -> tuple[float, float]:
    """Shares of function words for open and for certain text on this page."""
    prose = [_stop_words(b.text) for b in found
             if not b.apart and len(b.text) >= SHORT and b.linked <= LINKS * len(b.text)]
    share = sum(s for s, _ in prose) / max(sum(w for _, w in prose), 1)
    return min(STOPS_LOW, PART_LOW * share), min(STOPS_HIGH, PART_HIGH * share)


def _without_article(found: list[Block], low: float, high: float) -> list[str]:
    """Labels on a page that has no article or main element."""
    labels = [_first_pass(b, low, high) for b in found]
    if "text" not in labels:  # short pages: the first heading, if any, tells where the text begins
        begins = next((i for i, b in enumerate(found) if b.heading and labels[i] == "open"), 0)
        shorter = [_first_pass(b, low, high, SHORT) if i >= begins else x
                   for i, (b, x) in enumerate(zip(found, labels, strict=True))]
        if "text" not in shorter and found and found[begins].heading:
            shorter = ["text" if x == "open" and i >= begins else x for i, x in enumerate(labels)]
        labels = shorter
    n = len(found)
    before: list[tuple[int, str] | None] = [None] * n
    after: list[tuple[int, str] | None] = [None] * n
    last = apart = None
    for i in range(n):
        before[i] = last or apart
        if labels[i] != "open":
            last, apart = (last, (i, "other")) if found[i].apart else ((i, labels[i]), apart)
    last = apart = None
    for i in range(n - 1, -1, -1):
        after[i] = last or apart
        if labels[i] != "open":
            last, apart = (last, (i, "other")) if found[i].apart else ((i, labels[i]), apart)
        if found[i].heading:  # what follows a heading says nothing of what stands before it
            last = apart = None
    final = list(labels)
    for i, label in enumerate(labels):
        if label != "open":
            continue
        near = [(abs(i - x[0]), x[1], x is before[i], found[x[0]].apart) for x in (before[i], after[i]) if x]
        near = [x for x in near if not x[3]] or near
        if not near:
            final[i] = "other"
        elif found[i].heading and after[i]:
            final[i] = after[i][1]
        else:  # the nearer one, of two as near the one before
            final[i] = min(near, key=lambda x: (x[0], not x[2]))[1]
    return final


def _with_article(found: list[Block], low: float, high: float) -> list[str]:
    """Labels on a page with an article or main element."""
    labels = [_first_pass(b, low, high) for b in found]
    decided = [i for i, x in enumerate(labels) if x != "open"]
    certain = any(b.main and x == "text" for b, x in zip(found, labels, strict=True))
    before, j = -1, 0
    final = list(labels)
    for i, label in enumerate(labels):
        if label != "open":
            before = i
            continue
        while j < len(decided) and decided[j] < i:
            j += 1
        after = decided[j] if j < len(decided) else -1
        near = [labels[x] for x in (before, after) if x >= 0 and found[x].main == found[i].main]
        if found[i].main:
            final[i] = "other" if near == ["other"] * 2 and certain and len(found[i].text) <= LONG else "text"
        else:
            final[i] = "text" if near == ["text"] * 2 else "other"
    return final


def main_text(page: str | None) -> str:
    """Blocks of the main text, white space collapsed, joined by blank lines; empty without any."""
    if not page:
        return ""
    found = []
    for b in blocks(page):
        if b.parts:
            b.text = " ".join(html.unescape("".join(b.parts)).split())
            if b.text:
                found.append(b)
    classify = _with_article if any(b.main for b in found) else _without_article
    labels = classify(found, *_thresholds(found))
    return "\n\n".join(b.text for b, label in zip(found, labels, strict=True) if label == "text")


def extract(page: Column) -> Column:
    """Main text of a page; empty for a null, empty or textless one.  Repeated pages give the same text."""
    @F.arrow_udf("string")
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py()) for p in pages], pa.string())

    return run(page)
