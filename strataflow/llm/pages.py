"""Main text of web pages by tag-path ratios.

A page is cut into blocks at block-level tags. Every block has the path of open tags from the root. Text length and
marks of punctuation are summed per path and divided by the path's number of text nodes; both ratios are smoothed over
the blocks in page order, fused, and weighed: a main or article part weighs more than what stands beside it. Paths whose
fused ratio passes a threshold (a share of the page's deviation) are content. What stands in the same part of the page
as content (short list items, quotes, a last line; inside a main or article also parts of its own) belongs to it,
unless its path is a list of links. Parts that their tag, role or whole class name says are navigation, advertisement
and the like, and hidden ones, are left out before. Work is linear in the page, however broken its markup.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tag names of the HTML standard.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math canvas object audio video".split())
OUTSIDE_TAGS = frozenset("nav header footer aside form menu dialog button select option label input legend fieldset head".split())
MAIN_TAGS = frozenset("article main".split())
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
#: Words of class names, ids and roles that stand for what is not the article.
OUTSIDE_WORDS = frozenset(
    "ad ads advert advertisement advertising adv banner sponsor sponsored promo promotion menu nav navigation navbar breadcrumb breadcrumbs header masthead "
    "footer sidebar aside widget related recommended comments comment reply replies respond disqus discussion cookie cookies consent notice notices gdpr "
    "alert popup modal newsletter subscribe subscription signup login share sharing social toolbar pagination pager copyright legal search form".split()
)
#: Words that only say where or how such a part stands: `site-footer` and `share-buttons` are named as outside, `share-price` is not.
PLACE_WORDS = frozenset(
    "site page main top bottom left right center upper lower primary secondary global inner outer box bar block wrapper wrap container list lists item items link "
    "links post posts article articles story stories button buttons btn icon icons area section panel slot unit zone content text title label user reader view the "
    "group row col column module bar js is has by and on footer bottom".split()
)
#: Of the words for outside, those that style often gives to the page's own parts: they count only outside an article.
PAGE_WORDS = frozenset("header notice notices alert legal search form".split())
MAIN_WORDS = frozenset("article content post entry story main body".split())
#: Tags that only shape text: what is in them belongs to the part around them.
FLOW_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 hgroup hr ul ol li dl dt dd blockquote pre table tbody thead tfoot tr td th caption figure figcaption address details summary center".split())
#: Tags whose text is no list of links even where all of it is a link.
PROSE_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 hgroup blockquote pre figcaption".split())
#: Block levels and characters of a label that a path holds.
LEVELS, LABEL = 64, 80
#: Blocks on either side that smooth a block's ratios; the threshold as a share of their deviation.
REACH, SHARE = 2, 0.15
#: Weight of the fused ratio of blocks outside the page's main or article, where it has one.
BESIDE = 0.25
#: Of a path's characters, the share inside links from which it is a list of links.
LINKED = 0.6

_MARKUP = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z]|/)")
_NAME = re.compile(r"[^\s/>]+")
_ATTRIBUTE = re.compile(r"[\s/]*(?:(=?[^\s/>=]+|=)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>\"'][^\s>]*)?))?)?")
_NONE = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ZEROS, _HUGE = re.compile(r"&#([xX]?)0+(?=[0-9a-fA-F])"), re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")
_MARKS = re.compile(r"[.,;:!?…。，、！？]")
_BLANK = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    path: str
    home: str
    article: str
    prose: bool
    outside: bool
    main: int
    linked: int
    nodes: int


@dataclass
class _Open:
    tag: str
    path: str = ""
    home: str = ""
    article: str = ""
    level: int = 0
    outside: bool = False
    main: int = 0


_ROOT = _Open("")


@dataclass
class _Page:
    open: list[_Open] = field(default_factory=list)
    places: dict[str, list[int]] = field(default_factory=dict)
    levels: list[int] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    linked: int = 0
    nodes: int = 0

    def text(self, raw: str) -> None:
        if raw:
            self.parts.append(raw)
            if not raw.isspace():
                self.nodes += 1
                if self.places.get("a"):
                    self.linked += len(raw)

    def close_block(self) -> None:
        if self.parts:
            text = _BLANK.sub(" ", _decoded("".join(self.parts))).strip()
            if text:
                at = self.open[-1] if self.open else _ROOT
                prose = bool(self.levels) and self.open[self.levels[-1]].tag in PROSE_TAGS
                self.blocks.append(Block(text, at.path, at.home, at.article, prose, at.outside, at.main, self.linked, max(1, self.nodes)))
            self.parts, self.linked, self.nodes = [], 0, 0

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in VOID_TAGS:
            if tag == "hr":
                self.close_block()
            elif tag == "br":
                self.parts.append(" ")
            return
        if tag in BLOCK_TAGS:
            self.close_block()
            if self.levels and self.open[self.levels[-1]].tag == "p":  # a block ends an open paragraph and what is open in it
                self.cut(self.levels[-1])
            for i in range(len(self.open) - 1, max(-1, len(self.open) - 9), -1):
                if self.open[i].tag in CLOSED_BY.get(tag, ()):
                    self.cut(i)
                    break
                if self.open[i].tag in ("ul", "ol", "dl", "table", "tbody", "thead", "select"):
                    break
        above = self.open[-1] if self.open else _ROOT
        role = attributes.get("role", "").strip().lower()
        names = [[w.lower() for w in _WORDS.findall(name)] for key in ("class", "id", "role") for name in attributes.get(key, "").split()]
        named = {w for words in names for w in words}
        outside, main = above.outside, above.main
        here = tag in MAIN_TAGS or role == "main"
        if here:
            main = 2
        elif not main and MAIN_WORDS.intersection(named) and tag in ("div", "section", "td"):
            main = 1
        if tag not in ("html", "body") or not self.open:
            words = OUTSIDE_WORDS - PAGE_WORDS if main == 2 else OUTSIDE_WORDS
            alone = tag in ("html", "body") or tag in MAIN_TAGS and not {"comment", "comments", "reply"}.intersection(named)
            outside = outside or tag in OUTSIDE_TAGS and not (tag == "header" and above.main == 2) or not alone and any(_says(name, words) for name in names)
            outside = outside or "hidden" in attributes or bool(_NONE.search(attributes.get("style", "")))
            outside = outside or role in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert")
        path, home, article, level = above.path, above.home, above.article, above.level
        if tag in BLOCK_TAGS:
            self.levels.append(len(self.open))
            if level < LEVELS:
                path, level = f"{path}/{'.'.join([tag, *sorted(named)])[:LABEL]}", level + 1
        if tag in BLOCK_TAGS and tag not in FLOW_TAGS or main == 1 and above.main != 1:
            home = path
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(_Open(tag, path, home, path if here and not article else article, level, outside, main))

    def cut(self, at: int) -> None:
        for o in self.open[at:]:
            self.places[o.tag].pop()
        while self.levels and self.levels[-1] >= at:
            self.levels.pop()
        del self.open[at:]

    def end(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.close_block()
        at = self.places.get(tag)
        if at and (tag in BLOCK_TAGS or not self.levels or at[-1] > self.levels[-1]):  # an inline end tag doesn't reach out of its block
            self.cut(at[-1])


def _decoded(text: str) -> str:
    if "&#" in text:  # numbers beyond any character
        text = _HUGE.sub("\ufffd", _ZEROS.sub(r"&#\1", text))
    return entities.unescape(text)


def _says(name: list[str], words: frozenset[str]) -> bool:
    """Whether a class name is made of words for outside, and words for places, alone."""
    told = [w for w in name if len(w) > 1]
    return any(w in words for w in told) and all(w in OUTSIDE_WORDS or w in PLACE_WORDS for w in told)


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes of a tag and the place behind it; quotes count behind = alone, as browsers read them."""
    found: dict[str, str] = {}
    while at < len(page):
        if page[at] == ">":
            return found, at + 1
        m = _ATTRIBUTE.match(page, at)
        if m.end() == at:
            at += 1
            continue
        if m[1]:
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        at = m.end()
    return found, at


def _behind(page: str, mark: str, at: int) -> int:
    found = page.find(mark, at)
    return len(page) if found < 0 else found + len(mark)


def blocks_of(page: str) -> list[Block]:
    """The page's blocks of text in order; scripts, styles, comments and markup are gone."""
    state, at, end = _Page(), 0, len(page)
    while at < end:
        found = _MARKUP.search(page, at)
        if found is None:
            state.text(page[at:])
            break
        state.text(page[at : found.start()])
        mark, at = found[0], found.end()
        if mark == "<!--":
            at = at + 1 if page.startswith(">", at) else _behind(page, "-->", at)
        elif mark == "<![CDATA[":
            at = _behind(page, "]]>", at)
        elif not mark[-1].isalpha():
            at = _behind(page, ">", at)
        else:
            name = _NAME.match(page, at - 1)
            attributes, at = _attributes(page, name.end())
            tag = name[0].lower()
            if mark.startswith("</"):
                state.end(tag)
            elif tag in RAW_TAGS:
                if page[at - 2 : at] != "/>":
                    closing = re.compile(rf"</{re.escape(tag)}[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                    at = closing.end() if closing else end
                state.parts.append(" " if tag in ("svg", "math", "canvas", "iframe", "object", "audio", "video") else "")
            else:
                state.start(tag, attributes)
    state.close_block()
    return state.blocks


def main_text(page: str | None) -> str:
    """The blocks of the content paths and of what belongs to them, one a line."""
    found = [b for b in blocks_of(page or "") if not b.outside]
    if not found:
        return ""
    best = max(b.main for b in found)
    sums: dict[str, list[float]] = {}
    for b in found:
        own = sums.setdefault(b.path, [0.0, 0.0, 0.0, 0.0])
        for i, x in enumerate((len(b.text), len(_MARKS.findall(b.text)), b.nodes, b.linked)):
            own[i] += x
    length = np.array([sums[b.path][0] / sums[b.path][2] for b in found])
    marks = np.array([(1 + sums[b.path][1]) / sums[b.path][2] for b in found])
    kernel = np.exp(-np.arange(-REACH, REACH + 1) ** 2 / 2.0)
    norm = np.convolve(np.ones(len(found)), kernel, "same") if len(found) > 2 * REACH else None
    smooth = (lambda x: np.convolve(x, kernel, "same") / norm) if norm is not None else (lambda x: np.full(len(x), x.mean()) if len(x) else x)
    fused = np.sqrt(np.maximum(length, smooth(length)) * np.maximum(marks, smooth(marks)))
    fused *= np.array([1.0 if b.main == best else BESIDE for b in found])  # the page says itself where its article is
    floor = SHARE * float(fused.std())
    per_path: dict[str, list[float]] = {}
    for b, x in zip(found, fused.tolist(), strict=True):
        per_path.setdefault(b.path, []).append(x)
    listed = {b.path for b in found if not (b.prose and b.main == best) and sums[b.path][3] >= LINKED * sums[b.path][0]}
    passed = {path for path, x in per_path.items() if sum(x) / len(x) >= floor and path not in listed}
    homes = {b.home for b in found if b.path in passed and b.main == best}
    articles = {b.article for b in found if b.path in passed and b.article}
    kept = (b for b in found if b.path not in listed and (b.path in passed or b.home in homes or b.article in articles))
    return "\n".join(b.text for b in kept)


def extracted(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text (empty if none) and n_chars of the whole html.

    Null or empty html gives an empty text; nothing is dropped or cut; repeated rows keep their number.
    """

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages_ in batches:
            yield pd.Series([main_text(p) for p in pages_], dtype="object")

    out = pages.select("page_id", "url", text(F.col("html").cast("string")).alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
