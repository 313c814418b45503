"""Main text of a web page by tag-path ratios.

Every block of text has a path of tags from the root. Per path, text length and punctuation are added up and divided by the number of its blocks; these
ratios are smoothed along the page and fused with the raw ones, and the blocks of paths above a threshold are content nodes. The element that holds
most of what they weigh is the article, and an element around it if it holds much more; headings and short lines inside come along. That an element calls itself
article or main only adds to its weight. Elements that say what they are not (menus, adverts, forms, comments) count as zero.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch

#: Half-width of the smoothing kernel in blocks, and the share of the standard deviation that a path must exceed.
RADIUS, SHARE = 2, 0.8
#: How much more the text of an article or main element weighs; what an outer element must add, as a share, to be the article instead of an inner one.
PRIOR, GROWTH = 3.0, 0.3
#: A block with this share of its characters in links, and no heading, is a list of links.
LINKED = 0.9

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*(?:>|\Z)", re.S,
)
ATTR = re.compile(r"([^\s=\"'<>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'<>/]+)", re.S)
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
WORD = re.compile(r"[a-z]+|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag closes an open element of these names, up to the nearest of the bounds.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
SECTION = frozenset("article main".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
HOLDER = frozenset("article main section div body td blockquote".split())
#: Elements, roles, and words in classes and ids, that mark what is not the article.
NOT_TEXT = frozenset("nav footer aside form button select textarea iframe object dialog menu script style noscript template svg canvas head title input".split())
NOT_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
NOT_CLASS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay sidebar "
    "menu nav navbar navigation breadcrumb breadcrumbs toolbar footer masthead comment comments reply replies respond disqus share sharing social related "
    "recommended recommendations newsletter subscribe subscription signup login widget widgets pagination pager copyright skip hidden".split()
)


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower() if m[1] else m[5].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(source)}


def _is_not_text(name: str, attrs: dict[str, str], in_section: bool) -> bool:
    if name in NOT_TEXT or (name == "header" and not in_section):
        return True
    if not attrs or name in ("html", "body"):
        return False
    if attrs.get("role", "").lower() in NOT_ROLE or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", ""):
        return True
    words = set(WORD.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()))
    return not NOT_CLASS.isdisjoint(words) or ("header" in words and not in_section)


class _Element(NamedTuple):
    name: str
    path: int  # number of the path of block tags to here
    holder: int  # innermost holder, itself included; -1 for none
    bad: bool
    in_section: bool


class _Block(NamedTuple):
    path: int
    holder: int
    parts: list[str]
    links: list[int]  # characters in links
    bad: bool
    heading: bool


class _Page:
    """Blocks of a page in order, and its holders: parent, first block, block after the last, is it an article or main element, is it the body."""

    def __init__(self, source: str):
        self.stack: list[_Element] = []
        self.names: Counter[str] = Counter()  # of the open elements
        self.blocks: list[_Block] = []
        self.holders: list[list] = []
        self.paths: dict[tuple[int, str], int] = {}
        self.open = False
        at, n = 0, len(source)
        while at < n:
            m = TAG.search(source, at)
            if m is None:
                self.text(source[at:])
                break
            if m.start() > at:
                self.text(source[at : m.start()])
            at = m.end()
            if m["name"] is None:
                if m[0].startswith("<![CDATA["):
                    self.text(m[0][9:].removesuffix("]]>"))
                continue
            name = m["name"].lower()
            if m["end"]:
                self.end(name)
                continue
            self.start(name, m["attrs"])
            if name in RAW:  # no markup inside
                close = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(source, at)
                end = close.start() if close else n
                self.text(source[at:end])
                at = end
        self.cut(0)

    def start(self, name: str, source: str) -> None:
        if name == "br":
            self.text(" ")
            return
        if name in BLOCK:
            self.open = False
            if self.names["p"]:
                self.pop({"p"}, {"td", "th", "table", "li", "div", "article", "section", "blockquote", "button"})
        if name in CLOSES:
            self.pop(*CLOSES[name])
        if name in VOID:
            return
        above = self.stack[-1] if self.stack else _Element("", 0, -1, False, False)
        attrs = _attributes(source) if source.strip(" /\n\t") else {}
        path, holder = above.path, above.holder
        section = above.in_section or name in SECTION
        if name in BLOCK:
            label = ".".join([name, *WORD.findall(attrs.get("class", "").lower())]) + (f"#{attrs['id']}" if attrs.get("id") else "")
            path = self.paths.setdefault((path, label), len(self.paths) + 1)
        if name in HOLDER:
            self.holders.append([holder, len(self.blocks), None, name in SECTION, name == "body"])
            holder = len(self.holders) - 1
        self.names[name] += 1
        self.stack.append(_Element(name, path, holder, above.bad or _is_not_text(name, attrs, above.in_section), section))

    def cut(self, size: int) -> None:
        """Close open elements until ``size`` are left."""
        while len(self.stack) > size:
            e = self.stack.pop()
            self.names[e.name] -= 1
            if e.name in HOLDER:
                self.holders[e.holder][2] = len(self.blocks)

    def end(self, name: str) -> None:
        if name in BLOCK:
            self.open = False
        if self.names[name]:
            self.cut(next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i].name == name))

    def pop(self, names: set[str], bounds: set[str]) -> None:
        if not any(self.names[n] for n in names):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].name in names:
                self.cut(i)
                return
            if self.stack[i].name in bounds:
                return

    def text(self, source: str) -> None:
        now = self.stack[-1] if self.stack else _Element("", 0, -1, False, False)
        if now.bad and self.open and not self.blocks[-1].bad and now.name not in BLOCK:
            return  # an inline advert inside a block
        if not self.open:
            if not source.strip():
                return
            heading = any(self.names[h] for h in HEADINGS)
            self.blocks.append(_Block(now.path, now.holder, [], [0], now.bad, heading))
            self.open = True
        self.blocks[-1].parts.append(html.unescape(source) if "&" in source else source)
        if self.names["a"]:
            self.blocks[-1].links[0] += len(source)


def _fused(blocks: list[_Block], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per block: the fused ratio of its path and whether that is above the threshold; both 0 for blocks that say they are not text."""
    # per path: blocks, text, punctuation and links
    sums: dict[int, list[float]] = {}
    for b, text in zip(blocks, texts, strict=True):
        s = sums.setdefault(b.path, [0, 0, 0, 0])
        if not b.bad and text:
            s[0] += 1
            s[1] += len(text)
            s[2] += len(PUNCTUATION.findall(text))
            s[3] += min(b.links[0], len(text))
    ratio = {p: (c / n) * (1 + d / n) * (1 - linked / c) if n else 0.0 for p, (n, c, d, linked) in sums.items()}
    raw = np.array([ratio[b.path] if text and not b.bad else 0.0 for b, text in zip(blocks, texts, strict=True)])
    kernel = np.exp(-(np.arange(-RADIUS, RADIUS + 1) ** 2) / (2 * (RADIUS / 2) ** 2))
    smooth = np.convolve(raw, kernel / kernel.sum(), mode="full")[RADIUS:-RADIUS]
    fused = np.sqrt(raw * smooth)
    score: dict[int, float] = {}
    for b, f in zip(blocks, fused, strict=True):
        if not b.bad:
            score[b.path] = max(score.get(b.path, 0.0), float(f))
    of = np.array([0.0 if b.bad else score[b.path] for b in blocks])
    return of, (of > 0) & (of >= SHARE * float(fused.std()))


def main_text(source: str) -> str:
    """The article's blocks, one per line; an empty text if there are none."""
    page = _Page(source)
    blocks, holders = page.blocks, page.holders
    texts = [" ".join("".join(b.parts).split()) for b in blocks]
    if not any(t and not b.bad for b, t in zip(blocks, texts, strict=True)):
        return ""
    score, content = _fused(blocks, texts)
    size = np.array([len(t) for t in texts])
    if not content.any():  # links only: nothing has a ratio
        content = np.array([bool(t) and not b.bad for b, t in zip(blocks, texts, strict=True)])
        score = np.ones(len(blocks))
    weight = np.where(content, score * size, 0.0)
    held = np.concatenate([[0.0], np.cumsum(weight)])
    of = lambda h: held[holders[h][2]] - held[holders[h][1]]  # noqa: E731 - what a holder's blocks weigh; they are next to each other

    # what each holder has of its own, an article or main element around it adding to that
    own: dict[int, float] = {}
    for b, w in zip(blocks, weight, strict=True):
        if w:
            own[b.holder] = own.get(b.holder, 0.0) + float(w)

    def section(h: int) -> int:
        while h >= 0 and not holders[h][3]:
            h = holders[h][0]
        return h

    best = max(own, key=lambda h: own[h] * (PRIOR if section(h) >= 0 else 1.0))
    now = section(best) if section(best) >= 0 else best
    outer = holders[now][0] if now >= 0 else -1
    while outer >= 0:
        if of(outer) - of(now) >= GROWTH * of(now) and (holders[outer][3] or section(now) < 0):
            now = outer
        outer = holders[outer][0]
    whole = now < 0 or holders[now][4]  # the body itself: then only what the ratios chose
    begin, end = (0, len(blocks)) if now < 0 else (holders[now][1], holders[now][2])
    if whole and begin == 0 and end == len(blocks) and len(own) == 1 and not any(b.bad for b in blocks):
        whole = False  # a page that is nothing but its text
    chosen = []
    for i in range(begin, end):
        b, text = blocks[i], texts[i]
        links = b.links[0] >= LINKED * len(text) and not b.heading
        if text and not b.bad and (content[i] if whole else not links):
            chosen.append(text)
    return "\n".join(chosen)


def extract(df: DataFrame, source: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns, ``text`` and ``n_chars`` (code points), one row per row, in time and space linear in the page.

    A null or empty page, and one without text of its own, gives an empty text; repeated pages are read alike; columns not named in ``keep`` play no part, whatever their names.
    """
    types = dict(df.dtypes)

    def run(data: dict) -> dict:
        texts = [main_text(x) for x in data["_html"]]
        return {c: data[c] for c in keep} | {"text": texts, "n_chars": [len(t) for t in texts]}

    schema = ", ".join([*[f"`{c}` {types[c]}" for c in keep], "text string, n_chars bigint"])
    return per_batch(df.select(*keep, F.coalesce(F.col(source), F.lit("")).alias("_html")), schema, run)
