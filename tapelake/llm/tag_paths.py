"""Main text of web pages by tag-path ratios.

A page is cut into blocks (texts between block-level tags), each with its path of block-level elements from the root. Per
path the characters and the punctuation of its blocks are summed; both averages are fused into one value, weighted by what
the path says about its role and by the share of the path's text that is not links. Along the page the values are smoothed,
and blocks whose path and smoothed value reach a share of the page's average are content. Averaging by path keeps a short
paragraph beside long ones, and drops a long notice on a path of its own kind.

Null pages and pages without text give an empty text; unclosed, misnested and cut-off markup is read as browsers do in
spirit (paragraphs and items close implicitly, a stray end tag is ignored); long and deep pages are read whole: paths and flags
are numbered nodes that know their parent, and the places of open elements are kept by name, so that neither depth nor stray end
tags cost more than they are long;
repeated rows give the same text; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML, by their role here.
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody "
                    "td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg annotation annotation-xml canvas audio video select".split())
_NEVER = frozenset("head nav footer aside form fieldset button label dialog menu select option datalist output".split())
_MAIN = frozenset("article main".split())
# Words of class, id and role names that tell what a container holds.
_OUTSIDE = frozenset("ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments commentlist consent "
                     "contentinfo cookie cookies copyright dialog disqus disclaimer footer gdpr header login masthead menu menubar modal nav navbar navigation "
                     "newsletter notice notices notification pager pagination paywall popup promo promoted promotion recommended related replies reply respond search "
                     "share sharing sidebar signup social sponsor sponsored subscribe subscription tags toc toolbar topbar widget widgets alert complementary".split())
_INSIDE = frozenset("article articlebody body content entry main post story text".split())
_PUNCTUATION = frozenset(".,;:!?…。，、；：！？\"'“”«»()")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Weight of a path by its role, the share of the page's average from which a block is content, and the share of the text
#: that marked main content must hold for the rest to be left out.
_ROLE_MAIN, _ROLE_PLAIN, _THRESHOLD, _MAIN_SHARE = 8.0, 1.0, 0.35, 0.3
_KERNEL = (0.25, 0.5, 0.25)


#: No flag, no element: the parent of outermost ones.
_NONE = -1


@dataclass(slots=True)
class _Open:
    tag: str
    path: int
    role: float
    block: bool
    flag: int = _NONE
    outer: tuple[int, int] | None = None


@dataclass
class _Path:
    chars: int = 0
    marks: int = 0
    linked: int = 0
    blocks: int = 0


@dataclass
class _Page:
    """Blocks of a page as they are read: path, role, text, innermost flag, and (flag around it, number) of the main element."""

    stack: list[_Open] = field(default_factory=lambda: [_Open("", 0, _ROLE_PLAIN, True)])
    #: Where open elements stand in the stack: by name, those that make blocks, and those of block names.
    places: dict[str, list[int]] = field(default_factory=dict)
    blocked: list[int] = field(default_factory=lambda: [0])
    named: list[int] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    blocks: list[tuple[int, float, str, int, tuple[int, int] | None]] = field(default_factory=list)
    #: The flag around each flag, and the number of each (parent path, label).
    flags: list[int] = field(default_factory=list)
    labels: dict[tuple[int, str], int] = field(default_factory=dict)
    mains: int = 0
    paths: dict[int, _Path] = field(default_factory=dict)

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split()) if self.pieces else ""
        if text:
            top = self.stack[-1]
            stats = self.paths.setdefault(top.path, _Path())
            stats.chars += len(text)
            stats.marks += sum(c in _PUNCTUATION for c in text)
            stats.linked += min(self.linked, len(text))
            stats.blocks += 1
            self.blocks.append((top.path, top.role, text, top.flag, top.outer))
        self.pieces.clear()
        self.linked = 0

    def last(self, tags: tuple[str, ...]) -> int:
        """Where the innermost open element of these names stands."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=_NONE)

    def push(self, element: _Open) -> None:
        at = len(self.stack)
        self.stack.append(element)
        self.places.setdefault(element.tag, []).append(at)
        if element.block:
            self.blocked.append(at)
            if element.tag in _BLOCKS:
                self.named.append(at)

    def text(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self.pieces.append(text)
        if self.places.get("a"):
            self.linked += len(" ".join(text.split()))

    def close(self, place: int) -> None:
        """Close elements up to and with the one at this place."""
        while len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()
        for places in (self.blocked, self.named):
            while places and places[-1] >= place:
                places.pop()

    def close_in(self, tags: tuple[str, ...], limits: tuple[str, ...]) -> None:
        """Close the nearest of ``tags`` unless one of ``limits`` stands between."""
        place = self.last(tags)
        if place > self.last(limits):
            self.close(place)

    def open(self, tag: str, attributes: str) -> None:
        block = tag in _BLOCKS
        if block:
            self.flush()
            self.close_in(("p",), ("table", "td", "th", "button", "object"))
            if tag == "li":
                self.close_in(("li",), ("ul", "ol", "menu"))
            elif tag in ("dt", "dd"):
                self.close_in(("dt", "dd"), ("dl",))
            elif tag in ("td", "th"):
                self.close_in(("td", "th"), ("tr", "table"))
            elif tag == "tr":
                self.close_in(("tr",), ("table",))
            elif tag == "option":
                self.close_in(("option",), ("select",))
        top = self.stack[-1]
        role, label = top.role, tag
        names: set[str] = set()
        if attributes and (block or tag == "span"):
            names = {p for m in _NAMES.finditer(attributes) for p in _PART.findall(_CAMEL.sub(" ", m[1] or m[2] or m[3] or "").lower())}
            label = ".".join([tag, *sorted(names)])
        flag, outer = top.flag, top.outer
        if role and tag in _NEVER or tag == "header" and role != _ROLE_MAIN or attributes and _HIDDEN.search(attributes):
            role = 0.0
        elif role and names & _OUTSIDE and tag not in ("html", "body", *_MAIN):
            # Whether the name speaks of all it holds shows when the page is read.
            self.flags.append(flag)
            flag = len(self.flags) - 1
        elif role and (tag in _MAIN or names & _INSIDE and tag != "body"):
            role = _ROLE_MAIN
        if role and tag in _MAIN and outer is None and not names & _OUTSIDE:
            outer, self.mains = (flag, self.mains), self.mains + 1
        if not block and (role != top.role or flag != top.flag):
            self.flush()
            block = True
        path = self.labels.setdefault((top.path, label), len(self.labels) + 1) if block else top.path
        self.push(_Open(tag, path, role, block, flag, outer))

    def end(self, tag: str) -> None:
        place = self.last((tag,))
        if place == _NONE:
            return
        # An inline end tag does not close the blocks around it.
        if tag not in _BLOCKS and self.named and self.named[-1] > place:
            return
        if self.blocked[-1] >= place:
            self.flush()
        self.close(place)


def _read(source: str) -> _Page:
    page, at = _Page(), 0
    lowered = None
    while at < len(source):
        m = _TOKEN.search(source, at)
        if not m:
            page.text(source[at:])
            break
        if m.start() > at:
            page.text(source[at:m.start()])
        at = m.end()
        slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            page.end(tag)
        elif tag in _RAW and not attributes.endswith("/"):
            if lowered is None:
                lowered = source.lower()
                if len(lowered) != len(source):
                    lowered = "".join(c.lower() if c.isascii() else c for c in source)
            at = lowered.find(f"</{tag}", at)
            at = len(source) if at < 0 else (source.find(">", at) + 1 or len(source))
        elif tag == "br":
            page.pieces.append(" ")
        elif tag in _VOID:
            if tag == "hr":
                page.flush()
        else:
            page.open(tag, attributes)
            if attributes.endswith("/") and tag not in _BLOCKS:
                page.end(tag)
    page.flush()
    return page


def _standing(page: _Page) -> list[tuple[int, float, str]]:
    """The blocks outside containers whose names flag them, with the flags lifted that cannot be meant for all they hold.

    Without marked content outside flags, the outermost flags around most of the text are lifted, one layer at a time, then
    those around a single article or main element. If nothing is left, no name counts.
    """
    blocks = [x for x in page.blocks if x[1]]
    total = sum(len(x[2]) for x in blocks)
    held, inner = [0] * len(page.flags), {}
    for _, _, text, flag, _ in blocks:
        if flag != _NONE:
            held[flag] += len(text)
    for flag in range(len(page.flags) - 1, -1, -1):      # a flag's number is above that of the flag around it
        around = page.flags[flag]
        inner.setdefault(around, []).append(flag)
        if around != _NONE:
            held[around] += held[flag]
    # Only one flag of a layer can hold most of the text, so the lifted ones are nested in each other.
    marked, lifted, last = {x[3] for x in blocks if x[1] == _ROLE_MAIN}, {_NONE}, _NONE
    while last not in marked:
        bulk = [f for f in inner.get(last, ()) if 2 * held[f] > total]
        if not bulk:
            break
        last = bulk[0]
        lifted.add(last)
    if last in marked:
        return [x[:3] for x in blocks if x[3] in lifted]
    # Several articles in a flagged container are its items, such as comments.
    top = {f: _NONE for f in lifted}
    for flag, around in enumerate(page.flags):
        if flag not in top:
            top[flag] = flag if top[around] == _NONE else top[around]
    mains: dict[int, set[int]] = {}
    for _, _, _, flag, outer in blocks:
        if top[flag] != _NONE and outer:
            mains.setdefault(top[flag], set()).add(outer[1])
    inside = [x[:3] for x in blocks
              if top[x[3]] == _NONE or x[4] and len(mains[top[x[3]]]) == 1 and x[3] == x[4][0]]
    return inside or [x[:3] for x in blocks] or [(path, _ROLE_PLAIN, text) for path, _, text, _, _ in page.blocks]


def main_text(source: str | None) -> str:
    """The content blocks of one page, one a line."""
    page = _read(source or "")

    def fused(p: _Path) -> float:
        length, marks = p.chars / p.blocks, p.marks / p.blocks
        return math.log2(1 + length) * (1 + math.log2(1 + marks)) * (1 - p.linked / p.chars)

    by_path = {name: fused(p) for name, p in page.paths.items()}
    standing = _standing(page)
    # Linked items of marked content count as text; elsewhere a path of nothing but links is none.
    for path in {path for path, role, _ in standing if role == _ROLE_MAIN}:
        by_path[path] = fused(replace(page.paths[path], linked=0))
    kept = [x for x in standing if by_path[x[0]] > 0]
    if not kept:
        return ""
    chars = sum(len(text) for _, _, text in kept)
    if sum(len(text) for _, role, text in kept if role == _ROLE_MAIN) >= _MAIN_SHARE * chars:
        kept = [x for x in kept if x[1] == _ROLE_MAIN]
        chars = sum(len(text) for _, _, text in kept)
    values = [by_path[path] * role for path, role, _ in kept]
    padded = [values[0], *values, values[-1]]
    smooth = [sum(w * v for w, v in zip(_KERNEL, padded[i:i + 3])) for i in range(len(values))]
    # The average is taken over characters, so that many short blocks do not outvote the text.
    level = _THRESHOLD * sum(by_path[path] * len(text) for path, _, text in kept) / chars
    return "\n".join(text for (_, _, text), v, s in zip(kept, values, smooth) if max(v, s) >= level)


def extracted(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), source: str = "html") -> DataFrame:
    """The columns ``keep`` with the page's main text."""
    rows = pages.select(*keep, F.col(source).alias("_html"))
    schema = pages.select(*keep).schema.add("text", "string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])

    return rows.mapInArrow(read, schema)
