"""Main text of web pages by two passes of rules over their blocks.

A page is read once, tag by tag, into blocks: runs of text between block-level
tags, each with its words, linked characters and place.  Elements that are no
article text by what they are (scripts, forms, menus, footers, sidebars) or by
how they are named (adverts, notices, comments) give no blocks.

The first pass looks at each block alone: many links make it bad; length and a
high density of stop words make it good, less of either nearly good; a low density
leaves a longer block open, and short blocks are open always.  Nearly good blocks
with nothing bad between them that are long enough together are good.  Where no
block of a page is good, the nearly good ones are, else the open ones by length.

The second pass gives nearly good blocks a good label unless all their nearest
decided neighbours are bad, and open blocks the label of the nearest of theirs.
Where the page marks an article that holds most of the words the first pass finds
good (of nearly good ones where none is, of all but links where none is that),
blocks outside it are bad from the start; inside, the mark is one more vote: nearly
good blocks are good, and an open block is bad only between bad ones; other marks
count for nothing.

Defined results: a null or empty page has an empty text; an element that is
never closed reaches to the end of the one around it; pages of any length are
read whole; repeated rows get equal texts; an empty table gives an empty result;
columns of the input named like result columns give way to them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginspark.llm.batches import slices
from marginspark.llm.columns import boxed, others_of
from marginspark.llm.quality import STOP_WORDS

#: First pass: linked share that makes a block bad; words and stop-word shares.
LINKED = 0.5
FEW_WORDS, MANY_WORDS = 12, 35
LOW_STOP, HIGH_STOP = 0.2, 0.3

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?/][^>]*+>"
    r"|<[a-zA-Z][^>]*+\Z",
    re.S,
)
#: A whole attribute: its name and, past an equals sign, its value.
_ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s>/=]*+)(?:\s*+=\s*+(\"[^\"]*+\"?|'[^']*+'?|[^\s>]++))?")
#: Element kinds of the language.
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
    "menu nav ol optgroup option p pre section select summary table tbody td template textarea "
    "tfoot th thead title tr ul".split()
)
_RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp".split())
#: Elements without article text.
_NEVER = frozenset(
    "head nav footer aside form button select option textarea template menu dialog svg math "
    "object video audio canvas map".split()
)
_BAD_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu "
    "menubar toolbar status".split()
)
_BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo "
    "promotion banner sidebar side cookie cookies consent gdpr notice notices notification alert "
    "popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs masthead header footer "
    "foot widget widgets share sharing social related recommended newsletter subscribe "
    "subscription signup login search pagination pager toolbar copyright legal disclaimer".split()
)
_COMMENT_NAMES = frozenset(
    "comment comments commentlist commentary reply replies respond disqus discussion".split()
)
_TEXT_NAMES = frozenset("article content main body post entry story text".split())
#: These hide an element also where its name has a word of the text names.
_MENU_NAMES = frozenset("nav navbar navigation menu sidebar widget widgets breadcrumb breadcrumbs".split())
#: A name with one of these tells what an element is laid out with.
_BESIDE = frozenset("has with without no".split())
_STOP = frozenset(STOP_WORDS)
_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”’…"


@dataclass
class Block:
    text: str
    linked: int
    #: 2 inside an article element, 1 inside one named like an article, else 0.
    inside: int

    @property
    def n_words(self) -> int:
        return self.text.count(" ") + 1

    def label(self) -> str:
        """First pass: what the block is by itself."""
        if self.linked > LINKED * len(self.text):
            return "bad"
        words = self.text.split(" ")
        if len(words) < FEW_WORDS:
            return "short"
        stop = sum(w.lower().strip(_EDGES) in _STOP for w in words) / len(words)
        if stop >= HIGH_STOP and len(words) >= MANY_WORDS:
            return "good"
        return "near" if stop >= LOW_STOP else "low"


def _names(value: str) -> list[list[str]]:
    """The words of each name of a class or an id."""
    split = [re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name).lower() for name in value.split()]
    return [words for name in split if (words := re.findall(r"[a-z0-9]+", name))]


def _text_name(words: list[str]) -> bool:
    """Whether a whole name says article text, as post-content or post-17 do."""
    plain = [w for w in words if not w.isdigit()]
    return bool(plain) and _TEXT_NAMES.issuperset(plain)


def _menu_name(words: list[str]) -> bool:
    return not _MENU_NAMES.isdisjoint((words[0], words[-1])) and _BESIDE.isdisjoint(words)


def _attributes(raw: str) -> list[tuple[str, str]]:
    """Names, lowered, and values of an element's attributes."""
    return [(name.lower(), value.strip("\"'")) for name, value in _ATTRIBUTE.findall(raw)]


def _hidden(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element gives no article text."""
    if tag in _NEVER:
        return True
    if tag == "header":
        return not inside
    if not attributes or tag in ("html", "body"):
        return False
    for name, value in _attributes(attributes):
        if name == "role":
            if value.lower() in _BAD_ROLES:
                return True
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        elif name in ("class", "id"):
            names = _names(value)
            own = set().union(*names)
            if own & _COMMENT_NAMES:
                return True
            if own & _BAD_NAMES and tag not in ("article", "main"):
                if not own & _TEXT_NAMES:
                    return True
                if any(map(_menu_name, names)) and not any(map(_text_name, names)):
                    return True
    return False


def _marks(tag: str, attributes: str) -> int:
    """How surely an element holds the article: see :class:`Block`."""
    if tag in ("article", "main"):
        return 2
    if tag in ("div", "section", "td") and attributes:
        for name, value in _attributes(attributes):
            if name == "role" and value.lower() in ("main", "article"):
                return 2
            if name in ("class", "id") and any(map(_text_name, _names(value))):
                return 1
    return 0


class _Page:
    """The elements that are open, and the block that is being read."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.open: list[tuple[str, bool, int]] = []
        self.count: Counter[str] = Counter()
        self.hidden = self.links = self.breaks = 0
        self.inside = [0, 0, 0]
        self.parts: list[str] = []
        self.linked: list[str] = []

    def text(self, raw: str) -> None:
        if self.hidden or not raw:
            return
        plain = unescape(raw) if "&" in raw else raw
        self.parts.append(plain)
        if self.links:
            self.linked.append(plain)
        if self.breaks and not plain.isspace():
            self.breaks = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                linked = len(" ".join("".join(self.linked).split()))
                level = 2 if self.inside[2] else min(self.inside[1], 1)
                self.blocks.append(Block(text, linked, level))
            self.parts, self.linked = [], []
        self.breaks = 0

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.breaks += 1
            self.flush() if self.breaks > 1 else self.parts.append(" ")
            return
        if tag in _BLOCK:
            self.flush()
            if self.count["p"]:
                self.end("p")
            if tag in ("li", "option", "td", "th", "tr", "dt", "dd") and self.open and self.open[-1][0] == tag:
                self.end(tag)
        if tag in _VOID or attributes.endswith("/") and tag in ("svg", "path", "use"):
            return
        hides = bool(self.hidden) or _hidden(tag, attributes, self.inside[2] > 0)
        marks = 0 if hides else _marks(tag, attributes)
        self.open.append((tag, hides, marks))
        self.count[tag] += 1
        self.hidden += hides
        self.inside[marks] += 1
        self.links += tag == "a"

    def end(self, tag: str) -> None:
        if tag in _BLOCK:
            self.flush()
        if not self.count[tag]:
            return
        while self.open:
            name, hides, marks = self.open.pop()
            self.count[name] -= 1
            self.hidden -= hides
            self.inside[marks] -= 1
            self.links -= name == "a"
            if name == tag:
                break


def read_blocks(html: str) -> list[Block]:
    """The blocks of a page in order."""
    page, at = _Page(), 0
    while (tag := _TAG.search(html, at)) is not None:
        page.text(html[at : tag.start()])
        at = tag.end()
        name = tag[2] or tag[5]
        if not name:
            continue
        name = name.lower()
        if tag[1] or tag[4]:
            page.end(name)
            continue
        if name in _RAW:
            # Their content is no markup; none of it is article text.
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
            at = close.end() if close else len(html)
            page.flush() if name in _BLOCK else None
            continue
        page.start(name, (tag[3] or tag[6] or "").strip())
    page.text(html[at:])
    page.flush()
    return page.blocks


def _neighbours(labels: list[str]) -> list[list[int]]:
    """Of each block, the nearest decided blocks before and after it."""
    found: list[list[int]] = [[] for _ in labels]
    for order in (range(len(labels)), range(len(labels) - 1, -1, -1)):
        last = None
        for i in order:
            if last is not None:
                found[i].append(last)
            if labels[i] in ("good", "bad"):
                last = i
    return found


def _deciding(blocks: list[Block], labels: list[str]) -> int:
    """The level of the marks that decide, 0 for none: see the module's text."""
    for level in sorted({b.inside for b in blocks} - {0}, reverse=True):
        for kinds in (("good",), ("near",), ("low", "short")):
            words = [0, 0]
            for b, label in zip(blocks, labels):
                if label in kinds:
                    words[b.inside >= level] += b.n_words
            if any(words):
                if words[1] > words[0]:
                    return level
                break
    return 0


def _together(blocks: list[Block], labels: list[str]) -> list[str]:
    """Nearly good blocks that make a long text with those beside them are good;
    a page without a good block has its best ones as good."""
    labels, run = list(labels), []
    for i, label in enumerate([*labels, "bad"]):
        if label == "near":
            run.append(i)
        elif label == "bad":
            if sum(blocks[k].n_words for k in run) >= MANY_WORDS:
                for k in run:
                    labels[k] = "good"
            run = []
    if "good" not in labels:
        best = next((kind for kind in ("near", "low", "short") if kind in labels), None)
        labels = ["good" if label == best else label for label in labels]
    return labels


def main_blocks(blocks: list[Block]) -> list[Block]:
    """The good blocks after both passes."""
    alone = [b.label() for b in blocks]
    best = _deciding(blocks, alone)
    alone = ["bad" if b.inside < best else label for b, label in zip(blocks, alone)]
    labels = _together(blocks, alone)
    if best:
        labels = ["good" if label == "near" else label for label in labels]
    settled = list(labels)
    for i, near in enumerate(_neighbours(labels)):
        if labels[i] == "near":
            settled[i] = "good" if any(labels[k] == "good" for k in near) else "bad"
        elif best and labels[i] in ("low", "short"):
            # The border of the article is no neighbour.
            own = [labels[k] for k in near if blocks[k].inside >= best]
            settled[i] = "bad" if own == ["bad", "bad"] else "good"
    labels = settled
    settled = list(labels)
    for i, near in enumerate(_neighbours(labels)):
        if labels[i] in ("low", "short"):
            gap = min((abs(k - i) for k in near), default=0)
            settled[i] = "good" if any(labels[k] == "good" for k in near if abs(k - i) == gap) else "bad"
    return [b for b, label in zip(blocks, settled) if label == "good"]


def main_text(html: str) -> str:
    return "\n\n".join(b.text for b in main_blocks(read_blocks(html)))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """The columns of ``pages`` but for the html, with ``text`` and ``n_chars``."""
    boxes = pages.select(
        boxed(pages, html, "text", "n_chars").alias("page"),
        pages[f"`{html}`"].cast("string").alias("html"),
    )
    schema = T.StructType(
        [
            boxes.schema["page"],
            T.StructField("text", T.StringType()),
            T.StructField("n_chars", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sources in slices(batches, "html"):
            texts = [main_text(source) for source in sources]
            arrays = [part.column(0), pa.array(texts, pa.string()), pa.array(list(map(len, texts)))]
            yield pa.RecordBatch.from_arrays(arrays, ["page", "text", "n_chars"])

    made = boxes.mapInArrow(run, schema)
    names = [f.name for f in schema["page"].dataType.fields if f.name != "_none"]
    keep = others_of(names, ("text", "n_chars"))
    return made.select(*[F.col("page")[n].alias(n) for n in keep], "text", "n_chars")
