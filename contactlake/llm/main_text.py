"""Main text of web pages by maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive, tags negative; the stretch with
the largest total, found in one scan, is the content. How much a tag costs, and in which
elements words count against the content instead, is learned from labelled pages: pages
with exactly one article (or main) element, of which the inside is the label. A tag gets the log
of how often it stands inside against outside, but links, lists and tables without a class take
after what they stand in: they cost next to nothing, unless they stand in the bare frame of the
page and labelled pages show them there outside; an element whose words are outside on
labelled pages makes the words in it part of the markup. Names and classes that labelled
pages do not show fall back to a short list of what such elements usually are. Within an article a
class only counts if its words say nothing else ("share" does, "share-price" does not) or labelled
pages show it outside, and the article's own header is content. A sidebar or advert within the
article neither adds to the stretch nor ends it; its words are left out.

An element knows the one around it, and what all elements around it say is kept with it, so that
a page takes linear time however deep its elements stand in each other. List items, table cells and the like end
where the next one starts.

Fitting takes a bounded number of pages to the driver; each page is then read where it lies.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PAGES = 400
#: Bytes of the pages that are learned from, and how deep their elements may be.
MAX_BYTES, MAX_DEPTH = 16_000_000, 64
WORD_SCORE = 1.0
#: Elements and class words that hold no content where labelled pages say nothing about them.
ASIDE_TAGS = frozenset("head nav footer aside form button select textarea iframe noscript template svg object dialog menu header".split())
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement banner sponsor promo menu navbar navigation sidebar footer header comment comments reply replies "
    "notice cookie consent popup share social related breadcrumb breadcrumbs login newsletter subscribe".split()
)
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg")
#: Elements within a line or list: they take after what they stand in.
PLAIN = frozenset("a abbr b bdi bdo big br caption cite code col colgroup dd del dfn dl dt em font i img ins kbd li mark ol p q s samp small span strong sub sup td th tr tbody table tfoot thead time tt u ul var wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i img ins kbd mark q s samp small span strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr !doctype".split())
CONTENT = ("article", "main")
#: Words that say nothing on their own next to those above.
NEUTRAL_WORDS = frozenset("area bar block bottom box button buttons container content footer form inner item items left link links list main outer right section site top widget wrap wrapper".split())
#: Elements that end where another one starts: which ones, and within what.
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select", "optgroup"}),
}
#: Longer pages are read twice instead of keeping their pieces.
HELD_CHARS = 1 << 20
#: Elements that end so are looked for among so many of the innermost elements.
NEAR = 64
#: What a plain tag without a class costs within content: many of them weigh less than a word.
PLAIN_COST = -0.05
#: Elements that say nothing about their content ("" is none at all).
FRAME = frozenset(("", "html", "body", "div", "section"))

# The inside of a tag; quotes count where a value begins. A tag without its ">" is one token to the end.
_INSIDE = r"""(?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    + "".join(rf"|<{t}\b{_INSIDE}>.*?(?:</{t}\s*>|\Z)" for t in RAW)
    + rf"|<(?P<name>/?[a-zA-Z!?][^\s/>]*+)(?P<rest>{_INSIDE})(?:>|\Z)",
    re.S | re.I,
)
_HINT = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


class Model(NamedTuple):
    tags: dict[str, float]  # cost of a tag, by key
    words: dict[str, float]  # score of words in an element, by key


class Element:
    """An open element; ``worth`` is the least score of a word that it and those around it give."""

    __slots__ = ("key", "name", "up", "depth", "in_content", "block", "worth")

    def __init__(self, key: str, up: Element | None):
        self.key, self.up, self.worth = key, up, None
        self.name = key.split(".", 1)[0]
        self.depth = up.depth + 1 if up else 1
        self.in_content = bool(up) and (up.in_content or up.name in CONTENT)
        # the innermost element that is not plain, this one included
        self.block = key if key not in PLAIN else up.block if up else ""

    def chain(self) -> list[Element]:
        out, at = [], self
        while at:
            out.append(at)
            at = at.up
        return out[::-1]


class Piece(NamedTuple):
    kind: str  # "text", "open", "close" or "skip"
    element: Element | None  # around a text; the one that a tag opens or closes
    start: int
    end: int


def _key(name: str, rest: str) -> str:
    hints = " ".join(next(filter(None, m.groups()), "") for m in _HINT.finditer(rest)) if "=" in rest else ""
    return f"{name}.{' '.join(sorted(set(hints.lower().split())))}" if hints else name


def pieces(page: str) -> Iterator[Piece]:
    """Texts and tags in order."""
    stack, n_open, at = [], Counter(), 0

    def close_to(i: int) -> None:
        for element in stack[i:]:
            n_open[element.name] -= 1
        del stack[i:]

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield Piece("text", stack[-1] if stack else None, at, m.start())
        at = m.end()
        name = m.group("name")
        if name is None:
            yield Piece("skip", None, at, at)
        elif name[0] == "/":
            name = name[1:].lower()
            if n_open[name]:
                i = len(stack) - 1
                while stack[i].name != name:
                    i -= 1
                closed = stack[i]
                close_to(i)
            else:
                closed = Element(name, stack[-1] if stack else None)
            yield Piece("close", closed, at, at)
        else:
            name = name.lower()
            if name == "p" and stack and stack[-1].name == "p":
                close_to(len(stack) - 1)
            elif name in ENDED_BY:
                ended, within = ENDED_BY[name]
                cut = None
                for i in range(len(stack) - 1, max(-1, len(stack) - 1 - NEAR), -1):
                    if stack[i].name in within:
                        break
                    cut = i if stack[i].name in ended else cut
                if cut is not None:
                    close_to(cut)
            element = Element(_key(name, m.group("rest")), stack[-1] if stack else None)
            yield Piece("open", element, at, at)
            if name not in VOID and not m.group("rest").endswith("/"):
                stack.append(element)
                n_open[name] += 1
    if at < len(page):
        yield Piece("text", stack[-1] if stack else None, at, len(page))


def guess(key: str) -> bool:
    """Whether an element that labelled pages do not show holds no content."""
    name, _, hints = key.partition(".")
    return name in ASIDE_TAGS or not ASIDE_WORDS.isdisjoint(_WORD.findall(hints))


def guess_within(key: str) -> bool:
    """The same for an element of an article: its name or a class that says nothing else."""
    name, _, hints = key.partition(".")
    if name in ASIDE_TAGS and name != "header":
        return True
    for hint in hints.split():
        words = set(_WORD.findall(hint))
        if words & ASIDE_WORDS and words <= ASIDE_WORDS | NEUTRAL_WORDS:
            return True
    return False


def _place(piece: Piece) -> str:
    """The name under which the cost of a tag is learned; empty for plain tags that cost next to nothing."""
    element = piece.element
    if element.key not in PLAIN:
        return piece.kind + element.key
    if element.in_content:
        return ""
    around = element.up.block if element.up else ""
    return f"{piece.kind}{element.key}@page" if around in FRAME else ""


def fit_pages(pages: list[str]) -> Model:
    """Learn from pages with one content element; other pages, and very deep ones, are not looked at."""
    tags, words = Counter(), Counter()
    for page in pages:
        parts = list(pieces(page or ""))
        if any(p.kind == "open" and p.element.depth > MAX_DEPTH for p in parts):
            continue
        for content in CONTENT:
            marks = [p.element for p in parts if p.kind == "open" and p.element.name == content]
            if len(marks) == 1:
                break
        else:
            continue
        mark = marks[0]
        around = {e.key for e in mark.chain()}
        for p in parts:
            if p.kind == "skip" or p.element is mark or not p.element:
                continue
            own = p.element.chain()
            inside = mark in own
            if p.kind != "text":
                tags[_place(p), inside] += 1
                continue
            n = len(page[p.start : p.end].split())
            # A sidebar within the article is no part of what the label means.
            aside = inside and any(guess_within(e.key) for e in own[mark.depth :])
            keys = {e.key for e in own}
            if inside and not aside:
                chosen = keys
            else:
                chosen = {k for k in keys - around if not inside or guess_within(k)}
            for key in chosen:
                if key.split(".", 1)[0] not in PLAIN or "." in key:
                    words[key, inside and not aside] += n
    cost = lambda k: min(-0.05, max(-20.0, 4 * math.log((tags[k, True] + 0.5) / (tags[k, False] + 0.5))))
    value = lambda k: max(-WORD_SCORE, min(WORD_SCORE, math.log((words[k, True] + 0.5) / (words[k, False] + 0.5))))
    return Model({k: cost(k) for k, _ in tags}, {k: min(0.0, value(k)) if guess(k) else value(k) for k, _ in words})


def fit(pages: DataFrame, max_pages: int = MAX_PAGES, max_bytes: int = MAX_BYTES) -> Model:
    """Learn from pages that have one content element, drawn by a hash of id and page.

    At most ``max_pages`` pages and ``max_bytes`` bytes come to the driver; a page that does not fit any more is left out.
    """
    one = F.lit(False)
    for name in CONTENT:
        one = one | (F.size(F.split(F.lower("html"), f"<{name}\\b")) == 2)
    labelled = pages.filter(one).select(F.col("page_id").cast("long").alias("page_id"), "html")
    sizes = labelled.select("page_id", F.octet_length("html").alias("n"), F.xxhash64(F.lit("pages"), "page_id", "html").alias("draw"))
    left, drawn = max_bytes, []
    for row in sizes.orderBy("draw", "page_id").limit(max_pages).collect():
        if row["n"] <= left:
            left -= row["n"]
            drawn.append((row["page_id"], row["draw"]))
    drawn = F.broadcast(pages.sparkSession.createDataFrame(drawn, "page_id long, draw long"))
    labelled = labelled.withColumn("draw", F.xxhash64(F.lit("pages"), "page_id", "html"))
    # The draw tells rows apart that repeat an id with another page.
    chosen = labelled.join(drawn.distinct(), (labelled["draw"] == drawn["draw"]) & labelled["page_id"].eqNullSafe(drawn["page_id"]), "left_semi")
    return fit_pages([r["html"] for r in chosen.select("html").distinct().toLocalIterator()])


def score_of(piece: Piece, page: str, model: Model, values: dict[tuple[str, bool], float]) -> float:
    """What a piece adds to a stretch. ``values`` keeps what elements' words are worth."""
    if piece.kind == "text":
        return _worth(piece.element, model, values) * len(page[piece.start : piece.end].split())
    if piece.kind == "skip":
        return 0.0
    if piece.element.in_content:
        return PLAIN_COST
    key = piece.element.key
    place = _place(piece)
    if key in PLAIN:
        return model.tags.get(place, PLAIN_COST) if place else PLAIN_COST
    known = model.tags.get(place)
    if known is not None:
        return known
    return -2.0 if guess(key) else -0.2


def _value(element: Element, model: Model) -> float:
    """Score of a word by one element around it."""
    known = model.words.get(element.key)
    if element.in_content:
        outside = known is not None and known < 0 and "." in element.key
        return 0.0 if outside or guess_within(element.key) else WORD_SCORE
    return (0.0 if guess(element.key) else WORD_SCORE) if known is None else known


def _worth(element: Element | None, model: Model, values: dict[tuple[str, bool], float]) -> float:
    """Score of a word there: the least that one of the elements around it gives."""
    todo = []
    while element and element.worth is None:
        todo.append(element)
        element = element.up
    least = element.worth if element else WORD_SCORE
    for element in reversed(todo):
        at = (element.key, element.in_content)
        if at not in values:
            values[at] = _value(element, model)
        element.worth = least = min(least, values[at])
    return least


def best_stretch(scores: Iterable[float]) -> tuple[int, int]:
    """Start and end of the stretch with the largest sum, the first of equal ones; empty if none is positive."""
    best = total = 0.0
    begin = first = last = 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += score
        if total > best:
            best, first, last = total, begin, i + 1
    return first, last


def extract(page: str, model: Model) -> str:
    """The text of the stretch with the largest score, block by block."""
    values = {}
    held = list(pieces(page)) if len(page) <= HELD_CHARS else None
    first, last = best_stretch(score_of(p, page, model, values) for p in held or pieces(page))
    blocks, line = [], []
    for p in islice(held or pieces(page), first, last):
        if p.kind == "text":
            if _worth(p.element, model, values) > 0:
                line.append(page[p.start : p.end])
        elif p.kind != "skip":
            if p.element.name == "br":
                line.append(" ")
            elif p.element.name not in INLINE:
                blocks.append("".join(line))
                line = []
    blocks.append("".join(line))
    blocks = [" ".join(entities.unescape(b).split()) for b in blocks]
    return "\n".join(filter(None, blocks))


def main_text(pages: DataFrame, model: Model) -> DataFrame:
    """``page_id, url, text`` for pages ``(page_id, url, html, ...)``, one row for each row.

    Null html is empty; a page without words has an empty text. Of stretches with equal scores
    the first wins. Pages are read whole, whatever their length; a page takes memory in proportion to
    the elements that are open at once. Rows that repeat an id are extracted each. Other columns are not read; an empty table gives an empty result.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            texts = [extract(h or "", own) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
            )

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string")
