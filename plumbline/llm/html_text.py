"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. First pass: a block is decided by where it stands (navigation,
adverts, forms, comments and so on are boilerplate; so is all that lies outside the page's article, if it has one),
by its link density, its length, and its density of function words, which is left out where the function words known
here are not those of the text. Second pass: short blocks that stay open take
the label of the nearest decided block of their region, an article's edge counting as text.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.quality_rules import COMMON_WORDS

SHORT_WORDS = 12
LONG_WORDS = 30
LINK_DENSITY = 0.5
STOP_DENSITY = 0.12
HIGH_STOP_DENSITY = 0.25
#: A page with a smaller part of function words is in a language whose function words are not known here.
PAGE_STOP_DENSITY = 0.06
STOP_WORDS = frozenset(COMMON_WORDS)
#: Letters of scripts without spaces (two count as a word), and of scripts in which no function words are known.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_OTHER_SCRIPT = re.compile("[\u0370-\u1dff\u1f00-\u1fff\u2c00-\u2dff\u3005-\u3007\u3040-\ud7ff\uf900-\ufaff\ufb1d-\ufdff\ufe70-\ufefc\U00010000-\U0003ffff]")
#: Latin letters that English, German, French and Spanish do not use; a text has them in so many words in a hundred.
_OTHER_LATIN = re.compile("[\u00c3\u00c5\u00cc\u00d0\u00d2\u00d5\u00d8\u00dd\u00de\u00e3\u00e5\u00ec\u00f0\u00f2\u00f5\u00f8\u00fd\u00fe\u0100-\u0151\u0154-\u024f\u1e00-\u1eff]")
OTHER_LATIN_PERCENT = 5
_SENTENCE_END = re.compile("[.!?:;\u2026\u3002\uff01\uff1f\u061f\u06d4\u0964\u0589\u1362\u104b\u17d4][\"'\u201d\u2019\u00bb\u300d\u300f\uff09)\\]]*\\Z")

_HEAD = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)|[!?])")
_REST = re.compile(r"(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>")
_NEAR = 4096  # how far a tag is first looked through for its end
_EVENT = re.compile("[\"'>]")
# Elements whose content is no text.
_RAW = frozenset("script style noscript template svg annotation annotation-xml textarea select iframe object title".split())
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in (*_RAW, "head")}
_BODY, _END_OF_HEAD = re.compile("<body", re.I), re.compile("</head", re.I)
# Tag names by what they mean for blocks.
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody"
    " td tfoot th thead tr ul".split()
)
_HOLDER = frozenset("article aside button details dialog div fieldset figure footer form header main menu nav ol section table td ul".split())
_BAD_TAG = frozenset("aside button dialog footer form menu nav".split())
_HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_MAIN = frozenset(("article", "main"))
_BAD_WORD = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored sidebar navbar nav navigation menu"
    " breadcrumb breadcrumbs masthead footer copyright cookie cookies consent notice gdpr popup modal overlay newsletter subscribe"
    " subscription signup login social share sharing related recommended comments comment disqus reply replies respond widget toolbar"
    " pagination pager skip alert hidden".split()
)
_TOPIC = frozenset("alert menu notice related response reply share sharing skip social".split())
_FURNITURE = frozenset(
    "area article articles banner bar block box button buttons container content form group icon icons inner item items link links list"
    " media message module nav news panel popup post posts row section story stories text title to top wrap wrapper".split()
) | _BAD_WORD
_BAD_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NOT_LETTERS = re.compile(r"[^a-z0-9]+")


class _Tags:
    """The markup of a page, in one pass: whatever is broken or left open, no part is searched through again and again."""

    def __init__(self, page: str):
        self.page = page
        self.events: list[int] | None = None  # quotes and ends of tags, once a tag's end was not near
        self.ends: list[int] = []
        self.next: dict[re.Pattern, tuple[int, int]] = {}

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, end, name, whether it is an end tag, attributes); the name is empty where no tag is to be judged."""
        page, at = self.page, 0
        close = page.find(">")  # the first one at or after the current position
        while close >= 0:
            head = _HEAD.search(page, at)
            if head is None:
                return
            start, name = head.start(), head[3]
            if head[1]:
                stop = page.find("-->", head.end())
                at = len(page) if stop < 0 else stop + 3
                yield start, at, "", False, ""
            else:
                if close < head.end():
                    close = page.find(">", head.end())
                if close < 0:
                    break
                lower = name.lower() if name else ""
                if not name:
                    at = close + 1
                    yield start, at, "", False, ""
                elif not head[2] and (lower in _RAW or lower == "head" and self._holds_no_body(close)):
                    stop = _CLOSE[lower].search(page, close + 1)
                    at = stop.end() if stop else len(page)
                    yield start, at, "", False, ""
                else:
                    end = self._end_of_tag(head.end(), close)
                    at = end + 1
                    yield start, at, lower, bool(head[2]), page[head.end() : end]
            if close < at:
                close = page.find(">", at)
        comment = page.find("<!--", at)
        if comment >= 0:
            yield comment, len(page), "", False, ""

    def _holds_no_body(self, at: int) -> bool:
        end = self._find(_END_OF_HEAD, at)
        return end >= 0 and not 0 <= self._find(_BODY, at) < end

    def _find(self, what: re.Pattern, at: int) -> int:
        """The next place of a pattern, -1 if there is none; remembered until it is passed."""
        since, place = self.next.get(what, (at + 1, -1))
        if not (since <= at and (place < 0 or place >= at)):
            found = what.search(self.page, at)
            place = found.start() if found else -1
            self.next[what] = (at, place)
        return place

    def _end_of_tag(self, at: int, close: int) -> int:
        """The first > outside quotes, or the first one of all if a quote stays open."""
        if self.events is None:
            found = _REST.match(self.page, at, at + _NEAR)
            if found:
                return found.end() - 1
            self._index()
        k = bisect_left(self.events, at)
        return self.ends[k] if k < len(self.ends) and self.ends[k] >= 0 else close

    def _index(self) -> None:
        """For each quote or >, where a tag ends that reaches it outside quotes; from the last one to the first."""
        self.events = [m.start() for m in _EVENT.finditer(self.page)]
        self.ends = [-1] * len(self.events)
        free = double = single = -1
        for k in range(len(self.events) - 1, -1, -1):
            place = self.events[k]
            letter = self.page[place]
            if letter == ">":
                free = place
            elif letter == '"':
                free, double = double, free
            else:
                free, single = single, free
            self.ends[k] = free


@dataclass
class Block:
    text: str
    links: int  # characters inside links
    heading: bool
    region: int  # which main region it stands in; 0 outside
    bad: bool  # stands inside a boilerplate container
    doubt: int = 0  # which article with a boilerplate class it stands in; 0 none
    good: bool | None = field(default=None)


def _bad_class(name: str, inside_main: bool) -> bool:
    words = [w for w in _NOT_LETTERS.split(name) if w]
    for k, word in enumerate(words):
        if word in _TOPIC and k + 1 < len(words) and words[k + 1] not in _FURNITURE:
            continue  # a notice board or social history, not a notice or social links
        if word in _BAD_WORD or (word == "header" and not inside_main):
            return True
    return False


def _boilerplate(name: str, rest: str, inside_main: bool) -> bool:
    if name in _BAD_TAG or (name == "header" and not inside_main):
        return True
    if "=" not in rest and "hidden" not in rest:
        return False
    for key, *values in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), "".join(values).lower()
        if key in ("class", "id"):
            if any(_bad_class(x, inside_main) for x in value.split()):
                return True
        elif key == "role" and value in _BAD_ROLE or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        elif key == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The page's blocks in order; empty ones are left out."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, int]] = []  # open containers: name, and what held before: boilerplate, main region, doubt
    depth_of: dict[str, int] = {}  # how many containers of each name are open
    parts: list[str] = []
    links = regions = doubts = 0
    link_depth = -1  # open containers when the current link began; -1: not in a link
    heading = bad = False
    region = doubt = at = 0

    def close() -> None:
        nonlocal links, heading
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, links, heading, region, bad, doubt))
            parts.clear()
        links, heading = 0, False

    for start, stop, name, ends, rest in _Tags(page):
        if start > at:
            piece = page[at:start]
            parts.append(piece)
            if link_depth >= 0:
                links += len(piece.strip())
        at = stop
        if name == "a":
            link_depth = -1 if ends else len(stack)
        elif name == "br":
            parts.append(" ")
        elif name in _BLOCK:
            close()
            heading = name in _HEADING and not ends
            if name not in _HOLDER:
                continue
            if not ends:
                stack.append((name, bad, region, doubt))
                depth_of[name] = depth_of.get(name, 0) + 1
                if name in _MAIN and not bad and not region:
                    regions += 1
                    region = regions
                if name not in _MAIN:
                    bad = bad or _boilerplate(name, rest, region > 0)
                elif not doubt and _boilerplate(name, rest, True):
                    doubts += 1
                    doubt = doubts
            elif depth_of.get(name):
                while True:
                    opened, bad, region, doubt = stack.pop()
                    depth_of[opened] -= 1
                    if opened == name:
                        break
                if link_depth > len(stack):
                    link_depth = -1
    parts.append(page[at:])
    close()
    _settle(out)
    return out


def _settle(found: list[Block]) -> None:
    """Articles with a boilerplate class are boilerplate, unless the longest is longer than all other articles' text."""
    sizes: dict[int, int] = {}
    for b in found:
        if b.region and not b.bad:
            sizes[b.doubt] = sizes.get(b.doubt, 0) + len(b.text)
    clear = sizes.pop(0, 0)
    longest = max(sizes, key=sizes.__getitem__, default=0)
    if longest and sizes[longest] <= clear:
        longest = 0
    for b in found:
        b.bad = b.bad or b.doubt not in (0, longest)


def decide(found: list[Block]) -> list[Block]:
    """Labels every block; True is main text."""
    has_main = any(b.region and not b.bad for b in found)
    open_: list[tuple[Block, int, float]] = []  # outside any article: block, words, part of function words
    for b in found:
        if b.bad or (has_main and not b.region):
            b.good = False
        elif b.links > LINK_DENSITY * len(b.text):
            b.good = False
        else:
            words = b.text.split()
            length = len(words) + (0 if b.text.isascii() else len(_UNSPACED.findall(b.text)) // 2)
            if b.region:
                b.good = True if length > SHORT_WORDS else None
            else:
                stops = sum(w.strip(".,;:!?\"'()").lower() in STOP_WORDS for w in words) / max(1, length)
                open_.append((b, length, stops))
    known = _known_language(open_)
    for b, length, stops in open_:
        if not known or _other_letters(b.text):
            if length > LONG_WORDS or (length > SHORT_WORDS and _SENTENCE_END.search(b.text)):
                b.good = True
        elif length > LONG_WORDS:
            b.good = stops >= STOP_DENSITY
        elif length > SHORT_WORDS:
            b.good = True if stops >= HIGH_STOP_DENSITY else None
    n = len(found)
    before, after = _nearest(found, range(n)), _nearest(found, range(n - 1, -1, -1))
    labels = []
    for k, b in enumerate(found):
        if b.good is not None:
            labels.append(b.good)
            continue
        (d1, l1), (d2, l2) = before[k], after[k]
        if l1 == l2 or d1 < d2:
            labels.append(l1)
        elif d2 < d1:
            labels.append(l2)
        else:  # between text and boilerplate: an article's own block stays, and so does a heading over text
            labels.append(bool(b.region) or (b.heading and l2))
    for b, label in zip(found, labels, strict=True):
        b.good = label
    return found


def _known_language(blocks: list[tuple[Block, int, float]]) -> bool:
    """Whether the texts of a page without an article are in a language whose function words are known here."""
    long = [(length, stops) for _, length, stops in blocks if length > SHORT_WORDS]
    total = sum(length for length, _ in long)
    return any(stops >= STOP_DENSITY for _, stops in long) and sum(length * stops for length, stops in long) >= PAGE_STOP_DENSITY * total


def _other_letters(text: str) -> bool:
    """Whether the letters themselves show that it is none of the languages whose function words are known."""
    if text.isascii():
        return False
    words = text.split()
    return (
        2 * len(_OTHER_SCRIPT.findall(text)) > sum(map(str.isalpha, text))
        or 100 * sum(bool(_OTHER_LATIN.search(w)) for w in words) > OTHER_LATIN_PERCENT * len(words)
    )


def _nearest(found: list[Block], order: range) -> list[tuple[int, bool]]:
    """Distance and label of the nearest decided block on one side; the edge of a main region counts as text."""
    out: list[tuple[int, bool]] = [(0, False)] * len(found)
    region, distance, label = -1, 0, False
    for k in order:
        b = found[k]
        if b.region != region:
            region, distance, label = b.region, 0, b.region > 0
        if b.bad and b.region:  # a container inside the article says nothing about the blocks around it
            continue
        distance += 1
        out[k] = distance, label
        if b.good is not None:
            distance, label = 0, b.good
    return out


def main_text(page: str | None) -> str:
    return " ".join(b.text for b in decide(blocks(page)) if b.good) if page else ""


def extract_text(pages: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row for each row: the kept columns, text and n_chars, its code points.

    Null and empty pages, and pages with no block of text, have an empty text. Repeated rows give a row each;
    columns that are not named are not read, so names cannot clash; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = [main_text(x) for x in part.column(last).to_pylist()]
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:last], pa.array(texts, pa.string()), sizes], names=[*keep, "text", "n_chars"])

    names = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in keep)
    return pages.select(*keep, page).mapInArrow(run, f"{names}text string, n_chars long")
