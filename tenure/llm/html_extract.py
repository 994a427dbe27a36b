"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. Scripts, styles, the head and forms hold no
blocks. Elements whose end tag is omitted end where HTML ends them: a head at the first
element or text that cannot be in it, a p or li at the tags that close it.

The first pass looks at each block alone. Many characters in links make it bad, except a
paragraph in an article or main element, which may well be one link. So does standing in
a menu, header, footer, sidebar, notice, advert or reader comments, known by the element,
or by a class, id or role that is a listed word (never against an article or main element
or what holds one that has no such name itself); a header inside an article belongs to
it. Names with a listed word among others (``site-footer``, ``commentList``) are weak
evidence: they count unless they tell of the page's state (``has-sidebar``,
``comments-open``), and are dropped for a page on which they leave nothing. Of the others,
enough characters with enough stop words make a block good, and the rest stay undecided:
headings, short blocks, and long ones without stop words. Where stop words make no block
of a page good, as in languages without any here, enough characters do, an ideograph
or syllable sign counting as three; where these make none, blocks that end as sentences do.

In the second pass an undecided block takes the label of the nearest decided neighbour.
Blocks that are bad by where they stand are passed over, as an advert may stand anywhere
in a text. In an article or main element its edges count as good neighbours, and a block is
bad only between two bad ones; outside, the page's edges are bad, and between a good and a
bad neighbour at the same distance stop words decide. An undecided heading goes with the
next decided block.

Good blocks are joined in page order. Character references are decoded, white space
in a block becomes one space, nothing is cut.

Defined results. A null or empty page, and one without a good block, gives an empty
text. Markup that is cut off at the end is markup; elements left open end with the
element around them or the page. Pages of any length are read whole. Repeated rows give repeated
rows; an empty table gives none. A column ``main_text`` of the pages is replaced, and the
other columns stay as they are.
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
from pyspark.sql.types import StringType

MAX_LINK_SHARE = 1 / 3
#: Characters and share of stop words that make a block good by itself.
GOOD_CHARS, GOOD_STOP_SHARE, SOME_STOP_SHARE = 70, 0.2, 0.1

# Fixed: frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """
    a an and are as at be by for from in is it of on that the this to was with
    als auf das dem den der des die ein eine im ist mit nicht sich und von zu für
    au avec ce dans de des du elle en est et il la le les ne par pas pour que qui sur un une
    al como con de del el en es la las lo los más no para por que se su un una y
    """.split()
)

# Fixed: elements whose text is never shown as prose, and elements around the article.
_RAW = "script|style|noscript|template|textarea|svg|math|iframe|object|canvas"
_HIDDEN = frozenset("head title form dialog button select".split())
_OUTSIDE = frozenset("nav footer aside menu header".split())
_MAIN = frozenset({"article", "main"})
_BLOCKS = frozenset(
    """
    address article aside blockquote body caption center dd details dialog dir div dl dt
    fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main
    menu nav ol option p pre section summary table tbody td tfoot th thead tr ul
    """.split()
)
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Fixed: what HTML lets be in a head, what ends an open p, and what ends others of its kind
# (by start tag: the names that it ends, and those that it does not look beyond).
_HEAD = frozenset("base basefont bgsound head link meta noscript script style template title".split())
_CELLS = frozenset("table td th caption button".split())
_ENDS_P = _BLOCKS - frozenset("caption legend option tbody td tfoot th thead tr".split())
_LISTS = frozenset("ul ol menu dir".split()) | _CELLS
_ENDS = {
    "li": (frozenset(["li"]), _LISTS),
    **dict.fromkeys(("dt", "dd"), (frozenset(["dt", "dd"]), _CELLS | {"dl"})),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    **dict.fromkeys(("td", "th"), (frozenset(["td", "th"]), frozenset(["table", "tr"]))),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"]))),
}
_TABLE_PARTS = frozenset("table thead tbody tfoot tr td th caption".split())
# Fixed: words of class, id and role names for what is not the article.
_NOT_ARTICLE = frozenset(
    """
    ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment
    comments contentinfo cookie cookies disqus footer login masthead menu modal nav navbar
    navigation newsletter notice notices pagination popup promo promoted related replies
    reply respond search share sharing sidebar signup social sponsor sponsored subscribe
    toolbar widget widgets complementary
    """.split()
)
# Fixed: beside such a word, these say how the page is made, not what an element is.
_STATES = frozenset(
    "has no with without open closed enabled disabled layout template is not before after free show hide off".split()
)
# Fixed: what makes a header that of the site.
_SITE = frozenset("site page main top global".split())

_TOKEN = re.compile(
    rf"""
    <!--.*?(?:-->|\Z)
    | <(?P<raw>{_RAW})\b[^>]*(?:(?<=/)>|>.*?(?:</(?P=raw)\s*>|\Z)|\Z)
    | <(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)
    | <[!?/a-z][^>]*(?:>|\Z)
    """,
    re.S | re.I | re.X,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PARTS = re.compile("[a-z]+")
_HUMPS = re.compile("[A-Z]?[a-z]+|[A-Z]+")
_WIDE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
_SENTENCE = re.compile(r"[.!?…。！？।؟]['\"”’»)\]]*\Z")
# From the first letter of a word to its last.
_LETTERS = re.compile(r"[^\W\d_](?:\S*[^\W\d_])?")


#: Where a block stands: in the open, in what is no article, or in what is named like that.
IN_OPEN, IN_OUTSIDE, IN_NAMED = 0, 1, 2


@dataclass
class Block:
    text: str
    link_chars: int
    heading: bool
    main: int  # the article or main element it is in; 0 for none
    paragraph: bool = False
    place: int = IN_OPEN


@dataclass(slots=True, eq=False)
class Element:
    name: str
    rest: str
    holds: bool = False  # an article or main element
    place: int = IN_OPEN
    hidden: bool = False


def _named_outside(rest: str) -> bool:
    """A class, id or role that is a listed word, or made of listed words only."""
    if "=" not in rest:
        return False
    for value in _NAMES.findall(rest):
        for whole in value.lower().strip("\"'").split():
            words = _PARTS.findall(whole)
            if words and _NOT_ARTICLE.issuperset(words):
                return True
    return False


def _named_alike(rest: str) -> bool:
    """A class, id or role with a listed word among others, unless it tells of a state."""
    if "=" not in rest:
        return False
    for value in _NAMES.findall(rest):
        for whole in value.strip("\"'").split():
            words = {w.lower() for w in _HUMPS.findall(whole)}
            if words & _STATES:
                continue
            if words & _NOT_ARTICLE or ("header" in words and words & _SITE):
                return True
    return False


def _place(element: Element, in_main: bool) -> int:
    name = element.name
    if name in _OUTSIDE:
        return IN_OPEN if name == "header" and in_main else IN_OUTSIDE
    if name in ("html", "body") or element.holds:
        return IN_OPEN
    if name not in _MAIN and _named_outside(element.rest):
        return IN_OUTSIDE
    # A page has one main element, but articles may be comments.
    return IN_NAMED if name != "main" and _named_alike(element.rest) else IN_OPEN


def _events(page: str) -> Iterator[tuple[str, str, Element | None, list[Element]]]:
    """Text before a tag, the tag's name (with ``/`` if it closes), what it opens, and what it ends."""
    stack: list[Element] = []
    open_: Counter = Counter()

    def end(names, barrier) -> list[Element]:
        if any(open_[n] for n in names):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name in names:
                    ended = stack[k:]
                    del stack[k:]
                    open_.subtract(e.name for e in ended)
                    return ended[::-1]
                if stack[k].name in barrier:
                    break
        return []

    at = 0
    for token in _TOKEN.finditer(page):
        between = page[at : token.start()]
        at = token.end()
        if open_["head"] and stack[-1].name == "head" and between and not between.isspace():
            yield "", "", None, end(("head",), ())
        name = token["name"]
        if not name:
            if between:
                yield between, "", None, []
            continue
        name, rest = name.lower(), token["rest"]
        if token["close"]:
            if name in _TABLE_PARTS:
                barrier = ("table",)
            elif name in _BLOCKS:
                barrier = _LISTS if name == "li" else _CELLS
            else:
                barrier = () if name in ("html", "body", "head") else _BLOCKS
            yield between, "/" + name, None, end((name,), barrier)
            continue
        ended = end(("head",), ()) if open_["head"] and name not in _HEAD else []
        if name in _ENDS_P and open_["p"]:
            ended += end(("p",), _CELLS)
        if name in _ENDS:
            ended += end(*_ENDS[name])
        element = Element(name, rest)
        if name not in _VOID and not rest.endswith("/"):
            if name in _MAIN and not _named_outside(rest) and not (name == "article" and _named_alike(rest)):
                for e in reversed(stack):
                    if e.holds:
                        break
                    e.holds = True
            stack.append(element)
            open_[name] += 1
        else:
            element = None
        yield between, name, element, ended
    rest = page[at:]
    if open_["head"] and stack[-1].name == "head" and rest and not rest.isspace():
        yield "", "", None, end(("head",), ())
    yield rest, "", None, []


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order, with where they stand."""
    found: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    link_depth, heading, paragraph, main, mains = 0, False, False, 0, 0
    main_stack: list[tuple[Element, int]] = []
    hidden = 0  # how many open elements show no text
    places = [0, 0, 0]  # how many open elements are of each place
    kept_state = (0, False, False)  # of the block around what is outside

    def end_block() -> None:
        text = " ".join("".join(parts).split())
        if text:
            place = IN_OUTSIDE if places[IN_OUTSIDE] else IN_NAMED if places[IN_NAMED] else IN_OPEN
            chars = len(" ".join("".join(linked).split()))
            found.append(Block(text, chars, heading, main, paragraph, place))
        parts.clear()
        linked.clear()

    def add(raw: str) -> None:
        if raw and not hidden:
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if link_depth:
                linked.append(text)

    breaks = 0
    # What an element holds is known only after it, so all events come first.
    for between, name, element, ended in list(_events(page)):
        if between:
            add(between)
            breaks = breaks if between.isspace() else 0
        closed_outside = False
        for e in ended:
            hidden -= e.hidden
            closed_outside = e.hidden
            if e.place:
                end_block()
                places[e.place] -= 1
                if e.place == IN_OUTSIDE:
                    link_depth, heading, paragraph = kept_state
                    closed_outside = True
            if main_stack and main_stack[-1][0] is e:
                main_stack.pop()
        if not name:
            continue
        closing = name[0] == "/"
        name = name[closing:]
        if hidden or (closing and closed_outside):
            continue
        if name == "br":
            breaks += 1
            if breaks > 1:
                end_block()
            else:
                parts.append(" ")
            continue
        breaks = 0
        outside = places[IN_OUTSIDE] > 0
        if name in _BLOCKS:
            end_block()
            heading, link_depth = name in _HEADINGS and not closing, 0
            paragraph = name == "p" and not closing
        if not outside:
            main = main_stack[-1][1] if main_stack else 0
        if closing:
            if name == "a":
                link_depth = max(0, link_depth - 1)
            continue
        if not element:
            continue
        if name in _HIDDEN:
            end_block()
            element.hidden, hidden = True, 1
            continue
        place = IN_OPEN if outside else _place(element, bool(main))
        if place:
            end_block()
            element.place = place
            places[place] += 1
            if place == IN_OUTSIDE:
                kept_state = (link_depth, heading, paragraph)
        if name in _MAIN and place != IN_OUTSIDE and not outside:
            mains += 1
            main = mains
            main_stack.append((element, main))
        elif name == "a":
            link_depth += 1
    end_block()
    return found


def stop_share(text: str) -> float:
    """The share of words that are stop words, whatever other than letters stands around them."""
    return sum(w in STOP_WORDS for w in _LETTERS.findall(text.lower())) / max(1, len(text.split()))


def size(text: str) -> int:
    """Characters, those that stand for a syllable or a word three times."""
    return len(text) + (0 if text.isascii() else 2 * len(_WIDE.findall(text)))


#: What decided a block.
LINKS, PLACE, STOP_SHARE, LENGTH, SENTENCE, NEIGHBOURS = range(6)


def first_pass(block: Block, names: bool = True) -> tuple[bool, int] | None:
    """Good or bad and by which rule, or None for undecided."""
    linked = block.link_chars > MAX_LINK_SHARE * len(block.text)
    if linked and not (block.main and block.paragraph and not block.place):
        return False, LINKS
    if block.place == IN_OUTSIDE or (names and block.place == IN_NAMED):
        return False, PLACE
    if linked or block.heading or size(block.text) < GOOD_CHARS:
        return None
    return (True, STOP_SHARE) if stop_share(block.text) >= GOOD_STOP_SHARE else None


def _decided(blocks: list[Block], names: bool) -> list[tuple[bool, int] | None]:
    decided = [first_pass(b, names) for b in blocks]
    tests = (
        (LENGTH, lambda b: size(b.text) >= GOOD_CHARS),
        (SENTENCE, lambda b: not b.link_chars and _SENTENCE.search(b.text)),
    )
    for rule, good in tests:
        # No stop words that are known here, or only short blocks.
        if any(d and d[0] for d in decided):
            break
        decided = [
            (True, rule) if d is None and not b.heading and good(b) else d
            for b, d in zip(blocks, decided, strict=True)
        ]
    return decided


def decisions(blocks: list[Block]) -> list[tuple[bool, int]]:
    """For each block whether it is good, and what decided that."""
    out = _second_pass(blocks, _decided(blocks, True), True)
    if not any(good for good, _ in out) and any(b.place == IN_NAMED for b in blocks):
        out = _second_pass(blocks, _decided(blocks, False), False)
    return out


def _second_pass(
    blocks: list[Block], decided: list[tuple[bool, int] | None], names: bool
) -> list[tuple[bool, int]]:
    n = len(blocks)
    passed = [b.place == IN_OUTSIDE or (names and b.place == IN_NAMED) for b in blocks]

    def nearest(order) -> list[tuple[int, bool]]:
        """For each block the distance and label of the last decided neighbour passed."""
        found, gap, label, inside = [(0, False)] * n, 1, False, 0
        for i in order:
            if passed[i]:
                continue
            if blocks[i].main != inside:
                inside, gap = blocks[i].main, 1
                label = inside > 0 or label
            found[i] = (gap, label)
            if decided[i] is None:
                gap += 1
            else:
                gap, label = 1, decided[i][0]
        return found

    before, after = nearest(range(n)), nearest(range(n - 1, -1, -1))
    out = []
    for block, first, (left, a), (right, b) in zip(blocks, decided, before, after, strict=True):
        if first is not None:
            out.append(first)
            continue
        if a == b or block.heading:
            label = b  # a heading goes with what follows it
        elif block.main:
            label = True
        elif left != right:
            label = a if left < right else b
        else:
            label = stop_share(block.text) >= SOME_STOP_SHARE
        out.append((label, NEIGHBOURS))
    return out


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    kept = [b.text for b, (good, _) in zip(blocks, decisions(blocks), strict=True) if good]
    return "\n\n".join(kept)


@F.arrow_udf(StringType())
def main_text_of(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(p or "") for p in pages.to_pylist()], pa.string())


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The pages with ``main_text``."""
    return pages.withColumn("main_text", main_text_of(F.col(html_col)))
