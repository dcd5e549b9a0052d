"""Main text of web pages by two passes of block rules."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accessgraph.llm.common import fresh, query, table

# Element names by their part in the page.
SKIPPED = frozenset(
    "head script style noscript template iframe object embed canvas svg audio video map select textarea button datalist dialog".split()
)
RAW_TEXT = frozenset("script style textarea title xmp".split())
BOILERPLATE = frozenset("nav header footer aside form menu search".split())
MAIN = frozenset("article main".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary
    table tbody td tfoot th thead title tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSED_BY_NEXT = {
    "p": BLOCKS - {"body", "html", "head"},
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
    "head": frozenset(["body"]),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words of class, id and role that mark what is around an article.
CUES = frozenset(
    """ad ads adbox adslot advert advertisement advertising adverts alert announcement banner breadcrumb breadcrumbs comment comments commentlist
    complementary consent contentinfo cookie cookies disclaimer discussion disqus dialog dropdown footer gdpr hidden login masthead
    menu menubar modal nav navbar navigation navi newsletter notice notification overlay pager pagination popup promo promoted
    promotion recommendations recommended related replies reply respond rail share sharebar sharing sidebar signup sitemap social
    sponsor sponsored subscribe subscription tagcloud teaser toolbar topbar widget widgets""".split()
)
# Class words that say what an element has or holds, not what it is.
MODIFIERS = frozenset("has no with without".split())
WRAPPERS = frozenset("wrap wrapper container layout grid row".split())
WRAPPED = frozenset("article body content entry main page post primary site".split())
BUILDER = frozenset("elementor widget container".split())
# Cues of what is never the article, however long, unless it holds one.
APART = frozenset(
    """comment comments commentlist consent cookie cookies dialog discussion disqus gdpr hidden modal overlay popup replies reply
    respond""".split()
)
# Cues that also name parts of articles: inside one they need links or form fields to agree, and only on their own
# or with words such as these.
WEAK = frozenset("announcement banner discussion login menu recommendations recommended related reply respond teaser".split())
COMPANIONS = frozenset(
    """area articles bar block box column content inner item items links list news panel posts row section slot stories unit wrap
    wrapper""".split()
)
TEXTUAL = frozenset("blockquote cite dd figcaption figure p pre q td".split())
CONTROLS = frozenset("button input select textarea".split())
# Frequent function words of the four languages.
STOP_WORDS = frozenset(
    """the of and to in a is that it for was on are as with his they at be this from have or by one had not but what all were when
    we there can an your which their said if do will each about how up out them then she many some so these would other into has
    le la les de des du et un une en que qui dans pour pas sur par au avec est ce il elle ne se plus son sont ont nous vous ou mais
    der die das und ist von zu den mit sich des ein eine nicht auf für im dem auch als an es er sie nach bei aus wie wird oder
    el los las del y una por con para su al lo como más pero sus este entre cuando ya esta está ser son dos también fue era""".split()
)

# The classifier's limits.
LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.1, 0.25
LINK_HIGH = 0.33

# A letter of a script without spaces between words says as much as so many others.
WIDE_FROM, WIDE_CHARS = "\u2e80", 3

GOOD, NEAR, SHORT, LINKED, BAD = "good", "near", "short", "linked", "bad"

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?=>|\Z)|[^>]*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_CUE_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    """Consecutive text inside one block element."""

    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    heading: bool = False
    inside: str = ""
    kind: str = ""
    text: str = ""
    doubt: int = -1


@dataclass
class Doubt:
    """An element that a cue or a form marks, until it is known what of the page it holds."""

    parent: int
    apart: bool
    weak: bool = False
    main: bool = False
    article: bool = False
    good: int = 0
    chars: int = 0
    links: int = 0
    controls: int = 0
    bad: bool = True


def _class_words(value: str, inside_main: bool) -> set[str]:
    """The words of a class, id or role that say what an element is; ``related-work`` in an article says nothing."""
    found: set[str] = set()
    for name in value.split():
        words = [w.lower() for w in _CUE_WORD.findall(name)]
        if not words or words[0] in MODIFIERS or (WRAPPERS & set(words) and WRAPPED & set(words)):
            continue
        if inside_main and not set(words) <= CUES | COMPANIONS:
            words = [w for w in words if w not in WEAK] or ["_"]
        found |= set(words) - BUILDER if words[0] == "elementor" else set(words)
    return found


def _cues(name: str, attributes: str, inside_main: bool, nested: bool) -> tuple[bool, frozenset[str] | set[str]]:
    """(hidden, cue words) of class, id, role and style that mark an element as not part of the article.

    A block called header is the page's own unless it stands in an article. An
    article is judged only if it is ``nested`` in another or called a comment,
    and a heading of an article only if it is hidden.
    """
    if not attributes.strip() or name in ("html", "body", "main"):
        return False, frozenset()
    cues = frozenset(["comment"]) if name == "article" and not nested else CUES
    if not inside_main and name not in HEADINGS and name != "article":
        cues = cues | {"header"}
    elif inside_main and name in HEADINGS:
        cues = frozenset()
    hidden, words = False, set()
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), html.unescape(value.strip("\"'"))
        if key in ("class", "id", "role"):
            words |= _class_words(value, inside_main) & cues
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _HIDING.search(value)):
            hidden = True
    return hidden, words


class Open(NamedTuple):
    """An open element, with what holds for the text inside it."""

    name: str
    place: str = ""
    links: int = 0
    blocks: int = 0
    headings: int = 0
    nearest: str = ""
    doubt: int = -1


ROOT = Open("")


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order, each with the part of the page it stands in."""
    found: list[Block] = []
    doubts: list[Doubt] = []
    current = Block()
    stack: list[Open] = [ROOT]
    depth_of: dict[str, list[int]] = {}
    at = 0

    def close_block() -> None:
        nonlocal current
        if current.parts:
            current.heading, current.inside, current.doubt = stack[-1].headings > 0, stack[-1].place, stack[-1].doubt
            current.text = " ".join("".join(current.parts).split())
            if current.text:
                found.append(current)
            current = Block()

    def add(raw: str) -> None:
        top = stack[-1]
        if raw and top.place != "skip":
            text = html.unescape(raw)
            current.parts.append(text)
            if top.links:
                current.link_chars += len(" ".join(text.split()))

    def pop_to(depth: int) -> None:
        if stack[-1].blocks > stack[depth - 1].blocks:
            close_block()
        while len(stack) > depth:
            depth_of[stack.pop().name].pop()

    def push(name: str, mark: str, doubt: Doubt | None) -> None:
        top = stack[-1]
        if doubt:
            doubts.append(doubt)
        # What is skipped or boilerplate stays so for everything inside.
        place = "skip" if "skip" in (mark, top.place) else "bad" if "bad" in (mark, top.place) else mark or top.place
        block = name in BLOCKS
        stack.append(
            Open(
                name,
                place,
                top.links + (name == "a"),
                top.blocks + block,
                top.headings + (name in HEADINGS),
                name if block else top.nearest,
                len(doubts) - 1 if doubt else top.doubt,
            )
        )
        depth_of.setdefault(name, []).append(len(stack) - 1)

    while True:
        token = _TOKEN.search(page, at)
        if token is None:
            add(page[at:])
            break
        add(page[at : token.start()])
        at = token.end()
        if token[0].startswith("<![CDATA["):
            add(html.escape(token[0][9:].removesuffix("]]>")))
        if token[2] is None:
            continue
        name, attributes = token[2].lower(), token[3]
        if token[1]:
            if depth_of.get(name):
                pop_to(depth_of[name][-1])
            elif name in BLOCKS:
                close_block()
            continue
        if name == "br":
            add(" ")
            continue
        if name in CONTROLS and stack[-1].doubt >= 0:
            doubts[stack[-1].doubt].controls += 1
        if name in CLOSED_BY_NEXT.get(stack[-1].name, ()):
            pop_to(len(stack) - 1)
        elif name == "p" and stack[-1].nearest == "p":
            pop_to(depth_of["p"][-1])
        if name == "a" and depth_of.get("a"):
            pop_to(depth_of["a"][-1])
        if name in BLOCKS:
            close_block()
        if name in VOID:
            continue
        if name in RAW_TEXT:
            end = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = (page.find(">", end.start()) + 1 or len(page)) if end else len(page)
            continue
        if attributes.rstrip().endswith("/") and name in SKIPPED:
            continue
        top, mark, doubt = stack[-1], "", None
        nested = bool(depth_of.get("article"))
        hidden, cues = _cues(name, attributes, top.place == "main", nested)
        if name in SKIPPED:
            mark = "skip"
        elif hidden or (name in BOILERPLATE and name != "form" and not (name == "header" and top.place == "main")):
            mark = "bad"
        elif name in MAIN:
            mark = "main"
        if mark not in ("skip", "bad") and (cues or name == "form"):
            weak = top.place == "main" and name != "form" and cues <= (WEAK | {"comment"} if name in TEXTUAL else WEAK)
            doubt = Doubt(top.doubt, bool(cues & APART), weak)
        elif mark == "main" and top.place != "bad" and top.doubt >= 0:
            doubts[top.doubt].main |= name == "main"
            doubts[top.doubt].article |= name == "article" and not nested
        push(name, mark, doubt)
    close_block()
    if doubts:
        settle(found, doubts)
    return found


def settle(blocks: list[Block], doubts: list[Doubt]) -> None:
    """Clear the elements that hold the page's main part or most of its good text, and mark the blocks of the others.

    An element without article is not cleared for its length if text other than
    headings stands in an article outside all doubt, and comments and notices never are.
    Inside an article, a cue that may name a part of it marks only what is mostly links or has form fields.
    """
    total, article = 0, False
    for block in blocks:
        kind = classify(block)
        if block.doubt >= 0:
            doubts[block.doubt].chars += len(block.text)
            doubts[block.doubt].links += block.link_chars
        if kind in (GOOD, NEAR):
            total += len(block.text)
            if block.doubt >= 0:
                doubts[block.doubt].good += len(block.text)
        if kind != BAD and block.doubt < 0 and block.inside == "main" and not block.heading:
            article = True
    for doubt in reversed(doubts):
        if doubt.parent >= 0:
            outer = doubts[doubt.parent]
            outer.good, outer.main, outer.article = outer.good + doubt.good, outer.main or doubt.main, outer.article or doubt.article
            outer.chars, outer.links, outer.controls = outer.chars + doubt.chars, outer.links + doubt.links, outer.controls + doubt.controls
    for doubt in doubts:
        holds = doubt.article or not (article or doubt.apart)
        if doubt.weak:
            cleared = doubt.main or not (doubt.controls or doubt.links > LINK_HIGH * doubt.chars)
        else:
            cleared = doubt.main or (holds and 2 * doubt.good > total)
        doubt.bad = not cleared or (doubt.parent >= 0 and doubts[doubt.parent].bad)
    for block in blocks:
        if block.doubt >= 0 and doubts[block.doubt].bad:
            block.inside = "bad"


def weight(text: str) -> int:
    """Length of a text, with letters of scripts that need fewer of them counted several times."""
    return len(text) + (0 if text.isascii() else (WIDE_CHARS - 1) * sum(c >= WIDE_FROM for c in text))


def stop_density(text: str) -> float:
    words = _LETTERS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(len(words), 1)


def knows_language(blocks: list[Block]) -> bool:
    """Whether at least half of the page's running text is in a language with known stop words."""
    known = unknown = 0
    for block in blocks:
        size = weight(block.text)
        if block.inside != "bad" and size >= LENGTH_LOW and block.link_chars <= LINK_HIGH * len(block.text):
            if stop_density(block.text) >= STOP_LOW:
                known += size
            else:
                unknown += size
    return known >= unknown


def classify(block: Block, known: bool = True) -> str:
    """First pass: good, near (good), short, linked or bad, from the block alone.

    Stop words are judged only if the page's language is ``known``; in others
    the length decides. In an article, what is mostly links is ``linked``.
    """
    text = block.text
    if block.inside == "bad":
        return BAD
    density = block.link_chars / len(text)
    if block.inside == "main" and density > 0.5:
        return LINKED
    if density > LINK_HIGH and block.inside != "main":
        return BAD
    size = weight(text)
    if size < LENGTH_LOW:
        return BAD if block.link_chars and block.inside != "main" else SHORT
    if not known:
        return GOOD if size > LENGTH_HIGH or block.inside == "main" else NEAR
    stop = stop_density(text)
    if block.inside == "main":
        return GOOD if stop >= STOP_LOW else NEAR
    if stop >= STOP_HIGH:
        return GOOD if size > LENGTH_HIGH else NEAR
    return NEAR if stop >= STOP_LOW else BAD


def decide(blocks: list[Block]) -> None:
    """Second pass: undecided blocks take the label of the nearest decided neighbour.

    Neighbours count in blocks; of two equally near ones the one that keeps the
    block wins for headings and good-looking blocks, else the one that drops
    it. Blocks inside an article and blocks outside any are decided apart, and
    those in menus and the like count for neither. If nothing is decided, the
    blocks stay. Blocks of links in an article stay only between good ones.
    """
    known = knows_language(blocks)
    for block in blocks:
        block.kind = classify(block, known)
    groups: dict[bool, list[int]] = {True: [], False: []}
    for i, block in enumerate(blocks):
        if block.inside != "bad":
            groups[block.inside == "main"].append(i)
    labels = [b.kind for b in blocks]
    for main, order in groups.items():
        decided_before, decided_after = {}, {}
        last = None
        for position, i in enumerate(order):
            if blocks[i].kind in (GOOD, BAD):
                last = (position, blocks[i].kind)
            decided_before[i] = last
        last = None
        for position in range(len(order) - 1, -1, -1):
            i = order[position]
            if blocks[i].kind in (GOOD, BAD):
                last = (position, blocks[i].kind)
            decided_after[i] = last
        where = {i: p for p, i in enumerate(order)}
        for i in order:
            kind = blocks[i].kind
            if kind in (GOOD, BAD):
                continue
            if kind == LINKED:
                both = decided_before[i], decided_after[i]
                labels[i] = GOOD if all(d and d[1] == GOOD for d in both) else BAD
                continue
            lenient = kind == NEAR or blocks[i].heading or main
            near = [(abs(p - where[i]), k != GOOD if lenient else k == GOOD, k) for p, k in filter(None, (decided_before[i], decided_after[i]))]
            labels[i] = min(near)[2] if near else GOOD
    for block, label in zip(blocks, labels, strict=True):
        block.kind = label


def main_text(page: str | None) -> str:
    """The article of a page: its good blocks, one per line. A null page is empty."""
    blocks = blocks_of(page or "")
    decide(blocks)
    return "\n".join(b.text for b in blocks if b.kind == GOOD)


def extract(pages: DataFrame, columns: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``columns`` of every page with ``text`` and ``n_chars`` of its article.

    Stop words are known for English, French, German and Spanish. A page that is
    mostly in another language is judged by length and link density alone.
    Null and empty pages have an empty text; repeated rows are repeated; other
    columns, also ones named text or n_chars, are dropped.
    """
    kept = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(kept)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:kept], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*columns, "text", "n_chars"],
            )

    schema = pages.select(*columns).withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema
    return pages.select(*columns, F.col("html").alias(fresh(pages, "_html"))).mapInArrow(run, schema)


@query("op3_html_extraction")
def op3(spark, sf):
    """The main text of every page."""
    return extract(table(spark, sf, "pages"))
