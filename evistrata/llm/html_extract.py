"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass judges each block by itself: its link
density, its length and its density of stop words (of all languages here at once, so no language needs
to be known), and whether the markup around it names a menu, footer, advert, form or the like. Blocks too short to judge stay
undecided. On a page where no block has enough stop words the length counts in their place. The second pass gives those the label of their nearest decided neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evistrata.llm.shared import small_batches

#: First pass: most share of linked characters; characters below which a block is short, above which long; densities.
MAX_LINKS = 0.33
#: The same for short blocks of a marked article, where one link can be most of a sentence.
SHORT_LINKS = 0.5
SHORT, LONG = 80, 200
STOP_LOW, STOP_HIGH = 0.12, 0.22
#: Second pass: a heading is judged by what follows within this many characters.
HEADING_REACH = 300

#: Function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that it for on with as was be at by this have from or are not but an they which you his her she he we "
    "der die das und in den von zu mit sich auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se avec ce il sont ou "
    "de la que el en y los se del las un por con no una su para es al lo como o pero sus le ha me si sin".split()
)

_BLOCK = frozenset("address article aside blockquote body br button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
_RAW = ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "object", "math", "title")
#: Of these, an element that closes itself has no content.
_FOREIGN = ("svg", "math")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_AWAY = frozenset("nav footer aside menu dialog button head".split())
_MAIN = frozenset(("article", "main"))
_AWAY_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Words of class and id attributes that name what is no main text.
_AWAY_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"nav\w*|menu\w*|breadcrumbs?|sidebar|side|footer|foot|masthead|topbar|toolbar|share|sharing|social|related|recommend\w*|"
    r"comments?|comment-\w+|disqus|replies|reply|respond|widget|pagination|pager|skip|copyright|legal|disclaimer|search)(?=$|[\s_-]|\d)",
    re.I,
)
#: What a class or id may also call an article that is not the page's.
_AWAY_ARTICLE = re.compile(r"(?:^|[\s_-])(?:teaser|card|preview|excerpt|comment|review)s?(?=$|[\s_-]|\d)", re.I)
#: Names that a page's wrapper does not have by chance.
_READERS = re.compile(r"(?:^|[\s_-])(?:comments?|comment-\w+|disqus|replies|reply|respond|related|recommend\w*)(?=$|[\s_-]|\d)", re.I)
#: Names that tell a state or a subject and not what the element is: ``has-sidebar``, ``category-legal``.
_STATE_NAME = re.compile(r"(?:has|no|not|with|without|category|cat|tag|topic)[_-]", re.I)
#: Share of the candidate text above which an element is the page's wrapper, whatever its name.
WRAPPER = 0.75
#: Well-worded text outside of all marked articles, as a multiple of that inside, from which the articles are not the page's text.
OUTSIDE = 3
#: Comments and declarations; tags with well-formed attributes; other tags; a tag that the page's end cuts off.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest>[^<>]*+)>|</?[a-zA-Z][^<>]*\Z", re.S)  # fmt: skip
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in _RAW}
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w+")


@dataclass(slots=True)
class Block:
    text: str
    linked: int
    region: int  # number of the enclosing article or main, 0 outside
    away: bool  # inside something that its markup names as no main text
    heading: bool
    label: str = ""
    named: tuple[int, ...] = ()  # numbers of the enclosing elements that only their name marks as frame


def _away(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in _AWAY or tag == "header" and not in_main:
        return True
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value, name = a or b or c, name.lower()
        if name == "role" and value.lower() in _AWAY_ROLE:
            return tag not in ("body", "html")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def _named_away(tag: str, attributes: str) -> str:
    """``named`` or ``readers`` if a class or id calls the element frame, ``form`` for a form; '' otherwise, also for a page's root and main."""
    if tag in ("body", "html", "main"):
        return ""
    values = [a or b or c for name, a, b, c in _ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id")]
    words = [n for v in values for n in v.split() if not _STATE_NAME.match(n)]
    if any(_READERS.search(n) for n in words):
        return "readers"
    if any(_AWAY_NAME.search(n) or tag == "article" and _AWAY_ARTICLE.search(n) for n in words):
        return "named"
    return "form" if tag == "form" else ""


def _settle_names(found: list[Block], opened: list[tuple[int, ...]], kinds: list[str]) -> None:
    """Set ``away`` in forms and in elements with a frame's name, outer ones first, except in those that are wrappers.

    A wrapper holds most of the candidate text: of the marked articles outside of such elements if there
    are any, else of the page. One that is named for readers or for other pages is none where
    well-worded text stands outside of it, and a form is none without any. ``opened`` has the ``named`` of every region,
    ``kinds`` what each element is.
    """
    inside: dict[int, dict[int, int]] = {}
    total: dict[int, int] = {}
    worded: list[tuple[int, ...]] = []  # the elements around each well-worded block
    for b in found:
        if not b.away and b.linked <= MAX_LINKS * len(b.text):
            total[b.region] = total.get(b.region, 0) + len(b.text)
            for n in b.named:
                inside.setdefault(n, {})[b.region] = inside.setdefault(n, {}).get(b.region, 0) + len(b.text)
            if len(b.text) >= SHORT and not b.heading and _density(b.text) >= STOP_LOW:
                worded.append(b.named)
    lifted: set[int] = set()
    judged: list[int] = []
    for n in sorted(inside):
        if not judged:
            judged = [r for r in total if r and lifted.issuperset(opened[r])] or list(total)
            whole = sum(total.get(r, 0) for r in judged)
        mine = sum(n in names for names in worded)
        odd = kinds[n] == "readers" and mine < len(worded) or kinds[n] == "form" and not mine and len(found) > 1 and sum(inside[n].values()) < LONG
        if sum(inside[n].get(r, 0) for r in judged) > WRAPPER * whole and not odd:
            lifted.add(n)
            judged = []
    if not any(not b.away and lifted.issuperset(b.named) and len(b.text) >= SHORT for b in found):  # a list of articles, all named as parts of one
        lifted |= {n for n in inside if kinds[n] == "article"}
    for b in found:
        b.away = b.away or not lifted.issuperset(b.named)


def blocks(html: str) -> list[Block]:
    """Blocks in page order with their text (references decoded, white space joined) and surroundings."""
    found: list[Block] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, int, tuple[int, ...]]] = []  # tag, away, region, named
    opened: list[tuple[int, ...]] = [()]
    kinds: list[str] = []
    state = {"linked": 0, "links": 0, "regions": 0, "heading": False}

    def close_block() -> None:
        text = _SPACE.sub(" ", unescape("".join(parts))).strip()
        if text:
            away, region, named = stack[-1][1:] if stack else (False, 0, ())
            found.append(Block(text, min(state["linked"], len(text)), region, away, state["heading"], "", named))
        parts.clear()
        state["linked"] = 0

    def text(piece: str) -> None:
        if piece:
            parts.append(piece)
            if state["links"]:
                state["linked"] += len(piece)

    at = 0
    while at < len(html):
        m = _TOKEN.search(html, at)
        if not m:
            text(html[at:])
            break
        text(html[at : m.start()])
        at, tag = m.end(), (m[2] or m["name"] or "").lower()
        closing, attributes = bool(m[1] or m["close"]), m[3] or m["rest"] or ""
        if not tag:
            continue
        if tag in _RAW_END:
            if not closing and not (tag in _FOREIGN and attributes.rstrip().endswith("/")):
                end = _RAW_END[tag].search(html, at)
                at = end.end() if end else len(html)
                parts.append(" ")
            continue
        if tag == "a":
            state["links"] = max(0, state["links"] + (-1 if closing else 1))
        if tag not in _BLOCK:
            continue
        close_block()
        if not closing and tag != "head" and stack and stack[-1][0] == "head":  # </head> can be omitted
            stack.pop()
        if tag in _VOID:
            continue
        state["heading"] = bool(re.fullmatch("h[1-6]", tag)) and not closing
        if closing:
            state["links"] = 0
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in ("p", "li", "dt", "dd", "option") and stack and stack[-1][0] == tag:
            stack.pop()
        away, region, named = stack[-1][1:] if stack else (False, 0, ())
        if kind := _named_away(tag, attributes):
            kinds.append("article" if tag == "article" and kind == "named" else kind)
            named = (*named, len(kinds) - 1)
        if tag in _MAIN:
            state["regions"] += 1
            region = state["regions"]
            opened.append(named)
        stack.append((tag, away or _away(tag, attributes, region > 0), region, named))
    close_block()
    _settle_names(found, opened, kinds)
    return found


def _frame(b: Block) -> bool:
    """Whether markup, links or a copyright line make a block none of the text, however it is worded."""
    return b.away or b.linked > (SHORT_LINKS if b.region and len(b.text) < SHORT and not b.heading else MAX_LINKS) * len(b.text) or b.text.startswith("©") and len(b.text) < LONG or b.text.startswith("Copyright") and len(b.text) < SHORT and not b.heading


def _density(text: str) -> float:
    """Share of stop words."""
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def first_pass(b: Block) -> str:
    """``good``, ``bad``, or what is undecided: ``near`` (tends to good) and ``short``."""
    if _frame(b):
        return "bad"
    if len(b.text) < SHORT or b.heading:
        return "short"
    density = _density(b.text)
    if density >= STOP_HIGH:
        return "good" if len(b.text) >= LONG else "near"
    if density >= STOP_LOW:
        return "near"
    # dense text of unknown words: inside a marked article it is undecided, outside it is none
    return "short" if b.region else "bad"


def judge_by_length(found: list[Block]) -> None:
    """Where no block reaches a density, the page's language is unknown and the length decides alone."""
    if not any(b.label in ("good", "near") for b in found):
        for b in found:
            if len(b.text) >= SHORT and not b.heading and not _frame(b):
                b.label = "good" if len(b.text) >= LONG else "near"


def second_pass(found: list[Block]) -> None:
    """Undecided blocks take the label of their nearest decided neighbours in the same article or outside of all.

    ``near`` blocks are good and count as decided. Between two labels that differ short ones go with the closer side
    (bad on a draw). Where nothing is decided on either side, blocks of a marked article are good. A heading is good when a good block follows within reach. On a page where nothing turns out
    good, all blocks that the first pass left undecided are.
    """
    decided = ["" if b.label == "short" else "bad" if b.label == "bad" else "good" for b in found]
    before: list[tuple[str, int]] = []
    last: dict[int, tuple[str, int]] = {}
    for i, b in enumerate(found):
        before.append(last.get(b.region, ("", -1)))
        if decided[i] and not b.away:
            last[b.region] = (decided[i], i)
    last = {}
    for i in range(len(found) - 1, -1, -1):
        b = found[i]
        if not decided[i]:
            (prev, at_prev), (nxt, at_next) = before[i], last.get(b.region, ("", -1))
            if not prev and not nxt:
                b.label = "good" if b.region else "bad"
            elif b.heading and nxt == "good" and sum(len(x.text) for x in found[i + 1 : at_next]) <= HEADING_REACH:
                b.label = "good"
            elif not prev or not nxt or prev == nxt:
                b.label = nxt or prev
            else:
                b.label = prev if i - at_prev < at_next - i else nxt if at_next - i < i - at_prev else "bad"
        else:
            b.label = decided[i]
            if not b.away:
                last[b.region] = (decided[i], i)
    if all(b.label == "bad" for b in found):
        for b, was in zip(found, decided, strict=True):
            b.label = b.label if was else "good"


def main_text(html: str | None) -> str:
    """Text of the blocks that both passes find good, joined by one space; null and empty pages give ''."""
    found = blocks(html or "")
    open_ = [b for b in found if not b.away]
    if any(b.region for b in open_):  # a marked article: what lies outside is frame, unless nearly all well-worded text lies there
        worded = lambda blocks: sum(len(b.text) for b in blocks if len(b.text) >= SHORT and not b.heading and b.linked <= MAX_LINKS * len(b.text) and _density(b.text) >= STOP_LOW)
        if worded(b for b in open_ if not b.region) <= OUTSIDE * worded(b for b in open_ if b.region):
            found = [b for b in found if b.region]
    for b in found:
        b.label = first_pass(b)
    judge_by_length(found)
    second_pass(found)
    return " ".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without ``html_col``, with ``text`` and ``n_chars`` (code points).

    Each page is read whole in its task; nothing is shuffled. Null, empty and tag-only pages give '' and
    0. Repeated rows are extracted each; an empty table gives an empty result. Columns of ``pages``
    called ``text`` or ``n_chars`` are replaced.
    """
    small_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    @F.pandas_udf("string")
    def to_text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(main_text, na_action=None)

    return pages.select(*kept, to_text(html_col).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
