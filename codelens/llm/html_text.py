"""Main text of web pages by two passes of block rules.

The page is cut into blocks at block-level tags. In the first pass each block
is good, bad, short or near-good by its length, its share of characters
inside links and its share of stop words. In the second, what is undecided
takes the label of the nearest decided neighbours. Blocks inside elements
that never hold an article (navigation, scripts, reader comments and so on)
are bad from the start, and those inside more elements that are forms, or
named like what isn't the article, than the article itself: a name or a form
around everything says nothing. Where a page marks its article, the mark with
the fewest of these around it is one more feature: what stands outside is
bad, inside a lower density makes a block good and a low one leaves it
undecided, and neighbours are looked for inside the same mark; if nothing
there is decided, the mark alone speaks. On pages that hold hardly any stop
word, so of a language that isn't known, blocks go by length and links.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Common words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from has have he her his i in is it its not of on or she that the their they this to was we were which will with you "
    "aber als am auch auf aus bei bin bis das dass dem den der des die du ein eine einem einen einer er es für hat ich ihr im in ist ja mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wenn wie wir zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous y "
    "al como con cuando de del el ella en entre era es esta está este fue ha hay la las le lo los más me muy no nos o para pero por que se si sin su sus también un una y ya yo".split()
)
#: Elements whose whole content is no text.
SILENT = frozenset("script style noscript template svg math object embed applet canvas iframe head title select option datalist textarea button audio video map".split())
#: Elements that never hold the article, and those that may be around it.
ASIDE, AROUND = frozenset("nav header footer aside dialog menu".split()), frozenset(("form", "fieldset"))
#: Elements that begin and end a block.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag for these ends what its element can't stand in, (elements, not beyond these): HTML lets those end tags be left out.
_CELLS = ("td", "th")
_ROWS = ("tr", *_CELLS)
ENDS = {
    "p": (("p",), ("article", "main", "section", "div", "body", "td", "li", "blockquote")),
    "li": (("li",), ("ul", "ol", "menu", "dl", "table", "article", "main", "section", "blockquote", "body")),
    **dict.fromkeys(("dt", "dd"), (("dt", "dd"), ("dl", "ul", "ol", "menu", "table", "article", "main", "section", "blockquote", "body"))),
    **dict.fromkeys(_CELLS, (_CELLS, ("table", "tr"))),
    "tr": (_ROWS, ("table",)),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (("thead", "tbody", "tfoot", *_ROWS), ("table",))),
    "option": (("option",), ("select", "optgroup", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
}
#: A start tag that isn't of these ends the head; one that begins a block ends these, which can't hold any: pages leave such end tags out.
HEAD_ONLY = frozenset("head base link meta noscript script style template title".split())
NO_BLOCKS = ("title", "select", "optgroup", "option", "datalist", "textarea")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An end tag for these closes what is still open inside them.
NAMED_ASIDE = re.compile(
    r"(?<![a-z])(ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notices?|gdpr|popup|modal|overlay|sidebar|side-bar|breadcrumbs?|menu|nav\w*|footer|header|masthead|comments?|commentlist|replies|respond|disqus|discussion|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search\w*|pagination|pager|toolbar|widget\w*|copyright)(?![a-z])"
)
#: Names, from the start of a word on, of what readers have written.
COMMENTS = re.compile(r"(?<![a-z-])(?:comments?(?!-(?:open|closed|enabled|disabled|allowed))|commentlist|replies|respond|disqus|discussion)(?![a-z])")
ROLES, ROLES_AROUND = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar".split()), frozenset(("form",))
SPACE = re.compile(r"\s+")
WORD = re.compile(r"\w+")
#: A block longer than LONG characters can be good by its stop words alone, one up to SHORT is short.
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH, LINKED = 0.15, 0.25, 0.3
#: Share of stop words in a page's words below which its language isn't known.
KNOWN = 0.05


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[list] = []  # text, characters in links, heading, elements around it that may be aside, number of the marked article around it or 0, never the article
        self.open: list[tuple[str, bool, bool, bool, bool]] = []  # tag, silent, never the article, maybe aside, article
        self.around: dict[int, tuple[int, bool]] = {}  # by marked article: elements around it that may be aside, and whether one never holds an article
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # of each tag in open, in order
        self.text: list[str] = []
        self.linked = self.links = self.silent = self.never = self.maybe = self.article = self.marks = 0
        self.heading = False

    def cut(self) -> None:
        text = SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.blocks.append([text, self.linked, self.heading, self.maybe, self.marks if self.article else 0, self.never > 0])
        self.text, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in HEAD_ONLY:
            self.shut(("head",))
        if tag in BLOCKS:
            self.shut(NO_BLOCKS)
            self.cut()
        if tag in ENDS:
            self.shut(*ENDS[tag])
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        named = dict(attrs)
        about = " ".join(filter(None, (named.get("class"), named.get("id")))).lower().replace("_", "-")
        hidden = "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in (named.get("style") or "").replace(" ", "").lower()
        role = (named.get("role") or "").lower()
        if about and self.article:
            about = re.sub(r"header|masthead", "", about)  # an article's own head holds its title
        if tag in ("html", "body", "main"):
            about = ""
        never = tag in ASIDE and not (tag == "header" and self.article) or role in ROLES or hidden or bool(about and COMMENTS.search(about))
        maybe = tag in AROUND or role in ROLES_AROUND or bool(about and NAMED_ASIDE.search(about))
        article = tag in ("article", "main") or role == "main"
        self.places[tag].append(len(self.open))
        self.open.append((tag, tag in SILENT, never, maybe, article))
        self.silent += tag in SILENT
        self.never += never
        self.maybe += maybe
        if article and not self.article:
            self.marks += 1
            self.around[self.marks] = self.maybe, self.never > 0
        self.article += article
        self.links += tag == "a"
        if tag in HEADINGS:
            self.heading = True

    def last(self, tag: str) -> int:
        """Where the innermost element of that name is open, -1 if none is."""
        places = self.places.get(tag)
        return places[-1] if places else -1

    def shut(self, tags: tuple[str, ...], until: tuple[str, ...] = ()) -> None:
        """Close the innermost open elements of these names, and all inside them, unless one of ``until`` is open further in."""
        edge = max(map(self.last, until), default=-1)
        found = [at for at in map(self.last, tags) if at > edge]
        if not found:
            return
        at = min(found)
        for name, silent, never, maybe, article in self.open[at:]:
            self.silent -= silent
            self.never -= never
            self.maybe -= maybe
            self.article -= article
            self.links -= name == "a"
            self.places[name].pop()
        del self.open[at:]

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.cut()
        if tag in HEADINGS:
            self.heading = False
        self.shut((tag,))

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and data.strip():
            self.shut(("head",))
        if self.silent:
            return
        self.text.append(data)
        if self.links:
            self.linked += len(data.strip())

    def close(self) -> None:
        super().close()
        self.cut()


def blocks_of(html: str) -> tuple[list[list], dict[int, tuple[int, bool]]]:
    """[text, characters in links, heading, elements around it that may be aside, number of the article or main around it or 0, never the article]
    of each block, in page order; and of each article or main, what is around it."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    return parser.blocks, parser.around


def first_label(text: str, linked: int, aside: bool, marked: bool = False, known: bool = True, counts: tuple[int, int] | None = None) -> str:
    """good, near, short or bad, by the block alone; ``marked`` if the page marks it as part of its article, ``known`` if its language is, ``counts`` its stop words and words."""
    if aside or linked > LINKED * len(text) or "©" in text and len(text) < LONG and not marked:
        return "bad"
    if len(text) < SHORT:
        return "bad" if linked and not marked else "short"
    n, words = counts or _stop_words(text)
    share = n / max(1, words) if known else STOP_HIGH
    if marked:
        return "good" if share >= STOP_LOW else "near"
    if share >= STOP_HIGH:
        return "good" if len(text) > LONG else "near"
    return "near" if share >= STOP_LOW else "bad"


def _stop_words(text: str) -> tuple[int, int]:
    words = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def labels(blocks: list[list], around: dict[int, tuple[int, bool]]) -> list[bool]:
    """Whether each block belongs to the article."""
    counts = [_stop_words(b[0]) for b in blocks]
    known = sum(n for n, _ in counts) >= KNOWN * sum(n for _, n in counts)
    fewest = min((n for n, never in around.values() if not never), default=None)
    own = {m for m, (n, never) in around.items() if not never and n == fewest}
    marks = [b[4] if b[4] in own else 0 for b in blocks]
    inside = any(marks)
    # the elements that are around all of an article, or of a page's text, are none beside it
    least: dict[int, int] = {}
    for (text, linked, _, maybe, _, never), mark, n in zip(blocks, marks, counts, strict=True):
        if not never and (mark or not inside and first_label(text, linked, False, False, known, n) == "good"):
            least[mark] = min(maybe, least.get(mark, maybe))
    asides = [b[5] or b[3] > least.get(mark, 0) for b, mark in zip(blocks, marks, strict=True)]
    first = ["bad" if inside and not mark else first_label(b[0], b[1], aside, mark > 0, known, n) for b, mark, aside, n in zip(blocks, marks, asides, counts, strict=True)]
    # inside an article, what is named as aside says nothing of the blocks around it
    decided = [f if f in ("good", "bad") and not (mark and aside) else "" for f, mark, aside in zip(first, marks, asides, strict=True)]
    ahead, behind = _nearest(decided, marks), _nearest(decided[::-1], marks[::-1])[::-1]
    out = []
    for f, b, mark, (before, far), (after, near) in zip(first, blocks, marks, ahead, behind, strict=True):
        if f in ("good", "bad"):
            out.append(f == "good")
        elif mark:
            # the nearer decided block of the same article; the good one of two as near, and of none the mark
            out.append("good" in (before, after) if far == near else (before if far < near else after) == "good")
        elif f == "near":
            out.append(before == "good" or after == "good" or before != "bad" and after != "bad")
        else:
            out.append(before == after and before != "bad" or b[2] and after == "good")
    return out


def _nearest(decided: list[str], marks: list[int]) -> list[tuple[str, int]]:
    """For each block, the nearest earlier label that is decided, and how far it is: the page's edge where there is none. Of a block
    in a marked article only that article's count, and the article's edge is good, but further than any block."""
    out, last, at, mark = [], "edge", -1, 0
    for k, (label, m) in enumerate(zip(decided, marks, strict=True)):
        if m != mark:
            last, at, mark = "good" if m else "edge", -len(decided), m
        out.append((last, k - at))
        if label:
            last, at = label, k
    return out


def main_text(html: str | None) -> str:
    """The article's blocks, one a line, in page order; white space inside a block is one space."""
    blocks, around = blocks_of(html or "")
    return "\n".join(b[0] for b, keep in zip(blocks, labels(blocks, around), strict=True) if keep)


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of each page: its main text, empty if there is none, and its length in code points.

    Null and empty pages have no text. Pages of any length are read whole, in
    time and memory that grow with them. Repeated rows stay, an empty table
    stays empty; other columns are left out. Nothing is shuffled.
    """
    kinds = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (key, url)]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [key, url, "text", "n_chars"])

    return pages.select(key, url, html).mapInArrow(made, f"{', '.join(kinds)}, text string, n_chars long")
