"""Main text of web pages by tree scoring.

A page becomes a tree; scripts, styles, forms and what says by its tag, role or plain name (class
or id) that it is a menu, header, footer, sidebar, notice, advert or a reader's comment is left
out. Names that sections of an article have too (discussion, related work, copyright law) are
evidence only: such an element goes if it is linked through, holds readers' comments or, where such
a word is its whole name, has no text under a heading of its own. Ids of headings are anchors, and
a header within an article is its title's. Every block
of text left passes points, by its length and its commas, to its parent in full and to further
ancestors in part; an element's points are discounted by the share of its text that is links. The
element with most points is the container, widened to the ``article`` or ``main`` around it; its
siblings are kept if they score well beside it or read as its text, and headings right before
what is kept. Lists and boxes that are mostly links are left out of it.

Text: character references decoded as HTML 5 does, white space inside a block made one space,
blocks trimmed, empty ones dropped, the others joined by a line feed in page order. A line break
element is white space.

Defined results: null or empty html gives an empty text, as does a page without an article; where
all else is in a form, or the article is in an element named otherwise, these are read; an
article within the article is a comment on it; broken markup is read as far as it goes
(open elements end with the page); other columns are not read, repeated rows and null ids are kept
as they are; an empty table gives an empty table. Of elements with equal points the first is the container.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspack.llm import common

# Element names by their part in HTML, and words by which pages name their parts.
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option
    p pre search section summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
DROPPED = frozenset("""annotation annotation-xml applet audio button canvas datalist dialog head iframe map menu nav noembed noframes noscript
    object optgroup option script search select style svg template textarea title video""".split())
NAMED = frozenset("aside footer header".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
BOXES = frozenset("dl div ol p section table ul".split())
WHOLE = frozenset("article body html main".split())
ROLES = frozenset("""alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search
    toolbar""".split())
WORDS = frozenset("""ad ads adsense advert adverts advertisement advertisements advertising advertorial alert announcement
    aside banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer
    discussion disqus dropdown footer footers form forms gdpr header headers login masthead menu menus modal nav navbar
    navi navigation newsletter notice notices notification notifications overlay pager pagination paywall popup promo
    promoted promotion recommendations recommended related replies reply respond responses rail search share sharing
    sidebar sidebars signin signup sitemap skip social sponsor sponsored subscribe subscription toolbar topbar widget
    widgets""".split())
# Of these words, those that title sections of articles too, and those of readers' comments.
TITLES = frozenset("""announcement copyright disclaimer discussion form forms menu menus notifications promotion rail
    recommendations related responses search sharing skip social subscription""".split())
READERS = frozenset("comment comments commentlist disqus replies reply respond".split())
# What names of parts have beside such a word without saying what the part is about.
FRAME = frozenset("""area article bar block body bottom box btn button buttons container content count entry first group
    heading holder icons inline inner item items label last left line link links list main module outer page panel post
    posts primary right row secondary section signup site slot small stories text title top unit wrap wrapper
    zone""".split())
LINES = frozenset("blockquote caption dd dt figcaption li p pre td th".split())
#: Before such a word these say that something else has or hasn't such a part.
ABOUT = frozenset("with has have no without hide show is".split())
#: An opening tag ends open elements of these names, up to the element that holds them.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
        "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
        "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"}), "thead": ({"tbody", "caption"}, {"table"}),
        "option": ({"option"}, {"select"}), "a": ({"a"}, {"td", "th", "table"})}

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>]*+))*+)>|<[!?/][^>]*+>"
    r"|<[a-zA-Z/!?][^>]*+\Z", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_NAME_PART = re.compile(r"[A-Za-z][a-z]*|[0-9]+")
_ARTICLE = re.compile(r"<(?:article|main)\b", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Shares: of links from which a box is a menu, of the container's points from which a sibling stays.
MENU_LINKS, SIBLING = 0.6, 0.2
#: Share of links from which a name counts as a verdict, and characters above which a titled box is a section.
NAMED_LINKS, SECTION_CHARS = 0.35, 40
LEVELS = 5


#: What an element's attributes say: nothing, that its name has such a word beside others of its own, that its name is one
#: that sections of articles have too (in its class, or in the id of a section), that it is no part of the article.
PART, HINT, ANCHOR, TITLE, OTHER = range(5)


def named(tag: str, name: str, value: str, within: bool) -> int:
    """What one class or id says of an element, ``within`` an article or not."""
    parts = [p.lower() for p in _NAME_PART.findall(value)]
    found = {p for i, p in enumerate(parts) if p in WORDS and not (i and parts[i - 1] in ABOUT)}
    if within:
        found -= {"header", "headers"}
    if not found or (tag in HEADINGS and name == "id"):
        return PART
    framed = any(p in FRAME for p in parts)
    plain = all(p in found or p in FRAME or p.isdigit() or p in ("header", "headers") for p in parts)
    if not within and tag not in LINES | HEADINGS:
        return OTHER
    if not plain or (framed and tag in LINES | HEADINGS and found <= TITLES):
        return HINT
    if found <= TITLES:
        return ANCHOR if name == "id" and tag == "section" else TITLE
    return OTHER


def grade(tag: str, attributes: str, within: bool = False) -> int:
    """The most that an element's attributes say."""
    most = PART
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape("".join(values))
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (
                name == "style" and _HIDDEN.search(value)):
            return OTHER
        if tag in WHOLE and tag != "article":
            continue
        if name == "role" and value.strip().lower() in ROLES:
            return OTHER
        if name in ("class", "id"):
            most = max([most, *(named(tag, name, one, within) for one in value.split())])
    return most


def says_other(tag: str, attributes: str) -> bool:
    """Whether an element's attributes say that it is no part of the article."""
    return grade(tag, attributes) == OTHER


class Page:
    """The tree of a page: for each element its name, parent and blocks of text."""

    def __init__(self, source: str, forms: bool = False, around: bool = False):
        self.forms, self.around = forms, around  # read forms, and what is named otherwise around an article
        self.form_seen = False
        self.tags, self.parents = ["#"], [-1]
        self.doubts: dict[int, int] = {}  # elements whose names are evidence only
        self.readers: set[int] = set()  # elements named as readers' comments
        self.blocks: list[tuple[int, str, int, int]] = []  # element, text, its characters in links, links
        self.open = [0]
        self.skip = 0  # length of the stack at which the part left out began
        self.links = 0  # open links
        self.text: list[str] = []
        self.linked = [0, 0]
        self._read(source)

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            m = _TOKEN.search(source, at)
            if not m:
                self._add(source[at:])
                break
            if m.start() > at:
                self._add(source[at:m.start()])
            at = m.end()
            if m[2]:
                tag = m[2].lower()
                if m[1]:
                    self._close(tag)
                else:
                    self._begin(tag, m[3])
                    if tag in RAW:
                        done = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                        at = done.start() if done else end
        self._flush()

    def _add(self, text: str) -> None:
        if not self.skip:
            if "&" in text:
                text = html.unescape(text)
            self.text.append(text)
            if self.links:
                self.linked[0] += len("".join(text.split()))

    def _flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                holder = next(n for n in reversed(self.open) if self.tags[n] in BLOCK or n == 0)
                self.blocks.append((holder, text, *self.linked))
            self.text = []
        self.linked = [0, 0]

    def _pop(self, depth: int) -> None:
        if any(self.tags[n] in BLOCK for n in self.open[depth:]):
            self._flush()
        self.links -= sum(self.tags[n] == "a" for n in self.open[depth:])
        del self.open[depth:]
        if self.skip and len(self.open) < self.skip:
            self.skip = 0

    def _depth(self, names: set[str], until: set[str]) -> int:
        """Place on the stack of the outermost element of these names inside the innermost
        element that holds such (0: none)."""
        found = 0
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.tags[self.open[i]]
            if tag in names:
                found = i
            elif tag in until:
                break
        return found

    def _begin(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._add(" ")
        if tag in BLOCK:
            self._flush()
            depth = self._depth({"p"}, BLOCK - {"p"})
            if depth:
                self._pop(depth)
        if tag in ENDS:
            depth = self._depth(*ENDS[tag])
            if depth:
                self._pop(depth)
        if tag in HEADINGS and self.tags[self.open[-1]] in HEADINGS - {"hgroup"}:
            self._pop(len(self.open) - 1)
        if tag in VOID:
            return
        if attributes.endswith("/") and tag in ("svg", "path", "use", "g", "rect", "circle", "line", "polygon"):
            return
        self.tags.append(tag)
        self.parents.append(self.open[-1])
        self.open.append(len(self.tags) - 1)
        if tag == "a" and not self.skip:
            self.linked[1] += 1
        self.links += tag == "a"
        if not self.skip and (tag in DROPPED or self._other(tag, attributes)):
            if tag not in BLOCK:
                self._add(" ")
            self.skip = len(self.open)

    def _other(self, tag: str, attributes: str) -> bool:
        if tag == "form":
            self.form_seen = True
            return not self.forms
        if tag in NAMED and (tag != "header" or not any(self.tags[n] in ("article", "main") for n in self.open)):
            return True
        within = any(self.tags[n] in ("article", "main") for n in self.open[:-1])
        if self.around and not within and tag not in ("article", "main"):
            return False
        said = grade(tag, attributes, within) if attributes else PART
        if said in (HINT, ANCHOR, TITLE):
            self.doubts[self.open[-1]] = said
        if said and any(p.lower() in READERS for p in _NAME_PART.findall(attributes)):
            self.readers.add(self.open[-1])
        return said == OTHER

    def _close(self, tag: str) -> None:
        if tag in ("br", "p") and tag not in (self.tags[n] for n in self.open):
            self._add(" ")
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.tags[self.open[i]] == tag:
                self._pop(i)
                return
            if tag not in BLOCK and self.tags[self.open[i]] in BLOCK:
                return

    # scoring

    def _sums(self, out: list[bool]) -> tuple[list[int], list[int], list[int]]:
        """Per element its characters, those in links, and links, without what is out."""
        n = len(self.tags)
        chars, linked, links = [0] * n, [0] * n, [0] * n
        for node, text, in_links, count in self.blocks:
            if not out[node]:
                chars[node] += len(text)
                linked[node] += min(in_links, len(text))
                links[node] += count
        for i in range(n - 1, 0, -1):
            p = self.parents[i]
            chars[p] += chars[i]
            linked[p] += linked[i]
            links[p] += links[i]
        return chars, linked, links

    def _out(self) -> list[bool]:
        """Per element whether its name and the evidence beside it, or an ancestor's, leave it out."""
        n = len(self.tags)
        out = [False] * n
        if not self.doubts:
            return out
        chars, linked, _ = self._sums(out)
        titled, readers = [t in HEADINGS and c > 0 for t, c in zip(self.tags, chars)], [False] * n
        for i in range(n - 1, 0, -1):
            p = self.parents[i]
            titled[p] = titled[p] or titled[i]
            readers[p] = readers[p] or readers[i] or i in self.readers
        for i in range(1, n):
            out[i] = out[self.parents[i]]
            if i in self.doubts and not out[i]:
                text = chars[i] > SECTION_CHARS and (titled[i] or self.doubts[i] == ANCHOR)
                out[i] = readers[i] or linked[i] >= NAMED_LINKS * max(chars[i], 1) or (self.doubts[i] != HINT and not text)
        return out

    def main_text(self) -> str:
        n = len(self.tags)
        out = self._out()
        chars, linked, links = self._sums(out)
        points = [0.0] * n
        for node, text, _, _ in self.blocks:
            if out[node]:
                continue
            size = len(text)
            worth = min(1.0, size / 25) + text.count(",") + text.count("、") + min(size / 100, 3.0)
            up = self.parents[node] if self.tags[node] in ("p", "pre", "li", "dd", "td", "blockquote") else node
            for level in range(LEVELS):
                if up <= 0:
                    break
                points[up] += worth / (1, 2, 6, 9, 12)[level]
                up = self.parents[up]
        score = [points[i] * (1 - linked[i] / chars[i]) if chars[i] else 0.0 for i in range(n)]
        dense = [chars[i] > 0 and links[i] >= 3 and linked[i] >= MENU_LINKS * chars[i] and self.tags[i] in BOXES
                 for i in range(n)]
        best = max(range(n), key=lambda i: (score[i], -i))
        if score[best] <= 0:
            best = 0
        around = best
        while around > 0 and self.tags[around] not in ("article", "main"):
            around = self.parents[around]
        kept = {around} if around > 0 else self._siblings(best, score, chars, linked)
        inside = [False] * n
        for i in range(n):
            inside[i] = i in kept or (i > 0 and inside[self.parents[i]] and not dense[i] and not (
                self.tags[i] == "article" and self.tags[around] == "article"))
        return "\n".join(text for node, text, _, _ in self.blocks if inside[node] and not out[node])

    def _siblings(self, best: int, score: list[float], chars: list[int], linked: list[int]) -> set[int]:
        """The container and its siblings that go with it."""
        if best == 0 or self.tags[best] in ("body", "html"):
            return {best}
        kept, heads = set(), []
        ends = {}
        for node, text, _, _ in self.blocks:
            ends[node] = text[-1]
        for i in range(1, len(self.tags)):
            if self.parents[i] != self.parents[best]:
                continue
            density = linked[i] / chars[i] if chars[i] else 1.0
            well = score[i] >= SIBLING * score[best] or (self.tags[i] in ("p", "pre", "blockquote") and (
                (chars[i] > 80 and density < 0.25) or (density == 0 and ends.get(i, " ") in ".!?。\"”")))
            if i == best or well:
                kept |= {i, *heads}
                heads = []
            elif self.tags[i] in HEADINGS:
                heads.append(i)
            elif chars[i]:
                heads = []
        return kept


def main_text(source: str | None) -> str:
    """The main text of one page."""
    if not source:
        return ""
    page = Page(source)
    text = page.main_text()
    if not text and (page.form_seen or _ARTICLE.search(source)):
        return Page(source, forms=True, around=bool(_ARTICLE.search(source))).main_text()
    return text


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py()) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    common.small_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
