"""Main text of web pages by tag-path ratios.

A page becomes text blocks, each with its root-to-leaf tag path. Elements that are never article
text go first, by tag, role or the words of their class or id. Comments, adverts, footers and the
like go whatever their size, unless the page's ``main`` element or an article with most of the
page's weighted content stands inside; elements that only may be wrappers, such as widgets, stay
if next to nothing is left without them. For every path the text length and the
punctuation are summed over its text nodes; length per node times (1 + punctuation per node),
smoothed over neighbouring paths in page order and raised for paths below an article element,
is the path's score. Paths at or above a share of the mean score are content. Content text times
its score is a mass: an article element, or all text outside of them, that holds most of the
page's mass is the main text, and other article elements are teasers; if none does, all count.
The smallest element that holds nearly all content text of the main part is the article, or the
article or main element around it. Its blocks are kept whole, headings included; only lists of
links whose path is not content are left out, being menus.

A null or empty page has an empty text. Unclosed and stray tags, unended comments and texts of
any length are read as they stand, in time that grows with the page's length: elements are kept
in preorder with their parents, so that sums over subtrees need one pass. Repeated rows stay; an
empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import table

# Paths at or above this share of the mean score are content.
CONTENT_SHARE = 0.3
# The article holds this share of all content text.
HELD = 0.9
# One article element, or the text outside of them, is the main part at this share of the mass.
MAIN = 0.75
# How much more a text below an article element weighs.
ARTICLE_WEIGHT = 10.0
# Named elements that may be wrappers stay where no more than this share of the mass is outside.
OUTSIDE = 0.1
# Weight of the neighbouring paths when scores are smoothed.
NEIGHBOUR = 0.25

# What begins like markup: a comment, a declaration, or the name of a tag.
MARKUP = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)([a-zA-Z][^\s/>]*+)")
QUOTE_OR_END = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
QUOTED = re.compile(r"""=\s*+(?:"[^"]*+"|'[^']*+')""")
CLASS_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
PUNCTUATION = re.compile(r"[.,;:!?。、，；：！？…]")

# How HTML names things.
RAW = frozenset("script style noscript template textarea iframe xmp noembed noframes title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
# What can hold an article; the others hold one block of text.
HOLDS = BLOCK - frozenset("p h1 h2 h3 h4 h5 h6 pre li dd dt blockquote figcaption caption legend summary hr option".split())
ENDS_P = BLOCK - frozenset("tbody td tfoot th thead tr option optgroup caption legend body html".split())
SAME = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
NEVER = frozenset(
    "head nav aside footer form button select option input label svg math canvas object audio video dialog menu map search".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert toolbar".split())
COMMENTS = frozenset("comment comments reply replies respond".split())
# Never around an article.
ASIDES = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promotion promoted "
    "breadcrumb breadcrumbs sidebar sidebars footer disqus cookie cookies consent gdpr newsletter "
    "subscribe subscription signup login share sharing recommended recommendations pagination pager".split()
)
NAMES = ASIDES | frozenset(
    "nav navbar navigation menu menus aside rail header masthead topbar banner notice notices notification alert popup modal overlay form "
    "search social related widget widgets toolbar skip".split()
)
# Words of a class that say what else the element has.
TELLS = frozenset("with has no without".split())
# Last words that do not change what a name says.
LAYOUT = frozenset(
    "container wrapper wrap box block bar list area left right top bottom inner outer body text content contents slot slots item items "
    "section unit units zone panel card cards thread entry entries row col column group region holder frame links buttons".split()
)
# Their ids are made from titles.
TITLES = frozenset("h1 h2 h3 h4 h5 h6".split())


def _never(tag: str, attributes: str, found: dict[str, str], inside: bool) -> bool:
    """Whether an element is never article text, whatever it holds."""
    if tag in NEVER or tag == "header" and not inside:
        return True
    if found.get("role", "").lower() in ROLES or found.get("aria-hidden") == "true":
        return True
    bare = QUOTED.sub("", attributes)
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", bare) or re.search(r"display\s*:\s*none", found.get("style", "")))


def _names(tag: str, found: dict[str, str], inside: bool) -> set[str]:
    """What a class or the id says the element is: its whole or last word, not counting words of
    layout, if that names what is no article text. What an element has, or has not, does not name
    it. One block of text is named by an aside alone, an article element as a comment alone; so is a section by its id, and by the whole
    of it."""
    least = COMMENTS if tag == "article" else NAMES if tag in HOLDS else ASIDES
    given = [(c, least, False) for c in found.get("class", "").split()]
    if tag not in TITLES:
        given.append((found.get("id", ""), ASIDES if tag == "section" else least, tag == "section"))
    out = set()
    for named, names, whole in given:
        parts = [w.lower() for w in CLASS_WORD.findall(named)]
        if TELLS.intersection(parts):
            continue
        while len(parts) > 1 and parts[-1] in LAYOUT:
            parts.pop()
        if parts and parts[-1] in names and not (inside and parts[-1] == "header") and not (whole and len(parts) > 1):
            out.add(parts[-1])
    return out


class _Page:
    """The blocks of one page: for each its text runs with their paths, and the element it lies
    in. Elements have serial numbers in preorder, from 1; of each its parent, the last serial
    inside it, and what is around it: the outermost article or main element, the outermost
    article, the innermost element that is named out (0: none)."""

    def __init__(self, source: str):
        self.source = source
        # Of each open element its tag, serial, whether left out, path, whether in a link or list item.
        self.open: list[tuple] = [("", 0, False, 0, False, False)]
        self.count: dict[str, int] = defaultdict(int)
        self.parent, self.last = [0], [0]
        self.inside, self.article, self.named = [0], [0], [0]
        self.holds, self.aside, self.marked = [False], [False], [False]
        self.paths: dict[tuple[int, str], int] = {}
        self.blocks: list[dict] = []
        self.fresh = True
        # Where tags end, by the quote or bracket met first; and the last of those looked up.
        self.ends: dict[int, int] = {}
        self.ahead = (0, -1)
        self.unended: dict[str, int] = {}
        self._read()

    def _find(self, text: str, at: int) -> int:
        """``source.find``, which does not look again for what is not there any more."""
        if at >= self.unended.get(text, len(self.source)):
            return -1
        found = self.source.find(text, at)
        if found < 0:
            self.unended[text] = at
        return found

    def _special(self, at: int) -> int:
        """The first quote or closing bracket from ``at`` on, or -1."""
        begin, found = self.ahead
        if not (begin <= at <= found or found < 0 <= begin <= at and self.ahead != (0, -1)):
            met = QUOTE_OR_END.search(self.source, at)
            self.ahead = (at, met.start() if met else -1)
        return self.ahead[1]

    def _tag_end(self, at: int) -> int:
        """Where the tag whose name ends at ``at`` ends: brackets in quotes do not count, unless
        a quote is never closed. -1: nowhere."""
        chain, end = [], -1
        while True:
            special = self._special(at)
            if special < 0 or special in self.ends:
                end = self.ends.get(special, -1)
                break
            chain.append(special)
            mark = self.source[special]
            if mark == ">":
                end = special
                break
            close = self._find(mark, special + 1)
            if close < 0:
                break
            at = close + 1
        self.ends.update(dict.fromkeys(chain, end))
        return end

    def _read(self) -> None:
        source, at, text = self.source, 0, 0
        for_text = lambda upto: self._text(source[text:upto]) if upto > text else None
        while True:
            found = MARKUP.search(source, at)
            if found is None:
                break
            name = found[2]
            if name is None:
                close = {"<!--": "-->", "<![CDATA[": "]]>"}.get(found[0], ">")
                end = self._find(close, found.end())
                for_text(found.start())
                at = text = len(source) if end < 0 else end + len(close)
                continue
            end = self._tag_end(found.end())
            if end < 0:
                end = self._find(">", found.end())
            if end < 0:
                # No tag; what follows may be a comment.
                at = found.end()
                continue
            for_text(found.start())
            at = end + 1
            tag = name.lower()
            if found[1]:
                self._end(tag)
            elif tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(source, at)
                at = close.end() if close else len(source)
            else:
                self._start(tag, source[found.end() : end])
            text = at
        for_text(len(source))
        self._pop(1)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ENDS_P and any(e[0] == "p" for e in self.open[-8:]):
            self._close("p", ("table", "td", "th", "div", "section", "article"))
        if tag in SAME:
            self._close(tag, SAME[tag])
            if tag in ("dd", "dt"):
                self._close("dt" if tag == "dd" else "dd", SAME[tag])
        if tag in BLOCK:
            self.fresh = True
        elif tag == "br":
            self._text(" ")
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCK:
            return
        _, up, out, path, linked, listed = self.open[-1]
        inside, article, named = self.inside[up], self.article[up], self.named[up]
        serial, aside, own = len(self.parent), False, False
        if attributes.strip() and tag not in ("html", "body", "main", "h1"):
            found = {name.lower(): a or b or c for name, a, b, c in ATTRIBUTE.findall(attributes)}
            out = out or _never(tag, attributes, found, bool(inside))
            names = set() if out else _names(tag, found, bool(inside))
            named, aside = (serial if names else named), bool(names & ASIDES)
        else:
            out = out or _never(tag, "", {}, bool(inside))
        if not out:
            own = tag == "article" or "articleBody" in attributes
            main = tag == "main" or 'role="main"' in attributes
            self.marked.append(main or "articleBody" in attributes)
            article = article or own * serial
            inside = inside or (own or main) * serial
        else:
            self.marked.append(False)
        for column, value in (
            (self.parent, up), (self.last, serial), (self.inside, inside), (self.article, article),
            (self.named, named), (self.holds, tag in HOLDS or own), (self.aside, aside),
        ):
            column.append(value)
        path = self.paths.setdefault((path, tag), len(self.paths) + 1)
        self.open.append((tag, serial, out, path, linked or tag == "a", listed or tag == "li"))
        self.count[tag] += 1

    def _pop(self, to: int) -> None:
        """End all open elements from place ``to`` of the stack on."""
        for tag, serial, *_ in self.open[to:]:
            self.count[tag] -= 1
            self.last[serial] = len(self.parent) - 1
        del self.open[to:]

    def _close(self, tag: str, stop: tuple[str, ...]) -> None:
        """End the innermost open ``tag`` that is not above one of ``stop``."""
        if not self.count[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                self._pop(i)
                self.fresh = True
                return
            if self.open[i][0] in stop:
                return

    def _end(self, tag: str) -> None:
        if tag in BLOCK:
            self.fresh = True
        if not self.count[tag]:
            return
        i = len(self.open) - 1
        while self.open[i][0] != tag:
            i -= 1
        self._pop(i)

    def _text(self, raw: str) -> None:
        _, serial, out, path, linked, listed = self.open[-1]
        if out:
            return
        text = html.unescape(raw)
        if self.fresh and not text.strip():
            return
        if self.fresh:
            own = {"inside": self.inside[serial], "article": self.article[serial], "named": self.named[serial]}
            self.blocks.append({"runs": [], "at": serial, "listed": listed, **own})
            self.fresh = False
        self.blocks[-1]["runs"].append((path, text, linked))

    def sums(self, amounts: dict[int, float]) -> list[float]:
        """For every element the sum over itself and all elements inside it."""
        held = [0.0] * len(self.parent)
        for serial, amount in amounts.items():
            held[serial] += amount
        for serial in range(len(held) - 1, 0, -1):
            held[self.parent[serial]] += held[serial]
        return held

    def holds_block(self, serial: int, block: dict) -> bool:
        return serial <= block["at"] <= self.last[serial]


def path_scores(blocks: list[dict]) -> dict[int, float]:
    """The fused and smoothed score of each tag path."""
    length, marks, nodes, within = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for block in blocks:
        for path, text, _ in block["runs"]:
            text = text.strip()
            if text:
                length[path] += len(text)
                marks[path] += len(PUNCTUATION.findall(text))
                nodes[path] += 1
                within[path] = within.get(path, False) or bool(block["inside"])
    paths = list(nodes)
    raw = [length[p] / nodes[p] * (1 + marks[p] / nodes[p]) for p in paths]
    out = {}
    for i, p in enumerate(paths):
        beside = [raw[j] for j in (i - 1, i + 1) if 0 <= j < len(raw)]
        smooth = (1 - NEIGHBOUR) * raw[i] + NEIGHBOUR * (sum(beside) / len(beside) if beside else raw[i])
        out[p] = smooth * (ARTICLE_WEIGHT if within[p] else 1.0)
    return out


def _content(scores: dict[int, float]) -> set[int]:
    """The paths of content."""
    least = CONTENT_SHARE * sum(scores.values()) / max(len(scores), 1)
    return {p for p, s in scores.items() if s >= least}


def _mass(block: dict, scores: dict[int, float], content: set[int]) -> float:
    """Its text on content paths, each times its path's score."""
    return sum(len(t.strip()) * scores[p] for p, t, _ in block["runs"] if p in content)


def _per_element(blocks: list[dict], amount) -> dict[int, float]:
    out = defaultdict(float)
    for b in blocks:
        out[b["at"]] += amount(b)
    return out


def _unnamed(page: _Page) -> list[dict]:
    """The blocks without those in elements that are named out. A named element stays if the
    page's main element is in it or, where nearly all of the page's mass is in named elements, if
    an article with most of it is; or if it has most of it and is no aside."""
    blocks = page.blocks
    if not any(b["named"] for b in blocks):
        return blocks
    # What is inside an article weighs no more here: comments may be articles too.
    scores = path_scores([b | {"inside": 0} for b in blocks])
    content = _content(scores)
    held = page.sums(_per_element(blocks, lambda b: _mass(b, scores, content)))
    total = held[0]
    outside = sum(_mass(b, scores, content) for b in blocks if not b["named"])
    around = set()
    for serial in range(1, len(page.parent)):
        article = page.article[serial] == serial and outside <= OUTSIDE * total and held[serial] >= MAIN * total > 0
        itself = page.named[serial] == serial and page.aside[serial]
        if (article or page.marked[serial] and held[serial]) and not itself:
            up = page.named[serial]
            while up and up not in around:
                around.add(up)
                up = page.named[page.parent[up]]
    # In preorder, so that an element is judged after those around it.
    kept = [True] * len(page.parent)
    for serial in range(1, len(page.parent)):
        if page.named[serial] == serial:
            wraps = not page.aside[serial] and outside <= OUTSIDE * total and held[serial] >= MAIN * total > 0
            kept[serial] = kept[page.named[page.parent[serial]]] and (wraps or serial in around)
    return [b for b in blocks if kept[b["named"]]]


def _main_blocks(page: _Page, blocks: list[dict], scores: dict[int, float], content: set[int]) -> list[dict]:
    """The blocks of the element that is the main text."""
    size = lambda b: sum(len(t.strip()) for p, t, _ in b["runs"] if p in content)
    mass = defaultdict(float)
    for b in blocks:
        mass[b["article"]] += _mass(b, scores, content)
    main = max(mass, key=mass.get)
    clear = mass[main] >= MAIN * sum(mass.values())
    pool = [b for b in blocks if b["article"] == main] if clear else blocks
    held = page.sums(_per_element(pool, size))
    # The innermost element that still holds nearly all content, or the article or main around it.
    whole = max((s for s, n in enumerate(held) if s and n >= HELD * held[0] and page.holds[s]), default=0)
    around = next((b["inside"] for b in pool if page.holds_block(whole, b)), 0) if whole else 0
    if 0 < around < whole:
        whole = around
    return [b for b in blocks if (not whole or page.holds_block(whole, b)) and (not clear or b["article"] in (main, 0))]


def main_text(source: str | None) -> str:
    """The article of one page."""
    if not source:
        return ""
    page = _Page(source)
    blocks = _unnamed(page)
    if not blocks:
        return ""
    scores = path_scores(blocks)
    if not scores:
        return ""
    content = _content(scores)
    kept = _main_blocks(page, blocks, scores, content)
    texts = []
    for b in kept:
        said = [(p, linked) for p, t, linked in b["runs"] if t.strip()]
        menu = said and all(linked for _, linked in said) and not any(p in content for p, _ in said) and b["listed"]
        text = " ".join("".join(t for _, t, _ in b["runs"]).split())
        if text and not menu:
            texts.append(text)
    return " ".join(texts)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py()) for page in batch.column("html")]
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages`` (page_id, url, html)."""
    kinds = {name: pages.schema[name].dataType.simpleString() for name in ("page_id", "url")}
    types = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint"
    return pages.select("page_id", "url", "html").mapInArrow(_extract, types)


def op3_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
