"""Main text of web pages by a site style tree.

All pages of a host are merged into one tree of their elements: a node is a path of tags with
their classes and ids. How a node's contents and its children's sequences vary over the host's
pages says how important it is: menus and notices repeat themselves, articles do not.

    importance = -sum p log_m p     over the variants' shares p, for m different pages

A node's importance combines both entropies: the larger one counts, since a varying arrangement
is as telling as varying text. Branches below a threshold are cut from each page, once their
entropy over the host's different pages is significant.

A branch that a page declares to be no content (menus, forms, adverts, notices, ...) goes, however
long it is, unless the article lies in it: a declared article, or all text that the tree leaves.
Reader comments hold no article. If the page declares an article, only that is read, unless there
is clearly more undeclared text outside it.

Pages are parsed once, in time linear in their length: every element is a number with that of its
parent, every block of text names its element. Counts are combined before they are shuffled; a
host of any size is a few narrow rows for each node, and only its list of unimportant nodes
returns to its pages.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import map_arrow
from shelfline.session import stage

SIGNIFICANCE = 0.05  # the chance to find a node as repetitive by accident
LEAST_IMPORTANCE = 0.1
MARKED_SHARE = 0.5  # of the text, where all of it is declared: branches with less of it go
MORE_OUTSIDE = 200  # letters that the text outside the articles has to have more than they have

# Fixed values of HTML: elements without content, elements that are never text, elements that
# start a block, and which open elements a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(
    "audio canvas datalist head iframe input math noscript object "
    "optgroup option script select style svg template textarea title video".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
_HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"},
          "th": {"tr", "table"}, "option": {"select"}}
_HEAD = frozenset("base link meta noscript script style template title".split())
_ASIDE_TAGS = frozenset({"aside", "dialog", "footer", "form", "menu", "nav"})
_ASIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split()
)
# Words of classes and ids that declare a branch to be no content, and those that may stand beside
# them. A name with any other word (with-sidebar, related-work) declares nothing.
_ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos "
    "banner banners nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside "
    "footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended "
    "comment comments disqus replies respond pagination pager toolbar widget widgets skip".split()
)
_PLACE_WORDS = frozenset(
    "area bar block bottom box container inner item items left link links list main right section "
    "site top wrapper".split()
)
_COMMENT_WORDS = frozenset("comment comments disqus replies respond".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


# What an element is: declared to be no content, reader comments, an article, a closed button.
MARKED, COMMENT, ARTICLE, BUTTON = 1, 2, 4, 8

# Hashes of sequences that can be appended to each other.
_PRIME = (1 << 61) - 1
_BASE = 0x1F3D_5B79_86A2_C4E1
_POWERS = [pow(_BASE, n, _PRIME) for n in range(64)]


def _appended(first: tuple[int, int], second: tuple[int, int]) -> tuple[int, int]:
    """(hash, length) of two sequences in a row."""
    n = second[1]
    power = _POWERS[n] if n < 64 else pow(_BASE, n, _PRIME)
    return (first[0] * power + second[0]) % _PRIME, first[1] + n


def _declares(marks: str) -> int:
    """Whether one of the names declares a branch to be no content, and whether to be comments."""
    found = 0
    for name in marks.split():
        words = {w.lower() for w in _WORD.findall(name)}
        if words & _ASIDE_WORDS and words <= _ASIDE_WORDS | _PLACE_WORDS:
            found |= MARKED | (COMMENT if words & _COMMENT_WORDS else 0)
    return found


class _Page(HTMLParser):
    """One pass over a page: its blocks, its elements, and its nodes' contents.

    Element 0 is the page. Elements that are never text have no number. The open elements are
    found by tag, so that no step looks through all of them.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.plain: list[int] = []  # letters outside links, by block
        self.at: list[int] = []  # element, by block
        self.parent, self.node, self.flags = [0], [0], [0]  # by element
        # By node: the last child's style, the hash of the children's styles, that of the texts.
        self.nodes: dict[int, list] = {}
        self._folded: list[tuple[int, int]] = [(0, 0)]  # texts of an element, by element
        self._open: list[tuple[str, int, bool]] = []  # tag, element, whether a link
        self._places: dict[str, list[int]] = {}  # where a tag is open
        self._blocks: list[int] = []  # where a block element is open
        self._silent = self._links = self._articles = 0
        self._text: list[str] = []
        self._plain = 0

    def _element(self) -> int:
        return self._open[-1][1] if self._open else 0

    def _end_block(self) -> None:
        if self._text:
            text = _SPACE.sub(" ", "".join(self._text)).strip()
            if text:
                element = self._element()
                self.texts.append(text)
                self.plain.append(self._plain)
                self.at.append(element)
                self._folded[element] = _appended(
                    self._folded[element], (xxhash.xxh3_64_intdigest(text) % _PRIME, 1)
                )
            self._text, self._plain = [], 0

    def _pop(self, to: int) -> None:
        if self._blocks and self._blocks[-1] >= to:
            self._end_block()
        while len(self._open) > to:
            tag, element, link = self._open.pop()
            self._places[tag].pop()
            if tag in BLOCKS:
                self._blocks.pop()
            self._links -= link
            if tag in SILENT:
                self._silent -= 1
                continue
            self._articles -= bool(self.flags[element] & ARTICLE)
            texts, above = self._folded[element], self.parent[element]
            self._folded[above] = _appended(self._folded[above], texts)
            node = self.nodes[self.node[element]]
            node[2] = _appended(node[2], texts)

    def _place(self, tag: str) -> int:
        """Where the innermost open element of a tag is, -1 if there is none."""
        places = self._places.get(tag)
        return places[-1] if places else -1

    def _implied_end(self, tag: str) -> None:
        if self._place("head") >= 0 and (
            tag == "body" or tag not in _HEAD and self._open[-1][0] == "head"
        ):
            self._pop(self._place("head"))
        if tag in BLOCKS and self._blocks and self._open[self._blocks[-1]][0] == "p":
            self._pop(self._blocks[-1])
        if tag in _CLOSES:
            closed = max(self._place(t) for t in _CLOSES[tag])
            if closed > max(self._place(t) for t in _HOLDS[tag] - _CLOSES[tag]):
                self._pop(closed)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self._text.append(" ")
        self._implied_end(tag)
        if tag in BLOCKS:
            self._end_block()
        if tag in VOID:
            return
        values = dict(attrs)
        marks = f"{values.get('class') or ''} {values.get('id') or ''}"
        style = f"{tag} {' '.join(sorted(marks.split()))}"
        link = tag == "a" and "href" in values
        above = self._element()
        if above:
            node = self.nodes[self.node[above]]
            if style != node[0]:
                node[0] = style
                node[1] = _appended(node[1], (xxhash.xxh3_64_intdigest(style) % _PRIME, 1))
        self._places.setdefault(tag, []).append(len(self._open))
        if tag in BLOCKS:
            self._blocks.append(len(self._open))
        self._links += link
        if tag in SILENT:
            self._silent += 1
            self._open.append((tag, above, link))
            return
        role = (values.get("role") or "").lower()
        flags = 0
        if tag in ("article", "main") or role in ("article", "main"):
            flags = ARTICLE
        elif (
            tag in _ASIDE_TAGS
            or (tag == "header" and not self._articles)
            or role in _ASIDE_ROLES
            or "hidden" in values
        ):
            flags = MARKED
        if tag not in ("html", "body", "article", "main"):
            flags |= _declares(marks)
        self._articles += bool(flags & ARTICLE)
        element = len(self.parent)
        self.parent.append(above)
        self.node.append(xxhash.xxh3_64_intdigest(style, self.node[above]) >> 1)
        self.flags.append(flags)
        self._folded.append((0, 0))
        self.nodes.setdefault(self.node[-1], [None, (0, 0), (0, 0)])
        self._open.append((tag, element, link))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        place = self._place(tag)
        if place >= 0:
            if tag == "button":  # one that is never closed must not hide the rest of the page
                self._end_block()
                self.flags[self._open[place][1]] |= BUTTON
            self._pop(place)
        elif tag in BLOCKS:
            self._end_block()

    def handle_data(self, data: str) -> None:
        if self._silent and self._open[-1][0] == "head" and data.strip():
            self._pop(self._place("head"))
        if not self._silent:
            self._text.append(data)
            if not self._links:
                self._plain += len(data.strip())

    def close(self) -> None:
        super().close()
        self._end_block()
        self._pop(0)


def _parsed(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page


def _chosen(
    plain: np.ndarray,
    lengths: np.ndarray,
    at: np.ndarray,
    parent: list[int],
    node: list[int],
    flags: list[int],
    unimportant: frozenset[int],
) -> np.ndarray:
    """Which blocks are the main text. Parents come before their children in all lists."""
    n = len(parent)
    above = [0] * n  # all that an element lies in, itself included
    cut = [False] * n
    for e in range(1, n):
        above[e] = above[parent[e]] | flags[e]
        cut[e] = cut[parent[e]] or node[e] in unimportant
    above_at, cut_at = np.array(above)[at], np.array(cut)[at]
    shown = above_at & BUTTON == 0
    if not plain[shown].any():
        plain = lengths
    alive = shown & ~cut_at
    if not plain[alive].any():
        alive = shown
    texts = alive & (plain > 0) & (above_at & COMMENT == 0)
    # Declared wrappers of the article count for nothing where no article lies outside of them.
    wraps = [False] * n
    if not (texts & (above_at & ARTICLE > 0) & (above_at & MARKED == 0)).any():
        for e in set(at[texts & (above_at & ARTICLE > 0)].tolist()):
            outermost = 0
            while e:
                if flags[e] & ARTICLE:
                    outermost = e
                e = parent[e]
            while outermost and not wraps[parent[outermost]]:
                outermost = parent[outermost]
                wraps[outermost] = True
    declared = [False] * n
    for e in range(1, n):
        declared[e] = declared[parent[e]] or bool(flags[e] & MARKED) and not wraps[e]
    kept = alive & ~np.array(declared)[at]
    if not plain[kept].any():
        # All text is declared: the styles that hold most of it are the page.
        held: Counter[int] = Counter()
        marked = []
        for block in np.flatnonzero(alive & (above_at & COMMENT == 0)):
            own, e = set(), int(at[block])
            while e and above[e] & MARKED:
                if flags[e] & MARKED:
                    own.add(node[e])
                e = parent[e]
            marked.append((block, own))
            for name in own:
                held[name] += int(plain[block])
        most = MARKED_SHARE * sum(int(plain[block]) for block, _ in marked)
        small = {name for name, letters in held.items() if letters < most}
        kept = np.zeros(len(at), bool)
        kept[[block for block, own in marked if small.isdisjoint(own)] or [b for b, _ in marked]] = True
    inside = kept & (above_at & ARTICLE > 0)
    article = plain[inside].sum()
    if article and plain[kept].sum() - article <= article + MORE_OUTSIDE:
        return inside
    return kept


def main_text(html: str | None, unimportant: frozenset[int] = frozenset()) -> str:
    """The page's blocks, one on a line, without the branches of the given nodes.

    A page of which these would leave nothing is not cut by them.
    """
    page = _parsed(html)
    return _text(page.texts, page.plain, page.at, page.parent, page.node, page.flags, unimportant)


def _text(texts: list[str], plain, at, parent, node, flags, unimportant: frozenset[int]) -> str:
    if not texts:
        return ""
    lengths = np.array([len(t) for t in texts])
    chosen = _chosen(np.array(plain), lengths, np.array(at), parent, node, flags, unimportant)
    return "\n".join(texts[i] for i in np.flatnonzero(chosen))


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


_PARSED = {
    "_host": "string", "_page": "bigint", "_texts": "array<string>", "_plain": "binary", "_at": "binary",
    "_parent": "binary", "_node": "binary", "_flags": "binary",
    "_nodes": "array<struct<node: bigint, children: bigint, content: bigint>>",
}
_NODE = pa.struct([(name, pa.int64()) for name in ("node", "children", "content")])


def _parse(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` with the host, blocks and elements of each page."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        rows = []
        for url, html in zip(batch.column("url"), batch.column("html")):
            html = html.as_py() or ""
            page = _parsed(html)
            numbers = [
                np.array(values, kind).tobytes()
                for values, kind in (
                    (page.plain, np.int32), (page.at, np.int32), (page.parent, np.int32),
                    (page.node, np.int64), (page.flags, np.uint8),
                )
            ]
            nodes = [
                {"node": name, "children": children[0], "content": content[0]}
                for name, (_, children, content) in page.nodes.items()
            ]
            identity = xxhash.xxh3_64_intdigest(html.encode()) >> 1
            rows.append((host_of(url.as_py()), identity, page.texts, *numbers, nodes))
        kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), *[pa.binary()] * 5, pa.list_(_NODE)]
        columns = list(zip(*rows)) or [()] * len(kinds)
        return {name: pa.array(c, k) for name, c, k in zip(_PARSED, columns, kinds)}

    columns = list(dict.fromkeys([*keep, "url", "html"]))
    return map_arrow(pages, columns, run, _PARSED).select(*keep, *_PARSED)


def node_importance(pages: DataFrame) -> DataFrame:
    """host, node, pages, importance for each node of each host's style tree.

    Pages that are the same count once. A node of a single page has importance 1.
    """
    return _importance(stage(_parse(pages, []), "parsed-pages"))


def _importance(parsed: DataFrame) -> DataFrame:
    nodes = parsed.select(F.col("_host").alias("host"), F.col("_page").alias("page"), F.explode("_nodes").alias("_n"))
    rows = stage(nodes.select("host", "page", "_n.*").distinct(), "style-nodes")

    def entropy(variant: str) -> DataFrame:
        shares = rows.groupBy("host", "node", variant).agg(F.count("*").alias("n"))
        # -sum p log p = log N - sum n log n / N
        return shares.groupBy("host", "node").agg(
            F.sum("n").alias("pages"),
            F.sum(F.col("n") * F.log("n")).alias("_nlogn"),
        ).select(
            "host",
            "node",
            "pages",
            F.when(
                F.col("pages") > 1,
                (F.log("pages") - F.col("_nlogn") / F.col("pages")) / F.log("pages"),
            ).otherwise(1.0).alias(variant),
        )

    both = entropy("content").join(entropy("children").drop("pages"), ["host", "node"])
    return both.select("host", "node", "pages", F.greatest("content", "children").alias("importance"))


def extract_main_text(
    pages: DataFrame,
    keep: list[str],
    significance: float = SIGNIFICANCE,
    least_importance: float = LEAST_IMPORTANCE,
) -> DataFrame:
    """The columns `keep` and text: the main text of every page of a frame with url and html.

    White space within a block is one space, blocks are joined by line ends in page order, a line
    break element is white space. A null or empty page has an empty text; pages without a
    readable host share one. A page after the first repeats a node by accident with a chance of a
    half at most; branches are cut where that explains the tree with less than `significance`,
    which identical ones reach on six pages. `text` takes the place of a column of that name. Repeated pages stay.
    """
    keep_others = [c for c in keep if c != "text"]
    parsed = stage(_parse(pages, keep_others), "parsed-pages")
    weak = _importance(parsed).filter(
        (F.col("importance") < least_importance)
        & (F.pow(F.lit(0.5), (F.col("pages") - 1) * (1 - F.col("importance"))) < significance)
    )
    # Nodes are styles, not contents: a host's list is as long as its templates are many.
    lists = stage(weak.groupBy(F.col("host").alias("_of")).agg(F.collect_set("node").alias("_cut")), "style-cuts")
    if lists.isEmpty():
        matched = parsed.withColumn("_cut", F.lit(None).cast("array<bigint>"))
    else:
        matched = parsed.join(lists, F.col("_host") == F.col("_of"), "left")

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = []
        packed = [(name, np.int64 if name == "_node" else np.uint8 if name == "_flags" else np.int32)
                  for name in ("_plain", "_at", "_parent", "_node", "_flags")]
        for row, (blocks, cut) in enumerate(zip(batch.column("_texts"), batch.column("_cut"))):
            numbers = [np.frombuffer(batch.column(name)[row].as_py(), kind) for name, kind in packed]
            plain, at, *elements = numbers
            texts.append(_text(blocks.as_py(), plain, at, *[e.tolist() for e in elements], frozenset(cut.as_py() or ())))
        return {"text": pa.array(texts, pa.string())}

    columns = [*keep_others, "_texts", "_plain", "_at", "_parent", "_node", "_flags", "_cut"]
    return map_arrow(matched, columns, run, {"text": "string"}).select(*keep_others, "text")
