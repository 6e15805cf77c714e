"""The main text of web pages, by the ratio of text to tags per line.

The standard library's parser streams events. Each block element starts a line; a line has its text, the
number of tags met in it, and the element that holds it. A line's ratio is its characters per tag; the
ratios are smoothed by a Gaussian over neighbouring lines, and lines above a threshold (two means of the
smoothed ratios) form the content cluster. The cluster selects the regions: articles (or, without any, main elements)
that together hold half of its text, else the innermost element that holds nearly all of it. All lines of a region
are the text, short ones too, save what lies in parts that are no prose: menus, headers and footers of the page,
sidebars, notices, adverts, forms and reader comments.

Such a part is told by its element or role, or by a name in its class or id. A name counts as a whole (`ad-slot`, not
`ad-free`; `sidebar`, not `has-sidebar`), and it does not count for an element that holds the page's articles, or
nearly all of a page without articles. All of this takes time in proportion to the page, however deep it is nested.

Defined results: a null or empty page, or one without text, gives an empty text; an unfinished tag at the
end is dropped; markup that is not closed, or closed out of order, is read as far as it goes; rows that
repeat stay repeated; an empty table gives no rows; other columns are left out whatever their names.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import by_batch, text_or_empty

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Their text is none of the page's.
HIDDEN = frozenset("script style noscript template svg math canvas object iframe audio video map head title select datalist textarea button noembed noframes".split())
#: Parts of a page that are not its article.
APART = frozenset("nav footer aside form menu dialog search".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: A class or an id is a name of such a part if it is made of these words,
APART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner billboard breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer discussion disqus footer "
    "gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination paywall popup promo promoted promotion related replies reply respond responses share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget".split()
)
#: and of these, which name no part alone,
BESIDE_WORDS = frozenset("area article articles bar block body bottom box btn button buttons container content cta entry fixed form global group icon icons inner item items left link links list main mobile module outer page panel post posts primary right row secondary section site slot sticky stories text thread title top unit user wrap wrapper zone".split())
#: and these name a part of an article as well.
OF_ARTICLES = frozenset("disclaimer discussion related responses".split())
HEADER_WORDS = frozenset("header site page global main top web app wrapper container wrap inner bar".split())
#: An element that holds this many times the text outside of all such parts is none of them.
NEARLY_ALL = 20
#: Elements whose text can be the region.
HOLDERS = frozenset("body main article section div td".split())
#: Elements whose lines, if they are not mostly links, keep the region from closing in on a part beside them.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
UNFINISHED = re.compile(r"<[a-zA-Z/!][^<>]*\Z")


class Node:
    """An element. sure: apart by its element or role, or in such a part; named: apart by its class or id, as far as that counts."""

    __slots__ = ("apart", "block", "depth", "hidden", "in_article", "named", "parent", "sure", "tag")

    def __init__(self, tag: str, parent: Node | None, sure: bool = False, named: bool = False, hidden: bool = False) -> None:
        self.tag, self.parent, self.sure, self.named, self.hidden = tag, parent, sure, named, hidden
        self.depth = parent.depth + 1 if parent else 0
        self.block = self if parent is None or tag in BLOCK else parent.block
        self.in_article = bool(parent and parent.in_article) or tag in ("article", "main")
        self.apart = False


class Line:
    __slots__ = ("link", "node", "tags", "text")

    def __init__(self, text: str, tags: int, link: int, node: Node) -> None:
        self.text, self.tags, self.link, self.node = text, tags, link, node


class Lines(HTMLParser):
    """Collects the lines and the elements of a page, the latter in the order in which they start."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.at = self.root = Node("body", None)
        self.nodes = [self.root]
        #: Open elements by tag, and those that the end of an inline element does not reach beyond.
        self.open: dict[str, list[Node]] = defaultdict(list)
        self.walls = [self.root]
        self.parts: list[str] = []
        self.tags = self.link = self.in_link = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "body":
            self.close_to(self.root)
        if tag in ("html", "body"):
            return
        if tag in BLOCK:
            self.end_line()
            self.close_open(tag)
        self.tags += 1
        if tag in VOID:
            return
        if tag == "a":
            self.in_link += 1
        at = self.at
        self.at = Node(tag, at, at.sure or self.is_apart(tag, attrs), self.is_named(tag, attrs), at.hidden or tag in HIDDEN)
        self.nodes.append(self.at)
        self.open[tag].append(self.at)
        if tag in ("article", "main", "td"):
            self.walls.append(self.at)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in HIDDEN or tag in ("a",):  # written as if it were void
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body", "br"):
            return
        node = self.open[tag][-1] if self.open.get(tag) else None
        if tag in ("p", "b", "i", "a", "span", "em", "strong") and (node.depth if node else 0) < self.walls[-1].depth:
            return
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        if tag == "a":
            self.in_link = max(0, self.in_link - 1)
        if node:
            self.close_to(node.parent)

    def close_to(self, node: Node) -> None:
        """Ends all open elements within a node."""
        while self.at is not node:
            self.open[self.at.tag].pop()
            if self.at is self.walls[-1]:
                self.walls.pop()
            self.at = self.at.parent

    def handle_data(self, data: str) -> None:
        if not self.at.hidden:
            self.parts.append(data)
            if self.in_link:
                self.link += len(data)

    def close(self) -> None:
        super().close()
        self.end_line()

    def close_open(self, tag: str) -> None:
        """Ends the paragraph, list item or cell that a block element ends by starting."""
        ends = CLOSED_BY.get(tag, set()) | {"p"}
        while (node := self.at.block).tag in ends and node.parent:
            self.close_to(node.parent)

    def is_apart(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in APART or tag == "header" and not self.at.in_article:
            return True
        if tag in ("article", "main", "b", "i", "em", "strong", "a", "h1"):
            return False
        return any(name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and (value or "").lower() in APART_ROLES for name, value in attrs)

    def is_named(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in ("main", "b", "i", "em", "strong", "a", "h1"):
            return False
        for name, value in attrs:
            if name in ("class", "id"):
                for one in (value or "").split():
                    words = {w.lower() for w in WORDS.findall(one) if not w.isdigit()}
                    own = words & APART_WORDS
                    if self.at.in_article:
                        own -= OF_ARTICLES
                    if own and words <= APART_WORDS | BESIDE_WORDS or "header" in words and words <= HEADER_WORDS and not self.at.in_article:
                        return True
        return False

    def end_line(self) -> None:
        if text := " ".join("".join(self.parts).split()):
            self.lines.append(Line(text, self.tags, self.link, self.at))
            self.tags = self.link = 0
        self.parts.clear()


def smoothed(ratios: list[float], sigma: float = 1.0, reach: int = 2) -> list[float]:
    """Each value's mean with its neighbours, weighed by a Gaussian."""
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(reach + 1)]
    out = []
    for i in range(len(ratios)):
        total = weight = 0.0
        for j in range(max(0, i - reach), min(len(ratios), i + reach + 1)):
            w = kernel[abs(i - j)]
            total += w * ratios[j]
            weight += w
        out.append(total / weight)
    return out


def threshold(values: list[float]) -> float:
    """Halfway between the two means of the values."""
    low, high = min(values), max(values)
    for _ in range(16):
        cut = (low + high) / 2
        above = [v for v in values if v > cut]
        if not above or len(above) == len(values):
            return cut
        was = low, high
        low, high = (sum(values) - sum(above)) / (len(values) - len(above)), sum(above) / len(above)
        if (low, high) == was:
            break
    return (low + high) / 2


def sums(nodes: list[Node], own: dict[Node, int]) -> dict[Node, int]:
    """What each element and all within it hold."""
    out = dict(own)
    for n in reversed(nodes):
        if n.parent and (x := out.get(n)):
            out[n.parent] = out.get(n.parent, 0) + x
    return out


def set_apart(nodes: list[Node], lines: list[Line]) -> None:
    """Decides which names count, and marks what is apart."""
    own: dict[Node, int] = defaultdict(int)
    for line in lines:
        if not line.node.sure:
            own[line.node] += len(line.text) - line.link
    whole = sums(nodes, own)
    outer: dict[Node, Node | None] = {}  # the nearest named element that holds a node, itself included
    for n in nodes:
        outer[n] = n if n.named and not n.sure else outer[n.parent] if n.parent else None
    articles = [n for n in nodes if n.tag in ("article", "main") and not n.sure and not n.named and whole.get(n, 0) > 0]
    off: set[Node] = set()
    if articles and all(outer[n] for n in articles):
        at = outer[max(articles, key=lambda n: (whole[n], -n.depth))]
        while at:
            off.add(at)
            at = outer[at.parent] if at.parent else None
    if not articles:
        inner: dict[Node | None, list[Node]] = defaultdict(list)
        held: dict[Node | None, int] = defaultdict(int)  # by the nearest named element
        for n in nodes:
            held[outer[n]] += own.get(n, 0)
            if outer[n] is n:
                inner[outer[n.parent] if n.parent else None].append(n)
        rest, todo = held[None], [(-whole.get(n, 0), i, n) for i, n in enumerate(inner[None])]
        heapq.heapify(todo)
        number = len(nodes)
        while todo and NEARLY_ALL * rest < -todo[0][0]:
            n = heapq.heappop(todo)[2]
            off.add(n)
            rest += held[n]
            for x in inner[n]:
                number += 1
                heapq.heappush(todo, (-whole.get(x, 0), number, x))
    for n in nodes:
        n.apart = n.sure or bool(n.parent and n.parent.apart) or n.named and n not in off


def cluster(lines: list[Line]) -> list[bool]:
    """Whether each line belongs to the content cluster."""
    ratios = [0.0 if n.node.apart else (len(n.text) - n.link) / max(1, n.tags) for n in lines]
    values = smoothed(ratios)
    cut = threshold(values)
    return [r > 0 and (v >= cut or r >= cut) for r, v in zip(ratios, values, strict=True)]


def regions(nodes: list[Node], lines: list[Line], chosen: list[bool], share: float = 0.8) -> list[Node]:
    """Articles with a quarter of the largest one's cluster text or more, if they hold half of all; else the innermost element that holds `share` of it, and all prose beside it."""
    own: dict[Node, int] = defaultdict(int)
    prose: dict[Node, int] = defaultdict(int)
    for line, yes in zip(lines, chosen, strict=True):
        if not line.node.apart:
            own[line.node] += len(line.text) if yes else 0
            prose[line.node] += yes or line.node.tag in PROSE and 2 * line.link < len(line.text)
    mass, prose = sums(nodes, own), sums(nodes, prose)
    total, all_prose = mass.get(nodes[0], 0), prose.get(nodes[0], 0)
    for tag in ("article", "main"):
        within: set[Node] = set()
        outermost = []
        for n in nodes:
            if n.parent in within:
                within.add(n)
            elif n.tag == tag and not n.apart and mass.get(n, 0) > 0:
                within.add(n)
                outermost.append(n)
        most = max((mass[n] for n in outermost), default=0)
        found = [n for n in outermost if 4 * mass[n] >= most]
        if found and 2 * sum(mass[n] for n in found) >= total:
            return found
    inner = [n for n in nodes if n.tag in HOLDERS and mass.get(n, 0) >= share * total and prose.get(n, 0) == all_prose]
    return [max(inner, key=lambda n: n.depth)]


def main_blocks(html: str) -> list[str]:
    """The blocks of a page's main text, in page order."""
    parser = Lines()
    parser.feed(UNFINISHED.sub("", html))
    parser.close()
    lines, nodes = parser.lines, parser.nodes
    set_apart(nodes, lines)
    if not any(not n.node.apart for n in lines):
        return []
    within = set(regions(nodes, lines, cluster(lines)))
    for n in nodes:
        if n.parent in within:
            within.add(n)
    return [n.text for n in lines if n.node in within and not n.node.apart]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, blocks: an array of the main text's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks = [main_blocks(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(blocks, pa.list_(pa.string()))], ["page_id", "url", "blocks"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return by_batch(pages.select("page_id", F.col("url").cast("string").alias("url"), text_or_empty("html")), run, f"page_id {kind}, url string, blocks array<string>")
