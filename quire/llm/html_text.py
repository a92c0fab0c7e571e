"""Main text of HTML pages by composite text density.

A page is parsed into a tree in one pass over its tags (void elements, optional
end tags, raw-text elements, comments, cut-off markup). Parts that are never
article text are dropped: by tag (navigation, header, footer, aside, scripts,
styles ...); and forms, and elements with a tell-tale role, class or id (adverts,
cookie notices, comments, sidebars ...), unless they hold most of the page's text
outside links. A class or id tells only as a whole, and ids of headings, and of
sections inside an article or main, don't. Formulas are text.

Every remaining node has C characters, T tags, LC characters inside links and LT
link tags in its subtree; tags that only format words aren't counted. With the body's totals C_b and LC_b, its composite
density is

    C/T * log_b( (C * T) / (LC * LT) ),
    b = ln( C * LC / (C - LC) + LC_b * C / C_b + e )

with every count at least 1 in a quotient. A node's density sum is the sum of its
children's densities. The node with the largest sum is the centre; the smallest
density on the path from it to the body is the threshold. Going down from the
body, whatever subtree reaches the threshold keeps its node of largest sum; the
selection is their smallest common subtree. The names of elements play no part in it.

Text: character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined by one space. Nothing else is dropped.

Defined cases: null and empty pages, and pages whose every part is dropped, have
empty text; of equal sums and densities the first node in the page is taken; repeated
rows are separate; very deep nesting and very long pages are parsed without recursion,
in time proportional to their length and depth; other columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.words import chunks

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg".split())
DROPPED = frozenset(
    "head script style noscript template iframe object embed svg canvas audio video map nav header footer aside button "
    "select option input textarea label fieldset dialog menu title link meta base noembed noframes xmp".split()
)
BLOCKS = frozenset(
    "html body address article blockquote center dd details dir div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr li main ol p pre "
    "section summary table caption tbody thead tfoot tr td th ul search".split()
)
#: Tags that format words inside a block; they don't count as tags, so that emphasis and line ends don't thin a text out.
FORMATTING = frozenset("abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An open element that the start tag of the key ends, up to the given limits.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
ENDS_P = BLOCKS - {"html", "body", "caption", "tbody", "thead", "tfoot", "tr", "td", "th"} | {"nav", "header", "footer", "aside", "form", "fieldset", "menu"}
SCOPE = frozenset("html body table td th caption button object template article section div main blockquote li dd dt".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
_WORDS = (
    r"(?:ads?|advert\w*|adsense|adbox|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|"
    r"signup|login|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-bar|aside|widget|footer|masthead|site-header|page-header|topbar|toolbar|"
    r"comments?|commentlist|disqus|replies|reply|respond|discussion|social|share|sharing|related|recommended|pagination|pager|skip-link|search)"
)
#: What may stand beside a tell-tale word in a class or id without changing what it says.
_NEUTRAL = r"(?:site|page|main|top|bottom|left|right|list|box|bar|area|block|container|wrapper|section|inner|links?|form|buttons?|posts?|articles?|global|primary|secondary|\d+)"
_HINT = re.compile(rf"(?:{_NEUTRAL}[_-])*{_WORDS}(?:[_-](?:{_WORDS}|{_NEUTRAL}))*", re.I)
_REPLIES = re.compile(r"comments?|commentlist|disqus|replies|reply|respond|discussion", re.I)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ANNOTATION = re.compile(r"<(annotation(?:-xml)?)(?=[\s>]).*?</\1\s*>", re.I | re.S)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)", re.S
)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "total", "depth", "inside", "hint", "dropped")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.depth = parent.depth + 1 if parent is not None else 0
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.hint = "form" if tag == "form" else None
        self.dropped = parent is not None and (parent.dropped or tag in DROPPED)
        if attrs and not self.dropped:
            self._read()

    def _read(self) -> None:
        """What the attributes say: ``dropped``, or a ``hint`` that holds unless most of the page's text is in here."""
        tag = self.tag
        if tag in ("html", "body", "article", "main"):
            return
        slug = tag in _HEADINGS or tag == "section" and self.inside  # the id names a part of the text
        for m in _ATTRIBUTE.finditer(self.attrs):
            name, value = m[1].lower(), (m[2] or "").strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                self.dropped = True
            elif name == "role" and value.lower() in ROLES:
                self.hint = self.hint or "role"
            elif name == "class" or name == "id" and not slug:
                found = [x for x in value.split() if _HINT.fullmatch(x)]
                if found:
                    self.hint = "replies" if any(map(_REPLIES.search, found)) else self.hint or name


def _drop_hinted(root: Node) -> None:
    """Drop hinted elements that don't hold more than half of the page's text outside links.

    Comments may be longer than what they comment on: they go if any such text is outside them.
    """
    nodes: list[tuple[Node, bool]] = []
    todo = [(root, False)]
    while todo:
        node, link = todo.pop()
        nodes.append((node, link))
        todo += [(c, link or c.tag == "a") for c in node.children if not isinstance(c, str) and c.tag != "head" and c.tag not in RAW]
    plain: dict[int, int] = {}
    for node, link in reversed(nodes):
        own = 0 if link else sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        plain[id(node)] = own + sum(plain.get(id(c), 0) for c in node.children if not isinstance(c, str))
    total = plain[id(root)]
    for node, _ in nodes:  # parents come first
        node.dropped = node.dropped or node.parent is not None and node.parent.dropped
        if node.hint and not node.dropped:
            mine = plain[id(node)]
            node.dropped = mine < total if node.hint == "replies" else 2 * mine <= total


def parse(source: str) -> Node:
    """The page's tree, under a node ``html``."""
    root = Node("html", "", None)
    at, open_ = 0, [root]
    n = len(source)
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            open_[-1].children.append(source[at:lt])
        if lt == n:
            break
        m = _TOKEN.match(source, lt) or _LOOSE.match(source, lt)
        if not m:
            open_[-1].children.append("<")
            at = lt + 1
            continue
        at = m.end()
        if not m.lastindex or m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            _end(open_, tag)
            continue
        if tag in ("html", "body"):
            if tag == "body":
                _end(open_, "head")
                node = Node(tag, m[3], open_[-1])
                open_[-1].children.append(node)
                open_.append(node)
            continue
        if tag == "math" and (close := re.compile(r"</math(?=[\s>])[^>]*>", re.I).search(source, at)):
            # A formula is text of the block it stands in, without its markup.
            open_[-1].children.append(re.sub(r"<[^>]*>", "", _ANNOTATION.sub("", source[at : close.start()])))
            at = close.end()
            continue
        if tag in ENDS_P:
            _implied(open_, {"p"}, SCOPE)
        if tag in CLOSES:
            _implied(open_, *CLOSES[tag])
        node = Node(tag, m[3], open_[-1])
        open_[-1].children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
            node.children.append(source[at : close.start() if close else n])
            at = close.end() if close else n
        elif tag not in VOID:
            open_.append(node)
    _drop_hinted(root)
    return root


def _implied(open_: list[Node], ended: set[str] | frozenset[str], limits) -> None:
    """End the outermost open element of ``ended`` that no limit hides."""
    found = None
    for i in range(len(open_) - 1, 0, -1):
        if open_[i].tag in ended:
            found = i
        elif open_[i].tag in limits:
            break
    if found is not None:
        del open_[found:]


def _end(open_: list[Node], tag: str) -> None:
    for i in range(len(open_) - 1, 0, -1):
        if open_[i].tag == tag:
            del open_[i:]
            return
        if open_[i].tag in ("article", "main", "body", "td", "table") and tag not in BLOCKS and tag not in DROPPED and tag != "form":
            return


def nodes_of(root: Node) -> list[Node]:
    """Kept nodes, parents before children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.dropped:
            continue
        out.append(node)
        todo += [c for c in reversed(node.children) if not isinstance(c, str)]
    return out


def measure(root: Node) -> list[Node]:
    """Counts, densities and density sums of all kept nodes."""
    nodes = nodes_of(root)
    for node in reversed(nodes):
        link = node.tag == "a"
        for child in node.children:
            if isinstance(child, str):
                node.chars += len(child) - child.count(" ") if not child.isspace() else 0
            elif not child.dropped:
                node.chars += child.chars
                node.tags += child.tags + (child.tag not in FORMATTING)
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags + (child.tag == "a")
        if link:
            node.link_chars = node.chars
    chars, links = max(root.chars, 1), root.link_chars
    for node in nodes:
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        if c:
            base = math.log(c * lc / max(c - lc, 1) + links * c / chars + math.e)
            node.density = max(c / t * math.log(max(c * t / (lc * lt), 1.0 + 1e-9)) / math.log(max(base, 1.0 + 1e-9)), 0.0)
    for node in nodes:
        if node.parent is not None:
            node.parent.total += node.density
    return nodes


def select(root: Node) -> Node | None:
    """The subtree that holds the main text."""
    nodes = measure(root)
    if not root.chars:
        return None
    centre = max(nodes, key=lambda n: (n.total, n.density))
    threshold, node = centre.density, centre
    while node is not None and node.chars:
        threshold, node = min(threshold, node.density), node.parent
    chosen: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        inner = [c for c in node.children if not isinstance(c, str) and not c.dropped and c.chars]
        if node.density >= threshold and node is not root and node.tag not in ("html", "body"):
            best = max(nodes_of(node), key=lambda n: n.total)
            chosen.append(best if best.total else node)
        else:
            todo += inner
    top = chosen[0] if chosen else centre
    for node in chosen[1:]:
        top = _common(top, node)
    return top


def _common(a: Node, b: Node) -> Node:
    """The smallest subtree that holds both."""
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return a


def text_of(node: Node) -> str:
    """The blocks of a subtree, in page order, joined by one space."""
    pieces: list[str] = []
    todo: list[Node | str] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            pieces.append(html.unescape(x) if "&" in x else x)
        elif x.dropped:
            pieces.append(" " if x.tag in BLOCKS or x.tag in DROPPED or x.tag == "form" else "")
        else:
            block = x.tag in BLOCKS or x.tag == "form"
            if block or x.tag == "br":
                pieces.append(" ")
                todo.append(" ")
            todo += reversed(x.children)
    return " ".join("".join(pieces).split())


def extract(source: str | None) -> str:
    """The main text of a page."""
    if not source:
        return ""
    chosen = select(parse(source))
    return text_of(chosen) if chosen is not None else ""


def main_text(pages: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``text`` and ``n_chars`` (code points) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            names = [c for c in batch.schema.names if c != "text"]
            out = [extract(x) for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], [*names, "text", "n_chars"])

    slim = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(page).cast("string").alias("text"))
    types = ", ".join(f"k{i} {t}" for i, (_, t) in enumerate(slim.dtypes[:-1]))
    out = slim.mapInArrow(run, f"{types}, text string, n_chars bigint")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text", "n_chars")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.session import table

    return main_text(table(spark, sf_dir, "pages"))
