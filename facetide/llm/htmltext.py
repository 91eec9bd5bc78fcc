"""HTML extraction by composite text density.

The page is read into a tree of tags. Per node: characters of text, tags, and both of them inside links. Its composite text density is
the characters per tag, scaled down by the share of link characters and tags: C / T * log((C / link C) * (T / link T)), with
the logarithm's base ln(C / not-linked C * link C + link Cbody / Cbody * C + e), at least e. A node's density sum adds up its children's. From the node of largest sum
the path to the body is followed; the least density on it is the threshold, and the content is the node of
largest sum below the highest node of the path that the threshold keeps: the largest such subtree that is all above it.
What stands in tags that hold no running text, or in blocks named as menus, notices, adverts or comments, is not counted; a
name that only has such a word in it doesn't silence a block of half the page's text. On the given pages the threshold never
decides: the node of largest sum lies on the path whose least density it is. An article or main tag around it is taken whole.

Defined cases: null and empty pages, and pages without text outside such tags, give the empty text; broken
nesting is read as browsers do in the common cases (an open paragraph or list item ends where the next begins, an end tag
without start is ignored, open tags end with the page); equal densities go to the earlier node; other columns are kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import map_texts

# HTML's tags without content, tags that hold no article text, tags that begin a new block, and tags that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title nav footer aside form button select textarea iframe svg canvas object menu dialog".split())
BLOCKS = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption header address hr details summary fieldset legend center".split()
)
# Parts of class, id and role names of blocks that are no article text.
BOILERPLATE = re.compile(
    r"(^|[^a-z])(ads?|adverts?|advertisement|banner|sponsor(ed)?|promo|cookies?|consent|notice|gdpr|popup|modal|newsletter|subscribe|"
    r"nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|footer|header|masthead|topbar|toolbar|related|recommended|share|sharing|social|"
    r"comments?|comment-list|replies|respond|disqus|widget|search|login|signup|contentinfo|complementary|pagination|pager|tags?|skip)([^a-z]|$)"
)


class Node:
    """A tag with its children (nodes and pieces of text in page order) and the counts of its subtree."""

    __slots__ = ("tag", "parent", "children", "silent", "hinted", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, silent: bool = False):
        self.tag, self.parent, self.silent = tag, parent, silent
        self.hinted = False  # silent by a part of its names alone
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body"):
            if tag == "body" and self.at.tag != "body":
                while self.at.parent is not None:
                    self.at = self.at.parent
            elif tag == "html":
                return
        if tag in BLOCKS:
            self._end_paragraph()
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            self._end_sibling(tag)
        names = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v).lower()
        silent = tag in SILENT or (tag == "header" and not self._inside("article", "main"))
        named = bool(names and tag not in ("body", "article", "main", "a", "span", "b") and BOILERPLATE.search(names))
        node = Node(tag, self.at, silent or named)
        node.hinted = named and not silent and not any(BOILERPLATE.fullmatch(name) for name in names.split())
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not None and node.tag != tag:
            if node.tag in ("article", "body", "td", "nav", "footer", "aside", "form") and tag not in ("html", "body", "article", "table", "nav", "footer", "aside", "form", "main", "div", "section"):
                return
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)

    def _inside(self, *tags: str) -> bool:
        node = self.at
        while node is not None and node.tag not in tags:
            node = node.parent
        return node is not None

    def _end_paragraph(self) -> None:
        """A block ends a paragraph or heading that is still open, with the inline tags open in it."""
        node = self.at
        while node is not None and node.tag not in BLOCKS:
            node = node.parent
        if node is not None and node.tag == "p":
            self.at = node.parent

    def _end_sibling(self, tag: str) -> None:
        node = self.at
        while node is not None and node.tag not in (tag, "ul", "ol", "dl", "table", "body"):
            node = node.parent
        if node is not None and node.tag == tag:
            self.at = node.parent


def heed_hints(root: Node) -> None:
    """A block that holds half of the page's text or more is not silent because its name has a word such as "sidebar" in it
    ("content-with-sidebar"); one whose whole name is such a word stays silent ("comments")."""
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo.extend(c for c in node.children if isinstance(c, Node) and (not c.silent or c.hinted))
    chars: dict[int, int] = {}
    for node in reversed(nodes):  # children before parents
        chars[id(node)] = sum(len("".join(c.split())) if isinstance(c, str) else chars.get(id(c), 0) for c in node.children)
    for node in nodes:
        if node.hinted and 2 * chars[id(node)] >= chars[id(root)]:
            node.silent = False


def _in_order(root: Node) -> list[Node]:
    """All nodes outside silent ones, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.silent)
    return out


def weighed(root: Node) -> list[Node]:
    """The nodes with their densities and sums."""
    nodes = _in_order(root)
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len("".join(c.split()))
            elif not c.silent:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
            node.link_tags = max(node.link_tags, node.tags)
    share = root.link_chars / root.chars if root.chars else 0.0
    for node in reversed(nodes):
        if node.chars:
            plain = max(node.chars - node.link_chars, 1)
            base = math.log(node.chars / plain * node.link_chars + share * node.chars + math.e)
            linked = node.chars / max(node.link_chars, 1) * max(node.tags, 1) / max(node.link_tags, 1)
            node.density = node.chars / max(node.tags, 1) * math.log(linked) / math.log(max(base, math.e))
        node.total = sum(c.density for c in node.children if isinstance(c, Node) and not c.silent) + _own(node)
    return nodes


def _own(node: Node) -> float:
    """Text that stands in the node itself counts like a child without tags and links."""
    chars = sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
    return chars * math.log(chars) if chars and node.tag != "a" else 0.0


def content(root: Node) -> Node | None:
    """The subtree that holds the article."""
    nodes = weighed(root)
    best = max(nodes, key=lambda n: n.total, default=None)  # the first of equals
    if best is None or not best.chars:
        return None
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    body = [n for n in path if n.tag != "html"] or path
    threshold = min(n.density for n in body)
    kept = [n for n in nodes if n.density >= threshold and n.chars]
    best = max(kept, key=lambda n: n.total)
    # an article around the densest part belongs to it: its heading and its other parts
    node = best
    while node is not None:
        if node.tag in ("article", "main"):
            return node
        node = node.parent
    return best


def blocks(node: Node) -> list[str]:
    """Texts of the subtree's blocks in page order, white space as one space."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            run.append(x)
        elif not x.silent:
            if x.tag == "br":
                run.append(" ")
            if x.tag in BLOCKS:
                close()
                todo.append(None)
            todo.extend(reversed(x.children))
    close()
    return out


def extract(html: str | None) -> str:
    if not html:
        return ""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    heed_hints(tree.root)
    found = content(tree.root)
    return "\n".join(blocks(found)) if found is not None else ""


def main_texts(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text in place of the html, and ``n_chars``, its code points."""
    names = [c for c in pages.columns if c not in (html_col, text_col, "n_chars")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x) for x in batch.column(0).to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), sizes], [*names, text_col, "n_chars"])

    kinds = [pages.schema[c] for c in names] + [T.StructField(text_col, T.StringType()), T.StructField("n_chars", T.LongType())]
    return map_texts(pages.select(F.col(f"`{html_col}`").alias("_html"), *(F.col(f"`{c}`") for c in names)), of, T.StructType(kinds))
