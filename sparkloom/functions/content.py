"""The main content of a page: a tree of its blocks, scored by text and links, and the best subtree as markdown.

Every block of prose gives its parent a score by its length and commas, less what of it is link text, and its grandparent half of it; the names of classes and ids add to it or take away. The block with the best score is
the content, with the neighbours that read like it. Inside, menus, bars and boxes go; headers, lists, tables and preformatted text stay. A page without a block of prose gives all of its text, less the furniture.

Defined results. Null, empty and blank pages give the empty text. Any nesting depth and any markup that is left open is taken; a block closes what is open inside of it. Text in elements that are not shown counts for nothing. Equal paragraphs of 40 characters or more are
given once. What follows a footer among its siblings goes with it.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.html import CLOSING, DROPPED, LINES, VOID

#: Blocks whose own text is prose, and blocks that may be the content.
PROSE = frozenset("p pre blockquote td dd li".split())
HOLDERS = frozenset("div section article main td body blockquote".split())
#: Words in the names of classes and ids of furniture, and of content.
FURNITURE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disclaimer|menu\w*|modal|nav\w*|newsletter|pager|pagination|popup|promo\w*|related|share\w*|side\w*|skip|social\w*|sponsor\w*|subscribe|tags?|toolbar|widget\w*)(?=$|[\s_-])")
CONTENT = re.compile(r"(?:^|[\s_-])(?:article\w*|body|content\w*|entry\w*|main\w*|page\w*|post\w*|story|text)(?=$|[\s_-])")


class Node:
    """An element: its tag, its parent's place, and its text and children in order. ``text`` and ``links`` are the characters of the whole subtree and those in links."""

    __slots__ = ("tag", "parent", "parts", "names", "hidden", "own", "text", "links", "n_links", "score")

    def __init__(self, tag: str, parent: int, names: str, hidden: bool):
        self.tag, self.parent, self.names, self.hidden = tag, parent, names, hidden
        self.parts: list[str | int] = []
        self.own = self.text = self.links = self.n_links = 0
        self.score = 0.0

    @property
    def density(self) -> float:
        return self.links / self.text if self.text else 0.0


class Tree(HTMLParser):
    """Nodes in the order of their starts, so a parent stands before its children."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("", -1, "", False)]
        self.open = [0]

    def handle_starttag(self, tag, attrs):
        top = self.nodes[self.open[-1]]
        if tag in VOID:
            if tag in ("br", "hr"):
                top.parts.append("\n")
            return
        if top.tag == "p" and (tag in CLOSING or tag in ("h1", "h2", "h3", "h4", "h5", "h6")):
            self.handle_endtag("p")
        elif top.tag == tag and tag in ("li", "tr", "td", "th", "dd", "dt", "option"):
            self.handle_endtag(tag)
        parent = self.open[-1]
        at = dict(attrs)
        names = f"{at.get('class') or ''} {at.get('id') or ''}".lower()
        above = self.nodes[parent]
        foot = tag == "footer" or tag == "div" and ("footer" in names)
        unseen = "hidden" in at or (at.get("aria-hidden") or "") == "true" or "display:none" in (at.get("style") or "").replace(" ", "").lower()
        hidden = above.hidden or foot or unseen or tag in DROPPED
        self.nodes.append(Node(tag, parent, names, hidden))
        above.parts.append(len(self.nodes) - 1)
        if foot and parent:
            above.hidden = True  # of what comes, what is there is kept
        self.open.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        if all(self.nodes[k].tag != tag for k in self.open[1:]):
            return
        while self.nodes[self.open.pop()].tag != tag:
            pass

    def handle_data(self, data):
        top = self.nodes[self.open[-1]]
        if not top.hidden:
            top.parts.append(data)


def measured(nodes: list[Node]) -> None:
    """Characters and links of all subtrees, then scores. Children come after their parents, so no recursion is needed."""
    for node in nodes:
        node.own = sum(len(" ".join(x.split())) for x in node.parts if isinstance(x, str))
        node.text += node.own
    for node in reversed(nodes):
        if node.tag == "a":
            node.links, node.n_links = node.text, 1
        if node.parent >= 0:
            above = nodes[node.parent]
            above.text, above.links, above.n_links = above.text + node.text, above.links + node.links, above.n_links + node.n_links
    for node in nodes:
        if node.text >= 25 and (node.tag in PROSE or node.own >= 25 and node.tag in HOLDERS):
            said = "".join(x for x in node.parts if isinstance(x, str))
            gain = (1 + said.count(",") + min(node.text / 100, 3)) * (1 - node.density)
            for share in (1.0, 0.5):
                node = nodes[node.parent] if node.parent >= 0 else None
                if node is None:
                    break
                node.score += gain * share
    for node in nodes:
        if node.score:
            node.score += 10 * (node.tag in ("article", "main")) + 5 * bool(CONTENT.search(node.names)) - 15 * furnished(node)
            node.score *= 1 - node.density


def furnished(node: Node) -> bool:
    return bool(FURNITURE.search(node.names)) and not CONTENT.search(node.names)


def chosen(nodes: list[Node]) -> list[int]:
    """The content and its like among its siblings, in order; the root where there is none."""
    best = max((k for k, x in enumerate(nodes) if x.tag in HOLDERS and x.score > 1), key=lambda k: nodes[k].score, default=0)
    if not best or nodes[best].parent < 0:
        return [best]

    def alike(k: int) -> bool:
        x = nodes[k]
        if k == best:
            return True
        if furnished(x) or x.density > 0.3:
            return False
        return x.tag in ("h1", "h2") or x.score >= max(5.0, 0.2 * nodes[best].score) or x.tag == "p" and x.text >= 80

    return [k for k in nodes[nodes[best].parent].parts if isinstance(k, int) and alike(k)]


def dropped(node: Node, whole: int) -> bool:
    """Boxes and menus inside of the content: named so and without prose or not the larger part of it, or mostly links."""
    boxed = furnished(node) and (node.score <= 0 or node.text < 0.5 * whole)
    return boxed or node.tag in ("ul", "ol", "div", "section", "p") and node.n_links >= 3 and node.density > 0.6


def markdown(nodes: list[Node], roots: list[int], whole: int) -> str:
    """The text of some subtrees. What is to be written waits on a stack."""
    out: list[str] = []
    for root in roots:
        stack: list[tuple[int | str, bool]] = [(root, False)]
        while stack:
            x, pre = stack.pop()
            if isinstance(x, str):
                out.append(x if pre or x in ("\n\n", "\n", " |", "\n|") or x.startswith("\n") and x.strip("\n #-|") == "" else re.sub(r"\s+", " ", x))
                continue
            node = nodes[x]
            if x != root and (not node.text or dropped(node, whole)):
                continue
            tag, before, after = node.tag, "", ""
            if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
                before, after = "\n\n" + "#" * int(tag[1]) + " ", "\n\n"
            elif tag in LINES or tag in ("table", "dl"):
                before = after = "\n\n"
            elif tag in ("li", "dt", "dd"):
                before = "\n- "
            elif tag == "tr":
                before = "\n|"
            elif tag in ("td", "th"):
                before, after = " ", " |"
            inside = pre or tag == "pre"
            stack.append((after, True))
            stack += [(p, inside) for p in reversed(node.parts)]
            stack.append((before, True))
    return "".join(out)


def main_text(page: str | None) -> str:
    """The main content of one page as markdown."""
    if not page or not page.strip():
        return ""
    tree = Tree()
    tree.feed(page)
    tree.close()
    measured(tree.nodes)
    roots = chosen(tree.nodes)
    made = markdown(tree.nodes, roots, sum(tree.nodes[k].text for k in roots))
    lines = [re.sub(r"[ \t\r\f\v]+", " ", x).strip() for x in made.split("\n")]
    blocks, seen = [], set()
    for block in re.split(r"\n{2,}", "\n".join(lines)):
        block = block.strip("\n")
        if block and (len(block) < 40 or block not in seen):
            seen.add(block)
            blocks.append(block)
    return "\n\n".join(blocks)


@F.pandas_udf(T.StringType())
def main_content(raw: pd.Series) -> pd.Series:
    return raw.map(main_text)


@F.pandas_udf(T.StringType())
def decoded(raw: pd.Series) -> pd.Series:
    """Text without tags as a page shows it: references are read as the parser reads them, those without a semicolon too."""
    return raw.map(unescape, na_action="ignore")
