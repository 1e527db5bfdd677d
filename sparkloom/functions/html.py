"""HTML to text: a native restricted cleaner, and a structural one on the standard parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCKS = "p|div|section|article|main|ul|ol|li|table|tr|blockquote|pre|br|hr|h1|h2|h3|h4|h5|h6"


def clean_restricted(raw: Column) -> Column:
    """Markdown-like text by patterns alone: scripts, styles, comments and page furniture out, headers to ``#``, blocks to lines, tags out, five entities decoded.

    It treats no nesting; a footer goes with all that follows it.
    """
    x = F.coalesce(raw, F.lit(""))
    x = F.regexp_replace(x, "(?is)<!--.*?-->", "")
    for tag in ("script", "style", "head", "nav", "header"):
        x = F.regexp_replace(x, f"(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>", "")
    x = F.regexp_replace(x, "(?is)<footer\\b.*", "")
    x = F.regexp_replace(x, "[ \\t\\r\\n]+", " ")
    for level in range(1, 6):
        x = F.regexp_replace(x, f"(?i) ?<h{level}\\b[^>]*> ?", "\n" + "#" * level + " ")
    x = F.regexp_replace(x, f"(?i) ?</?({BLOCKS})\\b[^>]*> ?", "\n")
    x = F.regexp_replace(x, "<[^>]*>", "")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(plain))
    x = F.regexp_replace(F.regexp_replace(x, " +", " "), "\n[ \n]*", "\n")
    return F.trim(F.regexp_replace(x, "^[ \n]+|[ \n]+$", ""))


VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSING = frozenset("p div section article main ul ol table blockquote pre footer header nav aside form figure".split())
DROPPED = frozenset(("script", "style", "title", "noscript", "template", "header", "nav", "aside", "form", "button", "iframe", "svg"))
LINES = frozenset(("p", "div", "section", "article", "main", "ul", "ol", "blockquote", "pre", "hr", "br", "figure"))


class Cleaner(HTMLParser):
    """Main text as markdown: headers, lists and tables kept, links and pictures as their text, page furniture out.

    A footer (the element, a division with that id, or with a class that contains the word) is dropped with all its following siblings.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []  # tag, and whether what follows inside is dropped
        self.out: list[str] = []
        self.cells: list[str] | None = None

    def hidden(self) -> bool:
        return any(x for _, x in self.open)

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag in ("br", "hr") and not self.hidden():
                self.out.append("\n")
            return
        if self.open and self.open[-1][0] == "p" and (tag in CLOSING or tag[0] == "h" and tag[1:].isdigit()):
            self.handle_endtag("p")  # blocks end a paragraph that was left open
        at = dict(attrs)
        foot = tag == "footer" or tag == "div" and ((at.get("id") or "") in ("footer", "subfooter") or "footer" in (at.get("class") or ""))
        if foot and self.open:
            self.open[-1] = (self.open[-1][0], True)  # siblings that follow are dropped with it
        self.open.append((tag, foot or tag in DROPPED))
        if self.hidden():
            return
        if tag[0] == "h" and tag[1:].isdigit():
            self.out.append("\n\n" + "#" * int(tag[1:]) + " ")
        elif tag in LINES:
            self.out.append("\n\n")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "tr":
            self.out.append("\n|")
        elif tag in ("td", "th"):
            self.out.append(" ")

    def handle_endtag(self, tag):
        if tag not in [t for t, _ in self.open]:
            return
        while self.open:
            top, _ = self.open[-1]
            shown = not self.hidden()
            self.open.pop()
            if shown and top in ("td", "th"):
                self.out.append(" |")
            elif shown and (top in LINES or top[0] == "h" and top[1:].isdigit()):
                self.out.append("\n\n")
            if top == tag:
                break

    def handle_data(self, data):
        if not self.hidden():
            self.out.append(" ".join(data.split(" ")).replace("\n", " ") if not any(t == "pre" for t, _ in self.open) else data)


def cleaned_text(raw: str | None) -> str:
    """The text of one page. Paragraphs that repeat inside it are given once."""
    if not raw or not raw.strip():
        return ""
    parser = Cleaner()
    parser.feed(raw)
    parser.close()
    lines = [" ".join(x.split()) for x in "".join(parser.out).split("\n")]
    blocks, seen = [], set()
    for block in "\n".join(lines).split("\n\n"):
        block = block.strip("\n")
        if block and (len(block) < 40 or block not in seen):
            seen.add(block)
            blocks.append(block)
    return "\n\n".join(blocks).strip()


@F.pandas_udf(T.StringType())
def clean_html(raw: pd.Series) -> pd.Series:
    return raw.map(cleaned_text)


