"""Documents to parent and child chunks with deterministic ids.

Header sections and ids are DataFrame work; the recursive splitter is a vectorised Python function between
narrow steps. Every length is in characters.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as t
from sparkloom.functions import titles
from sparkloom.operators import dedup

#: Fixed lists: where to cut, best first.
PARENT_CUTS = ["\n\n", "\n", ". ", "! ", "? ", " ", ""]
CHILD_CUTS = ["\n\n", "\n", ". ", "! ", "? ", "; ", " ", ""]
#: Fixed value: the least length of a parent.
MIN_PARENT = 80


@dataclass(frozen=True)
class Sizes:
    parent: int
    parent_overlap: int
    child: int
    child_overlap: int


#: Sizes by document type; other types take those of html.
SIZES = {"html": Sizes(1250, 100, 400, 80), "pdf": Sizes(1700, 300, 500, 120)}


def size_of(kind: Column, field: str) -> Column:
    """A size of the type of each row: constants, so no join."""
    out = F.lit(getattr(SIZES["html"], field))
    for name, sizes in SIZES.items():
        out = F.when(kind == name, F.lit(getattr(sizes, field))).otherwise(out)
    return out


def split_text(text: str, size: int, overlap: int, cuts: list[str]) -> list[str]:
    """Chunks of at most ``size``, cut at the first of ``cuts`` that occurs, which stays at the start of what follows.

    Pieces are merged while they fit; a chunk begins with the last pieces of the one before, ``overlap`` characters at most. Pieces
    that are too long are cut by the cuts after it. Chunks are stripped, empty ones dropped.
    """
    at = next((i for i, c in enumerate(cuts) if c == "" or c in text), len(cuts) - 1)
    cut, rest = cuts[at], cuts[at + 1 :]
    if cut:
        parts = text.split(cut)
        pieces = [x for x in [parts[0], *(cut + p for p in parts[1:])] if x]
    else:
        pieces = list(text)
    out: list[str] = []
    first, total = 0, 0  # the chunk is ``pieces[first:k]``

    def flush(k: int) -> None:
        made = "".join(pieces[first:k]).strip()
        if made:
            out.append(made)

    for k, piece in enumerate(pieces):
        n = len(piece)
        if n > size and rest:
            flush(k)
            first, total = k + 1, 0
            out += split_text(piece, size, overlap, rest)
            continue
        if first < k and total + n > size:
            flush(k)
            while first < k and (total > overlap or total + n > size):
                total -= len(pieces[first])
                first += 1
        total += n
    flush(len(pieces))
    return out


def splitter(cuts: list[str]):
    @F.pandas_udf("array<string>")
    def split(text: pd.Series, size: pd.Series, overlap: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else split_text(x, int(s), int(o), cuts) for x, s, o in zip(text, size, overlap, strict=True)])

    return split


def pieces_of(text: Column, size: Column, overlap: Column, cuts: list[str]) -> Column:
    """The splitter's chunks of a long text, the text itself of a short one. Short texts don't go to Python: a condition around a Python function would not keep them from it, a null does."""
    return F.coalesce(splitter(cuts)(F.when(F.length(text) > size, text), size, overlap), F.array(text))


def header_sections(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Sections under markdown headers of level 1 to 5, headers kept in the text.

    Adds ``section`` (from 0), ``headers`` (five, null where not set) and the section's ``text``. The text is cut at lines that open or close a code fence, headers outside of fences get a mark with their level, and
    the text is split at the marks of each level inside the pieces of the level above: every step reads the text once, and nothing is shuffled. Sections without text but a header are kept. Null text is one empty section.
    """
    mark, kept = "\x01", "\x010"  # a mark that a text holds itself is written with a 0 after it
    whole = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(mark), F.lit(kept))
    first = whole.rlike("^ *(?:```|~~~)").cast("int")

    def marked(part: Column) -> Column:
        for level in range(1, 6):
            part = F.regexp_replace(part, f"(?md)^(#{{{level}}})(?=[^\\S\\n]+\\S)", f"{mark}{level}$1")
        return part

    fences = F.split(whole, "(?md)(?=^ *(?:```|~~~))", -1)
    rooted = F.array_join(F.transform(fences, lambda part, k: F.when((k + first) % 2 == 0, marked(part)).otherwise(part)), "")
    name = lambda part: F.trim(F.regexp_replace(F.replace(F.substring_index(part, "\n", 1), F.lit(kept), F.lit(mark)), "^#{1,5}\\s+", ""))

    def below(group: Column, level: int, above: list[Column]) -> Column:
        if level > 5:
            return F.array(F.struct(F.array(*above).alias("headers"), group.alias("body")))
        parts = F.split(group, f"{mark}{level}", -1)
        cut = F.transform(parts, lambda part, k: F.struct(F.when(k > 0, name(part)).alias("name"), part.alias("body")))
        # What stands before the first mark is no section where it is empty and marks follow.
        held = F.filter(cut, lambda x, k: (k > 0) | (x.body != "") | (F.size(parts) == 1))
        return F.flatten(F.transform(held, lambda x: below(x["body"], level + 1, [*above, x["name"]])))

    found = docs.select(*keys, rooted.alias("_rooted")).select(*keys, F.posexplode(below(F.col("_rooted"), 1, [])).alias("section", "s"))
    return found.select(*keys, "section", F.col("s.headers").alias("headers"), t.stripped(F.replace("s.body", F.lit(kept), F.lit(mark))).alias("text"))


def fixed_windows(docs: DataFrame, keys: list[str], size: int, overlap: int, text: str = "text") -> DataFrame:
    """Windows of ``size`` characters that overlap by ``overlap``: ``pos`` and ``chunk``."""
    n, step = F.length(F.col(text)), size - overlap
    last = F.greatest(F.ceil((n - overlap) / step).cast("int") - 1, F.lit(0))
    at = docs.where(n > 0).select(*keys, F.col(text).alias("_text"), F.explode(F.sequence(F.lit(0), last)).alias("pos"))
    return at.select(*keys, "pos", F.substring(F.col("_text"), F.col("pos") * step + 1, F.lit(size)).alias("chunk"))


def parent_id(source: Column, pos: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("::", source, pos.cast("string"), text), 256)


def child_id(parent: Column, index: Column, raw: Column) -> Column:
    return F.sha2(F.concat(parent, F.lit("::c"), index.cast("string"), F.lit("::"), raw), 256)


def with_document_line(text: Column, title: Column) -> Column:
    """``Document:`` line before the text; an older one gives way."""
    line = F.concat(F.lit("Document: "), title, F.lit("\n\n"))
    return F.when(text.startswith(line), text).otherwise(F.concat(line, F.regexp_replace(text, "(?s)^Document:.*?\n\n", "")))


def child_text(raw: Column, title: Column, context: Column) -> Column:
    return F.concat(F.lit("Document: "), title, context, F.lit("\nContent: "), raw)


def parents(docs: DataFrame) -> DataFrame:
    """Parent chunks of ``(source, title, type, record_index, text)`` with ids.

    A title line goes first, then sections by header, then the splitter for sections that are too long. Short chunks are dropped before positions are given. Positions count within a source
    by offsets, so one source's texts never meet in one task.
    """
    rooted = docs.withColumn("text", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.regexp_replace("text", f"^{t.WHITE}+", "")))
    keys = ["source", "title", "type", "record_index"]
    sections = header_sections(rooted, keys)
    size, overlap = size_of(F.col("type"), "parent"), size_of(F.col("type"), "parent_overlap")
    chunks = sections.select(*keys, "section", "headers", F.posexplode(pieces_of(F.col("text"), size, overlap, PARENT_CUTS)).alias("piece", "text")).where(F.length(t.stripped(F.col("text"))) >= MIN_PARENT)
    placed = dedup.running_position(chunks, "source", ["record_index", "section", "piece"])
    told = placed.withColumn("text", with_document_line(F.col("text"), F.col("title")))
    return told.withColumn("parent_id", parent_id(F.col("source"), F.col("chunk_pos"), F.col("text"))).drop("section", "piece")


def children(found: DataFrame) -> DataFrame:
    """Child chunks of parents: one for a short parent, else the splitter's; texts carry title and breadcrumb, ids are of the raw text. No shuffle."""
    line = F.concat(F.lit("Document: "), F.col("title"), F.lit("\n\n"))
    raw = F.when(F.col("text").startswith(line), F.substring(F.col("text"), F.length(line) + 1, F.length("text"))).otherwise(F.col("text"))
    size, overlap = size_of(F.col("type"), "child"), size_of(F.col("type"), "child_overlap")
    rows = found.withColumns({"_raw": raw, "_context": titles.section_context(F.col("headers"), F.col("title"))})
    rows = rows.withColumn("short_doc", F.length("_raw") <= size)
    pieces = pieces_of(F.col("_raw"), size, overlap, CHILD_CUTS)
    carried = [c for c in rows.columns if c not in ("text", "_raw")]
    out = rows.select(*carried, F.posexplode(pieces).alias("child_index", "raw"))
    return out.withColumns({"child_id": child_id(F.col("parent_id"), F.col("child_index"), F.col("raw")), "text": child_text(F.col("raw"), F.col("title"), F.col("_context"))}).drop("_context")
