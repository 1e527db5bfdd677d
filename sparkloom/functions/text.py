"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as Python's ``str.split`` has it: the Unicode property and the four separators 1C to 1F.
WHITE = "(?U)[\\s\\x1c-\\x1f]"


def words(text: Column) -> Column:
    """Words between white space; leading and trailing white space makes none."""
    return F.filter(F.split(text, f"{WHITE}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def sentence_count(text: Column) -> Column:
    """Parts between runs of end marks, an empty last one included; at least 1."""
    return F.greatest(F.lit(1), F.size(F.split(text, "[.!?]+")))


def terms(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))


def repetition_ratio(text: Column) -> Column:
    """Distinct terms over all terms; 0 without terms."""
    found = terms(text)
    return F.when(F.size(found) == 0, F.lit(0.0)).otherwise(F.size(F.array_distinct(found)) / F.size(found))


def has_header(text: Column) -> Column:
    """A markdown header of level 1 to 5 at the start of a line."""
    return text.rlike("(?m)^#{1,5}\\s+\\S")


def has_section(text: Column) -> Column:
    return text.contains("Section:")


def overlap_ratio(a: Column, b: Column, span: int = 80) -> Column:
    """Shared distinct words of the last ``span`` of a and the first of b, over the smaller distinct count; 0 if either has none."""
    wa, wb = words(a), words(b)
    tail = F.array_distinct(F.slice(wa, F.greatest(F.size(wa) - span, F.lit(0)) + 1, F.lit(span)))
    head = F.array_distinct(F.slice(wb, F.lit(1), F.lit(span)))
    least = F.least(F.size(tail), F.size(head))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(tail, head)) / least)


def normal_type(kind: Column) -> Column:
    """Trimmed and lower-cased; null and blank are ``missing``."""
    return F.coalesce(F.nullif(F.lower(F.trim(kind)), F.lit("")), F.lit("missing"))


def safe_length(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0))


def is_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(f"^{WHITE}*$")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def pdf_clean(text: Column) -> Column:
    """Picture placeholders (a fixed pattern) out; line and paragraph separators to line ends."""
    text = F.regexp_replace(text, r"\*\*==> picture \[[^\]]*\] intentionally omitted <==\*\*\s*", "")
    return F.replace(F.replace(text, F.lit("\u2028"), F.lit("\n")), F.lit("\u2029"), F.lit("\n\n"))


def repaired(text: Column) -> Column:
    """Text that was UTF-8 read as Latin-1, read right; any other text stays.

    A text is re-read only if all its characters are bytes and they are well-formed UTF-8, so nothing can fail.
    """
    multi = "[\\u00c2-\\u00df][\\u0080-\\u00bf]|\\u00e0[\\u00a0-\\u00bf][\\u0080-\\u00bf]|[\\u00e1-\\u00ec\\u00ee\\u00ef][\\u0080-\\u00bf]{2}|\\u00ed[\\u0080-\\u009f][\\u0080-\\u00bf]|\\u00f0[\\u0090-\\u00bf][\\u0080-\\u00bf]{2}|[\\u00f1-\\u00f3][\\u0080-\\u00bf]{3}|\\u00f4[\\u0080-\\u008f][\\u0080-\\u00bf]{2}"
    fits = text.rlike(f"^(?:[\\u0000-\\u007f]|{multi})*+$")
    return F.when(fits, F.decode(F.encode(F.when(fits, text), "ISO-8859-1"), "UTF-8")).otherwise(text)
