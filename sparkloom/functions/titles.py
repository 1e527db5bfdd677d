"""Readable titles of sources, and breadcrumbs of sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_TITLE = "Documento Sconosciuto"
#: Fixed list: path segments without meaning, besides numbers.
NOISE = ("id", "module", "row", "rescue", "page", "dettaglio")


def title_case(text: Column) -> Column:
    """Each run of letters with a capital first and the rest small, also after digits and marks."""
    runs = F.regexp_extract_all(text, F.lit("\\p{L}+|\\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))), "")


def readable_title(url: Column, overrides: dict[str, str] | None = None, noise: tuple[str, ...] = NOISE) -> Column:
    """Title of a source: an exact override; else the override of the first prefix that fits, followed by the path's meaningful segments.

    ``overrides`` maps URLs to titles, in order of precedence; ``noise`` has the segments to leave out, which a site may extend.
    """
    overrides, skipped = overrides or {}, f"(?i)^({'|'.join(noise)}|[0-9]+)$"
    path = F.regexp_replace(url, "https?://[^/]+", "")
    path = F.regexp_replace(F.substring_index(F.substring_index(path, "?", 1), "#", 1), "/+$", "")
    kept = F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.rlike(skipped) & ~s.startswith("__"))
    parts = F.transform(kept, lambda s: title_case(F.regexp_replace(F.regexp_replace(s, "(?i)\\.(pdf|html|htm|php|aspx)$", ""), "[-_]+", " ")))
    label, base = F.array_join(parts, " > "), F.lit(None).cast("string")
    for key, title in reversed(overrides.items()):
        base = F.when(url.startswith(key), F.lit(title)).otherwise(base)
    built = F.when(F.size(parts) == 0, F.coalesce(base, url)).when(base.isNull(), label).otherwise(F.concat(base, F.lit(" > "), label))
    for key, title in overrides.items():
        built = F.when(url == key, F.lit(title)).otherwise(built)
    return F.when(F.coalesce(url, F.lit("")).isin("", "unknown"), F.lit(UNKNOWN_TITLE)).otherwise(built)


def section_context(headers: Column, title: Column) -> Column:
    """Breadcrumb line of an array of headers: none that is empty, the title again, or a bare URL; empty if nothing is left."""
    norm = lambda x: F.lower(F.trim(x))
    kept = F.filter(headers, lambda h: (F.coalesce(h, F.lit("")) != "") & (norm(h) != norm(title)) & ~norm(h).startswith("http://") & ~norm(h).startswith("https://"))
    trail = F.array_join(kept, " > ")
    return F.when((F.size(kept) == 0) | (norm(trail) == norm(title)), F.lit("")).otherwise(F.concat(F.lit("\nSection: "), trail))
