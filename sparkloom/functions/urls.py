"""URL functions as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

AUTHORITY = "^([A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
#: Fixed list: files that are never pages.
FORBIDDEN = ("css", "js", "png", "jpg", "jpeg", "gif", "svg", "ico", "woff", "ttf", "json")


@dataclass(frozen=True)
class Site:
    """What is particular to a crawled site; all of it is configuration.

    ``unit_key`` and ``unit_id``: a query key that names an organisational unit, and the one to keep. ``course_host``, ``structure_path``:
    substrings of links to course and structure pages. ``year_key``, ``min_year``: oldest year of links that carry one. ``staff_path``, ``staff_key``: links to staff;
    ``staff_home``, ``staff_teaching``: last path segments of their two pages.
    """

    unit_key: str = "unit"
    unit_id: str = ""
    course_host: str = "courses."
    structure_path: str = "/structures"
    year_key: str = "year"
    min_year: int = 2021
    staff_path: str = "/people"
    staff_key: str = "person"
    staff_home: str = "home"
    staff_teaching: str = "teaching"


def canonical(url: Column) -> Column:
    """https, lower-case authority, no slash at the end; path case, query and fragment stay. For URLs with ``scheme://``."""
    cut = F.regexp_replace(F.trim(url), "/+$", "")
    rest = F.regexp_replace(cut, AUTHORITY, "")
    return F.concat(F.lit("https://"), F.lower(F.regexp_extract(cut, AUTHORITY, 2)), rest)


def source_domain(url: Column) -> Column:
    """Lower-case authority with port and user; null and empty are ``missing``, URLs without one ``local_or_unknown``."""
    found = F.lower(F.regexp_extract(url, AUTHORITY, 2))
    return F.when(F.coalesce(url, F.lit("")) == "", "missing").when(found == "", "local_or_unknown").otherwise(found)


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(without_fragment(url), "\\?(.*)$", 1)


def query_param(url: Column, key: str) -> Column:
    """First non-blank value of a query key, decoded; null without one."""
    pairs = F.filter(F.split(query_of(url), "&"), lambda x: x.startswith(f"{key}=") & (F.length(x) > len(key) + 1))
    raw = F.substring(F.get(pairs, 0), len(key) + 2, 1 << 30)
    return F.coalesce(F.try_url_decode(raw), raw)


def wrong_unit(url: Column, site: Site) -> Column:
    """A query key contains the unit key and none of that key's values is the unit to keep."""
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    key = lambda x: plain(F.substring_index(x, "=", 1))
    value = lambda x: plain(F.regexp_extract(x, "(?s)^[^=]*=(.*)$", 1))
    pairs = F.filter(F.split(query_of(url), "&"), lambda x: x.contains("=") & (value(x) != ""))
    named = F.filter(pairs, lambda x: F.lower(key(x)).contains(site.unit_key.lower()))
    return F.exists(named, lambda x: ~F.exists(named, lambda y: (key(y) == key(x)) & (value(y) == site.unit_id)))


def forbidden_extension(url: Column) -> Column:
    return F.lower(F.substring_index(url, "?", 1)).rlike(f"\\.({'|'.join(FORBIDDEN)})$")


def year_of(url: Column, site: Site) -> Column:
    return query_param(url, site.year_key).try_cast("int")


def young_enough(url: Column, site: Site) -> Column:
    """Links without a year, or with one that is no number, pass."""
    return F.coalesce(year_of(url, site) >= site.min_year, F.lit(True))


def surely_young(url: Column, site: Site) -> Column:
    """Links without a year, or with one that is no number, don't pass."""
    return F.coalesce(year_of(url, site) >= site.min_year, F.lit(False))


def is_english(url: Column) -> Column:
    low = F.lower(url)
    return low.contains("/en/") | low.endswith("/en")


def is_discarded(source: Column) -> Column:
    return F.lower(source).startswith("discard")


def absolute(base: Column, href: Column) -> Column:
    """``href`` resolved on ``base`` and cut at its fragment: absolute, ``//host``, ``/path``, ``?query``, empty and relative forms, dots included."""
    href = without_fragment(F.trim(href))
    bare = without_fragment(base)
    root = F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(F.substring(bare, F.length(root) + 1, F.lit(1 << 30)), "^[^?]*", 0)
    folder = F.regexp_extract(path, "^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    relative = F.concat(root, undotted(F.concat(folder, href)))
    return (
        F.when(href == "", bare)
        .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), href))
        .when(href.startswith("/"), F.concat(root, undotted(href)))
        .when(href.startswith("?"), F.concat(root, path, href))
        .otherwise(relative)
    )


def undotted(path: Column) -> Column:
    """``.`` and ``..`` segments removed from a path, its query kept."""
    body, tail = F.regexp_extract(path, "^[^?]*", 0), F.regexp_extract(path, "\\?.*$", 0)
    step = lambda out, x: F.when(x == ".", out).when(x == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(1)))).otherwise(F.array_append(out, x))
    clean = F.array_join(F.aggregate(F.split(body, "/"), F.array().cast("array<string>"), step), "/")
    clean = F.when(body.rlike("/\\.{1,2}$"), F.concat(clean, F.lit("/"))).otherwise(clean)
    return F.when(body.contains("./") | body.endswith("/.") | body.endswith(".."), F.concat(clean, tail)).otherwise(path)


def link_kind(url: Column, site: Site) -> Column:
    """``pdf``, ``course``, ``structure`` or null, in this order."""
    return F.when(F.lower(url).endswith(".pdf"), "pdf").when(url.contains(site.course_host), "course").when(url.contains(site.structure_path) & url.contains("id="), "structure")


def hrefs(html: Column) -> Column:
    """Values of href of all anchors, quoted or not."""
    found = F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, "^[\"']|[\"']$", ""))


def staff_id(href: Column, site: Site) -> Column:
    """Staff number of a link, zeros put before it to six digits; longer ones stay. Null for other links."""
    value = query_param(href, site.staff_key)
    padded = F.when(F.length(value) < 6, F.lpad(value, 6, "0")).otherwise(value)
    return F.when(href.contains(site.staff_path) & href.contains(f"{site.staff_key}="), padded)
