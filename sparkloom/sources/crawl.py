"""Crawls over snapshots of pages (``url``, ``html``): breadth first, a bounded number of levels, each a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import html, urls
from sparkloom.functions import text as t
from sparkloom.operators import dedup
from sparkloom.session import cut


def links(pages: DataFrame, site: urls.Site = urls.Site(), keep: list[str] | None = None) -> DataFrame:
    """Links of each page, resolved, cut at the fragment, with their kind; links that carry too old a year are dropped."""
    found = pages.select(*(keep or []), F.col("url").alias("src_url"), F.explode(urls.hrefs(F.col("html"))).alias("href"))
    full = found.select(*(keep or []), "src_url", urls.absolute(F.col("src_url"), F.col("href")).alias("dst_url"))
    return full.where(urls.young_enough(F.col("dst_url"), site)).withColumn("kind", urls.link_kind(F.col("dst_url"), site))


def discard_reason(url, site: urls.Site):
    """Unit first, then extension; null if neither. Duplicates come third and are found by ``judged``."""
    unit = F.when(urls.wrong_unit(url, site), "discard_wrong_department") if site.unit_id else F.lit(None).cast("string")
    return F.coalesce(unit, F.when(urls.forbidden_extension(url), F.lit("discard_extension")))


def judged(pages: DataFrame, order: str, site: urls.Site = urls.Site()) -> DataFrame:
    """Pages with their ``discard_reason``; of the ones not discarded, all but the first of a canonical URL are duplicates. Ties go by the hash of the row; rows that are equal in everything share their reason."""
    place = F.struct(F.col(order).alias("a"), F.xxhash64(*pages.columns).alias("b"))
    rows = pages.withColumns({"discard_reason": discard_reason(F.col("url"), site), "_canon": urls.canonical(F.col("url")), "_place": place})
    first = rows.where("discard_reason IS NULL").groupBy("_canon").agg(F.min("_place").alias("_first"))
    told = rows.join(first, "_canon", "left")
    return told.withColumn("discard_reason", F.when(F.col("discard_reason").isNull() & (F.col("_place") > F.col("_first")), "discard_duplicate").otherwise(F.col("discard_reason"))).drop("_canon", "_place", "_first")


def reach(pages: DataFrame, seeds: DataFrame, depth: int, site: urls.Site = urls.Site(), inside: str | None = None, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Canonical URLs reached from the seeds (``url``) in at most ``depth`` levels, the seeds being level 1, with their level.

    ``inside``: prefix that reached URLs must have; ``excluded``: prefixes they may not have. Every level joins the new frontier with the link table and drops what was seen; the levels are checkpointed, so a lost executor costs one level.
    """
    edges = links(pages, site).select(urls.canonical(F.col("src_url")).alias("src"), urls.canonical(F.col("dst_url")).alias("dst")).distinct()
    for prefix in excluded:
        edges = edges.where(~F.col("dst").startswith(prefix))
    if inside:
        edges = edges.where(F.col("dst").startswith(inside))
    edges = edges.join(pages.select(urls.canonical(F.col("url")).alias("dst")).distinct(), "dst", "left_semi")
    seen = seeds.select(urls.canonical(F.col("url")).alias("url"), F.lit(1).alias("level")).distinct()
    seen = seen.join(pages.select(urls.canonical(F.col("url")).alias("url")).distinct(), "url", "left_semi")
    edges, seen = cut(edges), cut(seen)
    frontier = seen
    for level in range(2, depth + 1):
        near = frontier.select(F.col("url").alias("src")).join(edges, "src").select(F.col("dst").alias("url")).distinct()
        frontier = cut(near.join(seen.select("url"), "url", "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def crawled(pages: DataFrame, seeds: DataFrame, depth: int = 4, order: str = "page_id", site: urls.Site = urls.Site(), full: bool = True, inside: str | None = None, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Records of all pages reached, by links ``inside`` and not ``excluded`` as in ``reach``, and not discarded: cleaned text, source, type ``html``."""
    found = reach(pages, seeds, depth, site, inside, excluded)
    kept = judged(pages, order, site).where("discard_reason IS NULL").withColumn("_canon", urls.canonical(F.col("url")))
    kept = kept.join(found.select(F.col("url").alias("_canon"), "level"), "_canon").drop("_canon")
    return as_records(kept, order, full)


def as_records(pages: DataFrame, order: str, full: bool = True) -> DataFrame:
    clean = html.clean_html(F.col("html")) if full else html.clean_restricted(F.col("html"))
    rows = pages.select(clean.alias("text"), F.col("url").alias("source"), F.lit("html").alias("type"), F.col(order).alias("ord"))
    return rows.where(~t.is_blank(F.col("text")))


def structures(pages: DataFrame, found: DataFrame, order: str = "page_id") -> DataFrame:
    """Records of the structure pages that links point to."""
    wanted = found.where("kind = 'structure'").select(F.col("dst_url").alias("url")).distinct()
    return as_records(pages.join(wanted, "url", "left_semi"), order)


def staff_ids(pages: DataFrame, site: urls.Site = urls.Site()) -> DataFrame:
    hrefs = pages.select(F.explode(urls.hrefs(F.col("html"))).alias("href"))
    return hrefs.select(urls.staff_id(F.col("href"), site).alias("staff_id")).where("staff_id IS NOT NULL").distinct()


def staff_urls(ids: DataFrame, root: str, site: urls.Site = urls.Site()) -> DataFrame:
    """Two pages a member of staff: home and teaching."""
    at = lambda page: F.concat(F.lit(f"{root}/"), F.col("staff_id"), F.lit(f"/{page}"))
    return ids.select("staff_id", F.explode(F.array(at(site.staff_home), at(site.staff_teaching))).alias("url"))


def staff_homes(pages: DataFrame, wanted: DataFrame, order: str = "page_id", site: urls.Site = urls.Site()) -> DataFrame:
    """Records of staff homes that have a table."""
    homes = wanted.where(F.col("url").endswith(f"/{site.staff_home}")).select("url")
    return as_records(pages.join(homes, "url", "left_semi").where(F.col("html").rlike("(?i)<table")), order)


def staff_courses(pages: DataFrame, wanted: DataFrame, order: str = "page_id", site: urls.Site = urls.Site()) -> DataFrame:
    """Records of the course pages that teaching pages link to, of the oldest year or later; the teaching pages themselves are not stored."""
    teaching = pages.join(wanted.where(F.col("url").endswith(f"/{site.staff_teaching}")).select("url"), "url", "left_semi")
    out = links(teaching, site).where(F.col("dst_url").contains(f"{site.staff_teaching}?{site.year_key}=") & F.col("dst_url").contains("id=") & urls.surely_young(F.col("dst_url"), site))
    return as_records(pages.join(out.select(F.col("dst_url").alias("url")).distinct(), "url", "left_semi"), order)


def courses(pages: DataFrame, found: DataFrame, depth: int = 3, order: str = "page_id", site: urls.Site = urls.Site()) -> DataFrame:
    """Records of crawls from all course links; English pages are dropped."""
    seeds = found.where("kind = 'course'").select(F.col("dst_url").alias("url")).distinct()
    return crawled(pages, seeds, depth, order, site).where(~urls.is_english(F.col("source")))


def acquire(pages: DataFrame, seeds: DataFrame, staff_root: str, order: str = "page_id", site: urls.Site = urls.Site(), pdfs: DataFrame | None = None, inside: str | None = None, excluded: tuple[str, ...] = ()) -> DataFrame:
    """All phases in their order, then the two deduplications: the first phase that has a page keeps it.

    Only pages that are reached and not discarded are mined for links to structures and courses.
    """
    base = reach(pages, seeds, 4, site, inside, excluded).select(F.col("url").alias("_canon"))
    left = judged(pages, order, site).where("discard_reason IS NULL").withColumn("_canon", urls.canonical(F.col("url")))
    mined = cut(links(left.join(base, "_canon", "left_semi"), site))
    wanted = cut(staff_urls(staff_ids(pages, site), staff_root, site))
    first = crawled(pages, seeds, 4, order, site, inside=inside, excluded=excluded)
    parts = [first, structures(pages, mined, order), staff_homes(pages, wanted, order, site), staff_courses(pages, wanted, order, site), courses(pages, mined, 3, order, site)]
    if pdfs is not None:
        parts.append(pdfs.withColumn("ord", F.xxhash64("source")))
    whole = cut(dedup.phases(parts))
    return dedup.content_dedup(dedup.url_dedup(whole, "place"), "place")
