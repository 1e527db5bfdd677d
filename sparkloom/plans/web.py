"""Queries over page snapshots: URLs, filters, links, cleaning, crawls."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import content, html, titles, urls
from sparkloom.operators import dedup, profile
from sparkloom.plans.registry import query
from sparkloom.session import cut, scratch, table
from sparkloom.sources import crawl, recrawl

#: The snapshot's own patterns, in place of a site's.
SITE = urls.Site(unit_key="page", unit_id="1", course_host="/about", structure_path="/docs", year_key="page", min_year=2)

AUTH = r"lower(regexp_extract({0}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1))"
CANON = r"('https://' || lower(regexp_extract(regexp_replace(trim({0}), '/+$', ''), '^([A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 2)) || regexp_replace(regexp_replace(trim({0}), '/+$', ''), '^([A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', ''))"
#: Pages, and each again under http and with a slash, so that canonical URLs collide.
VARIANTS = "v AS (SELECT page_id AS ord, url FROM pages UNION ALL SELECT page_id + 1000000, regexp_replace(url, '^https?:', 'http:') || '/' FROM pages)"


def variants(spark, sf):
    pages = table(spark, sf, "pages")
    again = pages.select((F.col("page_id") + 1_000_000).alias("ord"), F.concat(F.regexp_replace("url", "^https?:", "http:"), F.lit("/")).alias("url"))
    return pages.select(F.col("page_id").alias("ord"), "url").unionByName(again)


@query("url_canonical", f"WITH {VARIANTS} SELECT ord, {CANON.format('url')} AS canon FROM v")
def url_canonical(spark, sf):
    return variants(spark, sf).select("ord", urls.canonical(F.col("url")).alias("canon"))


@query("url_dedup", f"WITH {VARIANTS}, c AS (SELECT *, row_number() OVER (PARTITION BY {CANON.format('url')} ORDER BY ord) AS n FROM v) SELECT ord, url FROM c WHERE n = 1")
def url_dedup(spark, sf):
    return dedup.url_dedup(variants(spark, sf), "ord", "url")


@query("dedup_accounting", f"WITH {VARIANTS}, t AS (SELECT v.ord, v.url, p.html FROM v JOIN pages p ON v.ord % 1000000 = p.page_id), a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {CANON.format('url')} ORDER BY ord) AS n FROM t) WHERE n = 1), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha256(html) ORDER BY ord) AS k FROM a) WHERE k = 1) SELECT (SELECT count(*) FROM t) AS n_before, (SELECT count(*) FROM a) AS n_after_url, (SELECT count(*) FROM b) AS n_after_content")
def dedup_accounting(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("_p"), "html")
    whole = variants(spark, sf).withColumn("_p", F.col("ord") % 1_000_000).join(pages, "_p").drop("_p")
    once = dedup.url_dedup(whole, "ord", "url")
    return dedup.accounting(whole, once, dedup.content_dedup(once, "ord", "html"))


@query("domain_counts", f"SELECT CASE WHEN coalesce(url, '') = '' THEN 'missing' WHEN {AUTH.format('url')} = '' THEN 'local_or_unknown' ELSE {AUTH.format('url')} END AS domain, count(*) AS n, min(page_id) AS first_seen FROM pages GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 10")
def domain_counts(spark, sf):
    return profile.most_common(table(spark, sf, "pages"), urls.source_domain(F.col("url")), "page_id", 10, "domain")


HREFS = r"""h AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)', 1)) AS raw FROM pages),
g AS (SELECT page_id, url, split_part(trim(regexp_replace(raw, '^["'']|["'']$', '', 'g')), '#', 1) AS href FROM h),
l AS (SELECT page_id, url AS src_url, CASE WHEN href = '' THEN split_part(url, '#', 1) WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN href LIKE '/%' THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href ELSE '?' END AS dst_url FROM g)"""


@query("link_extract", f"WITH {HREFS} SELECT src_url, dst_url, count(*) AS n FROM l GROUP BY 1, 2")
def link_extract(spark, sf):
    """All links, with how often each occurs; no year filter."""
    found = crawl.links(table(spark, sf, "pages"), urls.Site(year_key="no such key"))
    return found.groupBy("src_url", "dst_url").agg(F.count("*").alias("n"))


@query("link_classify", f"WITH {HREFS}, k AS (SELECT CASE WHEN lower(dst_url) LIKE '%.pdf' THEN 'pdf' WHEN contains(dst_url, '/about') THEN 'course' WHEN contains(dst_url, '/docs') AND contains(dst_url, 'id=') THEN 'structure' ELSE 'other' END AS kind, dst_url FROM l) SELECT kind, count(*) AS n, count(DISTINCT dst_url) AS n_urls FROM k GROUP BY kind")
def link_classify(spark, sf):
    found = crawl.links(table(spark, sf, "pages"), urls.Site(course_host="/about", structure_path="/docs", year_key="no such key"))
    return found.groupBy(F.coalesce("kind", F.lit("other")).alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("dst_url").alias("n_urls"))


PARAM = r"nullif(regexp_extract(split_part(url, '#', 1), '[?&]page=([^&]*)', 1), '')"


@query("url_query_param", f"SELECT page_id, {PARAM} AS page FROM pages")
def url_query_param(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.query_param(F.col("url"), "page").alias("page"))


@query("year_filter", f"SELECT page_id, coalesce(try_cast({PARAM} AS INT) >= 2, true) AS on_links, coalesce(try_cast({PARAM} AS INT) >= 2, false) AS on_courses FROM pages")
def year_filter(spark, sf):
    """The page number plays the year."""
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", urls.young_enough(url, SITE).alias("on_links"), urls.surely_young(url, SITE).alias("on_courses"))


@query("crawl_discard", f"""WITH {VARIANTS}, r AS (SELECT ord, url, CASE WHEN {PARAM} IS NOT NULL AND {PARAM} <> '1' THEN 'discard_wrong_department' WHEN regexp_matches(lower(split_part(url, '?', 1)), '\\.(css|js|png|jpg|jpeg|gif|svg|ico|woff|ttf|json)$') THEN 'discard_extension' END AS why, {CANON.format('url')} AS canon FROM v)
SELECT ord, coalesce(why, CASE WHEN row_number() OVER (PARTITION BY canon, why IS NULL ORDER BY ord) > 1 THEN 'discard_duplicate' END) AS discard_reason FROM r""")
def crawl_discard(spark, sf):
    return crawl.judged(variants(spark, sf), "ord", SITE).select("ord", "discard_reason")


@query("english_filter", "SELECT page_id FROM pages WHERE NOT (lower(url) LIKE '%/en/%' OR lower(url) LIKE '%/en')")
def english_filter(spark, sf):
    return table(spark, sf, "pages").where(~urls.is_english(F.col("url"))).select("page_id")


@query("staff_expand", "SELECT vec_id, 'https://staff.example/' || CASE WHEN length(CAST(vec_id AS VARCHAR)) < 6 THEN lpad(CAST(vec_id AS VARCHAR), 6, '0') ELSE CAST(vec_id AS VARCHAR) END || '/' || p AS url FROM embeddings, (VALUES ('home'), ('didattica')) t(p)")
def staff_expand(spark, sf):
    """Ids of vectors play staff numbers in links."""
    site = urls.Site(staff_teaching="didattica")
    href = F.concat(F.lit("https://a.example/people?person="), F.col("vec_id").cast("string"))
    ids = table(spark, sf, "embeddings").select("vec_id", urls.staff_id(href, site).alias("staff_id"))
    return ids.join(crawl.staff_urls(ids, "https://staff.example", site), "staff_id").select("vec_id", "url")


def clean_sql() -> str:
    x = "coalesce(html, '')"
    step = lambda x, p, r: f"regexp_replace({x}, '{p}', '{r}', 'g')"
    x = step(x, "(?is)<!--.*?-->", "")
    for tag in ("script", "style", "head", "nav", "header"):
        x = step(x, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    x = step(x, r"(?is)<footer\b.*", "")
    x = step(x, r"[ \t\r\n]+", " ")
    for level in range(1, 6):
        x = f"regexp_replace({x}, '(?i) ?<h{level}\\b[^>]*> ?', chr(10) || '{'#' * level} ', 'g')"
    x = f"regexp_replace({x}, '(?i) ?</?({html.BLOCKS})\\b[^>]*> ?', chr(10), 'g')"
    x = step(x, "<[^>]*>", "")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{plain}')"
    x = f"regexp_replace(regexp_replace({x}, ' +', ' ', 'g'), '\\n[ \\n]*', chr(10), 'g')"
    return f"trim(regexp_replace({x}, '^[ \\n]+|[ \\n]+$', '', 'g'))"


CLEAN = clean_sql()


@query("html_clean_restricted", f"SELECT page_id, sha256({CLEAN}) AS hash, length({CLEAN}) AS length FROM pages")
def html_clean_restricted(spark, sf):
    clean = html.clean_restricted(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.sha2(clean, 256).alias("hash"), F.length(clean).alias("length"))


@query("html_clean")
def html_clean(spark, sf):
    return crawl.as_records(table(spark, sf, "pages"), "page_id")


@query("page_main_content")
def page_main_content(spark, sf):
    """The main content of all pages."""
    text = content.main_content(F.col("html"))
    return table(spark, sf, "pages").select("page_id", text.alias("text"))


LETTERS = r"regexp_replace(regexp_extract(html, '{0}', 1, 's'), '&\w+;|<[^>]*>|[^\p{{L}}]', '', 'g')"
ARTICLE, BOX, FOOTER = (LETTERS.format(x) for x in ("<article[^>]*>(.*)</article>", '<div class="ad">(.*?)</div>', "<footer>(.*?)</footer>"))


@query("main_content_kept", f"SELECT page_id, contains(html, '<h1') AS keeps_title, {BOX} <> '' AND contains({ARTICLE}, {BOX}) AS keeps_box, {FOOTER} <> '' AND contains({ARTICLE}, {FOOTER}) AS keeps_footer FROM pages")
def main_content_kept(spark, sf):
    """Whether a page's main content has its title, its advertisement and its footer, by their letters. The last two only where the article says the same.

    A title without letters has none to lose.
    """
    letters = lambda x: F.regexp_replace(x, "[^\\p{L}]", "")
    rows = table(spark, sf, "pages").select("page_id", "html", letters(content.main_content(F.col("html"))).alias("text"))
    part = lambda pattern: letters(content.decoded(F.regexp_replace(F.regexp_extract("html", pattern, 1), "<[^>]*>", "")))
    parts = {"title": "(?s)<h1[^>]*>(.*?)</h1>", "box": '(?s)<div class="ad">(.*?)</div>', "footer": "(?s)<footer>(.*?)</footer>"}
    rows = rows.withColumns({name: part(pattern) for name, pattern in parts.items()})
    has = lambda name: (F.col(name) != "") & F.col("text").contains(F.col(name))
    title = F.col("html").contains("<h1") & F.col("text").contains(F.col("title"))
    return rows.select("page_id", title.alias("keeps_title"), has("box").alias("keeps_box"), has("footer").alias("keeps_footer"))


PATH = r"list_filter(string_split(regexp_replace(split_part(split_part(regexp_replace(url, 'https?://[^/]+', ''), '?', 1), '#', 1), '/+$', ''), '/'), lambda s: s <> '' AND NOT regexp_matches(s, '(?i)^(id|module|row|rescue|page|dettaglio|[0-9]+)$') AND NOT starts_with(s, '__'))"
TITLED = r"array_to_string(list_transform({0}, lambda s: array_to_string(list_transform(regexp_extract_all(regexp_replace(regexp_replace(s, '(?i)\.(pdf|html|htm|php|aspx)$', ''), '[-_]+', ' ', 'g'), '[A-Za-z]+|[^A-Za-z]+'), lambda r: upper(r[1]) || lower(substr(r, 2))), '')), ' > ')"


@query("title_from_url", f"SELECT page_id, CASE WHEN len({PATH}) = 0 THEN CASE WHEN url LIKE 'https://%' THEN 'Secure' ELSE url END WHEN url LIKE 'https://%' THEN 'Secure > ' || {TITLED.format(PATH)} ELSE {TITLED.format(PATH)} END AS title FROM pages")
def title_from_url(spark, sf):
    title = titles.readable_title(F.col("url"), {"https://": "Secure"})
    return table(spark, sf, "pages").select("page_id", title.alias("title"))


@query("section_breadcrumb", f"SELECT page_id, chr(10) || 'Section: ' || lang || ' > Part ' || page_id AS context FROM (SELECT page_id, split_part(url, '/', 3) AS lang FROM pages)")
def section_breadcrumb(spark, sf):
    """Headers are the host, the title again, a bare URL and a part; the title is the URL."""
    headers = F.array(F.split_part("url", F.lit("/"), F.lit(3)), F.upper("url"), F.col("url"), F.concat(F.lit("Part "), F.col("page_id").cast("string")), F.lit(None).cast("string"))
    return table(spark, sf, "pages").select("page_id", titles.section_context(headers, F.col("url")).alias("context"))


@query("bfs_reach")
def bfs_reach(spark, sf):
    """Pages within four levels of all pages: every page is a seed, so what links reach is reached at level 1 already."""
    pages = table(spark, sf, "pages")
    return crawl.reach(pages, pages.select("url"), 4)


LINKED = f"""WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages), k AS (SELECT DISTINCT {CANON.format('url')} AS url FROM pages),
b AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages),
g AS (SELECT DISTINCT {CANON.format('a.url')} AS src, {CANON.format('b.url')} AS dst FROM pages a, n, b WHERE b.page_id IN ((7 * a.page_id + 3) % n, (11 * a.page_id + 5) % n)),
r AS (SELECT DISTINCT {CANON.format('url')} AS url, 1 AS level FROM pages WHERE page_id % 100 = 0 UNION SELECT dst, level + 1 FROM r JOIN g ON src = r.url JOIN k ON k.url = dst WHERE level < 4)
SELECT url, CAST(min(level) AS INT) AS level FROM r GROUP BY url"""


def linked(spark, sf):
    """Pages of the snapshot, each with two links to others of them."""
    pages = cut(table(spark, sf, "pages").select("page_id", "url"))
    n = pages.count()
    to = pages.select(F.col("page_id").alias("to"), F.col("url").alias("href"))
    wanted = pages.select("page_id", "url", F.explode(F.array((7 * F.col("page_id") + 3) % n, (11 * F.col("page_id") + 5) % n)).alias("to"))
    return wanted.join(to, "to").groupBy("page_id", "url").agg(F.array_join(F.transform(F.collect_list("href"), lambda h: F.concat(F.lit("<a href='"), h, F.lit("'>x</a>"))), " ").alias("html"))


@query("bfs_levels", LINKED)
def bfs_levels(spark, sf):
    """A crawl that goes somewhere: the snapshot's links leave it, so pages get links to one another; every hundredth page is a seed."""
    pages = linked(spark, sf)
    return crawl.reach(pages, pages.where("page_id % 100 = 0").select("url"), 4)


@query("crawl_in_turn", LINKED)
def crawl_in_turn(spark, sf):
    """The same from two snapshots in turn, the pages of even ids and then all of them, of which only the others are new. Pages that share a URL are told apart by their ids."""
    pages, path = cut(linked(spark, sf)), scratch(spark, "crawl")
    seeds = pages.where("page_id % 100 = 0").select("url")
    recrawl.update(pages.where("page_id % 2 = 0"), seeds, path, key="page_id")
    recrawl.update(pages, seeds, path, key="page_id")
    return recrawl.reached(spark, path)


@query("acquire")
def acquire(spark, sf):
    """All crawl phases from all pages, deduplicated."""
    pages = table(spark, sf, "pages")
    return crawl.acquire(pages, pages.select("url"), "https://staff.example").select("source", "type", "phase", F.length("text").alias("length"))
