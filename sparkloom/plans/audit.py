"""Queries of the chunk audit and the corpus profile, over documents taken as chunks or records."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import mojibake
from sparkloom.functions import text as t
from sparkloom.operators import chunks, dedup, heavy, profile, quality, structure
from sparkloom.plans.registry import query
from sparkloom.session import scratch, table
from sparkloom.sources import buckets

WORDS = r"len(list_filter(string_split_regex({0}, '\s+'), lambda x: x <> ''))"
TERMS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


def metrics_sql(source: str, key: str) -> str:
    terms = TERMS.format("text")
    return rf"""SELECT {key}, length(text) AS length, CAST({WORDS.format('text')} AS INT) AS word_count,
      CAST(greatest(1, len(string_split_regex(text, '[.!?]+'))) AS INT) AS sentence_count,
      CASE WHEN len({terms}) = 0 THEN 0.0 ELSE len(list_distinct({terms})) / len({terms}) END AS repetition_ratio,
      regexp_matches(text, '(?m)^#{{1,5}}\s+\S') AS has_header, contains(text, 'Section:') AS has_section FROM {source}"""


def issues_sql(source: str, key: str, limits: quality.Limits, child: bool) -> str:
    """One row an issue."""
    rules = [
        f"SELECT {key}, CASE WHEN length < {limits.least} THEN 'error:TOO_SHORT' WHEN length < {limits.ideal_least} THEN 'warning:BELOW_IDEAL' WHEN length > {limits.most} THEN 'error:TOO_LONG' WHEN length > {limits.ideal_most} THEN 'warning:ABOVE_IDEAL' END AS issue FROM m",
        f"SELECT {key}, CASE WHEN word_count < 8 THEN 'error:FEW_WORDS' END FROM m",
        f"SELECT {key}, CASE WHEN repetition_ratio < 0.6 THEN 'warning:REPETITIVE' END FROM m",
    ]
    if child:
        rules.append(f"SELECT {key}, CASE WHEN NOT has_header AND NOT has_section THEN 'info:NO_CONTEXT_INJECTION' END FROM m")
    return f"WITH m AS ({metrics_sql(source, key)}), i AS (SELECT * FROM ({' UNION ALL '.join(rules)}) WHERE issue IS NOT NULL)"


SCORED = (
    issues_sql("documents", "doc_id", quality.PARENT, False)
    + ", e AS (SELECT doc_id, count(*) FILTER (issue LIKE 'error:%') AS e, count(*) FILTER (issue LIKE 'warning:%') AS w, count(*) AS n FROM i GROUP BY doc_id)"
    + ", s AS (SELECT m.doc_id, m.length, coalesce(e.e, 0) AS e, coalesce(e.w, 0) AS w, greatest(0, 100 - 15 * coalesce(e.e, 0) - 5 * (coalesce(e.n, 0) - coalesce(e.e, 0))) AS score FROM m LEFT JOIN e ON m.doc_id = e.doc_id)"
)
LABELLED = "CASE WHEN score >= 85 THEN 'Ottimo' WHEN score >= 65 THEN 'Discreto' WHEN score >= 40 THEN 'Scarso' ELSE 'Critico' END"
ROUNDED = "round(CAST(min({0}) AS DOUBLE), 1) AS min, round(CAST(max({0}) AS DOUBLE), 1) AS max, round(avg({0}), 1) AS mean, round(median({0}), 1) AS median, round(coalesce(stddev_samp({0}), 0), 1) AS stdev"


def as_parents(spark, sf):
    """Documents taken as parent chunks that carry an id."""
    return quality.reports(table(spark, sf, "documents"), quality.PARENT, "parent", F.col("doc_id").cast("string"))


def as_children(spark, sf):
    ids = F.col("item_id").cast("string")
    return quality.reports(table(spark, sf, "benchmark"), quality.CHILD, "child", ids, ids)


@query("text_metrics", metrics_sql("documents", "doc_id"))
def text_metrics(spark, sf):
    return quality.metrics(table(spark, sf, "documents")).select("doc_id", "length", "word_count", "sentence_count", "repetition_ratio", "has_header", "has_section")


def told(found, key):
    return found.select(key, F.explode("issues").alias("i")).select(key, F.concat_ws(":", "i.severity", "i.code").alias("issue"))


@query("chunk_issues", issues_sql("documents", "doc_id", quality.PARENT, False) + " SELECT doc_id, issue FROM i")
def chunk_issues(spark, sf):
    return told(as_parents(spark, sf), "doc_id")


@query("child_issues", issues_sql("benchmark", "item_id", quality.CHILD, True) + " SELECT item_id, issue FROM i")
def child_issues(spark, sf):
    return told(as_children(spark, sf), "item_id")


@query("issue_counts", issues_sql("documents", "doc_id", quality.PARENT, False) + " SELECT issue, count(*) AS n FROM i GROUP BY issue ORDER BY n DESC, issue LIMIT 10")
def issue_counts(spark, sf):
    return quality.issue_counts(as_parents(spark, sf), top=10)


@query("quality_score", SCORED + f" SELECT doc_id, CAST(score AS INT) AS score, {LABELLED} AS quality_label FROM s")
def quality_score(spark, sf):
    return as_parents(spark, sf).select("doc_id", "score", "quality_label")


@query("quality_distribution", SCORED + f" SELECT {LABELLED} AS quality_label, count(*) AS n FROM s GROUP BY 1")
def quality_distribution(spark, sf):
    return as_parents(spark, sf).groupBy("quality_label").agg(F.count("*").alias("n"))


@query("worst_chunks", SCORED + " SELECT doc_id, CAST(score AS INT) AS score FROM s ORDER BY score, doc_id LIMIT 200")
def worst_chunks(spark, sf):
    return quality.worst(as_parents(spark, sf).select("doc_id", "score"), 200, "doc_id")


@query("severity_totals", SCORED + " SELECT CAST(sum(e) AS BIGINT) AS errors, count(*) FILTER (e > 0) AS chunks_with_error, CAST(sum(w) AS BIGINT) AS warnings, count(*) FILTER (w > 0) AS chunks_with_warning FROM s")
def severity_totals(spark, sf):
    return quality.severity_totals(as_parents(spark, sf)).drop("infos", "chunks_with_info")


@query("length_stats", f"SELECT count(*) AS count, {ROUNDED.format('length(text)')} FROM documents")
def length_stats(spark, sf):
    return quality.stats(table(spark, sf, "documents").select(F.length("text").alias("n")), "n")


@query("quality_summary")
def quality_summary(spark, sf):
    return quality.summary(as_parents(spark, sf))


TOLD = "coalesce((SELECT string_agg({0} || '=' || n, ',' ORDER BY n DESC, {0}) FROM (SELECT {0}, count(*) AS n FROM {1} GROUP BY 1 ORDER BY n DESC, {0} LIMIT 10)), '')"


@query("quality_summary_columns", SCORED + f""" SELECT CAST(sum(e) AS BIGINT) AS errors, count(*) FILTER (e > 0) AS chunks_with_error, CAST(sum(w) AS BIGINT) AS warnings, count(*) FILTER (w > 0) AS chunks_with_warning,
  round(CAST(min(length) AS DOUBLE), 1) AS least_length, round(avg(length), 1) AS mean_length, round(median(length), 1) AS median_length, round(coalesce(stddev_samp(length), 0), 1) AS stdev_length,
  round(CAST(min(score) AS DOUBLE), 1) AS least_score, round(avg(score), 1) AS mean_score, round(median(score), 1) AS median_score,
  {TOLD.format('issue', 'i')} AS top_issues, {TOLD.format('source', 'documents')} AS top_sources,
  (SELECT string_agg(quality_label || '=' || n, ',' ORDER BY quality_label) FROM (SELECT {LABELLED} AS quality_label, count(*) AS n FROM s GROUP BY 1)) AS labels FROM s""")
def quality_summary_columns(spark, sf):
    """The nested summary as flat columns."""
    listed = lambda c: F.array_join(F.transform(c, lambda v: F.concat(v.key, F.lit("="), v["count"].cast("string"))), ",")
    found = quality.summary(as_parents(spark, sf))
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("quality_dist")), lambda v: F.concat(v.key, F.lit("="), v.value.cast("string"))), ",")
    lengths = [F.col(f"length_stats.{k}").alias(f"{n}_length") for k, n in (("min", "least"), ("mean", "mean"), ("median", "median"), ("stdev", "stdev"))]
    scores = [F.col(f"score_stats.{k}").alias(f"{n}_score") for k, n in (("min", "least"), ("mean", "mean"), ("median", "median"))]
    return found.select("errors", "chunks_with_error", "warnings", "chunks_with_warning", *lengths, *scores, listed("top_issues").alias("top_issues"), listed("top_sources").alias("top_sources"), labels.alias("labels"))


@query("kb_overview", "SELECT count(*) AS records, count(*) FILTER (coalesce(text,'') <> '') AS valid_records, count(*) FILTER (coalesce(text,'') = '') AS missing_text, count(*) FILTER (coalesce(source,'') = '') AS missing_source, count(*) FILTER (coalesce(lang,'') = '') AS missing_type FROM documents")
def kb_overview(spark, sf):
    return profile.overview(table(spark, sf, "documents"), kind="lang")


@query("type_distribution", "SELECT coalesce(nullif(lower(trim(lang)), ''), 'missing') AS type, count(*) AS n, 100 * count(*) / sum(count(*)) OVER () AS percent FROM documents GROUP BY 1")
def type_distribution(spark, sf):
    return profile.type_distribution(table(spark, sf, "documents"), kind="lang")


@query("median_chars_by_type", "SELECT coalesce(nullif(lower(trim(lang)), ''), 'missing') AS type, median(coalesce(length(text), 0)) AS median_chars FROM documents GROUP BY 1")
def median_chars_by_type(spark, sf):
    return profile.median_chars(table(spark, sf, "documents"), kind="lang")


@query("text_length_stats", f"WITH m AS (SELECT length(text) AS c, {WORDS.format('text')} AS w FROM documents) SELECT avg(c) AS mean_chars, min(c) AS min_chars, max(c) AS max_chars, avg(w) AS mean_words, median(w) AS median_words FROM m")
def text_length_stats(spark, sf):
    return profile.length_stats(table(spark, sf, "documents"))


KINDED = "SELECT CASE doc_id % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'PDF' ELSE lang END AS type FROM documents"


@query("extract_summary", f"SELECT count(*) AS total, count(*) FILTER (lower(type) LIKE '%pdf%') AS n_pdf, count(*) FILTER (lower(type) LIKE '%html%' AND lower(type) NOT LIKE '%pdf%') AS n_html FROM ({KINDED})")
def extract_summary(spark, sf):
    """The table has no types, so they are derived: by turns html, PDF and the language."""
    kind = F.when(F.col("doc_id") % 3 == 0, "html").when(F.col("doc_id") % 3 == 1, "PDF").otherwise(F.col("lang"))
    return profile.extract_summary(table(spark, sf, "documents").select(kind.alias("type")))


@query("longest_records", "SELECT coalesce(length(text), 0) AS length, source, lower(trim(lang)) AS type FROM documents ORDER BY 1 DESC, 2 DESC, 3 DESC LIMIT 20")
def longest_records(spark, sf):
    return profile.longest(table(spark, sf, "documents"), 20, kind="lang")


@query("source_top", "SELECT coalesce(nullif(source, ''), 'missing') AS source, count(*) AS n, min(doc_id) AS first_seen FROM documents GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 10")
def source_top(spark, sf):
    return profile.most_common(table(spark, sf, "documents"), F.col("source"), "doc_id", 10, "source")


@query("source_top_two_pass", "SELECT coalesce(nullif(source, ''), 'missing') AS source, count(*) AS n, min(doc_id) AS first_seen FROM documents GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 10")
def source_top_two_pass(spark, sf):
    """The same through summaries: only candidates are counted."""
    return heavy.most_common(table(spark, sf, "documents").select("source", "doc_id"), F.col("source"), "doc_id", 10, "source")


@query("word_top", f"SELECT term, count(*) AS n, min(doc_id) AS first_seen FROM (SELECT doc_id, unnest({TERMS.format('text')}) AS term FROM documents) GROUP BY 1 ORDER BY n DESC, first_seen, term LIMIT 20")
def word_top(spark, sf):
    """The most frequent words of all texts: far more keys than counters. Where counts and first documents are equal, the word itself comes last in the order."""
    rows = table(spark, sf, "documents").select("doc_id", F.explode(t.terms(F.col("text"))).alias("term"))
    found = heavy.most_common(rows.withColumn("at", F.struct("doc_id", "term")), F.col("term"), "at", 20, "term")
    return found.select("term", "n", F.col("first_seen.doc_id").alias("first_seen"))


@query("chunk_length_stats", "SELECT min(length(text)) AS min_chars, max(length(text)) AS max_chars, CAST(floor(avg(length(text))) AS BIGINT) AS mean_chars FROM documents")
def chunk_length_stats(spark, sf):
    return profile.chunk_stats(table(spark, sf, "documents"))


@query("min_length_filter", "SELECT doc_id, source FROM documents WHERE length(text) >= 150")
def min_length_filter(spark, sf):
    return profile.exportable(table(spark, sf, "documents")).select("doc_id", "source")


@query("load_skip_reasons", r"""WITH r AS (SELECT CASE WHEN trim(text, E' \t\n\r') = '' THEN 'empty' WHEN length(trim(text, E' \t\n\r')) < 80 THEN 'short' END AS why FROM documents)
SELECT count(*) AS total, count(*) FILTER (why = 'empty') AS skipped_empty, count(*) FILTER (why = 'short') AS skipped_short, count(*) FILTER (why IS NULL) AS loaded FROM r""")
def load_skip_reasons(spark, sf):
    return profile.skip_counts(table(spark, sf, "documents"))


@query("content_dedup", "SELECT doc_id, sha256(text) AS hash FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def content_dedup(spark, sf):
    return dedup.content_dedup(table(spark, sf, "documents"), "doc_id").select("doc_id", dedup.content_hash().alias("hash"))


WINDOWS = """w AS (SELECT doc_id, pos, substr(text, CAST(pos * 320 + 1 AS BIGINT), 400) AS chunk FROM (SELECT doc_id, text, unnest(generate_series(0, CAST(greatest(ceil((length(text) - 80) / 320) - 1, 0) AS BIGINT))) AS pos FROM documents WHERE length(text) > 0))"""


def windows(spark, sf):
    return chunks.fixed_windows(table(spark, sf, "documents"), ["doc_id"], 400, 80)


@query("fixed_window_chunks", f"WITH {WINDOWS} SELECT doc_id, CAST(pos AS INT) AS pos, sha256(chunk) AS hash, length(chunk) AS length FROM w")
def fixed_window_chunks(spark, sf):
    return windows(spark, sf).select("doc_id", "pos", F.sha2("chunk", 256).alias("hash"), F.length("chunk").alias("length"))


@query("short_parent_passthrough", "SELECT doc_id, length(text) <= 400 AS short_doc, CASE WHEN length(text) <= 400 THEN 1 END AS n_children FROM documents")
def short_parent_passthrough(spark, sf):
    short = F.length("text") <= chunks.size_of(F.lit("html"), "child")
    return table(spark, sf, "documents").select("doc_id", short.alias("short_doc"), F.when(short, F.size(F.array("text"))).alias("n_children"))


@query("short_parent_children", "SELECT doc_id, length(text) <= 400 AS short_doc, CASE WHEN length(text) <= 400 THEN 1 END AS n_children, CASE WHEN length(text) <= 400 THEN length(text) END AS length FROM documents WHERE length(text) > 0")
def short_parent_children(spark, sf):
    """Documents as parents through the child splitter: a short one is its only child, whole. What longer ones give is in ``split_faults``."""
    docs = table(spark, sf, "documents").where(F.length("text") > 0)
    given = docs.select("doc_id", "text", F.lit("title").alias("title"), F.lit("html").alias("type"), F.array(F.lit("title")).alias("headers"), F.col("doc_id").cast("string").alias("parent_id"))
    found = chunks.children(given).groupBy("doc_id", "short_doc").agg(F.count("*").alias("n"), F.max(F.length("raw")).alias("longest"))
    return found.select("doc_id", "short_doc", F.when(F.col("short_doc"), F.col("n").cast("int")).alias("n_children"), F.when(F.col("short_doc"), F.col("longest")).alias("length"))


IDS = f"WITH {WINDOWS}, p AS (SELECT d.source, w.doc_id, w.pos, w.chunk, row_number() OVER (PARTITION BY d.source ORDER BY w.doc_id, w.pos) - 1 AS chunk_pos FROM w JOIN documents d ON w.doc_id = d.doc_id), t AS (SELECT *, 'Document: ' || source || chr(10) || chr(10) || chunk AS told FROM p), q AS (SELECT *, sha256(source || '::' || chunk_pos || '::' || told) AS parent_id FROM t)"


def identified(spark, sf):
    """Windows as parents: title lines, positions within the source, ids."""
    rows = chunks.fixed_windows(table(spark, sf, "documents"), ["doc_id", "source"], 400, 80)
    rows = dedup.running_position(rows, "source", ["doc_id", "pos"]).withColumn("told", chunks.with_document_line(F.col("chunk"), F.col("source")))
    return rows.withColumn("parent_id", chunks.parent_id(F.col("source"), F.col("chunk_pos"), F.col("told")))


@query("chunk_ids", IDS + " SELECT doc_id, CAST(pos AS INT) AS pos, chunk_pos, parent_id, sha256(parent_id || '::c0::' || chunk) AS child_id FROM q")
def chunk_ids(spark, sf):
    return identified(spark, sf).select("doc_id", "pos", "chunk_pos", "parent_id", chunks.child_id(F.col("parent_id"), F.lit(0), F.col("chunk")).alias("child_id"))


@query("child_enrich", IDS + " SELECT doc_id, CAST(pos AS INT) AS pos, 'Document: ' || source || chr(10) || 'Section: Part ' || pos || chr(10) || 'Content: ' || chunk AS text FROM q")
def child_enrich(spark, sf):
    from sparkloom.functions import titles

    rows = identified(spark, sf)
    context = titles.section_context(F.array(F.col("source"), F.concat(F.lit("Part "), F.col("pos").cast("string")), F.lit("https://a.example")), F.col("source"))
    return rows.select("doc_id", "pos", chunks.child_text(F.col("chunk"), F.col("source"), context).alias("text"))


@query("orphan_children", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_children(spark, sf):
    """Documents are the children, labels the parents, which cover some of them."""
    return structure.orphans(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id", "source")


@query("childless_parents", "SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE length(text) > 1500)")
def childless_parents(spark, sf):
    return structure.childless(table(spark, sf, "labels"), table(spark, sf, "documents").where(F.length("text") > 1500), "doc_id").select("doc_id", "quality")


@query("children_per_parent_stats", f"WITH {WINDOWS}, n AS (SELECT doc_id, count(*) AS n FROM w WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY doc_id) SELECT count(*) AS count, {ROUNDED.format('n')} FROM n")
def children_per_parent_stats(spark, sf):
    return quality.stats(structure.children_per_parent(windows(spark, sf), table(spark, sf, "labels"), "doc_id"), "n_children")


@query("child_ratio", f"WITH {WINDOWS} SELECT (SELECT count(*) FROM w) AS n_children, (SELECT count(*) FROM labels) AS n_parents, (SELECT count(*) FROM w) / greatest((SELECT count(*) FROM labels), 1) AS ratio")
def child_ratio(spark, sf):
    return structure.child_ratio(windows(spark, sf), table(spark, sf, "labels"))


def overlap_sql(source: str, key: str, order: str, text: str) -> str:
    ws = r"list_filter(string_split_regex({0}, '\s+'), lambda x: x <> '')"
    return f"""p AS (SELECT {key}, {order}, {ws.format(text)} AS a, {ws.format(f'lead({text}) OVER (PARTITION BY {key} ORDER BY {order})')} AS b, lead({text}) OVER (PARTITION BY {key} ORDER BY {order}) AS nxt FROM {source}),
    q AS (SELECT {key}, {order}, list_distinct(list_slice(a, greatest(len(a) - 80, 0) + 1, len(a))) AS x, list_distinct(list_slice(b, 1, 80)) AS y FROM p WHERE nxt IS NOT NULL),
    o AS (SELECT {key}, {order}, CASE WHEN least(len(x), len(y)) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / least(len(x), len(y)) END AS overlap FROM q)"""


@query("consecutive_overlap", f"WITH {WINDOWS}, {overlap_sql('w', 'doc_id', 'pos', 'chunk')} SELECT doc_id, CAST(pos AS INT) AS pos, overlap FROM o")
def consecutive_overlap(spark, sf):
    return structure.window_overlap(table(spark, sf, "documents"), ["doc_id"], 400, 80)


@query("turn_overlap", f"WITH {overlap_sql('conversations', 'conv_id', 'turn', 'text')} SELECT conv_id, turn, overlap FROM o")
def turn_overlap(spark, sf):
    return structure.consecutive_overlap(table(spark, sf, "conversations"), "conv_id", "turn")


@query("overlap_summary", f"WITH {WINDOWS}, {overlap_sql('w', 'doc_id', 'pos', 'chunk')} SELECT count(*) AS pairs, count(*) FILTER (overlap > 0.4) AS high_pairs, round(min(overlap), 6) AS min, round(max(overlap), 6) AS max, round(avg(overlap), 6) AS mean, round(median(overlap), 6) AS median, round(coalesce(stddev_samp(overlap), 0), 6) AS stdev FROM o")
def overlap_summary(spark, sf):
    found = structure.overlap_summary(consecutive_overlap(spark, sf))
    return found.select("pairs", "high_pairs", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "median", "stdev")])


OLD, NEW = "SELECT doc_id, source, text FROM documents WHERE doc_id % 3 <> 0", "SELECT doc_id, 'new' AS source, lower(text) AS text FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0"


@query("key_merge_upsert", f"WITH n AS ({NEW}), o AS ({OLD}) SELECT doc_id, source, sha256(text) AS hash FROM (SELECT * FROM n UNION ALL SELECT * FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n))")
def key_merge_upsert(spark, sf):
    """Old rows are those of ids that 3 does not divide; new ones, of ids that 2 or 3 divides, replace or join them. So every document is on a side."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    new = docs.where("doc_id % 2 = 0 OR doc_id % 3 = 0").select("doc_id", F.lit("new").alias("source"), F.lower("text").alias("text"))
    return dedup.upsert(docs.where("doc_id % 3 <> 0"), new, "doc_id").select("doc_id", "source", F.sha2("text", 256).alias("hash"))


@query("bucketed_merge", f"WITH n AS ({NEW}), o AS ({OLD}) SELECT doc_id, source, sha256(text) AS hash FROM (SELECT * FROM n UNION ALL SELECT * FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n))")
def bucketed_merge(spark, sf):
    """The same merge into a table in buckets: the old rows are its first version, the new ones its second, and a third batch repeats some of them."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    path = scratch(spark, "table")
    buckets.merge(docs.where("doc_id % 3 <> 0"), path, "doc_id", "source")
    new = docs.where("doc_id % 2 = 0 OR doc_id % 3 = 0").select("doc_id", F.lit("new").alias("source"), F.lower("text").alias("text"))
    buckets.merge(new, path, "doc_id", "source")
    buckets.merge(new.where("doc_id % 5 = 0"), path, "doc_id", "source")
    return buckets.read(spark, path).select("doc_id", "source", F.sha2("text", 256).alias("hash"))


@query("overwrite_by_key", "SELECT source, max(doc_id) AS doc_id, arg_max(lang, doc_id) AS lang FROM documents GROUP BY source")
def overwrite_by_key(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id", "lang")
    return dedup.last_by(docs, "source", "doc_id")


@query("debug_sample", f"WITH {WINDOWS}, f AS (SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 5) SELECT CAST(f.doc_id AS VARCHAR) AS parent_id, length(f.text) AS parent_length, CASE WHEN length(f.text) > 300 THEN substr(f.text, 1, 300) || '…' ELSE f.text END AS parent_preview, CAST(count(w.pos) AS INT) AS num_children, sum(length(w.chunk)) AS child_chars FROM f LEFT JOIN w ON f.doc_id = w.doc_id GROUP BY f.doc_id, f.text")
def debug_sample(spark, sf):
    docs = table(spark, sf, "documents")
    parents = docs.select(F.col("doc_id").cast("string").alias("parent_id"), "source", F.col("source").alias("title"), "text", "doc_id")
    kids = windows(spark, sf).select(F.col("doc_id").cast("string").alias("parent_id"), F.col("pos").alias("child_index"), F.sha2("chunk", 256).alias("child_id"), F.col("chunk").alias("text"))
    found = structure.debug_sample(parents, kids, "doc_id", 5)
    return found.select("parent_id", "parent_length", "parent_preview", "num_children", F.aggregate("children", F.lit(0).cast("long"), lambda a, c: a + c.length).alias("child_chars"))


@query("encoding_repair", "SELECT doc_id, sha256(text) AS hash FROM documents")
def encoding_repair(spark, sf):
    """Each text misread as Latin-1 and repaired; where its bytes allow that, it is as it was. Texts beyond Latin-1 stay."""
    docs = table(spark, sf, "documents")
    misread = F.decode(F.encode(F.col("text"), "UTF-8"), "ISO-8859-1")
    return docs.select("doc_id", F.sha2(t.repaired(misread), 256).alias("hash"))


@query("encoding_repair_segments", "SELECT doc_id, sha256(text || ' ' || text) AS hash FROM documents")
def encoding_repair_segments(spark, sf):
    """A good and a misread copy in one text: even ids are misread as Windows-1252, odd ones as Latin-1, multiples of 3 twice."""
    docs = table(spark, sf, "documents")
    latin = lambda x: F.decode(F.encode(x, "UTF-8"), "ISO-8859-1")
    # Windows-1252 differs from Latin-1 in bytes 80 to 9F alone; where it has no character, the byte itself stands.
    odd = [(chr(b), c) for c, b in mojibake.READERS["cp1252"].items() if 0x80 <= b <= 0x9F and ord(c) != b]
    windows_1252 = lambda x: F.translate(latin(x), "".join(a for a, _ in odd), "".join(b for _, b in odd))
    once = F.when(F.col("doc_id") % 2 == 0, windows_1252(F.col("text"))).otherwise(latin(F.col("text")))
    bad = F.when(F.col("doc_id") % 3 == 0, latin(once)).otherwise(once)
    return docs.select("doc_id", F.sha2(mojibake.repaired(F.concat("text", F.lit(" "), bad)), 256).alias("hash"))
