"""Queries of the indexing stage: sections, parents, children, their audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import html, titles
from sparkloom.operators import chunks, embeddings, quality, structure, vectors
from sparkloom.plans.registry import query
from sparkloom.plans.web import CLEAN
from sparkloom.session import table

SECTIONS = f"""WITH c AS (SELECT page_id, {CLEAN} AS body FROM pages),
l AS (SELECT page_id, n, body_lines[n] AS line FROM (SELECT page_id, string_split(body, chr(10)) AS body_lines FROM c), generate_series(1, 100000) s(n) WHERE n <= len(body_lines)),
v AS (SELECT *, length(regexp_extract(line, '^(#{{1,5}})\\s+\\S', 1)) AS level FROM l),
s AS (SELECT *, count(*) FILTER (level > 0) OVER (PARTITION BY page_id ORDER BY n) - CASE WHEN first_value(level) OVER (PARTITION BY page_id ORDER BY n) > 0 THEN 1 ELSE 0 END AS section,
  last_value(CASE WHEN level = 1 THEN trim(regexp_replace(line, '^#{{1,5}}\\s+', '')) END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY n) AS h1 FROM v)
SELECT page_id, CAST(section AS INT) AS section, any_value(h1) AS h1, sha256(trim(string_agg(line, chr(10) ORDER BY n), E' \\t\\n\\r')) AS hash FROM s GROUP BY page_id, section"""


@query("header_sections", SECTIONS)
def header_sections(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", html.clean_restricted(F.col("html")).alias("text"))
    found = chunks.header_sections(pages, ["page_id"])
    return found.groupBy("page_id", "section").agg(F.any_value(F.get("headers", F.lit(0))).alias("h1"), F.any_value(F.sha2("text", 256)).alias("hash"))


def page_records(spark, sf) -> DataFrame:
    pages = table(spark, sf, "pages")
    return pages.select(F.col("url").alias("source"), titles.readable_title(F.col("url")).alias("title"), F.lit("html").alias("type"), F.col("page_id").alias("record_index"), html.clean_restricted(F.col("html")).alias("text"))


def document_records(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("source", F.col("source").alias("title"), F.when(F.col("doc_id") % 2 == 0, "html").otherwise("pdf").alias("type"), F.col("doc_id").alias("record_index"), "text")


@query("recursive_split_parents")
def recursive_split_parents(spark, sf):
    """Parents of all documents; even ids play html, odd ones pdf."""
    return chunks.parents(document_records(spark, sf)).select("parent_id", "source", "record_index", "chunk_pos", F.length("text").alias("length"))


@query("recursive_split_children")
def recursive_split_children(spark, sf):
    found = chunks.children(chunks.parents(document_records(spark, sf)))
    return found.select("child_id", "parent_id", "child_index", "short_doc", F.length("raw").alias("raw_length"), F.length("text").alias("length"))


@query("split_faults", "SELECT CASE doc_id % 2 WHEN 0 THEN 'html' ELSE 'pdf' END AS type, 0 AS too_long, 0 AS not_inside, 0 AS out_of_order, 0 AS lost_ends, 0 AS gaps FROM documents WHERE length(text) > 1000 GROUP BY 1")
def split_faults(spark, sf):
    """What the two splitters must not do, counted over all documents: chunks beyond their size, chunks that are no part of what was split, chunks out of order, beginnings or ends that are in none, and words between two chunks that are in neither."""
    given = document_records(spark, sf).where(F.length("text") > 1000).select("type", F.col("record_index").alias("id"), chunks.t.stripped(F.col("text")).alias("text"))
    parts = []
    for kind, cuts in (("parent", chunks.PARENT_CUTS), ("child", chunks.CHILD_CUTS)):
        size, overlap = (chunks.size_of(F.col("type"), f"{kind}{x}") for x in ("", "_overlap"))
        made = given.withColumns({"made": chunks.pieces_of(F.col("text"), size, overlap, cuts), "size": size})
        parts.append(made.select("type", "text", "made", "size"))
    return faults(parts[0].unionByName(parts[1]))


def faults(rows: DataFrame) -> DataFrame:
    """Faults of chunks (``made``) of texts, by type."""

    def look(parts):
        import pandas as pd

        for x in parts:
            out = []
            for kind, text, made, size in zip(x["type"], x["text"], x["made"], x["size"], strict=True):
                found = [0] * 5
                end = 0
                for n, chunk in enumerate(made):
                    found[0] += len(chunk) > size
                    # The last place that leaves nothing but white space out.
                    free = end + len(text[end:]) - len(text[end:].lstrip())
                    place = text.rfind(chunk, max(0, end - 2 * size), free + len(chunk))
                    if place < 0:
                        place = text.find(chunk, free)
                        found[4 if place >= 0 else 2 if chunk in text else 1] += 1
                    found[3] += n == 0 and bool(text[:place].strip())
                    end = max(end, place + len(chunk))
                found[3] += bool(text[end:].strip())
                out.append((kind, *found))
            yield pd.DataFrame(out, columns=["type", "too_long", "not_inside", "out_of_order", "lost_ends", "gaps"])

    names = ("too_long", "not_inside", "out_of_order", "lost_ends", "gaps")
    counted = rows.mapInPandas(look, "type string, " + ", ".join(f"{n} int" for n in names))
    return counted.groupBy("type").agg(*(F.sum(n).cast("int").alias(n) for n in names))


@query("page_children")
def page_children(spark, sf):
    """Children of all pages, whose headers give sections."""
    found = chunks.children(chunks.parents(page_records(spark, sf)))
    return found.select("child_id", "parent_id", "child_index", "headers", "text")


@query("chunk_audit")
def chunk_audit(spark, sf):
    """Summary of the child audit of all pages."""
    found = chunks.children(chunks.parents(page_records(spark, sf)))
    return quality.summary(quality.reports(found, quality.CHILD, "child", F.col("parent_id"), F.col("child_id")))


@query("structure_audit")
def structure_audit(spark, sf):
    parents = chunks.parents(page_records(spark, sf))
    return structure.integrity(parents, chunks.children(parents), "record_index")


@query("embed_documents")
def embed_documents(spark, sf):
    """Stand-in embeddings of all documents, for a vector collection."""
    return vectors.embedded(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "embedding")


@query("embed_trained")
def embed_trained(spark, sf):
    """Embeddings of all documents by a projection that is fitted on them here."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return embeddings.embedded(docs, embeddings.fitted(docs)).select("doc_id", "embedding")


@query("embed_trained_copies", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS twin FROM documents WHERE length(text) > 0 QUALIFY twin < doc_id")
def embed_trained_copies(spark, sf):
    """Documents whose text an earlier one has, and that one: their vectors are equal, and so are no others' of unlike texts."""
    docs = table(spark, sf, "documents").where(F.length("text") > 0).select("doc_id", "text")
    found = embeddings.embedded(docs, embeddings.fitted(docs)).select("doc_id", F.sha2("text", 256).alias("hash"), F.xxhash64("embedding").alias("vector"))
    first = found.groupBy("hash", "vector").agg(F.min("doc_id").alias("twin"))
    return found.join(first, ["hash", "vector"]).where("twin < doc_id").select("doc_id", "twin")
