"""Corpus profiles: overviews, distributions, top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as t

MIN_EXPORT, MIN_LOAD = 150, 80


def overview(docs: DataFrame, text: str = "text", source: str = "source", kind: str = "type") -> DataFrame:
    """Records, valid records (with a text), and those without text, source or type."""
    lacks = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return docs.agg(F.count("*").alias("records"), F.count_if(~lacks(text)).alias("valid_records"), F.count_if(lacks(text)).alias("missing_text"), F.count_if(lacks(source)).alias("missing_source"), F.count_if(lacks(kind)).alias("missing_type"))


def type_distribution(docs: DataFrame, kind: str = "type") -> DataFrame:
    """Count and percentage of each normal type. The window runs over one row a type."""
    counts = docs.groupBy(t.normal_type(F.col(kind)).alias("type")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def length_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    sized = docs.select(F.length(body).alias("chars"), t.word_count(body).alias("words"))
    return sized.agg(F.avg("chars").alias("mean_chars"), F.min("chars").alias("min_chars"), F.max("chars").alias("max_chars"), F.avg("words").alias("mean_words"), F.median("words").alias("median_words"))


def median_chars(docs: DataFrame, kind: str = "type", text: str = "text") -> DataFrame:
    return docs.groupBy(t.normal_type(F.col(kind)).alias("type")).agg(F.median(t.safe_length(F.col(text))).alias("median_chars"))


def most_common(docs: DataFrame, key: Column, order: str, n: int, name: str) -> DataFrame:
    """The n most frequent keys; ties by first appearance."""
    counts = docs.groupBy(F.coalesce(F.nullif(key, F.lit("")), F.lit("missing")).alias(name)).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return counts.orderBy(F.desc("n"), "first_seen").limit(n)


def longest(docs: DataFrame, n: int, text: str = "text", source: str = "source", kind: str = "type") -> DataFrame:
    """The n longest records by length, source and type, all descending."""
    rows = docs.select(t.safe_length(F.col(text)).alias("length"), F.coalesce(F.col(source), F.lit("missing")).alias("source"), t.normal_type(F.col(kind)).alias("type"))
    return rows.orderBy(F.desc("length"), F.desc("source"), F.desc("type")).limit(n)


def extract_summary(docs: DataFrame, kind: str = "type") -> DataFrame:
    """Records whose type names pdf, and those that name html but not pdf."""
    low = F.lower(F.coalesce(F.col(kind), F.lit("")))
    return docs.agg(F.count("*").alias("total"), F.count_if(low.contains("pdf")).alias("n_pdf"), F.count_if(low.contains("html") & ~low.contains("pdf")).alias("n_html"))


def chunk_stats(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Least, most and whole mean length; nulls without chunks."""
    n = F.length(text)
    return chunks.agg(F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.floor(F.avg(n)).alias("mean_chars"))


def exportable(docs: DataFrame, text: str = "text", least: int = MIN_EXPORT) -> DataFrame:
    return docs.where(F.length(text) >= least)


def skip_reason(text: Column, least: int = MIN_LOAD) -> Column:
    """Why a record is not loaded: ``empty`` or ``short`` (of the repaired text); null if it is."""
    clean = t.repaired(t.stripped(F.coalesce(text, F.lit(""))))
    return F.when(t.is_blank(text), "empty").when(F.length(clean) < least, "short")


def loaded(records: DataFrame, text: str = "text", least: int = MIN_LOAD) -> DataFrame:
    """Records that are loaded, with their text stripped and repaired. Its filter stands before any Python step by construction."""
    return records.where(skip_reason(F.col(text), least).isNull()).withColumn(text, t.repaired(t.stripped(F.col(text))))


def skip_counts(records: DataFrame, text: str = "text", least: int = MIN_LOAD) -> DataFrame:
    why = skip_reason(F.col(text), least)
    return records.agg(F.count("*").alias("total"), F.count_if(why == "empty").alias("skipped_empty"), F.count_if(why == "short").alias("skipped_short"), F.count_if(why.isNull()).alias("loaded"))


def file_sizes(rows: DataFrame) -> DataFrame:
    """Bytes on disk of the files that a scan reads."""
    return rows.select("_metadata.file_path", "_metadata.file_size").distinct()
