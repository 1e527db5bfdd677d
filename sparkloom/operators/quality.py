"""Chunk quality: rules to issues, issues to scores, and their aggregates. All of it is Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as t


@dataclass(frozen=True)
class Limits:
    """Lengths in characters: below ``least`` and above ``most`` is an error, outside the ideal range a warning."""

    least: int
    ideal_least: int
    ideal_most: int
    most: int


#: Limits, least counts and shares, penalties in ``score``, names and bounds in ``label``.
PARENT, CHILD = Limits(100, 400, 1600, 2000), Limits(80, 150, 550, 700)
MIN_WORDS, MIN_REPETITION, MIN_SENTENCES = 8, 0.6, 1
#: Issue: severity, code and message.
ISSUE = "struct<severity:string,code:string,message:string>"


def issue(severity: str, code: str, message: Column | str) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def metrics(chunks: DataFrame, text: str = "text") -> DataFrame:
    """The measurements that the rules need, each computed once."""
    body = F.coalesce(F.col(text), F.lit(""))
    return chunks.withColumns({
        "length": F.length(body), "word_count": t.word_count(body), "sentence_count": t.sentence_count(body),
        "repetition_ratio": t.repetition_ratio(body), "has_header": t.has_header(body), "has_section": t.has_section(body),
    })


def length_issue(limits: Limits) -> Column:
    n = F.col("length")
    said = lambda what, bound: F.concat(n.cast("string"), F.lit(f" chars, {what} {bound}"))
    return (
        F.when(n < limits.least, issue("error", "TOO_SHORT", said("below", limits.least)))
        .when(n < limits.ideal_least, issue("warning", "BELOW_IDEAL", said("below", limits.ideal_least)))
        .when(n > limits.most, issue("error", "TOO_LONG", said("above", limits.most)))
        .when(n > limits.ideal_most, issue("warning", "ABOVE_IDEAL", said("above", limits.ideal_most)))
    )


def issues(limits: Limits, kind: str, parent_id: Column, child_id: Column | None = None) -> Column:
    """Array of the issues of a chunk, in rule order. ``kind``: ``parent`` or ``child``."""
    lacks = lambda c: F.coalesce(c, F.lit("")) == ""
    rules = [
        length_issue(limits),
        F.when(F.col("word_count") < MIN_WORDS, issue("error", "FEW_WORDS", "too few words")),
        F.when(F.col("sentence_count") < MIN_SENTENCES, issue("warning", "NO_SENTENCE", "no whole sentence")),
        F.when(F.col("repetition_ratio") < MIN_REPETITION, issue("warning", "REPETITIVE", "many repeated words")),
        F.when(lacks(parent_id), issue("error", "NO_PARENT_ID", "no parent id")),
    ]
    if kind == "child":
        rules += [
            F.when(lacks(child_id), issue("error", "NO_CHILD_ID", "no child id")),
            F.when(~F.col("has_header") & ~F.col("has_section"), issue("info", "NO_CONTEXT_INJECTION", "neither header nor section line")),
        ]
    return F.filter(F.array(*[r.cast(ISSUE) for r in rules]), lambda x: x.isNotNull())


def score(found: Column) -> Column:
    """100 less 15 an error and 5 any other issue; 0 at least."""
    errors = F.size(F.filter(found, lambda x: x.severity == "error"))
    return F.greatest(F.lit(0), 100 - 15 * errors - 5 * (F.size(found) - errors))


def label(points: Column) -> Column:
    return F.when(points >= 85, "Ottimo").when(points >= 65, "Discreto").when(points >= 40, "Scarso").otherwise("Critico")


def reports(chunks: DataFrame, limits: Limits, kind: str, parent_id: Column, child_id: Column | None = None, text: str = "text") -> DataFrame:
    """Each chunk with its measurements, issues, score and label."""
    found = metrics(chunks, text).withColumn("issues", issues(limits, kind, parent_id, child_id))
    return found.withColumn("score", score(F.col("issues"))).withColumn("quality_label", label(F.col("score")))


def issue_counts(found: DataFrame, top: int | None = None) -> DataFrame:
    """Issues by severity and code, most frequent first; ``top`` keeps the first."""
    counts = found.select(F.explode("issues").alias("i")).groupBy(F.concat_ws(":", "i.severity", "i.code").alias("issue")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "issue").limit(top) if top else counts


def severity_totals(found: DataFrame) -> DataFrame:
    """Issues by severity, and chunks with at least one of it."""
    n = lambda s: F.size(F.filter("issues", lambda x: x.severity == s))
    return found.agg(*[e for s in ("error", "warning", "info") for e in (F.coalesce(F.sum(n(s)), F.lit(0)).cast("long").alias(f"{s}s"), F.count_if(n(s) > 0).alias(f"chunks_with_{s}"))])


def stats(values: DataFrame, col: str, by: list[str] | None = None, digits: int | None = 1) -> DataFrame:
    """Count, min, max, mean, median and sample deviation, rounded; the deviation of one value is 0."""
    c = F.col(col)
    r = (lambda x: F.round(x, digits)) if digits is not None else (lambda x: x)
    return values.groupBy(*(by or [])).agg(
        F.count(c).alias("count"), r(F.min(c).cast("double")).alias("min"), r(F.max(c).cast("double")).alias("max"), r(F.avg(c)).alias("mean"), r(F.median(c)).alias("median"),
        F.when(F.count(c) > 0, r(F.coalesce(F.stddev_samp(c), F.lit(0.0)))).alias("stdev"),
    )


def summary(found: DataFrame, source: str = "source", top: int = 10) -> DataFrame:
    """One row: all aggregates of a set of reports, as nested columns."""
    ranked = lambda df, key: df.orderBy(F.desc("n"), key).limit(top).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), F.col(key).alias("key"), F.col("n").alias("count")))).alias("x")).select(F.transform("x", lambda v: F.struct(v.key.alias("key"), v["count"].alias("count"))).alias("x"))
    lengths, scores = stats(found, "length").select(F.struct("*").alias("length_stats")), stats(found, "score").select(F.struct("*").alias("score_stats"))
    labels = found.groupBy("quality_label").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("quality_label", "n")))).alias("quality_dist"))
    out = severity_totals(found)
    for part in (lengths, scores, labels, ranked(issue_counts(found), "issue").withColumnRenamed("x", "top_issues"), ranked(found.groupBy(source).agg(F.count("*").alias("n")), source).withColumnRenamed("x", "top_sources")):
        out = out.join(F.broadcast(part))  # one row each
    return out


def worst(found: DataFrame, k: int, order: str) -> DataFrame:
    """The k lowest scores, ties by the order column."""
    return found.orderBy("score", order).limit(k)
