"""Parent-child integrity: orphans, childless parents, children a parent, overlap of neighbours, debug samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as t
from sparkloom.operators import quality


def orphans(children: DataFrame, parents: DataFrame, key: str = "parent_id") -> DataFrame:
    """Children whose parent is null or unknown."""
    return children.join(parents.select(key).distinct(), key, "left_anti")


def childless(parents: DataFrame, children: DataFrame, key: str = "parent_id") -> DataFrame:
    return parents.join(children.select(key).distinct(), key, "left_anti")


def children_per_parent(children: DataFrame, parents: DataFrame, key: str = "parent_id") -> DataFrame:
    """Children of each known parent that has any."""
    return children.join(parents.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.count("*").alias("n_children"))


def child_ratio(children: DataFrame, parents: DataFrame) -> DataFrame:
    counts = children.agg(F.count("*").alias("n_children")).join(F.broadcast(parents.agg(F.count("*").alias("n_parents"))))
    return counts.withColumn("ratio", F.col("n_children") / F.greatest("n_parents", F.lit(1)))


def consecutive_overlap(chunks: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """Overlap of each chunk with the next one of its parent."""
    nxt = Window.partitionBy(key).orderBy(order)
    pairs = chunks.select(key, order, F.col(text).alias("_a"), F.lead(text).over(nxt).alias("_b")).where(F.col("_b").isNotNull())
    return pairs.select(key, order, t.overlap_ratio(F.col("_a"), F.col("_b")).alias("overlap"))


def window_overlap(docs: DataFrame, keys: list[str], size: int, overlap: int, text: str = "text") -> DataFrame:
    """The same for the fixed windows of each row's text, where both windows are parts of one text: nothing is shuffled. Texts of one window, empty and null ones have no pairs."""
    n, step = F.length(F.col(text)), size - overlap
    last = F.greatest(F.ceil((n - overlap) / step).cast("int") - 1, F.lit(0))
    at = docs.where(n > 0).select(*keys, F.col(text).alias("_text"), F.explode(F.filter(F.sequence(F.lit(0), last), lambda k: k < last)).alias("pos"))
    window = lambda k: F.substring(F.col("_text"), k * step + 1, F.lit(size))
    return at.select(*keys, "pos", t.overlap_ratio(window(F.col("pos")), window(F.col("pos") + 1)).alias("overlap"))


def overlap_summary(pairs: DataFrame, high: float = 0.4) -> DataFrame:
    """Pairs, those above ``high``, and the statistics of the overlap."""
    return pairs.agg(F.count_if(F.col("overlap") > high).alias("high_pairs")).join(F.broadcast(quality.stats(pairs, "overlap", digits=None).withColumnRenamed("count", "pairs")))


def integrity(parents: DataFrame, children: DataFrame, order: str, sample: int = 10) -> DataFrame:
    """One row: totals, orphans, childless parents with a sample of ids in order, children a parent, overlap."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    none = childless(parents, children)
    ids = none.orderBy(order).limit(sample).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "parent_id"))), lambda x: x.parent_id).alias("childless_sample"))
    per = quality.stats(children_per_parent(children, parents), "n_children").select(F.struct("*").alias("children_per_parent"))
    over = overlap_summary(consecutive_overlap(children.join(parents.select("parent_id").distinct(), "parent_id", "left_semi"), "parent_id", "child_index")).select(F.struct("*").alias("overlap"))
    out = one(parents, "total_parents")
    for part in (one(children, "total_children"), one(orphans(children, parents), "orphan_children"), one(none, "childless_parents"), ids, per, over):
        out = out.join(F.broadcast(part))  # one row each
    return out


def preview(text: str, n: int):
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(F.col(text))


def debug_sample(parents: DataFrame, children: DataFrame, order: str, n: int = 5) -> DataFrame:
    """The first n parents with previews and their children, nested. Children are gathered for n parents only."""
    first = parents.orderBy(order).limit(n).select("parent_id", "source", "title", F.length("text").alias("parent_length"), preview("text", 300).alias("parent_preview"), F.col(order).alias("_ord"))
    kids = children.select("parent_id", "child_index", "child_id", F.length("text").alias("length"), preview("text", 150).alias("preview"))
    held = first.select("parent_id").join(kids, "parent_id").groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("child_index", "child_id", "length", "preview"))).alias("c"))
    return first.join(held, "parent_id", "left").select("parent_id", "source", "title", "parent_length", "parent_preview", F.coalesce(F.size("c"), F.lit(0)).alias("num_children"), F.transform(F.coalesce("c", F.array().cast("array<struct<child_index:int,child_id:string,length:int,preview:string>>")), lambda x: F.struct(x.child_id.alias("child_id"), x.length.alias("length"), x.preview.alias("preview"))).alias("children"), "_ord").orderBy("_ord").drop("_ord")
