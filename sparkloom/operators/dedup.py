"""Deduplication with a defined survivor, its accounting, key merges and unions of phases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import urls


def first_by(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """First row of each key by the order column; all columns stay.

    Exactly one row a key survives: rows without a place come last, ties go by the hash of the whole row, so they don't depend on arrival, and of rows that are equal in all one stays. Rows
    without a key are one key. The aggregate has places and hashes alone, and combines before the shuffle, so a key of any size is no task's burden and texts are not sorted; the rows themselves are met again by a semi join. Empty tables give empty results.
    """
    return chosen_by(rows, key, F.struct(F.col(order).isNull().alias("a"), F.col(order).alias("b"), F.xxhash64(*rows.columns).alias("c")), F.min)


def chosen_by(rows: DataFrame, key: Column, place: Column, best) -> DataFrame:
    """The row of the best place of each key. Two rows have one place only where all their columns are equal; such rows alone go through ``distinct``."""
    own = "_" * max([1, *(len(c) + 1 for c in rows.columns)])  # longer than any column's name
    told = rows.withColumns({f"{own}k": F.xxhash64(key), f"{own}v": key, f"{own}p": place})
    places = told.groupBy(f"{own}k", f"{own}v", f"{own}p").agg(F.count("*").alias(f"{own}n"))
    won = places.groupBy(F.col(f"{own}k").alias(f"{own}l"), F.col(f"{own}v").alias(f"{own}w")).agg(best(F.struct(f"{own}p", f"{own}n")).alias(f"{own}b"))
    won = won.select(f"{own}l", f"{own}w", F.col(f"{own}b.{own}p").alias(f"{own}q"), F.col(f"{own}b.{own}n").alias(f"{own}m"))
    same = (F.col(f"{own}k") == F.col(f"{own}l")) & F.col(f"{own}v").eqNullSafe(F.col(f"{own}w")) & F.col(f"{own}p").eqNullSafe(F.col(f"{own}q"))
    # What is hashed is a place a key; the rows stream past it, unsorted.
    met = lambda some: told.join(won.where(some).hint("shuffle_hash"), same, "left_semi").select(rows.columns)
    return met(F.col(f"{own}m") == 1).unionByName(met(F.col(f"{own}m") > 1).distinct())


def url_dedup(docs: DataFrame, order: str, source: str = "source", keep_empty: bool = False) -> DataFrame:
    """First document of each canonical URL. Sources that are null or empty count as one, or with ``keep_empty`` as none."""
    key = urls.canonical(F.coalesce(F.col(source), F.lit("")))
    if keep_empty:
        key = F.when(F.coalesce(F.col(source), F.lit("")) == "", F.concat(F.lit("row "), F.col(order).cast("string"))).otherwise(key)
    return first_by(docs, key, order)


def content_hash(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def content_dedup(docs: DataFrame, order: str, text: str = "text") -> DataFrame:
    """First document of each content hash."""
    return first_by(docs, content_hash(text), order)


def accounting(before: DataFrame, after_url: DataFrame, after_content: DataFrame) -> DataFrame:
    """Documents before, after the URL step and after the content step."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(before, "n_before").join(F.broadcast(count(after_url, "n_after_url"))).join(F.broadcast(count(after_content, "n_after_content")))


def phases(parts: list[DataFrame], order: str = "ord") -> DataFrame:
    """All rows of the phases; ``order`` and the phase number give each row its place (``place`` sorts as phase, then order)."""
    tagged = [p.withColumn("phase", F.lit(k)).withColumn("place", F.struct(F.lit(k).alias("phase"), F.col(order).alias("ord"))) for k, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def last_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Last row of each key, as ``first_by`` finds the first: rows without a place come first. Rows without a key are skipped."""
    kept = rows.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    return chosen_by(kept, F.col(key), F.struct(F.col(order).isNotNull().alias("a"), F.col(order).alias("b"), F.xxhash64(*rows.columns).alias("c")), F.max)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows, and the old ones whose key is not among them."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


#: Neighbouring record numbers whose offsets one task may compute.
RECORD_BLOCK = 65_536


def running_position(rows: DataFrame, by: str, order: list[str], name: str = "chunk_pos") -> DataFrame:
    """Position of each row in its group, from 0, in the order of ``order``: a record's integer number first, then places inside the record.

    Rows are numbered inside their record only. Records get offsets from counts, in blocks of ``RECORD_BLOCK`` neighbouring numbers, and blocks from the counts of blocks,
    so a group of any size never meets in one task. Null groups and null numbers are groups and records like others; nulls come first.
    """
    number, *inside = order
    before = lambda *own: Window.partitionBy(*own[:-1]).orderBy(own[-1]).rowsBetween(Window.unboundedPreceding, -1)
    offset = lambda window: F.coalesce(F.sum("_n").over(window), F.lit(0))
    counts = rows.groupBy(F.col(by).alias("_by"), F.col(number).alias("_number")).agg(F.count("*").alias("_n")).withColumn("_block", F.floor(F.col("_number") / RECORD_BLOCK))
    blocks = counts.groupBy("_by", "_block").agg(F.sum("_n").alias("_n")).select(F.col("_by").alias("_b"), F.col("_block").alias("_k"), offset(before("_by", "_block")).alias("_blocks"))
    records = counts.withColumn("_records", offset(before("_by", "_block", "_number"))).join(blocks, F.col("_by").eqNullSafe(F.col("_b")) & F.col("_block").eqNullSafe(F.col("_k")))
    starts = records.select("_by", "_number", (F.col("_blocks") + F.col("_records")).alias("_start"))
    own = Window.partitionBy(by, number).orderBy(*(inside or [number]))
    numbered = rows.withColumn("_inside", F.row_number().over(own) - 1)
    placed = numbered.join(starts, F.col(by).eqNullSafe(F.col("_by")) & F.col(number).eqNullSafe(F.col("_number")))
    return placed.withColumn(name, (F.col("_start") + F.col("_inside")).cast("long")).drop("_by", "_number", "_start", "_inside")
