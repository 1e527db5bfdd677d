"""Crawls that go on from snapshot to snapshot: a new one costs its new pages, and what they change.

Under ``path`` are three tables in buckets (``buckets``): ``pages``, what has been processed with its canonical URL, ``edges``, their links, and ``levels``, the level at which each URL was reached. A fourth, ``filters``, has a Bloom filter for each
bucket of ``pages``: pages that it doesn't know are new, without a look at the table; only the others are held against it, so that no page is taken for seen by chance.

``update`` processes the pages that are new, and mends levels from there: a new page may be a seed, or the target of links that led nowhere before, and may bring others nearer. What it gives after several snapshots is what ``crawl.reach`` gives over all of them.

Defined results. A page is its canonical URL, or that and a ``key``, where several pages share a URL; the links of all of them count. The first snapshot that has a page counts, with all of its rows there; pages without a URL are left out.
A snapshot without new pages changes nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import urls
from sparkloom.session import cut
from sparkloom.sources import buckets, crawl

#: Bits a URL of a filter, and places that a URL sets.
BITS, HASHES = 16, 8


def spots(found: list[str], size: int) -> np.ndarray:
    """Places of each URL among ``size``: a row each."""
    h = np.array([xxhash.xxh3_128_intdigest(x) for x in found], dtype=object)
    low = np.array([x & (2**64 - 1) for x in h], np.uint64)
    step = np.array([x >> 64 | 1 for x in h], np.uint64)
    return ((low[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(size)).astype(np.int64)


def filter_of(found: list[str]) -> bytes:
    bits = np.zeros(max(64, -(-BITS * len(found) // 8) * 8), np.uint8)
    if found:
        bits[spots(found, len(bits)).ravel()] = 1
    return np.packbits(bits).tobytes()


def known(found: list[str], raw: bytes) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(raw, np.uint8))
    return bits[spots(found, len(bits))].all(axis=1) if found else np.zeros(0, bool)


def bucket_of(column: str, n: int):
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def unseen(spark: SparkSession, path: str, found: DataFrame) -> DataFrame:
    """Those of distinct pages (``page``, ``url``) that no snapshot has had."""
    held = buckets.latest(spark, f"{path}/pages")
    if held is None:
        return found
    filters = buckets.read(spark, f"{path}/filters")

    def ask(own: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        told = known(own["page"].tolist(), kept["bits"].iloc[0]) if len(kept) else np.zeros(len(own), bool)
        return pd.DataFrame({"page": own["page"], "url": own["url"], "told": told})

    asked = found.select("page", "url", bucket_of("page", held.buckets).alias("block")).groupBy("block").cogroup(filters.groupBy("block")).applyInPandas(ask, "page string, url string, told boolean")
    asked = cut(asked)
    likely = asked.where("told").select("page", "url", bucket_of("page", held.buckets).cast("string").alias("block"))
    met = [r.block for r in likely.select("block").distinct().collect()]
    really = buckets.read(spark, f"{path}/pages", held, met).select("page")
    return asked.where("NOT told").select("page", "url").unionByName(likely.select("page", "url").join(really, "page", "left_anti"))


def remember(spark: SparkSession, path: str, fresh: DataFrame, n_buckets: int) -> None:
    """Put pages into the table of processed ones, and make the filters of the buckets that got some anew."""
    version = buckets.merge(fresh, f"{path}/pages", "page", buckets=n_buckets)
    block = bucket_of("page", version.buckets)
    touched = [r.block for r in fresh.select(block.alias("block")).distinct().collect()]
    own = buckets.read(spark, f"{path}/pages", version, [str(k) for k in touched]).select("page", block.alias("block"))

    def make(x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [int(x["block"].iloc[0])], "bits": [filter_of(x["page"].tolist())]})

    # A group is a bucket of the table.
    buckets.merge(own.groupBy("block").applyInPandas(make, "block int, bits binary"), f"{path}/filters", "block", buckets=n_buckets)


def update(pages: DataFrame, seeds: DataFrame, path: str, depth: int = 4, site: urls.Site = urls.Site(), n_buckets: int = 64, key: str | None = None) -> int:
    """Process a snapshot (``url``, ``html``); how many of its pages were new. ``seeds``, ``depth`` and ``key`` are those of all snapshots. ``key`` is a column that tells pages of one URL apart."""
    spark = pages.sparkSession
    path = path.rstrip("/")
    canon = urls.canonical(F.col("url"))
    rows = pages.where("url IS NOT NULL").select("url", "html", canon.alias("_canon"), (F.concat_ws(" ", canon, F.col(key).cast("string")) if key else canon).alias("page"))
    fresh = cut(unseen(spark, path, rows.select("page", F.col("_canon").alias("url")).distinct()))
    n = fresh.count()
    if not n:
        return 0
    first = rows.join(fresh.select("page"), "page", "left_semi").select("url", "html")
    found = crawl.links(first, site).select(urls.canonical(F.col("src_url")).alias("src"), urls.canonical(F.col("dst_url")).alias("dst")).distinct()
    buckets.merge(found.select(F.concat_ws(" ", "src", "dst").alias("edge"), "src", "dst"), f"{path}/edges", "edge", buckets=n_buckets)
    remember(spark, path, fresh, n_buckets)
    edges = buckets.read(spark, f"{path}/edges").select("src", "dst")
    every = buckets.read(spark, f"{path}/pages").select("url")
    begun = buckets.latest(spark, f"{path}/levels") is not None
    levels = buckets.read(spark, f"{path}/levels") if begun else spark.createDataFrame([], "url string, level int")
    # New pages are reached as seeds, or by links from pages that have a level; those of a URL that has a level bring it new links.
    roots = seeds.select(urls.canonical(F.col("url")).alias("url")).distinct().join(fresh, "url", "left_semi").withColumn("level", F.lit(1))
    led = levels.where(F.col("level") < depth).withColumnRenamed("url", "src").join(edges, "src").select(F.col("dst").alias("url"), (F.col("level") + 1).alias("level")).join(fresh, "url", "left_semi")
    again = levels.join(fresh, "url", "left_semi").select("url", "level")
    front = cut(roots.unionByName(led).unionByName(again).groupBy("url").agg(F.min("level").alias("level")))
    changed = front
    while not front.isEmpty():
        near = front.where(F.col("level") < depth).withColumnRenamed("url", "src").join(edges, "src").select(F.col("dst").alias("url"), (F.col("level") + 1).alias("level"))
        near = near.join(every, "url", "left_semi").groupBy("url").agg(F.min("level").alias("level"))
        now = levels.unionByName(changed).groupBy("url").agg(F.min("level").alias("_now"))
        front = cut(near.join(now, "url", "left").where("_now IS NULL OR level < _now").select("url", "level"))
        changed = cut(changed.unionByName(front).groupBy("url").agg(F.min("level").alias("level")))
    buckets.merge(changed, f"{path}/levels", "url", buckets=n_buckets)
    return n


def reached(spark: SparkSession, path: str) -> DataFrame:
    """``url`` and ``level`` of all that has been reached."""
    return buckets.read(spark, f"{path.rstrip('/')}/levels")
