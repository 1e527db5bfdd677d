"""Shared pieces of the training-data operators: shared folder, words, shingles."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

#: White space of all word rules here: space and the five controls 09 to 0D.
SPACE = "\\x20\\x09-\\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; one of our own only where that is unset and the session local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='sparkloom-')}"
        atexit.register(shutil.rmtree, found[7:], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: its lineage ends there.

    The table outlives the call, since the result is lazy; the folder is one that
    its owner clears (a checkpoint folder).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def joined_by(big: DataFrame, small: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small`` on ``key``, however many rows of ``big`` one key has.

    ``small`` has one row a key, or a few, and in ``n_rows`` (left out of the result) how many rows the key has in ``big``, which are ``total``
    in all. Keys of more than a 20,000th of ``total`` are fewer than 20,000, so their rows of ``small`` are sent to all executors and
    their rows of ``big`` stay where they are; the others are shuffled. ``how`` is inner or left.
    """
    limit = max(1000, total // 20_000)
    hot = small.where(F.col("n_rows") > limit).drop("n_rows")
    rest = small.where(F.col("n_rows") <= limit).drop("n_rows")
    others = big.join(F.broadcast(hot.select(key).distinct()), key, "left_anti").join(rest, key, how)
    return big.join(F.broadcast(hot), key).unionByName(others)


def give_back() -> None:
    """Return freed memory to the system. Python workers live on, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    here = ctypes.CDLL(None)
    if hasattr(here, "malloc_trim"):
        here.malloc_trim(0)


def relieved(look: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives its memory back at its end."""

    def run(parts: Iterator) -> Iterator:
        yield from look(parts)
        give_back()

    return run


def by_batch(df: DataFrame, look: Callable[[Iterator[dict[str, list]]], Iterator[list[tuple]]], out: pa.Schema) -> DataFrame:
    """Rows that ``look`` makes of the rows of each batch, given as a list a column. Values pass as they are: a null beside an id doesn't make it a float."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for x in batches:
            told = {name: x.column(k).to_pylist() for k, name in enumerate(x.schema.names)}
            del x  # not held beside its own copy
            yield told
            del told

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in look(lists(batches)):
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], field.type) for k, field in enumerate(out)], schema=out)
        give_back()

    return df.mapInArrow(run, from_arrow_schema(out))


def spread(n_rows: int, per_part: int, least: int = 1) -> int:
    """Partitions for ``n_rows`` at ``per_part`` rows each."""
    return max(least, -(-n_rows // per_part))


def words(text: str | None) -> list[bytes]:
    """Words of the text as UTF-8 with A-Z lower-cased; null has none.

    ``bytes.split`` and ``bytes.lower`` know ASCII only: exactly the six white
    space characters and exactly A-Z. A lone surrogate can't come from Spark.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash of several hash columns, order kept."""
    out = columns[0].copy()
    for x in columns[1:]:
        out ^= out >> np.uint64(32)
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += x
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def shingle_list(found: list[bytes], size: int = 5) -> np.ndarray:
    """64-bit hashes of the word shingles in text order; fewer words make one shingle, no words none."""
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    if len(found) < size:
        return mixed([np.full(1, len(found), np.uint64), *np.split(h, len(h))])
    return mixed([h[i : len(h) - size + 1 + i] for i in range(size)])


def shingle_hashes(found: list[bytes], size: int = 5) -> np.ndarray:
    """The distinct ones of ``shingle_list``, ascending."""
    return np.unique(shingle_list(found, size))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))
