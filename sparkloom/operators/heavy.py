"""The most frequent keys without a shuffle of all keys: summaries first, then exact counts of those that could be among them.

Each task keeps at most ``capacity`` counters. When there are more, the count of the first one too many is taken off all of them, and what is left with nothing goes: so a counter is at most what was taken off too low, and a key without one has
occurred no oftener than that. Summaries add up, and so do their errors. Keys whose counter and error reach the n-th best counter are counted exactly; if the n-th of them is above the error of a key without a counter, none has been missed. Else all keys are counted.

Defined results. As ``profile.most_common`` has them: null and empty keys are ``missing``, ties go by the least ``order``, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import profile
from sparkloom.session import cut

CAPACITY = 4096


class Summary:
    """Counters of one task. ``error`` is what has been taken off in all."""

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.counts = pd.Series(dtype="int64")

    def add(self, keys: pd.Series) -> None:
        counts = self.counts.add(keys.value_counts(), fill_value=0).astype("int64")
        if len(counts) > self.capacity:
            least = int(counts.nlargest(self.capacity + 1).iloc[-1])
            self.error += least
            counts = counts[counts > least] - least
        self.counts = counts


def summaries(keys: DataFrame, capacity: int) -> DataFrame:
    """``key``, ``n`` and ``error`` of each task; a row without a key has the error of a task that kept none."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Summary(capacity)
        for x in batches:
            held.add(x.column(0).to_pandas())
        yield pa.RecordBatch.from_arrays([pa.array([*held.counts.index, None], pa.string()), pa.array([*held.counts, 0], pa.int64()), pa.array([0] * len(held.counts) + [held.error], pa.int64())], names=["key", "n", "error"])

    return keys.mapInArrow(look, "key string, n long, error long")


def most_common(docs: DataFrame, key: Column, order: str, n: int, name: str, capacity: int = CAPACITY, sent: int = 100_000) -> DataFrame:
    """The n most frequent keys, as ``profile.most_common``. At most ``sent`` candidates are sent to the tasks; with more, all keys are counted."""
    told = docs.withColumn("_key", F.coalesce(F.nullif(key, F.lit("")), F.lit("missing")))
    found = cut(summaries(told.select("_key"), max(capacity, n + 1)).groupBy("key").agg(F.sum("n").alias("n"), F.sum("error").alias("error")))
    error = found.agg(F.sum("error")).first()[0] or 0
    best = [r.n for r in found.where("key IS NOT NULL").orderBy(F.desc("n")).limit(n).collect()]
    floor = best[-1] if len(best) == n else 0
    likely = [r.key for r in found.where(F.col("key").isNotNull() & (F.col("n") + error >= floor)).limit(sent + 1).collect()]
    # Lower bounds of n keys above the error of all others: what has no counter can't be among the first.
    if len(likely) > sent or error and not floor > error:
        return profile.most_common(docs, key, order, n, name)
    wanted = docs.sparkSession.createDataFrame([(k,) for k in likely], "_key string")
    return profile.most_common(told.join(F.broadcast(wanted), "_key", "left_semi"), F.col("_key"), order, n, name)
