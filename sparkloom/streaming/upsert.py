"""Streams of records into the knowledge base: micro-batches merged by key, so that a batch that is run again changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sparkloom.sources import buckets as table
from sparkloom.sources import kb


def record_stream(spark: SparkSession, path: str) -> DataFrame:
    """New JSON lines files of records as they come."""
    return spark.readStream.schema(kb.RECORD).json(path)


def upsert_stream(rows: DataFrame, table_path: str, checkpoint: str, key: str = "source", order: str | None = None, buckets: int = 64) -> StreamingQuery:
    """Merge each batch into a table in buckets (``buckets.read`` reads it): only buckets in which a batch changes something are rewritten.

    Of several rows of a key in one batch the last by ``order`` counts. A batch that is repeated after a failure is passed over if it is in, else merged whole. All available input is taken, then the query ends.
    """

    def merge(batch: DataFrame, number: int) -> None:
        table.merge(batch, table_path, key, order, number, buckets)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
