"""Scans and sinks of the knowledge base: records, parent stores, child tables, debug exports, PDF files."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as t
from sparkloom.operators import dedup, profile, structure
from sparkloom.sources import json_array

#: Fixed names and values: fields of records, stores and exports, and the type of a record that has none (``sconosciuto``).
RECORD = "text string, source string, type string"
STORE = "map<string,struct<page_content:string,metadata:map<string,string>>>"
EXPORT = "parent_id string, source string, title string, parent_length int, parent_preview string, num_children int, children array<struct<child_id:string,length:int,preview:string>>"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON array, with their position in it; a missing path is an error. Canonical storage is Parquet; the array form is read by as many tasks as it has ranges, if it has lines (``json_array``)."""
    return json_array.records(spark, path).select(F.col("record_index").cast("long").alias("record_index"), F.from_json("body", RECORD).alias("r")).select("record_index", "r.*")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of parents, one row a key."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", STORE)).alias("parent_id", "v")).select("parent_id", F.col("v.page_content").alias("text"), F.col("v.metadata").alias("metadata"))


def read_children(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_export(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children of a nested debug export."""
    nested = spark.read.schema(EXPORT).json(path, multiLine=True)
    return nested.drop("children"), nested.select("parent_id", F.posexplode("children").alias("child_index", "c")).select("parent_id", "child_index", "c.*")


def write_records(docs: DataFrame, path: str, least: int = profile.MIN_EXPORT) -> None:
    """Records of a text of ``least`` characters or more."""
    kept = profile.exportable(docs, least=least)
    kept.select("text", "source", F.coalesce("type", F.lit("sconosciuto")).alias("type")).write.mode("overwrite").parquet(path)


def write_records_json(docs: DataFrame, path: str, order: str, least: int = profile.MIN_EXPORT) -> int:
    """The same records as one JSON array in a file of the driver, in order, with all characters as they are; how many there are.

    This is the hand-over form, one file by nature: rows stream through the driver, a partition at a time, and are never all held.
    """
    kept = profile.exportable(docs, least=least).orderBy(order, "source", "text")
    n = 0
    with open(path, "w", encoding="utf-8") as out:
        out.write("[")
        for r in kept.select("text", "source", F.coalesce("type", F.lit("sconosciuto")).alias("type")).toLocalIterator():
            out.write(("," if n else "") + "\n" + json.dumps(r.asDict(), ensure_ascii=False))
            n += 1
        out.write("\n]\n")
    return n


def write_export(parents: DataFrame, children: DataFrame, path: str, order: str, n: int = 5) -> None:
    """The debug export of the first n parents as a JSON array in a file of the driver."""
    found = [r.asDict(recursive=True) for r in structure.debug_sample(parents, children, order, n).collect()]
    with open(path, "w", encoding="utf-8") as out:
        json.dump(found, out, ensure_ascii=False, indent=2)


def write_store(parents: DataFrame, path: str, order: str) -> None:
    """One row a parent, the last of each id; rows without an id are skipped."""
    dedup.last_by(parents, "parent_id", order).write.mode("overwrite").parquet(path)


def merge_children(spark: SparkSession, old_path: str | None, new: DataFrame, out_path: str, key: str = "child_id") -> None:
    """Old children less those given anew, and the new ones, in a new place; the same call again gives the same table. Null texts are empty."""
    filled = new.na.fill("", [f.name for f in new.schema if f.dataType.simpleString() == "string" and f.name != key])
    made = dedup.upsert(spark.read.parquet(old_path), filled, key) if old_path else filled
    made.write.mode("overwrite").parquet(out_path)


def read_pdfs(spark: SparkSession, path: str, to_text: Callable[[bytes], str]) -> DataFrame:
    """PDF files as records. ``to_text`` reads the bytes of one file; no reader is built in. Picture marks go, blank texts are dropped."""

    @F.pandas_udf("string")
    def read(content: pd.Series) -> pd.Series:
        return content.map(to_text)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    rows = files.select(t.pdf_clean(read("content")).alias("text"), F.col("path").alias("source"), F.lit("pdf").alias("type"))
    return rows.where(~t.is_blank(F.col("text")))
