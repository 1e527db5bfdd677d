"""Embeddings trained on the corpus: term weights, and a low-rank projection by randomised subspace iteration.

Terms are hashed to ``terms`` places. A place's weight falls with the documents that have it, counted over all of them; a document is its places with ``1 + ln`` of their counts times the weights, of length 1. The projection spans the directions
that documents share most: a random basis is multiplied with the documents and back, and made orthogonal, a few times. Each task multiplies its own documents and the tasks' sums are added up, so the corpus is never in one place; what comes to the driver is the basis, ``terms`` x ``size`` numbers.

Defined results. Null and empty texts, and texts without terms, have the zero vector. Equal texts have equal vectors. Without documents the basis is the random one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as t
from sparkloom.session import cut

#: Documents that are multiplied at once.
SLICE = 512


@dataclass
class Projection:
    weights: np.ndarray
    basis: np.ndarray

    @property
    def size(self) -> int:
        return self.basis.shape[1]


def places(text: str, terms: int) -> Column:
    """The place of each term of the text, repeats too; none for a null."""
    return F.coalesce(F.transform(t.terms(F.col(text)), lambda x: F.pmod(F.xxhash64(x), F.lit(terms)).cast("int")), F.array().cast("array<int>"))


def sparse(column: pa.ListArray, weights: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of documents: how many, and row, place and value of what is not zero, sorted by row and place; rows have length 1."""
    for i in range(0, len(column), SLICE):
        part = column.slice(i, SLICE)
        rows = np.repeat(np.arange(len(part)), part.value_lengths().to_numpy())
        keys, counts = np.unique(rows * len(weights) + part.flatten().to_numpy(), return_counts=True)
        row, place = np.divmod(keys, len(weights))
        value = (1 + np.log(counts)) * weights[place]
        norm = np.sqrt(np.bincount(row, value * value, len(part)))
        yield len(part), row, place, value / np.where(norm == 0, 1, norm)[row]


def summed(values: np.ndarray, by: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` with equal ``by``, which is sorted."""
    out = np.zeros((n, values.shape[1]))
    if len(by):
        starts = np.flatnonzero(np.diff(by, prepend=-1))
        out[by[starts]] = np.add.reduceat(values, starts, axis=0)
    return out


def multiplied(told: DataFrame, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The basis times all documents and back."""
    sent = told.sparkSession.sparkContext.broadcast((weights, basis))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = sent.value
        total = np.zeros(b.shape)
        for x in batches:
            for n, row, place, value in sparse(x.column(0), w):
                y = summed(value[:, None] * b[place], row, n)
                order = np.argsort(place, kind="stable")
                total += summed(value[order, None] * y[row[order]], place[order], len(b))
        here = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(here, pa.int32()), pa.array(list(total[here]), pa.list_(pa.float64()))], names=["place", "v"])

    def add(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("place", kind="stable")
        v = np.array(x["v"].tolist())
        starts = np.flatnonzero(np.diff(x["place"].to_numpy(), prepend=-1))
        return pd.DataFrame({"place": x["place"].to_numpy()[starts], "v": list(np.add.reduceat(v, starts, axis=0))})

    # A group has as many rows as 64 places have tasks.
    schema = "place int, v array<double>"
    rows = told.mapInArrow(look, schema).groupBy(F.floor(F.col("place") / 64)).applyInPandas(add, schema).collect()
    out = np.zeros(basis.shape)
    for r in rows:
        out[r.place] = r.v
    return out


def fitted(docs: DataFrame, size: int = 64, terms: int = 1 << 14, rounds: int = 3, sample: int = 50_000, did: str = "doc_id", text: str = "text") -> Projection:
    """Weights over all documents, and a basis over at most ``sample`` of them, by the hash of their ids and texts."""
    every = docs.select(F.explode(F.array_distinct(places(text, terms))).alias("place")).groupBy("place").agg(F.count("*").alias("n")).collect()
    total = docs.count()
    weights = np.zeros(terms)
    for r in every:
        weights[r.place] = np.log((1 + total) / (1 + r.n)) + 1
    basis = np.linalg.qr(np.random.default_rng(5).normal(size=(terms, size)))[0]
    drawn = docs.where(F.length(text) > 0).select(places(text, terms).alias("p"), F.xxhash64(did, text).alias("h")).orderBy("h").limit(sample)
    told = cut(drawn.select("p").repartition(max(1, min(sample, total) // 2048)))
    for _ in range(rounds if total else 0):
        made = multiplied(told, weights, basis)
        if not made.any():
            break
        basis = np.linalg.qr(made)[0]
    # Signs are of no account to products; fixed, they make fits comparable.
    signs = np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(size)])
    return Projection(weights, basis * np.where(signs == 0, 1, signs))


def embedded(rows: DataFrame, projection: Projection, text: str = "text", name: str = "embedding") -> DataFrame:
    """The rows with the embedding of their text, a batch at a time."""
    sent = rows.sparkSession.sparkContext.broadcast(projection)

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        p = sent.value
        for column in batches:
            out = [summed(value[:, None] * p.basis[place], row, n) for n, row, place, value in sparse(column, p.weights)]
            v = np.concatenate(out) if out else np.zeros((0, p.size))
            norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
            flat = (v / np.where(norm == 0, 1, norm)).astype(np.float32).ravel()
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * p.size, pa.int32()), pa.array(flat))

    return rows.withColumn(name, run(places(text, len(projection.weights))))


def saved(projection: Projection, spark: SparkSession, path: str) -> None:
    """The model as a table: a row a place."""
    rows = [(k, float(w), v.tolist()) for k, (w, v) in enumerate(zip(projection.weights, projection.basis, strict=True))]
    spark.createDataFrame(rows, "place int, weight double, v array<double>").write.parquet(path)


def loaded(spark: SparkSession, path: str) -> Projection:
    rows = spark.read.parquet(path).orderBy("place").collect()
    return Projection(np.array([r.weight for r in rows]), np.array([r.v for r in rows]))
