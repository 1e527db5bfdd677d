"""Trained embeddings: near-duplicates are nearest, the fit is that of the whole matrix, the model is a table."""

import random

import numpy as np
from pyspark.sql import functions as F

from sparkloom.operators import embeddings, vectors
from sparkloom.session import scratch

TOPICS = [[f"{k}word{i}" for i in range(40)] for k in range(8)]


def corpus(n=240):
    rng = random.Random(2)
    out = []
    for k in range(n):
        words = rng.choices(TOPICS[k % len(TOPICS)], k=60) + rng.choices(["the", "of", "and"], k=30)
        rng.shuffle(words)
        out.append((k, " ".join(words)))
    # Every tenth document once more, with a twentieth of its words changed.
    for k, text in out[::10]:
        words = text.split()
        for i in rng.sample(range(len(words)), len(words) // 20):
            words[i] = "changed"
        out.append((1000 + k, " ".join(words)))
    return out


def test_near_duplicates_come_first(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(4).cache()
    model = embeddings.fitted(docs, size=32, terms=1 << 12)
    found = embeddings.embedded(docs, model).cache()
    queries = found.where("doc_id >= 1000").select(F.col("doc_id").alias("qid"), "embedding")
    hits = vectors.similar(queries, found.where("doc_id < 1000"), 5, vid="doc_id").collect()
    first = {r.qid: r.vec_id for r in hits if r["rank"] == 1}
    assert len(first) == 24 and sum(first[q] == q - 1000 for q in first) >= 23
    # Neighbours are of one topic.
    assert np.mean([r.vec_id % 8 == (r.qid - 1000) % 8 for r in hits]) > 0.95


def test_basis_spans_the_leading_directions(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)
    model = embeddings.fitted(docs, size=8, terms=512, rounds=6)
    assert np.allclose(model.basis.T @ model.basis, np.eye(8))
    rows = docs.select(embeddings.places("text", 512).alias("p")).toPandas()["p"]
    import pyarrow as pa

    a = np.zeros((len(rows), 512))
    at = 0
    for n, row, place, value in embeddings.sparse(pa.array([list(x) for x in rows], pa.list_(pa.int32())), model.weights):
        a[at + row, place] = value
        at += n
    held = np.linalg.norm(a @ model.basis) ** 2
    best = (np.linalg.svd(a, compute_uv=False)[:8] ** 2).sum()
    assert held > 0.97 * best


def test_odd_texts(spark):
    rows = [(1, "alpha beta"), (2, None), (3, ""), (4, "... !"), (5, "alpha beta"), (None, "beta"), (6, "gamma " * 50_000)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, place string")
    model = embeddings.fitted(docs, size=4, terms=64)
    got = {r.doc_id: r.embedding for r in embeddings.embedded(docs, model).collect()}
    assert got[2] == got[3] == got[4] == [0.0] * 4 and got[1] == got[5] and abs(np.linalg.norm(got[6]) - 1) < 1e-5 and len(got) == 7
    path = scratch(spark, "projection")
    embeddings.saved(model, spark, path)
    again = embeddings.loaded(spark, path)
    assert np.array_equal(again.basis, model.basis) and np.array_equal(again.weights, model.weights)
    none = embeddings.fitted(docs.limit(0), size=4, terms=64)
    assert embeddings.embedded(docs.limit(0), none).count() == 0 and none.basis.shape == (64, 4)
