"""Searches through indexes against searches without: vectors by cells and codes, words by postings."""

import math
import random
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.operators import postings, vector_index, vectors
from sparkloom.plans import answers
from sparkloom.session import scratch, table

BIG = 2**53


def searched(spark, rows, queries, **more):
    path = scratch(spark, "vectors")
    model = vector_index.fitted(rows)
    vector_index.build(rows, model, path)
    return model, path, vector_index.search(path, queries, rows, **more)


def hits(df):
    return {(r.qid, r.vec_id, r.score, r["rank"]) for r in df.collect()}


def recall(got, want):
    a, b = ({(q, v) for q, v, _, _ in x} for x in (got, want))
    return len(a & b) / len(b)


def test_recall_over_the_query_set(spark, sf_dir):
    vecs = table(spark, sf_dir, "embeddings")
    queries = vecs.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    want = hits(vectors.similar(queries, vecs))
    _, path, found = searched(spark, vecs, queries)
    got = hits(found)
    assert len(got) == len(want) and recall(got, want) >= 0.95
    assert hits(vector_index.search(path, queries, vecs, certified=True)) == want
    stored = spark.read.parquet(f"{path}/blocks")
    assert stored.agg(F.sum("n")).first()[0] == vecs.count()


def grouped_vectors(spark, n=6000, groups=40, size=24):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(groups, size))
    v = centers[rng.integers(0, groups, n)] + 0.15 * rng.normal(size=(n, size))
    return spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": (v / np.linalg.norm(v, axis=1)[:, None]).tolist()}))


def test_grouped_vectors_are_found_in_few_cells(spark):
    vecs = grouped_vectors(spark).repartition(4).cache()
    queries = vecs.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    model, path, found = searched(spark, vecs, queries)
    assert model.probes < len(model.centroids) / 4
    want = hits(vectors.similar(queries, vecs))
    assert recall(hits(found), want) >= 0.95
    assert hits(vector_index.search(path, queries, vecs, certified=True)) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_what_leaves_tasks_is_bounded(spark, monkeypatch):
    """Vectors in all directions alike go to many cells; what is ranked is still a few hits of each query and task, not all of a cell's."""
    rng = np.random.default_rng(9)
    n, size = 6000, 16
    v = rng.normal(size=(n, size))
    vecs = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": (v / np.linalg.norm(v, axis=1)[:, None]).tolist()})).repartition(6)
    queries = vecs.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    path, ranked, best = scratch(spark, "vectors"), [], vector_index.best

    def counted(rows, k):
        ranked.append((rows.count(), k))
        return best(rows, k)

    monkeypatch.setattr(vector_index, "best", counted)
    model = vector_index.fitted(vecs)
    vector_index.build(vecs, model, path)
    got = hits(vector_index.search(path, queries, vecs, certified=True))
    assert model.probes > len(model.centroids) / 4 and got == hits(vectors.similar(queries, vecs))
    assert all(rows <= 300 * 160 * 2 for rows, _ in ranked), ranked
    # The last ranking has little but the hits themselves.
    assert ranked[-1][0] <= 300 * 20 * 2, ranked


def test_query_through_the_index_keeps_the_best_by_codes(spark, sf_dir, monkeypatch):
    """Cells are smaller than what a query fetches: a task still gives no more than that of each query."""
    ranked, best = [], vector_index.best

    def counted(rows, k):
        ranked.append((rows.count(), k))
        return best(rows, k)

    monkeypatch.setattr(vector_index, "best", counted)
    got = hits(answers.knn_index_top20(spark, sf_dir))
    n = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").count()
    assert ranked[0][1] == 160 and ranked[0][0] <= n * 160, ranked
    assert recall(got, hits(answers.knn_top20(spark, sf_dir))) >= 0.95


def peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_ranking_ties_takes_bounded_memory():
    """Copies of one vector score alike, so all of them are sorted: for some queries at a time."""
    n = 2048
    scores, ids, among = np.zeros((n, n)), np.arange(n)[::-1].copy(), np.ones((n, n), bool)
    best = vectors.Best(n, 160)
    assert peak(lambda: best.add(scores, ids, among)) < 150
    assert len(best.at) == n * 160 and (best.v.reshape(n, 160) == np.arange(160)).all()


def test_ranking_in_parts_is_ranking_at_once(monkeypatch):
    rng = np.random.default_rng(2)
    n, k = 700, 9
    steps = [(rng.integers(0, 12, (n, m)).astype(float), rng.permutation(10_000)[:m], rng.random((n, m)) < share) for m, share in ((40, 1), (5, 0.3), (60, 0.1), (1, 1))]
    want = []
    for q in range(n):
        pairs = [(-s[q, c], ids[c]) for s, ids, among in steps for c in np.flatnonzero(among[q])]
        want += [(q, -s, v) for s, v in sorted(pairs)[:k]]
    for rows in (1, 256, 700, 1000):
        monkeypatch.setattr(vectors, "ROWS", rows)
        best = vectors.Best(n, k)
        for s, ids, among in steps:
            best.add(np.where(among, s, -np.inf), ids, among)
        assert list(zip(best.at.tolist(), best.s.tolist(), best.v.tolist(), strict=True)) == want


def test_queries_meet_cells_a_few_at_a_time():
    """What a batch of queries is held against has a column for each cell, up to 4,096 of them."""
    v = pa.array(np.arange(3000.0).reshape(1000, 3).tolist(), pa.list_(pa.float64()))
    got = list(vector_index.few(iter([pa.RecordBatch.from_arrays([v], names=["q"])])))
    assert max(x.num_rows for x in got) <= vectors.ROWS
    assert (np.concatenate([vector_index.matrix(x.column("q")) for x in got]) == np.arange(3000.0).reshape(1000, 3)).all()


def test_a_sample_is_drawn_without_ranking_the_table(spark):
    vecs = spark.range(50_000, numPartitions=5).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")).alias("vec_id"), F.array(F.rand(3), F.rand(4)).alias("v"))
    order = F.xxhash64("vec_id", "v")
    few = vector_index.narrowed(vecs, 50_000, 2000)
    assert 2000 <= few.count() < 3000
    drawn = lambda x: [tuple(r.v) for r in x.orderBy(order).limit(2000).collect()]
    assert drawn(few) == drawn(vecs)
    assert vector_index.narrowed(vecs.limit(100), 100, 2000).count() == 100


def test_odd_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(900)]
    rows += [(BIG, [1.0] * 6), (BIG + 1, [1.0] * 5 + [1.1]), (None, [9.0] * 6), (901, None), (902, [1.0, 2.0]), (903, [float("nan")] * 6), (904, [0.0] * 6), (1, rows[1][1]), (905, []), (906, rows[0][1])]
    vecs = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "vec_id long, embedding array<double>, cell string, score int, v int").repartition(3)
    asked = [(1, rows[1][1]), (2, [1.0, 2.0]), (3, None), (None, [1.0] * 6), (4, [0.0] * 6), (5, [1.0] * 6), (BIG + 1, [-1.0] * 6)]
    queries = spark.createDataFrame(asked, "qid long, embedding array<double>")
    want = hits(vectors.similar(queries, vecs))
    _, _, found = searched(spark, vecs, queries, certified=True)
    # NaN scores come last in both, and are unequal to themselves.
    plain = lambda x: {r for r in x if r[2] == r[2]}
    assert plain(hits(found)) == plain(want)
    none = vecs.limit(0)
    assert searched(spark, none, queries)[2].count() == 0
    few = vecs.where("vec_id < 5")
    assert hits(searched(spark, few, queries)[2]) == hits(vectors.similar(queries, few))
    assert searched(spark, few, queries.limit(0))[2].count() == 0


def test_one_cell_of_copies(spark):
    """A third of all vectors are one; ties go by id, so the least ids win."""
    rows = [(k, [1.0, 0.0, 0.0, 0.0]) for k in range(3000)] + [(k, np.random.default_rng(k).normal(size=4).tolist()) for k in range(3000, 5000)]
    vecs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(7, [1.0, 0.0, 0.0, 0.0])], "qid long, embedding array<double>")
    assert hits(searched(spark, vecs, queries, certified=True)[2]) == hits(vectors.similar(queries, vecs))


# ---- postings


def brute_bm25(docs, question, k, k1=postings.K1, b=postings.B):
    """Ids and scores of all documents, the best first."""
    mean = sum(len(d) for _, d in docs) / len(docs) or 1.0
    out = []
    for key, d in docs:
        score = 0.0
        for w in set(question):
            n = sum(w in x for _, x in docs)
            if f := d.count(w):
                score += math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(d) / mean))
        if score:
            out.append((-round(score, 6), key))
    return [(key, -s) for s, key in sorted(out)[:k]]


def segment_of(docs):
    rows = postings.inverted(0, np.array([k for k, _ in docs], np.int64), pa.array([d for _, d in docs], pa.list_(pa.string()))).to_pandas()
    return postings.Segment(rows, sum(len(d) for _, d in docs) / len(docs))


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 400), st.integers(1, 12))
def test_pruning_loses_nothing(seed, n, k):
    rng = random.Random(seed)
    draw = lambda: f"t{int(rng.paretovariate(0.7)) % 60}"
    docs = [(key, [draw() for _ in range(rng.randrange(30))]) for key in rng.sample(range(10**6), n)]
    question = list({draw() for _ in range(rng.randrange(1, 8))} | {"never"})
    segment = segment_of(docs)
    rarity = {w: math.log(1 + (n - m + 0.5) / (m + 0.5)) for w in question if (m := sum(w in d for _, d in docs))}
    ids, scores = segment.best(list(rarity.items()), k)
    want = brute_bm25(docs, question, k)
    assert ids.tolist() == [key for key, _ in want] and scores.tolist() == pytest.approx([s for _, s in want])


def test_rare_terms_read_few_blocks():
    docs = [(k, ["common"] * (1 + k % 3) + [f"f{k % 7}"] * (k % 5) + (["rare"] * 4 if k in (11, 4000) else [])) for k in range(20_000)]
    segment = segment_of(docs)
    n = len(docs)
    rarity = lambda m: math.log(1 + (n - m + 0.5) / (m + 0.5))
    ids, _ = segment.best([("common", rarity(n)), ("rare", rarity(2))], 2)
    assert set(ids.tolist()) == {11, 4000}
    blocks = sum(len(x.parts) for x in segment.terms.values())
    assert blocks > 250 and segment.read <= 3


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    docs = [(k, ["a"] * int(c) + ["b"] * (300 if k == 900 else 0) + (["c"] * 70_000 if k in (0, 901) else [])) for k, c in enumerate(rng.integers(0, 5, 1000))]
    segment = segment_of(docs)
    for w in "abc":
        found, counts = (np.concatenate(x) for x in zip(*map(segment.block, segment.terms[w].parts), strict=True))
        assert [(int(d), int(c)) for d, c in zip(found, counts, strict=True)] == [(k, d.count(w)) for k, d in docs if w in d]


def test_bm25_odd_rows(spark):
    rows = [(1, "Red apple pie"), (2, "red RED wine"), (3, None), (4, ""), (5, "apple"), (None, "red apple"), (BIG, "apple pie pie"), (BIG + 1, "apple pie pie"), (5, "apple"), (6, "日本 apple_pie x" * 2000)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, term string, segment int").repartition(2)
    asked = [(1, "apple, red!"), (2, None), (3, ""), (None, "apple"), (4, "日本"), (5, "nothing here"), (BIG + 1, "PIE")]
    questions = spark.createDataFrame(asked, "qid long, text string")
    path = scratch(spark, "postings")
    postings.build(docs, path)
    got = sorted((r.qid, r.place, r.doc_id, r.score) for r in postings.bm25_best(spark, path, questions, 4).collect())
    from sparkloom.functions import text as t

    held = [(r.doc_id, r.terms or []) for r in docs.select("doc_id", t.terms(F.col("text")).alias("terms")).where("doc_id IS NOT NULL").collect()]
    want = [(q, p + 1, *x) for q, words in ((1, ["apple", "red"]), (4, ["日本"]), (BIG + 1, ["pie"])) for p, x in enumerate(brute_bm25(held, words, 4))]
    assert got == sorted(want)
    empty = scratch(spark, "postings")
    postings.build(docs.limit(0), empty)
    assert postings.bm25_best(spark, empty, questions).count() == 0
    assert postings.bm25_best(spark, path, questions.limit(0)).count() == 0


def test_many_segments_and_terms(spark, monkeypatch):
    rng = random.Random(3)
    docs = [(k, " ".join(f"t{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randrange(40)))) for k in range(400)]
    asked = [(q, " ".join(f"t{rng.randrange(300)}" for _ in range(6))) for q in range(20)]
    path = scratch(spark, "postings")
    postings.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), path)
    questions = spark.createDataFrame(asked, "qid long, text string")
    want = [(q, p + 1, *x) for q, text in asked for p, x in enumerate(brute_bm25([(k, d.split()) for k, d in docs], text.split(), 10))]
    for sought in (postings.SOUGHT, 3):
        monkeypatch.setattr(postings, "SOUGHT", sought)
        got = sorted((r.qid, r.place, r.doc_id, r.score) for r in postings.bm25_best(spark, path, questions).collect())
        assert [x[:3] for x in got] == [x[:3] for x in sorted(want)] and [x[3] for x in got] == pytest.approx([x[3] for x in sorted(want)])
