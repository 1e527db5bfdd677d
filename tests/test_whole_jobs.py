"""Queries do the whole job: every row takes part, and rows that the SQL lists are among the results."""

import hashlib
import json
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom import catalog
from sparkloom.functions import urls
from sparkloom.operators import dedup, vectors
from sparkloom.session import table
from sparkloom.sources import crawl, kb


def sql_rows(sf_dir, name):
    con = duckdb.connect()
    for t in ("embeddings", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con.execute(catalog.ORACLES[name]).fetchall()


# ---- search


@pytest.mark.parametrize("name", ["knn_top20", "parent_first_hit", "parent_lookup_fallback", "key_merge_upsert", "rerank_lexical_top10", "adaptive_threshold", "context_concat", "domain_normalise"])
def test_the_sql_has_the_same_rows(spark, sf_dir, name):
    assert sorted(tuple(r) for r in catalog.QUERIES[name](spark, sf_dir).collect()) == sorted(sql_rows(sf_dir, name))


def test_every_twentieth_vector_gets_hits(spark, sf_dir):
    want = {r.vec_id for r in table(spark, sf_dir, "embeddings").collect() if r.vec_id % 20 == 0}
    for name in ("knn_top20", "mmr_select"):
        assert {r.qid for r in catalog.QUERIES[name](spark, sf_dir).collect()} == want


def test_vectors_that_are_missing_or_of_other_lengths(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (None, [1.0, 0.0]), (3, [1.0, 0.0, 0.0])], "qid long, embedding array<float>")
    rows = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.5, 0.5]), (12, None), (13, [0.0, 0.0, 1.0]), (14, [1.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted((r.qid, r.rank, r.vec_id) for r in vectors.similar(queries, rows, 5).collect())
    assert got == [(1, 1, 10), (1, 2, 11), (3, 1, 13)]
    assert vectors.similar(queries.limit(0), rows).count() == 0 and vectors.similar(queries, rows.limit(0)).count() == 0


def test_best_keeps_ties_by_id():
    rng = np.random.default_rng(5)
    s, ids = rng.integers(0, 4, (6, 90)) / 4, rng.permutation(90)
    best = vectors.Best(6, 7)
    for i in range(0, 90, 20):
        best.add(s[:, i : i + 20], ids[i : i + 20])
    for q in range(6):
        want = sorted(zip(-s[q], ids, strict=True))[:7]
        assert list(zip(-best.s[best.at == q], best.v[best.at == q], strict=True)) == want


# ---- crawls


def linked_pages(spark, n=30):
    """Page i links to page i + 1; every text is its own."""
    rows = [(i, f"http://a.it/p{i}x", f"<a href='/p{i + 1}x'>next</a><p>{f'word{i} ' * 40}</p>") for i in range(n)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_crawls_start_from_all_pages(spark, tmp_path):
    linked_pages(spark).repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    assert {r.url for r in catalog.QUERIES["bfs_reach"](spark, str(tmp_path)).collect()} == {f"https://a.it/p{i}x" for i in range(30)}
    got = catalog.QUERIES["acquire"](spark, str(tmp_path)).collect()
    assert sorted(r.source for r in got) == sorted(f"http://a.it/p{i}x" for i in range(30))


def test_reach_goes_on_by_levels(spark):
    pages = linked_pages(spark)
    found = crawl.reach(pages, pages.where("page_id IN (3, 20)").select("url"), 4)
    assert {r.url: r.level for r in found.collect()} == {f"https://a.it/p{s + k}x": k + 1 for s in (3, 20) for k in range(4)}


# ---- reranking and merging


def test_questions_meet_all_documents(spark, tmp_path):
    docs = [(i, " ".join(f"w{(i * k) % 23}" for k in range(1, 9))) for i in range(40)] + [(40, None), (41, ""), (42, "Alpha, beta; GAMMA alpha!")]
    items = [(0, "w1 w2 w3"), (1, "alpha beta gamma"), (77, "w5 w6 \u00e9"), (78, "")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    words = lambda t: set(re.findall(r"\w+", t.lower()))
    want = {}
    for q, a in items:
        scored = [(-len(words(a) & words(t)) / (len(words(a) | words(t)) or 1), d) for d, t in docs if t is not None]
        want |= {(q, p): (d, -s) for p, (s, d) in enumerate(sorted(scored)[:10], 1)}
    rows = catalog.QUERIES["rerank_lexical_top10"](spark, str(tmp_path)).collect()
    assert {(r.qid, r.place): (r.doc_id, r.score) for r in rows} == want
    assert want[1, 1] == (42, 1.0)
    texts = dict(docs)
    context = {q: "\n\n".join(texts[want[q, p][0]] for p in range(1, 11))[:3000] for q, _ in items}
    got = {r.qid: r.hash for r in catalog.QUERIES["context_concat"](spark, str(tmp_path)).collect()}
    assert got == {q: hashlib.sha256(c.encode()).hexdigest() for q, c in context.items()}
    cut = {(r.qid, r.doc_id) for r in catalog.QUERIES["adaptive_threshold"](spark, str(tmp_path)).collect()}
    assert cut == {(q, d) for (q, _), (d, s) in want.items() if s >= max(0.3 * want[q, 1][1], 0.009)}


def test_every_document_is_merged(spark, sf_dir):
    got = {tuple(r) for r in catalog.QUERIES["key_merge_upsert"](spark, sf_dir).collect()}
    assert {r[0] for r in got} == {r.doc_id for r in table(spark, sf_dir, "documents").collect()}


# ---- domains


def test_domains_of_whole_texts(spark, sf_dir, tmp_path):
    rows = [(1, "x" * 200 + " OUT of it"), (2, "x" * 200), (3, None), (4, "out")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    query = catalog.QUERIES["domain_normalise"]
    assert {r.doc_id for r in query(spark, str(tmp_path)).collect() if r.domain == "out_of_domain"} == {1, 4}


# ---- first rows and sinks


def test_one_first_row_a_key(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("b", 2, "z"), ("b", 2, "z"), (None, 5, "n"), (None, 4, "m"), ("c", None, "late"), ("c", 9, "early")], "_key string, ord long, row string")
    got = {tuple(r) for n in (1, 3) for r in dedup.first_by(rows.repartition(n), F.col("_key"), "ord").collect()}
    assert len(got) == 4 and {("b", 2, "z"), (None, 4, "m"), ("c", 9, "early")} < got
    assert dedup.first_by(rows.limit(0), F.col("_key"), "ord").columns == rows.columns


def test_discarded_pages_are_not_mined(spark):
    rows = [(1, "http://a.it/x", "<a href='http://courses.a.it/one'>c</a><p>first page</p>"), (2, "http://a.it/y.css", "<a href='http://courses.a.it/two'>c</a><p>style</p>"), (3, "http://courses.a.it/one", "<p>one</p>"), (4, "http://courses.a.it/two", "<p>two</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = crawl.acquire(pages, pages.where("page_id < 3").select("url"), "https://staff.example", inside="https://a.it")
    assert {(r.phase, r.source) for r in got.collect()} == {(0, "http://a.it/x"), (4, "http://courses.a.it/one")}


def test_units_of_values_with_marks(spark):
    site = urls.Site(unit_id="a=b c")
    df = spark.createDataFrame([("http://x.it/?unit=a=b%20c",), ("http://x.it/?unit=z=a=b%20c",), ("http://x.it/?q=1",)], "url string")
    assert [r[0] for r in df.select(urls.wrong_unit(F.col("url"), site)).collect()] == [False, True, False]


def test_json_hand_over(spark, tmp_path):
    docs = spark.createDataFrame([(2, "é" * 200, "s2", None), (1, 'a "b" ' * 40, "s1", "html"), (3, "short", "s3", "html")], "ord long, text string, source string, type string")
    assert kb.write_records_json(docs, str(tmp_path / "r.json"), "ord") == 2
    assert "é" in (tmp_path / "r.json").read_text(encoding="utf-8")
    back = kb.read_records(spark, str(tmp_path / "r.json")).orderBy("record_index").collect()
    assert [(r.source, r.type) for r in back] == [("s1", "html"), ("s2", "sconosciuto")]
    assert kb.write_records_json(docs.limit(0), str(tmp_path / "e.json"), "ord") == 0 and json.loads((tmp_path / "e.json").read_text()) == []
