"""Operators on small tables, with brute force or hand-made expectations, and invariants."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.operators import chunks, dedup, history, quality, structure, vectors
from sparkloom.plans import flow, report
from sparkloom.sources import crawl, kb


def test_url_then_content_dedup(spark):
    rows = [(1, "http://a.it/x", "t"), (2, "https://A.it/x/", "u"), (3, "https://a.it/y", "t"), (4, None, "v"), (5, "", "w")]
    docs = spark.createDataFrame(rows, "ord int, source string, text string")
    once = dedup.url_dedup(docs, "ord")
    assert sorted(r.ord for r in once.collect()) == [1, 3, 4]
    assert sorted(r.ord for r in dedup.url_dedup(docs, "ord", keep_empty=True).collect()) == [1, 3, 4, 5]
    assert sorted(r.ord for r in dedup.content_dedup(once, "ord").collect()) == [1, 4]
    assert dedup.accounting(docs, once, dedup.content_dedup(once, "ord")).first() == (5, 3, 2)


def test_first_by_is_stable_under_repartition(spark):
    rows = [(i, f"k{random.Random(i).randrange(5)}") for i in range(200)]
    docs = spark.createDataFrame(rows, "ord int, k string")
    want = {k: min(i for i, x in rows if x == k) for _, k in rows}
    for n in (1, 7):
        assert {r.k: r.ord for r in dedup.first_by(docs.repartition(n), F.col("k"), "ord").collect()} == want


def test_upsert_and_last(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, dedup.upsert(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    rows = spark.createDataFrame([("x", 1), ("x", 2), (None, 3)], "k string, o int")
    assert [tuple(r) for r in dedup.last_by(rows, "k", "o").collect()] == [("x", 2)]


@pytest.mark.parametrize(("n", "code"), [(99, "TOO_SHORT"), (100, "BELOW_IDEAL"), (400, None), (1600, None), (1601, "ABOVE_IDEAL"), (2000, "ABOVE_IDEAL"), (2001, "TOO_LONG")])
def test_length_rule(spark, n, code):
    row = spark.createDataFrame([(n,)], "length int").select(quality.length_issue(quality.PARENT).alias("i")).first()
    assert (row.i.code if row.i else None) == code


def test_scores_and_labels(spark):
    kinds = [["error"], ["error", "warning"], ["info"], ["error"] * 9, []]
    rows = spark.createDataFrame([([(s, "c", "m") for s in k],) for k in kinds], f"i array<{quality.ISSUE}>")
    got = rows.select(quality.score(F.col("i")).alias("s")).select("s", quality.label(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [(85, "Ottimo"), (80, "Discreto"), (95, "Ottimo"), (0, "Critico"), (100, "Ottimo")]


def test_child_issues_and_summary(spark):
    text = "Word one. " * 3
    rows = spark.createDataFrame([("c1", "p", text, "s"), (None, None, "# h\nshort", "s"), ("c3", "p", None, "r")], "child_id string, parent_id string, text string, source string")
    found = quality.reports(rows, quality.CHILD, "child", F.col("parent_id"), F.col("child_id"))
    codes = [[i.code for i in r.issues] for r in found.collect()]
    assert codes[0] == ["TOO_SHORT", "FEW_WORDS", "REPETITIVE", "NO_CONTEXT_INJECTION"]
    assert codes[1] == ["TOO_SHORT", "FEW_WORDS", "NO_PARENT_ID", "NO_CHILD_ID"]
    row = quality.summary(found).first()
    assert row.errors == sum(i.severity == "error" for r in found.collect() for i in r.issues)
    assert sum(row.quality_dist.values()) == 3 and row.length_stats["count"] == 3
    told = report.console(json.loads(quality.summary(found).toJSON().first()), "Children")
    assert "chunks: 3" in told


def test_stats(spark):
    one = lambda v: quality.stats(spark.createDataFrame([(x,) for x in v], "v double"), "v").first()
    assert tuple(one([1.0, 2.0, 4.0, 9.0])) == (4, 1.0, 9.0, 4.0, 3.0, 3.6)
    assert one([5.0]).stdev == 0
    assert tuple(one([])) == (0, None, None, None, None, None)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!\n;é", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_splitter(text, size, overlap):
    made = chunks.split_text(text, size, overlap, chunks.CHILD_CUTS)
    assert all(len(c) <= size and c == c.strip() and c for c in made)
    at = 0
    squeezed = "".join(text.split())
    for c in made:  # in order, and nothing but white space is lost
        c = "".join(c.split())
        back = max(0, at - overlap)
        found = squeezed.rfind(c, back, at + len(c))  # the last place that leaves nothing out
        assert back <= found <= at
        at = max(at, found + len(c))
    assert at == len(squeezed)


def test_sections_parents_children(spark):
    body = "intro text " * 12 + "\n# One\n" + "alpha beta. " * 150 + "\n## Two\n```\n# no header\n```\n" + "gamma delta " * 9
    docs = spark.createDataFrame([("s", "T", "html", 0, body), ("s", "T", "odd", 1, "words and more words " * 8), ("s", "T", "pdf", 2, "")], "source string, title string, type string, record_index long, text string")
    sections = chunks.header_sections(docs, ["record_index"]).where("record_index = 0").orderBy("section").collect()
    assert [r.headers[:2] for r in sections] == [[None, None], ["One", None], ["One", "Two"]]
    parents = chunks.parents(docs)
    rows = parents.orderBy("chunk_pos").collect()
    assert [r.chunk_pos for r in rows] == list(range(len(rows))) and len({r.parent_id for r in rows}) == len(rows)
    assert all(r.text.startswith("Document: T\n\n") for r in rows)
    again = {r.parent_id for r in chunks.parents(docs.repartition(3)).collect()}
    assert again == {r.parent_id for r in rows}
    kids = chunks.children(parents)
    assert all(len(r.raw) <= 400 for r in kids.collect())
    whole = structure.integrity(parents, kids, "chunk_pos").first()
    assert (whole.orphan_children, whole.childless_parents) == (0, 0)
    assert whole.overlap.pairs == whole.total_children - whole.total_parents
    sample = structure.debug_sample(parents, kids, "chunk_pos", 2).collect()
    assert len(sample) == 2 and all(r.num_children == len(r.children) > 0 for r in sample)


def test_structure(spark):
    parents = spark.createDataFrame([("p1", 0), ("p2", 1)], "parent_id string, ord int")
    kids = spark.createDataFrame([("p1", 0), ("p9", 0), (None, 0)], "parent_id string, child_index int")
    assert structure.orphans(kids, parents).count() == 2
    assert [r.parent_id for r in structure.childless(parents, kids).collect()] == ["p2"]


def test_retrieval(spark):
    hits = spark.createDataFrame([(1, "p1", 1, "a"), (1, "p2", 2, "b"), (1, "p1", 3, "c"), (1, "p9", 4, "d")], "qid int, parent_id string, rank int, child_text string")
    first = vectors.first_hits(hits).orderBy("rank")
    assert [r.parent_id for r in first.collect()] == ["p1", "p2", "p9"]
    parents = spark.createDataFrame([("p1", "A"), ("p2", "B")], "parent_id string, text string")
    found = vectors.with_parents(first.join(hits.select("qid", "rank", "child_text"), ["qid", "rank"]), parents).orderBy("rank").collect()
    assert [r.text for r in found] == ["A", "B", "d"]


def test_adaptive_cut(spark):
    rows = [(1, x) for x in (0.9, 0.3, 0.28, 0.26)] + [(2, 0.02), (2, 0.008), (3, 0.005)]
    kept = vectors.adaptive_cut(spark.createDataFrame(rows, "qid int, score double")).collect()
    assert sorted((r.qid, r.score) for r in kept) == [(1, 0.28), (1, 0.3), (1, 0.9), (2, 0.02)]


def test_similar_and_diverse(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 8)).astype("float32")
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    vecs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>").repartition(3)
    queries = vecs.where("vec_id < 4").select(F.col("vec_id").alias("qid"), "embedding")
    hits = vectors.similar(queries, vecs, 10)
    s = np.round(m[:4].astype(float) @ m.astype(float).T, 6)
    for q in range(4):
        want = sorted(range(60), key=lambda i: (-s[q, i], i))[:10]
        assert [r.vec_id for r in hits.where(f"qid = {q}").orderBy("rank").collect()] == want
    plain = vectors.diverse(hits, vecs, k=5, weight=1.0).where("qid = 0").orderBy("rank").collect()
    assert [r.vec_id for r in plain] == [r.vec_id for r in hits.where("qid = 0 AND rank <= 5").orderBy("rank").collect()]


def brute_trim(messages, most=2000):
    messages = messages[-16:]
    while sum(map(len, messages)) > most and len(messages) > 2:
        messages = messages[2:]
    return messages


def test_history(spark):
    rng = random.Random(2)
    talks = {c: ["x" * rng.choice([10, 200, 900, 5000]) for _ in range(rng.randrange(1, 24))] for c in range(30)}
    talks[100], talks[101] = ["x" * 900, "x" * 200] * 3, ["x" * 2500, "x" * 2500]
    rows = [(c, i, "user" if i % 2 == 0 else "assistant", t) for c, ts in talks.items() for i, t in enumerate(ts)]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = {}
    for r in history.trimmed(turns).collect():
        got.setdefault(r.conv_id, []).append(r.turn)
    assert {c: sorted(v) for c, v in got.items()} == {c: list(range(len(ts) - len(brute_trim(ts)), len(ts))) for c, ts in talks.items()}


def test_grades(spark):
    rows = [(1, "2: relevant\n1: not_relevant\njunk", 3), (2, None, 2), (3, "1: relevant\n1: relevant", 1), (4, "9: relevant", 0)]
    got = flow.grades(spark.createDataFrame(rows, "qid int, raw string, n int"), "raw", "n").orderBy("qid", "place").collect()
    assert [(r.qid, r.doc) for r in got] == [(1, 2), (1, 3), (2, 1), (2, 2), (3, 1), (3, 1)]


def test_normalisers_and_routes(spark):
    rows = spark.createDataFrame([("Out_of_domain",), ("in_domain",), ("about",), (None,)], "x string")
    assert [r[0] for r in rows.select(flow.domain_of(F.col("x"))).collect()] == ["out_of_domain", "in_domain", "out_of_domain", "in_domain"]
    rows = spark.createDataFrame([("Grounded",), ("not hallucinated",), (None,)], "x string")
    assert [r[0] for r in rows.select(flow.hallucination_of(F.col("x"))).collect()] == ["grounded", "hallucinated", "grounded"]
    rows = spark.createDataFrame([("not_relevant", k) for k in range(3)], "g string, n int")
    assert [r[0] for r in rows.select(flow.route_after_grading(F.col("g"), F.col("n"))).collect()] == ["retry", "retry", "generate"]


def test_ui():
    pairs = [("a", "b")] * 10
    assert len(flow.ui_history(pairs)) == 15 and flow.ui_history([{"role": "user", "content": "q"}]) == [("user", "q")]

    def fail(*_):
        raise RuntimeError

    assert flow.ui_answer("x", [], fail) == flow.UI_FAILED and flow.ui_answer("x", pairs, lambda m, h: m) == "x"


def test_flow_answers_every_question(spark):
    texts = ["apples grow on trees", "rivers run to the sea", "stars shine at night"]
    children = vectors.embedded(spark.createDataFrame([(i, f"p{i}", t) for i, t in enumerate(texts)], "vec_id long, parent_id string, text string"))
    parents = spark.createDataFrame([("p0", "apples grow on trees in autumn")], "parent_id string, text string")
    asked = spark.createDataFrame([(1, "apples trees", None), (2, "rivers sea", "User: hi")], "qid int, question string, history string")

    def model(prompt):
        if prompt.startswith("DOMAIN?"):
            return "out" if "rivers" in prompt else "in"
        return "apples" if "autumn" in prompt else None

    got = {r.qid: r for r in flow.answer(asked, children, parents, model).collect()}
    assert got[1].answer == "apples" and got[2].answer == flow.OUT_OF_DOMAIN


def test_crawl(spark):
    link = lambda *hs: "".join(f"<a href='{h}'>x</a>" for h in hs) + "<p>" + "text " * 30 + "</p>"
    pages = spark.createDataFrame([(0, "http://a.it/", link("/b", "/x.css")), (1, "http://a.it/b", link("/c")), (2, "https://A.it/b/", link()), (3, "http://a.it/c", link("/d")), (4, "http://a.it/d", link()), (5, "http://a.it/x.css", "css")], "page_id long, url string, html string")
    reached = {r.url: r.level for r in crawl.reach(pages, pages.where("page_id = 0").select("url"), 3).collect()}
    assert reached == {"https://a.it": 1, "https://a.it/b": 2, "https://a.it/c": 3, "https://a.it/x.css": 2}
    why = {r.page_id: r.discard_reason for r in crawl.judged(pages, "page_id").collect()}
    assert why[2] == "discard_duplicate" and why[5] == "discard_extension" and why[1] is None
    kept = crawl.crawled(pages, pages.where("page_id = 0").select("url"), 3).collect()
    assert sorted(r.source for r in kept) == ["http://a.it/", "http://a.it/b", "http://a.it/c"]


def test_stores(spark, tmp_path):
    (tmp_path / "kb.json").write_text(json.dumps([{"text": "é" * 200, "source": "s", "type": "html"}, {"text": "x", "source": None}]))
    records = kb.read_records(spark, str(tmp_path / "kb.json"))
    assert [(r.record_index, r.source) for r in records.orderBy("record_index").collect()] == [(0, "s"), (1, None)]
    kb.write_records(records, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    (tmp_path / "store.json").write_text(json.dumps({"p1": {"page_content": "t", "metadata": {"a": "b"}}}))
    assert kb.read_store(spark, str(tmp_path / "store.json")).first().text == "t"
    new = spark.createDataFrame([("c1", None)], "child_id string, text string")
    kb.merge_children(spark, None, new, str(tmp_path / "v0"))
    kb.merge_children(spark, str(tmp_path / "v0"), spark.createDataFrame([("c1", "z"), ("c2", "y")], "child_id string, text string"), str(tmp_path / "v1"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "v1")).collect())) == [("c1", "z"), ("c2", "y")]
    with pytest.raises(Exception):  # noqa: B017
        kb.read_records(spark, str(tmp_path / "none.json")).count()
    (tmp_path / "a.pdf").write_bytes(b"page text")
    assert kb.read_pdfs(spark, str(tmp_path), lambda b: b.decode()).first().text == "page text"


def test_streamed_upsert(spark, tmp_path):
    from sparkloom.sources import buckets
    from sparkloom.streaming import upsert

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"text": "one", "source": "s1", "type": "html"}\n')
    run = lambda: upsert.upsert_stream(upsert.record_stream(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(60)
    run()
    (tmp_path / "in/b.json").write_text('{"text": "two", "source": "s1", "type": "html"}\n{"text": "three", "source": "s2", "type": "html"}\n')
    run()
    assert sorted((r.source, r.text) for r in buckets.read(spark, str(tmp_path / "t")).collect()) == [("s1", "two"), ("s2", "three")]
