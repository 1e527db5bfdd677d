"""Queries of retrieval and answering: search, lookup, reranking, cuts, history, flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import history, postings, vector_index, vectors
from sparkloom.plans import flow
from sparkloom.plans.registry import query
from sparkloom.session import cut, scratch, ship, table
from sparkloom.streaming import conversations

#: Queries are the vectors whose id this divides; they are held against all vectors.
EVERY = 20
KNN = f"""q AS (SELECT vec_id AS qid, embedding AS e FROM embeddings WHERE vec_id % {EVERY} = 0),
s AS (SELECT qid, vec_id, round(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score, label FROM q, embeddings v),
h AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 20)"""


def hits(spark, sf, k: int = 20):
    """Every vector of an id that ``EVERY`` divides is a query, held against all vectors."""
    vecs = table(spark, sf, "embeddings")
    queries = vecs.where(f"vec_id % {EVERY} = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return vectors.similar(queries, vecs, k)


@query("knn_top20", f"WITH {KNN} SELECT qid, vec_id, score, CAST(rank AS INT) AS rank FROM h")
def knn_top20(spark, sf):
    return hits(spark, sf)


@query("parent_first_hit", f"WITH {KNN} SELECT qid, label AS parent_id, CAST(min(rank) AS INT) AS rank FROM h GROUP BY 1, 2")
def parent_first_hit(spark, sf):
    labels = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("parent_id"))
    return vectors.first_hits(hits(spark, sf).join(labels, "vec_id"))


@query("parent_lookup_fallback", f"WITH {KNN} SELECT qid, vec_id, CASE WHEN label < 5 THEN 'parent ' || label ELSE 'child ' || vec_id END AS text, label < 5 AS from_parent FROM h")
def parent_lookup_fallback(spark, sf):
    """Labels below five are stored parents; the other hits keep their own text."""
    vecs = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("parent_id"), F.concat(F.lit("child "), F.col("vec_id").cast("string")).alias("child_text"))
    parents = vecs.where("parent_id < 5").select("parent_id", F.concat(F.lit("parent "), F.col("parent_id").cast("string")).alias("text")).distinct()
    return vectors.with_parents(hits(spark, sf).join(vecs, "vec_id"), parents).select("qid", "vec_id", "text", "from_parent")


def indexed(spark, sf, certified: bool):
    """The same search through an index that is built here."""
    vecs = table(spark, sf, "embeddings")
    path = scratch(spark, "vectors")
    vector_index.build(vecs, vector_index.fitted(vecs), path)
    queries = vecs.where(f"vec_id % {EVERY} = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return vector_index.search(path, queries, vecs, certified=certified)


@query("knn_index_top20")
def knn_index_top20(spark, sf):
    """By codes, then whole vectors: nearly the hits of ``knn_top20``; the tests measure how nearly."""
    return indexed(spark, sf, certified=False)


@query("knn_index_certified20", f"WITH {KNN} SELECT qid, vec_id, score, CAST(rank AS INT) AS rank FROM h")
def knn_index_certified20(spark, sf):
    """Exact, by bounds on what a cell can hold."""
    return indexed(spark, sf, certified=True)


#: Each round takes one hit of every query: the least gain's opposite, ties by rank. ``nearest`` is a hit's highest similarity to earlier picks.
MMR = f"""WITH RECURSIVE {KNN.replace('rank <= 20', 'rank <= 60')},
c AS (SELECT h.qid, h.vec_id, h.rank, h.score, CAST(v.embedding AS DOUBLE[]) AS e FROM h JOIN embeddings v ON h.vec_id = v.vec_id),
r AS (SELECT qid, vec_id, rank, score, e, CAST(NULL AS DOUBLE) AS nearest, CAST(NULL AS INT) AS place, 1 AS step FROM c
  UNION ALL
  SELECT qid, vec_id, rank, score, e, greatest(coalesce(nearest, -2), list_inner_product(e, pick_e)), CASE WHEN place IS NULL AND vec_id = pick THEN step ELSE place END, step + 1
  FROM (SELECT *, first_value(vec_id) OVER w AS pick, first_value(e) OVER w AS pick_e FROM r WHERE step <= 20
        WINDOW w AS (PARTITION BY qid, step ORDER BY place IS NOT NULL, 0.5 * score - 0.5 * coalesce(nearest, 0) DESC, rank)))
SELECT qid, vec_id, score, place AS rank FROM r WHERE step = 21 AND place IS NOT NULL"""


@query("mmr_select", MMR)
def mmr_select(spark, sf):
    return vectors.diverse(hits(spark, sf, 60), table(spark, sf, "embeddings"))


TERMS = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'))"
RANKED = f"""x AS (SELECT item_id AS qid, {TERMS.format('text')} AS a FROM benchmark),
y AS (SELECT doc_id, text, {TERMS.format('text')} AS b FROM documents),
t AS (SELECT * FROM x, y),
r AS (SELECT qid, doc_id, text, CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END AS score FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS place FROM r QUALIFY place <= 10)"""


def ranked(spark, sf):
    """Every question against every document."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return vectors.lexical_best(items, table(spark, sf, "documents"))


@query("rerank_lexical_top10", f"WITH {RANKED} SELECT qid, doc_id, score, CAST(place AS INT) AS place FROM k")
def rerank_lexical_top10(spark, sf):
    return ranked(spark, sf).select("qid", "doc_id", "score", "place")


@query("adaptive_threshold", f"WITH {RANKED}, m AS (SELECT qid, max(score) AS best FROM k GROUP BY qid) SELECT k.qid, doc_id, score FROM k JOIN m ON k.qid = m.qid WHERE score >= greatest(0.3 * best, 0.009)")
def adaptive_threshold(spark, sf):
    return vectors.adaptive_cut(ranked(spark, sf)).select("qid", "doc_id", "score")


@query("context_concat", f"WITH {RANKED} SELECT qid, sha256(substr(string_agg(text, chr(10) || chr(10) ORDER BY place), 1, 3000)) AS hash FROM k GROUP BY qid")
def context_concat(spark, sf):
    texts = table(spark, sf, "documents").select("doc_id", "text")
    return vectors.context(ranked(spark, sf).join(texts, "doc_id")).select("qid", F.sha2("context", 256).alias("hash"))


BM25 = r"""x AS (SELECT item_id AS qid, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS term FROM benchmark),
d AS (SELECT doc_id, coalesce(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), []) AS terms FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT count(*) AS n_docs, avg(len(terms)) AS mean FROM d),
f AS (SELECT doc_id, length, term, count(*) AS f FROM (SELECT doc_id, len(terms) AS length, unnest(terms) AS term FROM d) GROUP BY ALL),
i AS (SELECT term, ln(1 + (n_docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM f, s GROUP BY term, n_docs),
p AS (SELECT qid, doc_id, round(sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM x JOIN f USING (term) JOIN i USING (term), s GROUP BY qid, doc_id)
SELECT qid, doc_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INT) AS place FROM p QUALIFY place <= 10"""


@query("bm25_top10", f"WITH {BM25}")
def bm25_top10(spark, sf):
    """Every question against an index of all documents that is built here."""
    path = scratch(spark, "postings")
    postings.build(table(spark, sf, "documents"), path)
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return postings.bm25_best(spark, path, items).select("qid", "doc_id", "score", "place")


SPOKEN = "t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role IN ('user', 'assistant'))"


@query("history_last_turns", f"WITH {SPOKEN} SELECT conv_id, turn, role FROM t WHERE back <= 6")
def history_last_turns(spark, sf):
    return history.last_turns(history.spoken(table(spark, sf, "conversations"))).select("conv_id", "turn", "role")


@query("history_trim_chars", f"""WITH {SPOKEN}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS at, count(*) OVER (PARTITION BY conv_id) AS n FROM t WHERE back <= 16),
c AS (SELECT a.conv_id, a.turn, a.role, a.n - 2 * (a.at // 2) AS left_over, (SELECT sum(length(b.text)) FROM r b WHERE b.conv_id = a.conv_id AND b.at >= 2 * (a.at // 2)) AS chars FROM r a)
SELECT conv_id, turn, role FROM c WHERE chars <= 2000 OR left_over <= 2""")
def history_trim_chars(spark, sf):
    return history.trimmed(history.spoken(table(spark, sf, "conversations"))).select("conv_id", "turn", "role")


@query("history_by_turn", """WITH s AS (SELECT conv_id, turn, role, coalesce(length(text), 0) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role IN ('user', 'assistant')),
p AS (SELECT a.conv_id, a.turn, a.role, b.turn AS held, b.size, b.i - greatest(a.i - 16, 0) - 1 AS spot, least(a.i, 16) AS n FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.i <= a.i AND b.i > a.i - 16),
c AS (SELECT *, n - 2 * (spot // 2) AS left_over, sum(size) OVER (PARTITION BY conv_id, turn ORDER BY spot // 2 DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tail FROM p)
SELECT conv_id, turn, role, CAST(count(*) AS INT) AS n_kept, min(held) AS first_kept, CAST(sum(size) AS BIGINT) AS chars FROM c WHERE tail <= 2000 OR left_over <= 2 GROUP BY conv_id, turn, role""")
def history_by_turn(spark, sf):
    """All conversations as a stream of turns; each conversation's state is kept across its batches."""
    ship(spark)
    path, checkpoint = scratch(spark, "histories"), scratch(spark, "stream")
    conversations.written_histories(conversations.turn_stream(spark, f"{sf.rstrip(chr(47))}/conversations.parque[t]"), path, checkpoint).awaitTermination()
    return spark.read.schema(conversations.HISTORY).parquet(path).drop("history")


@query("rewrite_prompt", f"WITH {SPOKEN} SELECT conv_id, sha256(string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Bot: ' END || text, chr(10) ORDER BY turn)) AS hash FROM t WHERE back <= 6 GROUP BY conv_id")
def rewrite_prompt(spark, sf):
    found = history.rewrite_prompt(history.spoken(table(spark, sf, "conversations")))
    return found.select("conv_id", F.sha2("history", 256).alias("hash"))


#: A grader's raw answer, made of the row itself: one bad line, one repeat, one number out of range.
RAW = "CAST(1 + doc_id % 3 AS VARCHAR) || ': relevant' || chr(10) || 'junk' || chr(10) || '2: not_relevant' || chr(10) || CAST(1 + doc_id % 5 AS VARCHAR) || ': Relevant' || chr(10) || '99: relevant'"


@query("grade_parse", f"""WITH r AS (SELECT doc_id AS qid, lower({RAW}) AS raw, CAST(doc_id % 6 AS INT) AS n FROM documents),
l AS (SELECT qid, n, i, string_split(raw, chr(10))[i] AS line FROM r, generate_series(1, 5) s(i)),
g AS (SELECT qid, n, i, try_cast(regexp_extract(line, '^\\s*(\\d{{1,9}})\\s*:', 1) AS INT) AS doc, regexp_extract(line, ':(.*)$', 1) AS label FROM l),
v AS (SELECT * FROM g WHERE doc BETWEEN 1 AND n),
k AS (SELECT qid, doc, 0 AS later, i AS spot FROM v WHERE label LIKE '%relevant%' AND label NOT LIKE '%not%' UNION ALL SELECT r.qid, d, 1, d FROM r, generate_series(1, 6) s(d) WHERE d <= r.n AND NOT EXISTS (SELECT 1 FROM v WHERE v.qid = r.qid AND v.doc = d))
SELECT qid, CAST(doc AS INT) AS doc, CAST(row_number() OVER (PARTITION BY qid ORDER BY later, spot) AS INT) AS place FROM k""")
def grade_parse(spark, sf):
    line = lambda n: F.concat((1 + F.col("doc_id") % n).cast("string"), F.lit(":"))
    raw = F.concat(line(3), F.lit(" relevant\njunk\n2: not_relevant\n"), line(5), F.lit(" Relevant\n99: relevant"))
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("qid"), raw.alias("raw"), (F.col("doc_id") % 6).cast("int").alias("n_docs"))
    return flow.grades(rows, "raw", "n_docs")


@query("domain_normalise", "SELECT doc_id, CASE WHEN contains(lower(trim(text)), 'out') THEN 'out_of_domain' ELSE 'in_domain' END AS domain FROM documents")
def domain_normalise(spark, sf):
    """Whole texts play raw model answers."""
    return table(spark, sf, "documents").select("doc_id", flow.domain_of(F.col("text")).alias("domain"))


@query("hallucination_normalise", "SELECT doc_id, CASE WHEN contains(lower(CASE WHEN doc_id % 2 = 0 THEN ' Not Hallucinated' ELSE text END), 'hallucinated') THEN 'hallucinated' ELSE 'grounded' END AS grade FROM documents")
def hallucination_normalise(spark, sf):
    raw = F.when(F.col("doc_id") % 2 == 0, F.lit(" Not Hallucinated")).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", flow.hallucination_of(raw).alias("grade"))


@query("routing", "SELECT doc_id, CASE WHEN quality = 0 AND doc_id % 4 < 2 THEN 'retry' ELSE 'generate' END AS after_grading, CASE WHEN toxic = 1 AND doc_id % 2 < 1 THEN 'regenerate' ELSE 'end' END AS after_check FROM labels")
def routing(spark, sf):
    """Labels play grades, rests of the id play counters."""
    grade = F.when(F.col("quality") == 0, "not_relevant").otherwise("relevant")
    check = F.when(F.col("toxic") == 1, "hallucinated").otherwise("grounded")
    return table(spark, sf, "labels").select("doc_id", flow.route_after_grading(grade, F.col("doc_id") % 4).alias("after_grading"), flow.route_after_check(check, F.col("doc_id") % 2).alias("after_check"))


@query("qa_flow")
def qa_flow(spark, sf):
    """Benchmark items as questions over all documents as chunks, every stage on, with the stand-in models."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("parent_id"), "text")
    # Embedded once: each of up to four searches reads the checkpoint.
    children = cut(vectors.embedded(docs))
    parents = table(spark, sf, "documents").groupBy(F.col("source").alias("parent_id")).agg(F.min_by("text", "doc_id").alias("text"))
    questions = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("User: "), "text")).alias("history"))
    return flow.answer(questions, children, parents, flow.stub, flow.Flow(grading=True, checking=True))
