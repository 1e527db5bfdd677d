"""Vector search and ranking: exact search over query blocks, parent lookup, reranking, cuts, context."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as t

#: Places that scores are rounded to before they rank, so that the order of a sum decides nothing.
PLACES = 6
TOP_CHILDREN, TOP_PARENTS, CONTEXT_CHARS = 20, 10, 3000
SHARE_OF_BEST, LEAST_SCORE = 0.3, 0.009
QUERY_BLOCK = 4096
#: Queries that are ranked at once in a task.
ROWS = 256


def hashed_embedding(text: str | None, size: int = 64) -> np.ndarray:
    """A stand-in for a model: words counted in hashed places with signs, length 1 (0 for no words)."""
    import xxhash

    out = np.zeros(size)
    for w in (text or "").lower().split():
        h = xxhash.xxh3_64_intdigest(w)
        out[h % size] += 1.0 if h >> 63 else -1.0
    norm = float(np.sqrt((out * out).sum()))
    return out / norm if norm else out


def embedded(rows: DataFrame, text: str = "text", embed: Callable[[str | None], np.ndarray] = hashed_embedding, name: str = "embedding") -> DataFrame:
    @F.pandas_udf("array<float>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda s: embed(s).astype(np.float32))

    return rows.withColumn(name, run(F.col(text)))


class Best:
    """The k best of each of n queries so far: higher scores first, ties by id, NaN last. What lies below a query's ``floor`` is not among them."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k, self.floor = k, np.full(n, -np.inf) if floor is None else floor.copy()
        self.at, self.s, self.v = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)

    def add(self, s: np.ndarray, ids: np.ndarray, among: np.ndarray | None = None) -> None:
        """Scores of all queries (rows) and some ids (columns), -inf but for those ``among``, if that is given. What lies below a query's k-th best, here or so far, is not sorted.

        ``ROWS`` queries at a time: where all ids tie, as those of copies do, all are sorted.
        """
        n, kept = s.shape[1], []
        for a in range(0, len(self.floor), ROWS):
            own, held = slice(a, a + ROWS), slice(*np.searchsorted(self.at, (a, a + ROWS)))
            floor = self.floor[own]
            if n > self.k and np.isinf(floor).any():
                floor = np.fmax(floor, np.partition(s[own], n - self.k, axis=1)[:, n - self.k])
            over = ~(s[own] < floor[:, None])
            q, c = np.nonzero(over if among is None else over & among[own])
            at, scores, v = np.concatenate([self.at[held], q + a]), np.concatenate([self.s[held], s[q + a, c]]), np.concatenate([self.v[held], ids[c]])
            order = np.lexsort((v, -scores, at))
            at, scores, v = at[order], scores[order], v[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            last, first = (place == self.k - 1) & ~np.isnan(scores), place < self.k
            self.floor[at[last]] = scores[last]
            kept.append((at[first], scores[first], v[first]))
        if kept:
            self.at, self.s, self.v = (np.concatenate(x) for x in zip(*kept, strict=True))


def query_blocks(held: DataFrame) -> Iterator[list]:
    """All rows of ``held``, in blocks by the hash of ``qid``."""
    blocks = max(1, -(-held.count() // (QUERY_BLOCK // 2)))
    for b in range(blocks):
        rows = held.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).collect()
        if rows:
            yield rows


def similar(queries: DataFrame, vectors: DataFrame, k: int = TOP_CHILDREN, qid: str = "qid", vid: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k most similar vectors of each query by inner product: ``qid``, ``vec_id``, ``score``, ``rank`` from 1, ties by id.

    Queries without an id or a vector, and vectors without one, have no hits; a query meets the vectors of its own length. Queries are taken in blocks of at most ``QUERY_BLOCK``, each sent whole; a task multiplies its vectors with the block and keeps its own k best a query, so what is shuffled is k rows a query and task.
    """
    spark = queries.sparkSession
    found = None
    for rows in query_blocks(queries.select(F.col(qid).alias("qid"), F.col(column).alias("q")).where("qid IS NOT NULL AND q IS NOT NULL")):
        by_size: dict[int, list] = {}
        for r in rows:
            by_size.setdefault(len(r.q), []).append(r)
        sent = spark.sparkContext.broadcast({n: (np.array([r.qid for r in own], np.int64), np.array([r.q for r in own], np.float64)) for n, own in by_size.items()})

        def search(parts: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            best = {n: Best(len(ids), k) for n, (ids, _) in sent.value.items()}
            for x in parts:
                for i in range(0, len(x), 2048):
                    part = x.iloc[i : i + 2048]
                    sizes = part["v"].map(len).to_numpy()
                    for n, (_, matrix) in sent.value.items():
                        if len(own := part[sizes == n]):
                            best[n].add(np.round(matrix @ np.array(own["v"].tolist(), np.float64).reshape(len(own), n).T, PLACES), own["vec_id"].to_numpy(np.int64))
            for n, (ids, _) in sent.value.items():
                yield pd.DataFrame({"qid": ids[best[n].at], "vec_id": best[n].v, "score": best[n].s})

        made = vectors.select(F.col(vid).cast("long").alias("vec_id"), F.col(column).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL").mapInPandas(search, "qid bigint, vec_id bigint, score double")
        found = made if found is None else found.unionByName(made)
    if found is None:
        return spark.createDataFrame([], "qid bigint, vec_id bigint, score double, rank int")
    place = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def diverse(hits: DataFrame, vectors: DataFrame, k: int = TOP_CHILDREN, weight: float = 0.5, vid: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Maximal marginal relevance over fetched hits: each pick maximises weight x score less (1 - weight) x its highest similarity to earlier picks; ties by rank.

    A group is the fetched hits of one query.
    """

    def pick(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("rank", kind="stable").reset_index(drop=True)
        v, s = np.array(x["v"].tolist(), np.float64), x["score"].to_numpy()
        chosen: list[int] = []
        nearest = np.full(len(x), -np.inf)
        while len(chosen) < min(k, len(x)):
            gain = weight * s - (1 - weight) * np.where(np.isinf(nearest), 0.0, nearest)
            gain[chosen] = -np.inf
            at = int(gain.argmax())
            chosen.append(at)
            nearest = np.maximum(nearest, v @ v[at])
        out = x.iloc[chosen][["qid", "vec_id", "score"]].copy()
        out["rank"] = np.arange(1, len(out) + 1, dtype=np.int32)
        return out

    rows = hits.join(vectors.select(F.col(vid).cast("long").alias("vec_id"), F.col(column).alias("v")), "vec_id")
    return rows.select("qid", "vec_id", "score", "rank", "v").groupBy("qid").applyInPandas(pick, "qid bigint, vec_id bigint, score double, rank int")


def first_hits(hits: DataFrame, parent: str = "parent_id") -> DataFrame:
    """Best-ranked child of each query and parent."""
    return hits.groupBy("qid", parent).agg(F.min("rank").alias("rank"))


def with_parents(hits: DataFrame, parents: DataFrame, parent: str = "parent_id", child_text: str = "child_text") -> DataFrame:
    """Text of the parent of each hit; of the child itself where the parent is unknown."""
    found = hits.join(parents.select(parent, F.col("text").alias("_parent")), parent, "left")
    return found.withColumns({"text": F.coalesce("_parent", child_text), "from_parent": F.col("_parent").isNotNull()}).drop("_parent")


def lexical_score(query: Column, text: Column) -> Column:
    """A stand-in for a cross-encoder: shared distinct terms over all distinct terms of both."""
    a, b = F.array_distinct(t.terms(query)), F.array_distinct(t.terms(text))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def lexical_best(questions: DataFrame, docs: DataFrame, k: int = TOP_PARENTS, qid: str = "qid", did: str = "doc_id", text: str = "text") -> DataFrame:
    """The k documents of the highest ``lexical_score`` for each question, of all documents: ``qid``, ``doc_id``, ``score``, ``place`` from 1, ties by id.

    Questions go in blocks as in ``similar``. A task counts the terms that a document shares with each question of a block by the questions that have the term. Texts that are null have null scores, which come last.
    """
    spark = questions.sparkSession
    distinct = F.array_distinct(t.terms(F.col(text)))
    told = docs.select(F.col(did).cast("long").alias("doc_id"), distinct.alias("b"))
    found = None
    for rows in query_blocks(questions.select(F.col(qid).cast("long").alias("qid"), distinct.alias("a"))):
        having: dict[str, list[int]] = {}
        for n, r in enumerate(rows):
            for w in r.a or ():
                having.setdefault(w, []).append(n)
        sizes = np.array([np.nan if r.a is None else len(r.a) for r in rows])
        sent = spark.sparkContext.broadcast((np.array([r.qid for r in rows]), sizes, {w: np.array(x) for w, x in having.items()}))

        def score(parts: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, sizes, having = sent.value
            best = Best(len(ids), k)
            for x in parts:
                for i in range(0, len(x), 1024):
                    part = x.iloc[i : i + 1024]
                    shared = np.zeros((len(part), len(ids)))
                    lengths = np.full(len(part), np.nan)
                    for n, words in enumerate(part["b"]):
                        if words is None:
                            continue
                        lengths[n] = len(words)
                        if hit := [having[w] for w in words if w in having]:
                            shared[n] = np.bincount(np.concatenate(hit), minlength=len(ids))
                    union = sizes + lengths[:, None] - shared
                    best.add(np.divide(shared, union, out=np.zeros_like(shared), where=union != 0).T, part["doc_id"].to_numpy(np.int64))
            yield pd.DataFrame({"qid": ids[best.at], "doc_id": best.v, "score": best.s})

        made = told.mapInPandas(score, "qid bigint, doc_id bigint, score double")
        found = made if found is None else found.unionByName(made)
    if found is None:
        return spark.createDataFrame([], "qid bigint, doc_id bigint, score double, place int")
    return reranked(found, F.when(~F.isnan("score"), F.col("score")), k, order="doc_id")


def reranked(pairs: DataFrame, score: Column, k: int = TOP_PARENTS, qid: str = "qid", order: str = "rank") -> DataFrame:
    """The k best of each query by score; ties keep their order."""
    place = Window.partitionBy(qid).orderBy(F.desc("score"), order)
    return pairs.withColumn("score", score).withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)


def adaptive_cut(ranked: DataFrame, qid: str = "qid") -> DataFrame:
    """Rows whose score is a share of the query's best at least, and over the least score at all."""
    best = F.max("score").over(Window.partitionBy(qid))
    return ranked.withColumn("_best", best).where(F.col("score") >= F.greatest(SHARE_OF_BEST * F.col("_best"), F.lit(LEAST_SCORE))).drop("_best")


def context(ranked: DataFrame, qid: str = "qid", place: str = "place", text: str = "text", most: int | None = CONTEXT_CHARS) -> DataFrame:
    """Texts of each query in order, joined by a blank line and cut. At most the reranked few are gathered."""
    joined = ranked.groupBy(qid).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col(text).alias("x")))), lambda v: v.x), "\n\n").alias("context"))
    return joined.withColumn("context", F.substring("context", 1, most)) if most else joined
