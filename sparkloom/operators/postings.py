"""Lexical search through an inverted index: BM25 over compressed postings, pruned by the most that a block can give.

``build`` inverts documents where they are read: each task cuts its documents into segments, and writes the postings of each term of a segment in blocks of ``BLOCK``
documents, with the highest frequency and the least document length in the block. Nothing is shuffled, and a term that all documents have is spread over all segments.

``bm25_best`` reads the blocks of the terms that are asked for, segment by segment. A question's terms are taken with the one that can give most first; once
the k-th best document is out of reach for one that has none of the terms so far, only documents that can still get there are looked at, in blocks that could get them there. What a segment gives is its k best a question, which are ranked over all segments.
The result is that of scoring every document.

A document's score is the sum over the question's distinct terms of ``ln(1 + (N - n + 0.5) / (n + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * length / mean length))``.

Defined results. Terms are those of ``text.terms``. A null text has no terms, and its length is 0; rows without an id are not indexed, repeated rows are documents of their own. Scores are rounded to ``PLACES`` and ties
go by id. Documents that share no term with a question are no hits, nor does a question without an id or a text have any. Empty tables give an empty index and no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as t
from sparkloom.operators.vectors import PLACES, TOP_PARENTS, query_blocks

BLOCK, SEGMENT_TERMS, SEGMENT_DOCS = 128, 4_000_000, 65_536
K1, B = 1.2, 0.75
#: Terms that are sought by value, so that the reader passes over pages without them; more are joined.
SOUGHT = 2_000
#: One row a block of postings; a segment's documents are the row without a term.
SCHEMA = "segment long, term string, first int, last int, n int, most int, least int, form int, body binary, terms long"
ROW = pa.schema([("segment", pa.int64()), ("term", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("n", pa.int32()), ("most", pa.int32()), ("least", pa.int32()), ("form", pa.int32()), ("body", pa.binary()), ("terms", pa.int64())])
WIDTHS = ("<u1", "<u2", "<u4")


def narrow(x: np.ndarray, width: int) -> bytes:
    return x.astype(WIDTHS[width]).tobytes()


def width_of(most: np.ndarray) -> np.ndarray:
    return (most > 0xFF).astype(np.int32) + (most > 0xFFFF)


def inverted(segment: int, ids: np.ndarray, terms: pa.ListArray) -> pa.RecordBatch:
    """Rows of one segment: its documents, then blocks by term. Documents are numbered by their place."""
    n = len(ids)
    lengths = terms.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    coded = terms.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    pairs, counts = np.unique(rank[coded.indices.to_numpy()] * n + np.repeat(np.arange(n), lengths), return_counts=True)
    term, doc = np.divmod(pairs, n)
    # Blocks start with a term, and at every BLOCK-th of its documents.
    begins = np.flatnonzero(np.diff(term, prepend=-1))
    inside = np.arange(len(term)) - np.repeat(begins, np.diff(np.append(begins, len(term))))
    starts = np.flatnonzero(inside % BLOCK == 0)
    ends = np.append(starts[1:], len(term))[: len(starts)].astype(np.int64)
    gaps = np.diff(doc, prepend=0)
    gaps[starts] = 0
    over = lambda f, x: f.reduceat(x, starts) if len(starts) else np.empty(0, np.int64)
    most, least = over(np.maximum, counts), over(np.minimum, lengths[doc])
    wide_gap, wide_count = width_of(over(np.maximum, gaps)), width_of(most)
    sizes = ends - starts
    # A block of one document says all in its columns.
    bodies = [b"" if m == 1 else narrow(gaps[a:b], g) + narrow(counts[a:b], c) for a, b, m, g, c in zip(starts.tolist(), ends.tolist(), sizes.tolist(), wide_gap.tolist(), wide_count.tolist(), strict=True)]
    names = coded.dictionary.take(pa.array(order)).take(pa.array(term[starts]))
    head = [(segment, None, 0, 0, n, 0, 0, 0, ids.astype("<i8").tobytes() + lengths.astype("<u4").tobytes(), int(lengths.sum()))]
    blank = np.zeros(len(starts), np.int64)
    blocks = [np.full(len(starts), segment), names, doc[starts], doc[ends - 1], sizes, most, least, wide_gap * 3 + wide_count, bodies, blank]
    made = [pa.array([head[0][k]], f.type) for k, f in enumerate(ROW)], [pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(blocks, ROW, strict=True)]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(list(c)) for c in zip(*made, strict=True)], schema=ROW)


def build(docs: DataFrame, path: str, did: str = "doc_id", text: str = "text") -> None:
    """Write the index of all documents to ``path``. A segment has the rows of one batch at most."""

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for x in batches:
            ids, terms = x.column(0).to_numpy(), x.column(1)
            ends = np.cumsum(terms.value_lengths().fill_null(0).to_numpy().astype(np.int64))
            at = 0
            while at < len(ids):
                before = int(ends[at - 1]) if at else 0
                stop = min(max(at + 1, int(np.searchsorted(ends, before + SEGMENT_TERMS, "right"))), at + SEGMENT_DOCS)
                yield inverted(number, ids[at:stop], terms.slice(at, stop - at))
                number, at = number + 1, stop

    rows = docs.select(F.col(did).cast("long").alias("doc_id"), t.terms(F.col(text)).alias("terms")).where("doc_id IS NOT NULL")
    rows.mapInArrow(invert, SCHEMA).write.parquet(path)


@dataclass
class Term:
    """A term's blocks in one segment, in order."""

    first: list[int] = field(default_factory=list)
    last: list[int] = field(default_factory=list)
    most: list[int] = field(default_factory=list)
    least: list[int] = field(default_factory=list)
    parts: list[tuple] = field(default_factory=list)


class Segment:
    """What is asked of one segment. ``read`` counts the blocks that were decoded."""

    def __init__(self, rows: pd.DataFrame, mean: float, k1: float = K1, b: float = B):
        head = rows[rows["term"].isna()].iloc[0]
        self.n, self.read = int(head["n"]), 0
        self.ids = np.frombuffer(head["body"], "<i8", self.n)
        lengths = np.frombuffer(head["body"], "<u4", self.n, 8 * self.n)
        self.k1, self.b, self.mean = k1, b, mean or 1.0
        self.norm = self.damping(lengths)
        self.terms: dict[str, Term] = {}
        self.known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for name, *rest in rows[rows["term"].notna()].sort_values(["term", "first"])[["term", "first", "last", "most", "least", "n", "form", "body"]].itertuples(index=False):
            own = self.terms.setdefault(name, Term())
            for kept, value in zip((own.first, own.last, own.most, own.least), rest, strict=False):
                kept.append(value)
            own.parts.append((rest[0], rest[2], *rest[4:]))
        self.bounds = {name: self.weight(np.array(x.most), self.damping(np.array(x.least))) for name, x in self.terms.items()}

    def damping(self, length):
        return self.k1 * (1 - self.b + self.b * length / self.mean)

    def weight(self, count, norm):
        return count * (self.k1 + 1) / (count + norm)

    def block(self, part: tuple) -> tuple[np.ndarray, np.ndarray]:
        first, most, n, form, body = part
        self.read += 1
        if n == 1:
            return np.array([first]), np.array([most])
        kinds = np.dtype(WIDTHS[form // 3]), np.dtype(WIDTHS[form % 3])
        return first + np.cumsum(np.frombuffer(body, kinds[0], n).astype(np.int64)), np.frombuffer(body, kinds[1], n, n * kinds[0].itemsize).astype(np.int64)

    def whole(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a term and what it gives them, before its rarity. Kept for other questions."""
        if name not in self.known:
            docs, counts = (np.concatenate(c) for c in zip(*map(self.block, self.terms[name].parts), strict=True))
            self.known[name] = docs, self.weight(counts, self.norm[docs])
        return self.known[name]

    def some(self, name: str, wanted: np.ndarray, enough: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for wanted documents (ascending) alone, from blocks that can give one of them what it needs (``enough``)."""
        if name in self.known:
            docs, given = self.known[name]
        else:
            own, found = self.terms[name], []
            lo, hi = np.searchsorted(wanted, own.first), np.searchsorted(wanted, own.last, "right")
            for k in np.flatnonzero(hi > lo).tolist():
                if self.bounds[name][k] >= enough[lo[k] : hi[k]].min():
                    found.append(self.block(own.parts[k]))
            if not found:
                return np.empty(0, np.int64), np.empty(0)
            docs, counts = (np.concatenate(c) for c in zip(*found, strict=True))
            given = self.weight(counts, self.norm[docs])
        at = np.searchsorted(docs, wanted)
        hit = np.flatnonzero((at < len(docs)) & (docs[np.minimum(at, len(docs) - 1)] == wanted))
        return wanted[hit], given[at[hit]]

    def best(self, question: list[tuple[str, float]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and rounded scores of the k best: terms come with their rarity."""
        slack = 10.0**-PLACES
        own = sorted(((float(self.bounds[name].max()) * idf, name, idf) for name, idf in question if name in self.terms), reverse=True)
        left = np.cumsum([x[0] for x in own][::-1])[::-1]
        score, wanted = np.zeros(self.n), None
        for (_, name, idf), most in zip(own, left, strict=True):
            if wanted is None and self.n > k and score.max(initial=0) > most:
                floor = np.partition(score, self.n - k)[self.n - k]
                if floor - slack > most:
                    wanted = np.flatnonzero(score)
            if wanted is None:
                docs, given = self.whole(name)
                score[docs] += idf * given
                continue
            floor = np.partition(score, self.n - k)[self.n - k]
            wanted = wanted[score[wanted] + most >= floor - slack]
            # A block matters if the term, with all that follow it, can lift one of its documents to the floor.
            after = most - idf * float(self.bounds[name].max())
            docs, given = self.some(name, wanted, (floor - slack - score[wanted] - after) / idf)
            score[docs] += idf * given
        found = np.flatnonzero(score)
        rounded = np.round(score[found], PLACES)
        if len(found) > k:
            top = np.flatnonzero(rounded >= np.partition(rounded, len(found) - k)[len(found) - k])
            found, rounded = found[top], rounded[top]
        order = np.lexsort((self.ids[found], -rounded))[:k]
        return self.ids[found[order]], rounded[order]


def scorer(sent, k: int, k1: float, b: float):
    """Function for the rows of a segment: its k best of each question that was sent."""

    def score(x: pd.DataFrame) -> pd.DataFrame:
        mean, asked = sent.value
        if x["term"].isna().all():
            return pd.DataFrame({"qid": [], "doc_id": [], "score": []})
        segment = Segment(x, mean, k1, b)
        out = [(q, *segment.best(own, k)) for q, own in asked]
        return pd.DataFrame({"qid": np.repeat([q for q, _, _ in out], [len(ids) for _, ids, _ in out]), "doc_id": np.concatenate([ids for _, ids, _ in out]), "score": np.concatenate([s for _, _, s in out])})

    return score


def bm25_best(spark: SparkSession, path: str, questions: DataFrame, k: int = TOP_PARENTS, qid: str = "qid", text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """The k documents of the highest score for each question: ``qid``, ``doc_id``, ``score``, ``place`` from 1. Questions go in blocks, as in ``vectors.similar``."""
    index = spark.read.schema(SCHEMA).parquet(path)
    n_docs, n_terms = index.where("term IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    mean = n_terms / n_docs if n_docs else 0.0
    asked = questions.select(F.col(qid).cast("long").alias("qid"), F.array_distinct(t.terms(F.col(text))).alias("a")).where("qid IS NOT NULL AND a IS NOT NULL")
    found = None
    for rows in query_blocks(asked):
        sought = sorted({w for r in rows for w in r.a})
        if len(sought) <= SOUGHT:
            held = index.where(F.col("term").isin(sought))
        else:
            held = index.join(F.broadcast(spark.createDataFrame([(w,) for w in sought], "term string")), "term", "left_semi")
        # As many as the block of questions has terms.
        rarity = {r.term: float(np.log(1 + (n_docs - r.n + 0.5) / (r.n + 0.5))) for r in held.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        sent = spark.sparkContext.broadcast((mean, [(r.qid, [(w, rarity[w]) for w in r.a if w in rarity]) for r in rows]))
        both = held.unionByName(index.where("term IS NULL"))
        made = both.groupBy("segment").applyInPandas(scorer(sent, k, k1, b), "qid long, doc_id long, score double")
        found = made if found is None else found.unionByName(made)
    if found is None:
        return spark.createDataFrame([], "qid long, doc_id long, score double, place int")
    place = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)
