"""Benchmark decontamination: short test items inside long documents, by size-partitioned MinHash containment.

The similarity is one-sided: the share of an item's distinct five-word shingles that a document has. For each of ``hashes`` hash functions an item keeps the
shingle of its minimum. The chance that a document has that shingle is the containment itself, whatever the length
of the document, so the share of such shingles found estimates it. Items are partitioned by size (powers of two of
their shingle counts): a document is held against the partitions whose items could be contained in it at the
threshold, and each partition has its own least number of found minima, below which an item at the
threshold falls with a probability under ``miss``: items of a few shingles must share more than the threshold says, one of 2 all of them, one of 5 four. Candidates are verified on the full shingle sets.

Items are a stated set: they are taken in blocks of bounded size, each block is sent to the executors and all documents
pass it. Documents are never shuffled.

Defined results. Null or empty items and documents have no shingles and match nothing; with fewer than five words the whole sequence is
one shingle. Repeated items each give their rows, as do repeated documents. Empty tables give empty results. Extra columns are
left out by ``search`` and kept by ``cleaned``; an input column named like a helper is left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import by_batch, give_back, mixed, shingle_hashes, spread, words

SIZE = 5
FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shared", pa.int64()), ("n_item_shingles", pa.int64()), ("containment", pa.float64())])


def least_hits(hashes: int, share: float, miss: float) -> int:
    """The most hits that an item at the threshold has with a probability of at least ``1 - miss``; one or more."""
    total, k = 0.0, 0
    while True:
        total += comb(hashes, k) * share**k * (1 - share) ** (hashes - k)
        if total > miss:
            return max(1, k)
        k += 1


class Index:
    """Signatures and shingle sets of one block of items."""

    def __init__(self, items: list[tuple[int, str | None]], share: float = 0.75, hashes: int = 32, miss: float = 1e-9):
        self.share = share
        factors = np.random.default_rng(5).integers(1, 2**63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.sizes, sets, minima = [], [], [], []
        for key, text in items:
            found = words(text)
            if not found:
                continue
            own = shingle_hashes(found, SIZE)
            self.ids.append(key)
            self.sizes.append(len(own))
            sets.append(own)
            minima.append(own[(own[None, :] * factors[:, None]).argmin(axis=1)])
            for w in found:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        n = len(self.ids)
        self.word_hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.vocabulary), np.uint64, len(self.vocabulary))
        self.sizes = np.array(self.sizes, np.int64)
        order = lambda keys, items_: (keys[o := np.argsort(keys, kind="stable")], items_[o])
        join = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.uint64)
        self.set_keys, self.set_items = order(join(sets), np.repeat(np.arange(n), self.sizes))
        self.min_keys, self.min_items = order(join(minima), np.repeat(np.arange(n), hashes))
        partition = np.floor(np.log2(np.maximum(self.sizes, 1))).astype(np.int64)
        # By item: the least size of its partition, and the minima that the partition asks for.
        self.least, self.need = 2**partition, np.zeros(n, np.int64)
        for p in np.unique(partition).tolist():
            here = partition == p
            sizes = np.unique(self.sizes[here])
            self.need[here] = least_hits(hashes, float((np.ceil(share * sizes - 1e-9) / sizes).min()), miss)

    def shingles(self, found: list[bytes]) -> tuple[np.ndarray, int]:
        """Distinct shingles of the document that the block's words allow, and the most that the document can have."""
        if len(found) < SIZE:
            own = shingle_hashes(found, SIZE)
            return own, len(own)
        at = np.fromiter(map(self.vocabulary.get, found, repeat(-1)), np.int64, len(found))
        gaps = np.concatenate([[0], np.cumsum(at < 0)])
        whole = np.flatnonzero(gaps[SIZE:] == gaps[:-SIZE])
        h = self.word_hashes
        return np.unique(mixed([h[at[whole + i]] for i in range(SIZE)])) if len(whole) else np.empty(0, np.uint64), len(found) - SIZE + 1

    @staticmethod
    def hits(keys: np.ndarray, items: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items with keys that the document has, and how many."""
        lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        here = np.flatnonzero(hi > lo)
        if not len(here):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        spans = (hi - lo)[here]
        ends = np.cumsum(spans)
        return np.unique(items[np.repeat(lo[here] - (ends - spans), spans) + np.arange(ends[-1])], return_counts=True)

    def search(self, text: str | None) -> list[tuple[int, int, int]]:
        """Item, shared shingles and item size of all items that the text contains."""
        found = words(text)
        if not found or not self.ids:
            return []
        own, most = self.shingles(found)
        if not len(own):
            return []
        items, minima = self.hits(self.min_keys, self.min_items, own)
        candidates = items[(minima >= self.need[items]) & (self.share * self.least[items] <= most)]
        if not len(candidates):
            return []
        items, shared = self.hits(self.set_keys, self.set_items, own)
        kept = np.isin(items, candidates) & (shared >= self.share * self.sizes[items])
        return [(self.ids[i], n, int(self.sizes[i])) for i, n in zip(items[kept].tolist(), shared[kept].tolist(), strict=True)]


def indexes(items: DataFrame, item_id: str, text: str, share: float, block_bytes: int) -> Iterator[Index]:
    """Indexes of bounded blocks of items, one at a time."""
    kept = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    total = kept.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = spread(int(total), block_bytes, least=1)
    for k in range(blocks):
        rows = kept.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        yield Index(sorted(((r.item_id, r.text) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")), share)


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_id: str = "item_id", text: str = "text", share: float = 0.75, block_bytes: int = 16 << 20) -> DataFrame:
    """Pairs of document and item with their containment."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for index in indexes(items, item_id, text, share, block_bytes):
        sent = context.broadcast(index)

        def look(parts: Iterator[dict[str, list]], sent=sent) -> Iterator[list[tuple]]:
            for x in parts:
                yield [(key, i, shared, size, shared / size) for key, body in zip(x["doc_id"], x["text"], strict=True) for i, shared, size in sent.value.search(body)]

        made = by_batch(rows, look, FOUND)
        out = made if out is None else out.unionByName(made)
    return out


def free_of(sent) -> object:
    """Function for columns: whether a text contains no item of a sent index."""

    @F.pandas_udf("boolean")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in parts:
            yield pd.Series([not sent.value.search(body) for body in x], dtype=bool)
        give_back()

    return clean


def cleaned(docs: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", share: float = 0.75, block_bytes: int = 16 << 20) -> DataFrame:
    """The documents that contain no item; columns as they were."""
    context = docs.sparkSession.sparkContext
    for index in indexes(items, item_id, text, share, block_bytes):
        docs = docs.where(free_of(context.broadcast(index))(F.col(text)))
    return docs
