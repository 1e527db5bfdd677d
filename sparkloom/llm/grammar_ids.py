"""Token ids in a binary file format, compressed by a Re-Pair grammar a block.

Texts are encoded where they are read; their ids, two bytes each in a vocabulary of up to 65,536, are range-partitioned and sorted by document id, and cut into blocks
of about ``block_tokens`` ids that end with a document. In each block frequent pairs
of neighbouring symbols are replaced by nonterminals, again and again; a
block stores its rules, the expansion length of each nonterminal and the
symbols left. No pair crosses the end of a document, so one document, or a stretch of one, is decoded without
the rest of its block.

File format: Parquet, one row a block: ``part``, ``seq`` (place in file order), ``doc_ids``, ``token_ends``
and ``symbol_ends`` (by document, inside the block), ``rules`` (left and right symbols of each nonterminal, 32-bit little-endian),
``expansions`` (their lengths, 32-bit), ``symbols`` (16 or 32-bit), ``width`` and ``base``
(the first nonterminal). Symbol ``base - 1`` ends a document and stands for the end id.

Defined results. Null and empty text give the end id alone. A null id sorts first. Repeated ids follow one
another, by the hash of their token ids and then by those; however many rows have one id, or none, several tasks share them. An empty table writes no blocks and reads back empty. Extra columns are left
out. A very long text is one document of one block, which then holds more than ``block_tokens`` ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm import tokens
from sparkloom.llm.common import by_batch, spread, written

END_ID = 0
#: Pieces whose ids a worker keeps; starts of this many blocks are sent to all executors (a few bytes each), beyond it they are joined by a shuffle.
KEPT_PIECES, SENT_BLOCKS = 1_200_000, 500_000
#: Characters that the encoder splits at a time: twice the usual, for nothing else of size is held beside it here.
STRETCH = 16_000_000
BLOCK = "part int, seq int, doc_ids array<bigint>, token_ends array<bigint>, symbol_ends array<bigint>, n_tokens bigint, base int, width int, rules binary, expansions binary, symbols binary"
READ = pa.schema([(x, pa.int64()) for x in ("doc_id", "start", "n_tokens", "ids_crc32", "n_symbols")])


def disjoint(lefts: list[int], rights: list[int], stop: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first pairs that can't overlap: a symbol is the left one of pairs or the right one, not both.

    A pair of equal symbols is taken only if the symbol is in no other pair.
    """
    role: dict[int, str] = {}
    out = []
    for a, b in zip(lefts, rights, strict=True):
        if stop in (a, b):
            continue
        if a == b:
            if a in role:
                continue
            role[a] = "both"
        elif role.get(a, "left") != "left" or role.get(b, "right") != "right":
            continue
        else:
            role[a], role[b] = "left", "right"
        out.append((a, b))
        if len(out) == most:
            break
    made = np.array(out, np.int64).reshape(-1, 2)
    return made[:, 0], made[:, 1]


def chosen(symbols: np.ndarray, stop: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that occur ``least`` times or more, most frequent first, without overlaps."""
    wide = symbols.dtype.itemsize > 2
    kind, shift = (np.uint64, 32) if wide else (np.uint32, 16)
    keys = symbols[:-1].astype(kind)
    keys <<= kind(shift)
    keys |= symbols[1:]
    keys.sort()
    edges = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
    counts = np.diff(edges)
    often = np.flatnonzero(counts >= least)
    pairs, counts = keys[edges[often]], counts[often]
    if len(pairs) > 4 * most:
        best = np.argpartition(-counts, 4 * most)[: 4 * most]
        pairs, counts = pairs[best], counts[best]
    pairs = pairs[np.lexsort((pairs, -counts))]
    return disjoint((pairs >> kind(shift)).tolist(), (pairs & kind((1 << shift) - 1)).tolist(), stop, most)


def replaced(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, first: int, size: int) -> np.ndarray:
    """Each occurrence of pair k, from the left, becomes symbol ``first + k``."""
    ls, rs = np.unique(left), np.unique(right)
    lmap, rmap = np.zeros(size, np.int32), np.zeros(size, np.int32)
    lmap[ls], rmap[rs] = np.arange(1, len(ls) + 1), np.arange(1, len(rs) + 1)
    cells = np.zeros((len(ls) + 1) * (len(rs) + 1), np.int32)
    cells[lmap[left] * (len(rs) + 1) + rmap[right]] = np.arange(1, len(left) + 1)
    at = lmap[symbols[:-1]]
    at *= len(rs) + 1
    at += rmap[symbols[1:]]
    hit = cells[at]
    there = np.flatnonzero(hit)
    if len(there) > 1 and (close := np.diff(there) == 1).any():  # runs of one symbol: every second place
        starts = np.concatenate([[True], ~close])
        run = np.maximum.accumulate(np.where(starts, np.arange(len(there)), 0))
        there = there[(np.arange(len(there)) - run) % 2 == 0]
    out = symbols.copy()
    out[there] = (first - 1 + hit[there]).astype(out.dtype)
    keep = np.ones(len(out), bool)
    keep[there + 1] = False
    return out[keep]


def compressed(ids: np.ndarray, ends: np.ndarray, vocabulary: int, rounds: int = 5, per_round: int = 1024, least: int = 16) -> dict:
    """The grammar of one block. ``ends``: place after each document; the last id of each is the end id."""
    stop, base = vocabulary, vocabulary + 1
    roomy = base + rounds * per_round > 1 << 16
    symbols = ids.astype(np.uint32 if roomy else np.uint16)
    symbols[ends - 1] = stop
    rules, n = [], 0
    for _ in range(rounds):
        if len(symbols) < 2:
            break
        left, right = chosen(symbols, stop, least, per_round)
        if not len(left):
            break
        symbols = replaced(symbols, left, right, base + n, base + n + len(left))
        rules.append(np.stack([left, right], 1))
        n += len(left)
    made = np.concatenate(rules) if rules else np.empty((0, 2), np.int64)
    lengths = np.ones(base + n, np.int64)
    for k, (a, b) in enumerate(made.tolist()):
        lengths[base + k] = lengths[a] + lengths[b]
    return {
        "base": base, "width": symbols.dtype.itemsize, "rules": made.astype("<u4").tobytes(), "expansions": lengths[base:].astype("<u4").tobytes(),
        "symbols": symbols.astype(f"<u{symbols.dtype.itemsize}").tobytes(), "symbol_ends": np.flatnonzero(symbols == stop) + 1,
    }


class Block:
    """One block read back, with random access by document."""

    def __init__(self, row):
        self.base, self.doc_ids = int(row.base), row.doc_ids
        self.token_ends, self.symbol_ends = np.asarray(row.token_ends, np.int64), np.asarray(row.symbol_ends, np.int64)
        self.symbols = np.frombuffer(row.symbols, f"<u{int(row.width)}")
        rules, spans = np.frombuffer(row.rules, "<u4").reshape(-1, 2).astype(np.int64), np.frombuffer(row.expansions, "<u4").astype(np.int64)
        self.lengths = np.concatenate([np.ones(self.base, np.int64), spans])
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        flat = np.empty(int(self.lengths.sum()), np.uint32)
        flat[: self.base] = np.arange(self.base)
        flat[self.base - 1] = END_ID
        offsets, lengths = self.offsets.tolist(), self.lengths.tolist()
        for at, (a, b) in zip(offsets[self.base :], rules.tolist(), strict=True):
            middle = at + lengths[a]
            flat[at:middle] = flat[offsets[a] : offsets[a] + lengths[a]]
            flat[middle : middle + lengths[b]] = flat[offsets[b] : offsets[b] + lengths[b]]
        self.flat = flat

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        spans = self.lengths[symbols]
        ends = np.cumsum(spans)
        return self.flat[np.repeat(self.offsets[symbols] - (ends - spans), spans) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document of the block, with its end id."""
        return self.expand(self.symbols[(self.symbol_ends[k - 1] if k else 0) : self.symbol_ends[k]])

    def stretch(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the k-th document: only the symbols that cover them are expanded."""
        symbols = self.symbols[(self.symbol_ends[k - 1] if k else 0) : self.symbol_ends[k]]
        ends = np.cumsum(self.lengths[symbols])
        lo, hi = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skipped = int(ends[lo - 1]) if lo else 0
        return self.expand(symbols[lo:hi])[start - skipped : stop - skipped]


def write_blocks(docs: DataFrame, path: str, vocabulary_file: str, id_col: str = "doc_id", text: str = "text", block_tokens: int = 2_000_000, rounds: int = 5) -> None:
    """Write the ids of all documents, in ascending id order, to ``path``."""

    def encoded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokens.encoder(vocabulary_file, KEPT_PIECES, STRETCH)
        end = np.array([END_ID], encode.kind).tobytes()
        for x in parts:
            raw = [ids + end for ids in encode.packed_all(x["text"])]
            yield pd.DataFrame({"doc_id": x["doc_id"], "no_id": x["no_id"], "n_tokens": [len(r) // encode.kind.itemsize for r in raw], "ids": raw})

    def blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokens.encoder(vocabulary_file, KEPT_PIECES, STRETCH)
        vocabulary, part, seq = encode.tokenizer.get_vocab_size(True), TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def block() -> pd.DataFrame:
            lengths = np.fromiter(map(len, held), np.int64, len(held)) // encode.kind.itemsize
            ends = np.cumsum(lengths)
            found = compressed(np.frombuffer(b"".join(held), encode.kind), ends, vocabulary, rounds)
            return pd.DataFrame({"part": [part], "seq": [seq], "doc_ids": [ids], "token_ends": [ends], "symbol_ends": [found["symbol_ends"]], "n_tokens": [int(ends[-1])]} | {k: [found[k]] for k in ("base", "width", "rules", "expansions", "symbols")})

        for x in parts:
            for key, missing, n, raw in zip(x["doc_id"], x["no_id"], x["n_tokens"], x["ids"], strict=True):
                ids.append(None if missing else int(key))
                held.append(raw)
                size += n
                if size >= block_tokens:
                    yield block()
                    ids, held, size, seq = [], [], 0, seq + 1
        if held:
            yield block()

    key = F.col(id_col)
    rows = docs.select(F.coalesce(key, F.lit(0)).cast("long").alias("doc_id"), key.isNull().alias("no_id"), F.col(text).alias("text"))
    # Written, so that neither the sample for the ranges nor a lost shuffle file encodes texts again.
    rows = written(rows.mapInPandas(encoded, "doc_id bigint, no_id boolean, n_tokens bigint, ids binary"), "encoded")
    total = rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    order = [F.col("no_id").desc(), F.col("doc_id"), F.xxhash64("ids")]
    ranged = rows.repartitionByRange(spread(int(total), 2 * block_tokens), *order)
    ranged.sortWithinPartitions(*order, "ids").mapInPandas(blocks, BLOCK).write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Digest of every document from the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``.

    Starts are summed in two steps: over parts, of which there is one a writing task, then inside a part.
    """
    found = spark.read.schema(BLOCK).parquet(path)
    sizes = found.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = sizes.withColumn("inside", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    few = sizes.count() <= SENT_BLOCKS
    starts = inside.join(before, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("start"))

    def digests(parts: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
        for x in parts:
            for k in range(len(x["part"])):
                block = Block(SimpleNamespace(**{name: column[k] for name, column in x.items()}))
                ids = block.expand(block.symbols).astype("<u4")
                ends = block.token_ends
                begins = np.concatenate([[0], ends[:-1]])
                sizes, spans = (ends - begins).tolist(), np.diff(block.symbol_ends, prepend=0).tolist()
                yield [(key, x["start"][k] + at, n, zlib.crc32(ids[at : at + n].tobytes()), m) for key, at, n, m in zip(block.doc_ids, begins.tolist(), sizes, spans, strict=True)]

    joined = found.join(F.broadcast(starts) if few else starts, ["part", "seq"])
    return by_batch(joined, digests, READ)
