"""SimHash near-duplicates, compared in bit slices.

A text's fingerprint has a bit set where more than half of its shingles' hashes have it. Fingerprints that differ in at most ``radius`` bits are linked; documents with
one fingerprint are a class.

1. The 64 bits are cut into ``radius`` + 3 blocks. Two fingerprints within the radius agree in three blocks at least, so each goes to one bucket for
   each choice of three blocks: about 32 bits agree there, which keeps buckets small however many documents there are.
2. A bucket is a cell; one of more than ``cell`` fingerprints is cut into blocks by hash, and each two of them meet in a cell.
3. In a cell the bits that the key doesn't fix are stored as bit planes: one word holds a bit of 64 fingerprints. A block of queries is held against
   all planes at once: the differing bits go through a carry-save adder into two bitwise counters and a plane of those that have overflowed; a query whose
   fingerprints have all exceeded the radius leaves. Every fingerprint is a query once, against those that nothing has reached yet, so a group of near copies costs about its size.
   Buckets of a few are compared pair by pair, one pair a lane of the planes.
4. A cell gives one link for each fingerprint that it joins to another; components come from the links.

No pair within the radius is left out: agreement in blocks is a necessity, not a chance.

Defined results. Null, empty and blank texts have the fingerprint zero, linked like any other; fewer words than a shingle has are one shingle. A row with a null id
has a fingerprint and no component, and links nothing. Rows of one id are one document, linked by what either holds. An empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import by_batch, give_back, joined_by, words, written
from sparkloom.llm.odd_sketches import components

RADIUS, CELL, QUERIES, FEW = 3, 8192, 256, 8
WORD = np.uint64(0xFFFFFFFFFFFFFFFF)
PRINTS = pa.schema([("doc_id", pa.int64()), ("print", pa.int64())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: str | None, size: int = 3) -> int:
    """Signed 64 bits. Hashes of long texts are counted in parts."""
    found = words(text)
    if not found:
        return 0
    whole = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(lengths) - 1
    n = max(1, len(found) - size + 1)
    starts = (ends - lengths + 1)[:n].tolist()
    stops = ends[size - 1 :].tolist() if len(found) >= size else [len(whole)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(whole[a:b], 42) for a, b in zip(starts, stops, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 16384):
        ones += np.unpackbits(h[i : i + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def prints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    def look(parts: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
        for x in parts:
            yield [(key, fingerprint(body, size)) for key, body in zip(x["doc_id"], x["text"], strict=True)]

    return by_batch(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")), look, PRINTS)


def masks(radius: int = RADIUS) -> list[int]:
    """Bits of each choice of three blocks, as signed numbers."""
    cuts = np.linspace(0, 64, radius + 4).round().astype(int).tolist()
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [int(np.array([sum(c)], np.uint64).view(np.int64)[0]) for c in combinations(blocks, 3)]


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes, the lowest bit first: row b has bit b of every value, 64 values a word."""
    lanes = np.zeros((-(-len(values) // 64) * 64, 64), np.uint8)
    lanes[: len(values)] = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(lanes.T), axis=1, bitorder="little").view(np.uint64)


def lanes(found: np.ndarray) -> np.ndarray:
    """Places of the set bits of a row of words."""
    return np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little"))


class Counter:
    """Bitwise counters of one shape: each lane counts to ``radius``; one more leaves it ``over`` for good."""

    def __init__(self, shape: tuple[int, ...], radius: int):
        size = max(1, radius.bit_length())
        # Counters overflow one past the radius: they start at what is between it and their greatest value.
        start = (1 << size) - 1 - radius
        self.count = [np.full(shape, WORD if start >> k & 1 else 0, np.uint64) for k in range(size)]
        self.over = np.zeros(shape, np.uint64)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        """Two planes at once: a carry-save adder takes both into the lowest counter, and its carry goes up."""
        low = self.count[0]
        half = low ^ x
        carry = (low & x) | (half & y)
        self.count[0] = half ^ y
        for k in range(1, len(self.count)):
            up = self.count[k] & carry
            self.count[k] = self.count[k] ^ carry
            carry = up
        self.over |= carry

    def keep(self, rows: np.ndarray) -> None:
        self.count, self.over = [c[rows] for c in self.count], self.over[rows]


def within(stored: np.ndarray, queries: np.ndarray, bits: list[int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Queries that have a value within the radius in the block, and for each a bitset of those lanes. Bits not in ``bits`` agree."""
    alive = np.arange(len(queries))
    counter = Counter((len(queries), stored.shape[1]), radius)
    asked = [np.where(queries >> np.uint64(b) & np.uint64(1), WORD, np.uint64(0))[:, None] for b in bits]
    for k in range(0, len(bits), 2):
        x = stored[bits[k]] ^ asked[k][alive]
        y = stored[bits[k + 1]] ^ asked[k + 1][alive] if k + 1 < len(bits) else np.zeros_like(x)
        counter.add(x, y)
        if k % 8 == 6:
            left = (counter.over != WORD).any(axis=1)
            if not left.all():
                alive = alive[left]
                counter.keep(left)
                if not len(alive):
                    break
    return alive, ~counter.over


def joined(values: np.ndarray, bits: list[int], radius: int = RADIUS, block: int = 4096) -> np.ndarray:
    """For each value the place of one that stands for its component within this cell."""
    n = len(values)
    label, reached, open_ = np.arange(n), np.zeros(n, bool), np.ones(n, bool)
    waiting: list[int] = []
    at, rest, stored = 0, np.arange(n), None
    while waiting or at < n:
        now, waiting = waiting[:QUERIES], waiting[QUERIES:]
        while len(now) < QUERIES and at < n:
            if open_[at] and not reached[at]:
                now.append(at)
                reached[at] = True
            at += 1
        if not now:
            break
        # Planes hold what is open; they are packed anew once half of it has gone.
        if stored is None or open_[rest].sum() * 2 < len(rest):
            rest = rest[open_[rest]]
            stored = planes(values[rest]) if len(rest) else None
        if stored is None:
            break
        queries = np.array(now)
        # What already has a query's label is no target of it.
        labels, own_label = np.unique(label[queries], return_inverse=True)
        targets = np.zeros((len(labels), stored.shape[1] * 64), bool)
        targets[:, : len(rest)] = open_[rest] & (label[rest] != labels[:, None])
        masks_ = np.packbits(targets, axis=1, bitorder="little").view(np.uint64)
        for w in range(0, stored.shape[1], block // 64):
            alive, found = within(stored[:, w : w + block // 64], values[queries], bits, radius)
            found &= masks_[own_label[alive], w : w + block // 64]
            some = found.any(axis=1)
            for i, row in zip(queries[alive[some]].tolist(), found[some], strict=True):
                hits = rest[lanes(row) + 64 * w]
                known = reached[hits]
                fresh = hits[~known]
                own = label[i]
                label[fresh] = own
                reached[fresh] = True
                waiting += fresh.tolist()
                for other in np.unique(label[hits[known]]).tolist():
                    if other != own:
                        label[label == other] = own
        # A query has met all that was open, others of its block among them.
        open_[queries] = False
    return label


def few_links(values: np.ndarray, ids: np.ndarray, ends: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links in buckets of at most ``FEW``; ``ends`` is where each value's bucket ends. One pair is one lane."""
    a, b = [], []
    spots = np.arange(len(values))
    for step in range(1, FEW):
        left = spots[spots + step < ends]
        for i in range(0, len(left), 65536):
            part = left[i : i + 65536]
            if not len(part):
                continue
            differing = planes(values[part] ^ values[part + step])
            counter = Counter((differing.shape[1],), radius)
            for k in range(0, 64, 2):
                counter.add(differing[k], differing[k + 1])
                if k % 8 == 6 and (counter.over == WORD).all():
                    break
            near = lanes(~counter.over)
            near = part[near[near < len(part)]]
            a.append(ids[near])
            b.append(ids[near + step])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def links(classes: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """Links (``a``, ``b``) between the ``rep`` of classes that join all classes within the radius; ``print`` is distinct."""
    fixed = masks(radius)
    keys = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("print").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(fixed)))).alias("k")
    dealt = classes.select("print", "rep", keys).select("print", "rep", "k.t", "k.key")
    large = dealt.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > cell).select("t", "key", F.ceil(F.col("n") / cell * 2).cast("int").alias("blocks"))
    spot = F.pmod(F.xxhash64("print", F.lit(3)), F.col("blocks")).cast("int")
    met = F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("spot")), lambda k: F.struct(F.least(k, F.col("spot")).alias("lo"), F.greatest(k, F.col("spot")).alias("hi")))
    one = F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))
    # Only keys of more than a cell are on the right, so it is 3 x cell times smaller at least; the planner sends it or splits what is skewed.
    placed = dealt.join(large, ["t", "key"], "left").withColumn("spot", spot).withColumn("c", F.explode(F.when(F.col("blocks").isNull(), one).otherwise(met)))
    cells = placed.select("t", "key", F.col("c.lo").alias("lo"), F.col("c.hi").alias("hi"), "print", "rep")

    free = [[b for b in range(64) if not m >> b & 1] for m in fixed]

    def compared(t: int, values: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        label = joined(values, free[t], radius)
        moved = label != np.arange(len(label))
        return ids[label[moved]], ids[moved]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for x in batches:
            rows = np.stack([c.to_numpy().astype(np.int64) for c in x.columns])
            rows = np.concatenate([*held, rows], axis=1) if held else rows
            cuts = np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(axis=0)) + 1
            # The last cell may go on in the next batch. A cell has two blocks at most.
            last = int(cuts[-1]) if len(cuts) else 0
            held = [rows[:, last:]]
            if last:
                yield from found(rows[:, :last], np.concatenate([[0], cuts]))
        if held:
            rows = held[0]
            yield from found(rows, np.array([0, rows.shape[1]]))
        give_back()

    def found(rows: np.ndarray, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(cuts)
        values, ids = rows[4].view(np.uint64), rows[5]
        ends = np.repeat(cuts[1:], sizes)
        small = np.repeat((sizes > 1) & (sizes <= FEW), sizes)
        # Rows of other cells are left out, and ends are counted in what stays.
        kept = np.flatnonzero(small)
        shift = np.concatenate([[0], np.cumsum(small)])
        out = [few_links(values[kept], ids[kept], shift[ends[kept]], radius)] if len(kept) else []
        for k in np.flatnonzero(sizes > FEW).tolist():
            a, b = int(cuts[k]), int(cuts[k + 1])
            out.append(compared(int(rows[0, a]), values[a:b], ids[a:b]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], schema=LINKS)

    order = ["t", "key", "lo", "hi"]
    return cells.repartition(*order).sortWithinPartitions(*order).mapInArrow(look, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text: str = "text", cell: int = CELL) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hexadecimal digits), ``component_id`` (the smallest id reachable) of every row."""
    found = written(prints(docs, id_col, text), "prints")
    total = found.count()
    known = found.where("doc_id IS NOT NULL")
    classes = written(known.groupBy("print").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_rows")), "classes")
    # An id whose rows differ belongs to several classes, which it links.
    torn = known.groupBy("doc_id").agg(F.min("print").alias("x"), F.max("print").alias("y")).where("x <> y").select("doc_id")
    given = joined_by(known.join(torn, "doc_id", "left_semi"), classes, "print", total).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    made = written(components(written(links(classes, radius, cell).union(given), "links")), "components")
    final = classes.join(made.withColumnRenamed("node", "rep"), "rep", "left").select("print", "n_rows", F.coalesce("component", "rep").alias("component_id"))
    linked = joined_by(known, written(final, "final"), "print", total)
    alone = found.where("doc_id IS NULL").withColumn("component_id", F.lit(None).cast("long"))
    return linked.unionByName(alone).select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
