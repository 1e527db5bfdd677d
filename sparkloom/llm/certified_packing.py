"""Best-fit packing with certified bin counts.

Each document is its ids and the end id. Longer ones than a sequence are cut from the back, so that only the first piece may be
shorter; full pieces are sequences of their own. The others are bin-packed: every partition packs its pieces
best-fit decreasing, and lower bounds from dual feasible functions say how many
bins it must have at least. A partition that meets its bound is done. The others hand
the pieces of their bins that are not full to one another: those are dealt anew over fewer partitions and packed again.
The rounds end when all that is left fits one partition, or when a round saves no bin; its packing is then left out. Each row
tells the bins of the partition that placed it and their bound (``group_bins``, ``group_bound``; a full piece is its own).

Defined results. Null and empty text are the end id alone. Repeated ids give repeated rows, each with its own place.
An empty table gives an empty result. Extra columns are left out. A very long text is many full pieces.
No row carries ids: places and lengths alone are shuffled, and a group is bounded by ``per_part``.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import tokens
from sparkloom.llm.common import by_batch, spread, written

PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PLACED = "row bigint, length bigint, bin bigint, offset bigint, open boolean, group_bins bigint, group_bound bigint"


def pieces(docs: DataFrame, vocabulary_file: str, id_col: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of all documents, with the digest of their ids."""

    def cut(parts: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
        encode = tokens.encoder(vocabulary_file)
        for x in parts:
            out = []
            for key, packed in zip(x["doc_id"], encode.packed_all(x["text"]), strict=True):
                ids = np.append(np.frombuffer(packed, encode.kind), encode.kind.type(end_id)).astype("<u4")
                raw, first = ids.tobytes(), len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                out += [(key, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            yield out

    return by_batch(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")), cut, PIECE)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by dual feasible functions: identity, and for each threshold the one that counts items over
    ``capacity - t`` as whole bins, items below ``t`` as nothing and the rest by their length; and the half-bin count by multiples."""
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    weight = counts * np.arange(capacity + 1)
    n_to, w_to = np.cumsum(counts), np.cumsum(weight)
    best = -(-int(w_to[-1]) // capacity)
    t = np.arange(1, capacity // 2 + 1)
    large = n_to[-1] - n_to[capacity - t]
    middle = w_to[capacity - t] - w_to[t - 1]
    best = max(best, int((large + -(-middle // capacity)).max()))
    for k in range(2, 21):  # u(k): (k + 1) x / C rounded down, over k, whole multiples kept
        x = (k + 1) * np.arange(capacity + 1)
        value = np.where(x % capacity == 0, k * np.arange(capacity + 1), (x // capacity) * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, and the room left in each bin.

    Bins of equal room are one stack; a number with one bit for each room finds the tightest one that fits.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, free = 0, []
    order = np.argsort(-lengths, kind="stable")
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            stack = stacks[room]
            at = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            room, at = capacity, len(free)
            free.append(capacity)
        bins[i], offsets[i] = at, capacity - room
        room -= size
        free[at] = room
        if room:
            if not stacks[room]:
                rooms |= 1 << room
            stacks[room].append(at)
    return bins, offsets, np.array(free, np.int64)


def packed_once(items: DataFrame, parts: int, round_no: int, capacity: int) -> DataFrame:
    """One round: ``row``, ``length`` to ``PLACED``. Full bins are closed; so are those of a partition that meets its bound, but for its emptiest."""

    def pack(x: pd.DataFrame) -> pd.DataFrame:
        lengths = x["length"].to_numpy(np.int64)
        bins, offsets, free = best_fit(lengths, capacity)
        loose, bound = free > 0, lower_bound(lengths, capacity)
        if len(free) == bound:
            loose &= np.arange(len(free)) == free.argmax()
        number = (np.int64(round_no) << 56) + (np.int64(x["part"].iloc[0]) << 28) + bins
        return pd.DataFrame({"row": x["row"], "length": lengths, "bin": number, "offset": offsets, "open": loose[bins], "group_bins": len(free), "group_bound": bound})

    dealt = items.select("row", "length", F.pmod(F.xxhash64("row", F.lit(round_no)), F.lit(parts)).alias("part"))
    return dealt.groupBy("part").applyInPandas(pack, PLACED)


def pack(docs: DataFrame, vocabulary_file: str, capacity: int = 2048, per_part: int = 40_000, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece with its sequence and its place there."""
    # Written at once, so the number of a row is the same in each later read.
    cut = written(pieces(docs, vocabulary_file, id_col, text, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    items = cut.where(F.col("length") < capacity).select("row", "length")
    left, n_bins, before, done, k = items.count(), None, None, [], 0
    while left:
        parts = spread(left, per_part)
        now = written(packed_once(items, parts, k, capacity), "packed")
        held = lambda df: df.agg(F.count("*"), F.count_if(F.col("offset") == 0)).first()
        if before is not None and held(now)[1] >= n_bins:
            done.append(before)
            break
        if parts == 1:
            done.append(now)
            break
        done.append(now.where(~F.col("open")))
        before = now.where("open")
        items = before.select("row", "length")
        left, n_bins = held(before)
        k += 1
    own = [F.col(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")]
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    out = cut.where(F.col("length") == capacity).select(*own, (-1 - F.col("row")).alias("sequence_id"), none.alias("offset"), one.alias("group_bins"), one.alias("group_bound"))
    if done:
        spots = functools.reduce(DataFrame.unionByName, done).drop("length", "open")
        placed = cut.where(F.col("length") < capacity).join(spots, "row")
        out = placed.select(*own, F.col("bin").alias("sequence_id"), "offset", "group_bins", "group_bound").unionByName(out)
    return out
