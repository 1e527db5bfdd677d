"""Filter interaction audit over packed bitmaps.

Each document has one bit a filter (set where it fails), one bit a label and one bit for its part. A task packs the bits of its rows into
NumPy bitsets and counts, for each part and each set of filters, the rows that no filter of the set removes: AND-NOT of one filter more, then
popcount. Every order of the filters walks through such sets, so the counts of the sets, summed over the tasks, give all orders:
2^k sets are counted, not k! orders.

Defined results. Null and empty texts have no words; they fail the filters that this makes true, and are identical to one another. A null part is the
empty string. A row with a null id has no label and is no copy of anything, nor is anything a copy of it. Rows are counted one by one, so repeated rows count
each; rows of one id and text are no copies of one another. Labels of one id given twice hold if any row has them. An empty table gives an empty report; other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import by_batch, joined_by, written

#: Fails if: A too few words, B words repeat too often, C too many capitals, D has one of these symbols, E an earlier document has the same text.
FILTERS = ("A", "B", "C", "D", "E")
LABELS = ("good", "toxic")
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = re.compile(rb"[#$%&*|]")
MEASURED = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), *((f, pa.bool_()) for f in FILTERS[:4])])
#: Parts that a task sums before it hands them on.
HELD_PARTS = 4096


def text_failures(text: str | None) -> tuple[bool, bool, bool, bool]:
    """Failures of A to D, which a text decides alone."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    found = raw.split()  # bytes.split() parts at exactly the six white space characters
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return len(found) < 200, 100 * len(set(found)) < 50 * len(found), 100 * capitals > 3 * len(text), SYMBOLS.search(raw) is not None


def failures(docs: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``doc_id``, ``part`` and a boolean column a filter for every row. Texts are read once; what is shuffled is a digest and bits a row."""

    def look(parts: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
        for x in parts:
            yield [(key, own or "", hashlib.sha256((body or "").encode("utf-8", "surrogatepass")).digest(), *text_failures(body)) for key, own, body in zip(x["doc_id"], x["part"], x["text"], strict=True)]

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(part).cast("string").alias("part"), F.col(text).alias("text"))
    found = written(by_batch(rows, look, MEASURED), "measured")
    first = found.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n_rows"))
    several = written(first.where("first < last").drop("last"), "copied")
    known = joined_by(found.where("doc_id IS NOT NULL"), several, "digest", found.count(), "left")
    copied = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)).alias("E")
    unknown = found.where("doc_id IS NULL").withColumn("first", F.lit(None).cast("long"))
    return known.unionByName(unknown).select("doc_id", "part", *FILTERS[:4], copied)


def labelled(rows: DataFrame, labels: DataFrame, conditions: dict[str, str], id_col: str = "doc_id") -> DataFrame:
    """The rows with a boolean column a label: whether a row of ``labels`` with their id meets its condition. Rows without an id don't go through the join."""
    own = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(*(F.coalesce(F.max(F.expr(c)), F.lit(False)).alias(k) for k, c in conditions.items()))
    found = rows.where("doc_id IS NOT NULL").join(own, "doc_id", "left").withColumns({k: F.coalesce(k, F.lit(False)) for k in conditions})
    return found.unionByName(rows.where("doc_id IS NULL").withColumns({k: F.lit(False) for k in conditions}))


def packed(bits: np.ndarray) -> np.ndarray:
    """Booleans as 64-bit words; what is over at the end is unset."""
    out = np.packbits(bits)
    return np.concatenate([out, np.zeros(-len(out) % 8, np.uint8)]).view(np.uint64)


def survivors(own: np.ndarray, failed: list[np.ndarray], labels: list[np.ndarray]) -> np.ndarray:
    """For each set of filters (its number has a bit a filter), the rows of ``own`` that it leaves: all, and those with each label."""
    left = [own]
    out = np.empty((1 << len(failed), 1 + len(labels)), np.int64)
    for s in range(len(out)):
        if s:
            last = s.bit_length() - 1
            left.append(left[s ^ (1 << last)] & ~failed[last])
        out[s] = [np.bitwise_count(x).sum() for x in (left[s], *(left[s] & y for y in labels))]
    return out


def subset_counts(rows: DataFrame, filters: tuple[str, ...] = FILTERS, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """``part``, ``subset`` (a bit a filter), ``n`` and a count a label: rows that the filters of the subset leave."""
    schema = pa.schema([("part", pa.string()), ("subset", pa.int64()), ("n", pa.int64()), *((f"n_{x}", pa.int64()) for x in labels)])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def given() -> pa.RecordBatch:
            sets = np.tile(np.arange(1 << len(filters)), len(held))
            counts = np.concatenate(list(held.values())).T
            out = pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(held), object), 1 << len(filters)), pa.string()), pa.array(sets, pa.int64()), *(pa.array(c, pa.int64()) for c in counts)], schema=schema)
            held.clear()
            return out

        for x in batches:
            bits = {name: packed(x.column(name).to_numpy(zero_copy_only=False).astype(bool)) for name in (*filters, *labels)}
            codes = x.column("part").dictionary_encode()
            places = codes.indices.to_numpy()
            for k, name in enumerate(codes.dictionary.to_pylist()):
                found = survivors(packed(places == k), [bits[f] for f in filters], [bits[y] for y in labels])
                held[name] = held[name] + found if name in held else found
            if len(held) > HELD_PARTS:
                yield given()
        if held:
            yield given()

    names = ["part", *filters, *labels]
    counted = rows.select(names).mapInArrow(look, "part string, subset bigint, n bigint, " + ", ".join(f"n_{x} bigint" for x in labels))
    return counted.groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in ("n", *(f"n_{x}" for x in labels))))


def report(counts: DataFrame, filters: tuple[str, ...] = FILTERS, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """One row a part, order of all filters and step, from the counts of the subsets alone.

    ``kept`` after the step; ``removed`` here; ``redundant``: failing the step's filter, but removed earlier; ``unique_fails``: failing that filter only;
    ``<label>_lost``: removed here with the label; ``shapley``: what the filter removes, summed over all orders.
    """
    k, whole = len(filters), (1 << len(filters)) - 1
    steps = [(order, i, sum(1 << f for f in order[:i])) for order in permutations(range(k)) for i in range(k)]
    names = ["".join(filters[f] for f in order) for order, _, _ in steps]
    at = np.array([i for _, i, _ in steps])
    own = np.array([order[i] for order, i, _ in steps])
    before = np.array([s for _, _, s in steps])
    values = ("kept", "removed", "redundant", "unique_fails", *(f"{y}_lost" for y in labels), "shapley")
    out = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((v, pa.int64()) for v in values)])
    columns = ("n", *(f"n_{y}" for y in labels))

    def unfold(parts: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
        for x in parts:
            for name, rows in zip(x["part"], x["counts"], strict=True):
                left = np.array([[r[c] for c in columns] for r in rows], np.int64)
                after = before | (1 << own)
                gone = left[before] - left[after]
                fails = left[0, 0] - left[1 << own, 0]
                alone = left[whole ^ (1 << own), 0] - left[whole, 0]
                value = np.bincount(own, gone[:, 0], k).astype(np.int64)[own]
                made = np.column_stack([left[after, 0], gone[:, 0], fails - gone[:, 0], alone, gone[:, 1:], value])
                yield [(name, names[i], int(at[i]) + 1, *made[i].tolist()) for i in range(len(steps))]

    # One row a subset and part: the list of a part has 2^k entries.
    folded = counts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", *columns))).alias("counts"))
    return by_batch(folded, unfold, out)
