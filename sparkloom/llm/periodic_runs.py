"""Periodic runs of words, found with a suffix automaton.

A run is a stretch of words with smallest period q and at least ``max(6, 4 q)`` words that can't be made longer at either end. The states of the automaton hold where their
strings end. Sets of end positions are merged from the leaves up, the smaller into the larger and in order, so that each new position meets its
neighbours: two ends at a distance d under a state of length n seed a stretch of n + d words with period d, a square where d <= n. Two ends meet first at the state whose length is all that they have in common on their left,
so a seed reaches as far to the left as the period does; the one whose right end can't go on is a run. Of seeds with one stretch the least distance is its period.

In a run every three words occur three times or more. Stretches in which others have been cut away, again and again, go to the automaton; in most texts nothing is left.

Defined results. Null and empty texts have no words and no runs. Words are compared as they are. A text without runs has nulls for its longest run. Rows are independent: repeats and ties change nothing, and an empty
table gives an empty result. Null ids stay null. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import by_batch

LEAST, TIMES = 6, 4
OUT = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def stretches(codes: np.ndarray, turns: int = 32) -> list[tuple[int, int]]:
    """Bounds of the stretches that can hold a run: all three words in a row occur three times there. After ``turns`` they are taken as they are, which is no less exact."""
    n = len(codes) - 2
    if n < LEAST - 2:
        return []
    v = int(codes.max()) + 1
    pairs = np.unique(codes[:-1] * v + codes[1:], return_inverse=True)[1]
    _, three = np.unique(pairs[:-1] * v + codes[2:], return_inverse=True)
    spots = np.arange(n)
    # The automaton's own stretch of each place; at first there is one.
    part = np.zeros(n, np.int64)
    for _ in range(turns):
        _, back, counts = np.unique(part * n + three[spots], return_inverse=True, return_counts=True)
        ok = counts[back] >= TIMES - 1
        left = spots[ok]
        if not len(left):
            return []
        fresh = np.cumsum(np.concatenate([[0], (np.diff(left) > 1) | (np.diff(part[ok]) != 0)]))
        long = np.bincount(fresh)[fresh] >= LEAST - 2
        same = ok.all() and long.all()
        spots, part = left[long], fresh[long]
        if same or not len(spots):
            break
    if not len(spots):
        return []
    cuts = np.flatnonzero(np.diff(part)) + 1
    return [(int(a[0]), int(a[-1]) + 3) for a in np.split(spots, cuts)]


def automaton(s: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Length, suffix link and end position (-1 of a clone) of each state of the suffix automaton."""
    length, link, end, moves = [0], [-1], [-1], [{}]
    last = 0
    for i, c in enumerate(s):
        now = len(length)
        length.append(length[last] + 1)
        link.append(0)
        end.append(i)
        moves.append({})
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = now
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                moves.append(moves[q].copy())
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return length, link, end


def seeds(s: list[int]) -> dict[tuple[int, int], int]:
    """Least period of each maximal stretch (start, last word) that is long enough."""
    length, link, end = automaton(s)
    n, found = len(s), {}
    # A stretch of n + d words with n + d >= max(6, 4 d) needs a state of five words at least; shorter ones are not merged.
    least = min(max((TIMES - 1) * d, LEAST - d) for d in range(1, LEAST))
    held: list[list[int] | None] = [[e] if e >= 0 and length[v] >= least else None for v, e in enumerate(end)]
    for v in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        own, up = held[v], link[v]
        held[v] = None
        size = length[up]
        if own is None or size < least:
            continue
        into = held[up] or []
        if len(into) < len(own):
            into, own = own, into
        most = size // (TIMES - 1)
        for x in own:
            k = bisect_left(into, x)
            for a, b in ((into[k - 1] if k else None, x), (x, into[k] if k < len(into) else None)):
                if a is None or b is None:
                    continue
                d = b - a
                if d > most or size + d < LEAST:
                    continue
                first = a - size + 1
                if (b + 1 == n or s[a + 1] != s[b + 1]) and (first == 0 or s[first - 1] != s[first - 1 + d]) and d < found.get((first, b), n):
                    found[first, b] = d
            into.insert(k, x)
        held[up] = into
    return found


def runs(found: list) -> list[tuple[int, int, int]]:
    """Start, length and period of every run, by start and then period."""
    if len(found) < LEAST:
        return []
    known: dict = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in found), np.int64, len(found))
    out = []
    for a, b in stretches(codes):
        out += [(a + x, y - x + 1, d) for (x, y), d in seeds(codes[a:b].tolist()).items()]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(found: list, own: list[tuple[int, int, int]]) -> list:
    """The words without those of any run beyond its first period."""
    if not own:
        return found
    keep = np.ones(len(found), bool)
    for start, length, period in own:
        keep[start + period : start + length] = False
    return [found[i] for i in np.flatnonzero(keep).tolist()]


def scan(docs: DataFrame, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Number of runs, the longest one (ties: the first, then the shortest period), and digests of all runs and of the collapsed text of every row. ``prepare`` may change a text's words first."""

    def look(parts: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
        for x in parts:
            out = []
            for key, body in zip(x["doc_id"], x["text"], strict=True):
                found = body.encode("utf-8", "surrogatepass").split() if body else []
                if prepare is not None:
                    found = prepare(key, found)
                own = runs(found)
                best = min(own, key=lambda r: (-r[1], r[0], r[2])) if own else None
                told = "".join(f"{a},{n},{q}\n" for a, n, q in own)
                shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                out.append((key, len(own), *shown, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(found, own))).hexdigest()))
            yield out

    return by_batch(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")), look, OUT)


def deduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with every run cut to its first period; texts with a run are their kept words joined by a space, others stay as they are."""

    @F.pandas_udf("string")
    def cut(x: pd.Series) -> pd.Series:
        out = []
        for body in x:
            found = body.encode("utf-8", "surrogatepass").split() if body else []
            own = runs(found)
            out.append(b" ".join(collapsed(found, own)).decode("utf-8", "surrogatepass") if own else body)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text, cut(F.col(text)))
