"""License scans by patience alignment.

Text and template are aligned on the words that occur once in both: their longest increasing
subsequence fixes anchors, and the gaps between anchors are aligned the same way, again and again. The share of the template's
words that are matched is its coverage. Alignment runs in windows of the whole text where words of a
template occur, so a document of any length costs one pass. In a window that holds a notice twice no word is unique, so each start is aligned on its own stretch
as well, and on what lies before the next start: a license that is given twice is found twice.

Defined results. Null and empty texts have no licenses. Finds don't overlap: the one with more matched words, less the foreign words between them, goes before, then the higher coverage, then the name, then the
shorter span, then the first. Rows are independent, so repeats change nothing; empty tables give empty results; extra columns are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import by_batch

FOUND = pa.schema([("doc_id", pa.int64()), ("n_licenses", pa.int64()), ("licenses", pa.string()), ("coverage", pa.float64()), ("spans", pa.string())])
#: Fixed texts: how licenses are named in a line, and the opening of their notices.
TEMPLATES = {
    "all-rights-reserved": ("All rights reserved.",),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    ),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "cc-by-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "public-domain": ("This work is dedicated to the public domain.", "This is free and unencumbered software released into the public domain."),
}
#: Words too common to start an alignment at.
COMMON = frozenset("a all an and any are as at be by for free from in is it may not of or that the this to under use with work you version file copy".split())
WORD = re.compile(r"[^\W_]+(?:[.+-][^\W_]+)*")


def folded(text: str) -> list[str]:
    return [m[0].lower() for m in WORD.finditer(text)]


class Template:
    """Words of a template, ``need`` of which must be matched. Hints occur in it more often than words may be missing, so each find matches one."""

    def __init__(self, name: str, text: str, coverage: float):
        self.name, self.words = name, folded(text)
        self.need = ceil(coverage * len(self.words) - 1e-9)
        counts = Counter(self.words)
        self.hints: set[str] = set()
        left = len(self.words) - self.need
        for w in sorted(counts, key=lambda w: (w in COMMON, -len(w), w)):
            if left < 0:
                break
            self.hints.add(w)
            left -= counts[w]
        self.seeds = [(w, i) for i, w in enumerate(self.words) if w in self.hints or (counts[w] == 1 and w not in COMMON)]


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence whose second places rise; the pairs come in the order of their first places."""
    ends: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(ends, j)
        back.append(last[at - 1] if at else -1)
        if at == len(ends):
            ends.append(j)
            last.append(k)
        else:
            ends[at], last[at] = j, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places of both word lists. Gaps wait on a list, so depth is no limit."""
    out, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        alo, ahi, blo, bhi = gaps.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        na, nb = Counter(a[alo:ahi]), Counter(b[blo:bhi])
        place = {w: j for j, w in enumerate(b[blo:bhi], blo) if nb[w] == 1}
        anchors = rising([(i, place[w]) for i, w in enumerate(a[alo:ahi], alo) if na[w] == 1 and w in place])
        if not anchors:
            continue
        i0, j0 = alo, blo
        for i, j in anchors:
            gaps.append((i0, i, j0, j))
            out.append((i, j))
            i0, j0 = i + 1, j + 1
        gaps.append((i0, ahi, j0, bhi))
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]], coverage: float):
        self.templates = [Template(name, text, coverage) for name, texts in sorted(templates.items()) for text in texts]
        self.by_seed: dict[str, list[tuple[int, int]]] = {}
        for k, t in enumerate(self.templates):
            for w, i in t.seeds:
                self.by_seed.setdefault(w, []).append((k, i))
        self.hints = sorted({w for t in self.templates for w in t.hints})

    def scan(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """Start, end (code points), license and coverage of each find, by start."""
        if not text:
            return []
        low = text.lower()
        if not any(h in low for h in self.hints):
            return []
        spots = [(m[0].lower(), *m.span()) for m in WORD.finditer(text)]
        found = [x[0] for x in spots]
        starts: dict[int, dict[int, int]] = {}
        for p, w in enumerate(found):
            for k, i in self.by_seed.get(w, ()):
                near = starts.setdefault(k, {})
                near[p - i] = near.get(p - i, 0) + 1
        hits = []
        for k, near in starts.items():
            t = self.templates[k]
            n, slack = len(t.words), max(2, len(t.words) // 4)
            at, begins = None, sorted(near)
            windows = set()
            for begin in begins:
                if at is None or begin - at > slack:
                    at = begin
                    windows.add((max(0, begin - slack), min(len(found), begin + n + 2 * slack)))
                after = bisect_left(begins, begin + t.need)
                last = min(len(found), begin + n + 2 * slack, *begins[after : after + 1])
                windows |= {(max(0, begin), min(len(found), begin + n)), (max(0, begin), last)}
            for lo, hi in sorted(windows):
                pairs = aligned(found[lo:hi], t.words) if hi - lo >= t.need else []
                if pairs and len(pairs) >= t.need:
                    first, last = lo + pairs[0][0], lo + pairs[-1][0]
                    foreign = max(0, last - first + 1 - n)
                    hits.append((foreign - len(pairs), -len(pairs) / n, t.name, last - first, spots[first][1], spots[last][2]))
        out: list[tuple[int, int, str, float]] = []
        for _, share, name, _, a, b in sorted(set(hits)):
            # Chosen spans are sorted and apart, so the neighbours alone can overlap.
            k = bisect_left(out, (a,))
            if (k == 0 or out[k - 1][1] <= a) and (k == len(out) or b <= out[k][0]):
                insort(out, (a, b, name, -share))
        return out


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, coverage: float = 0.8, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Licenses of every text: their names and spans by start, and the best coverage (0 without one)."""

    def look(parts: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
        scanner = Scanner(templates, coverage)
        for x in parts:
            out = []
            for key, body in zip(x["doc_id"], x["text"], strict=True):
                found = scanner.scan(body)
                out.append((key, len(found), ",".join(s[2] for s in found), max((s[3] for s in found), default=0.0), ",".join(f"{n}:{a}:{b}" for a, b, n, _ in found)))
            yield out

    return by_batch(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")), look, FOUND)
