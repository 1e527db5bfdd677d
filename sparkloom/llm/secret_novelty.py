"""Secret scans: fixed patterns, and strings that a primed zstandard can't shorten.

Base kinds are the three patterns. Beyond them, in a sensitive context each candidate string that base spans don't
cover is measured, whole even where they cover a part of it: the bytes that it adds to a zstandard frame of its surroundings, primed with
a dictionary of ordinary long words, identifiers and code. A string that adds nearly as many bytes as random characters would is reported as
``novel``, whatever its characters; so is a word, name or number of 12 characters or more that the dictionary does not shorten.

A context is 64 characters on both sides of a sensitive word: a candidate starts there after the word, or ends there before it. From such a
candidate the context goes on, in the same direction, through candidates on adjoining lines that only marks and blanks part from it. Candidates have 12 characters at least.

Defined results. Null and empty text have no spans. Texts are scanned whole, and places count code points. Rows are independent: ties and
repeats change nothing, an empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import functools
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import by_batch, give_back
from sparkloom.llm.long_words import WORDS

FOUND = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_novel", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
KINDS = ("assign", "access", "hex", "novel")
#: Fixed patterns; ASCII letters of the names in either case.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so shorter ones can be left out at once
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Words that make a context sensitive, and candidates near them.
CONTEXT = re.compile(r"(?ai:password|passwd|passphrase|pwd|secret|token|api.?key|access.?key|private.?key|credential|bearer|authorization|signature)")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
#: What may lie between candidates of adjoining lines: marks and blanks with a line end, also an escaped one.
BREAK = re.compile(r"(?=[^\w+/=-]{0,63}[\r\n\\])[^\w+/=-]{1,64}")
NEAR, AROUND = 64, 200
#: Ordinary long words, identifiers and code that candidates are held against.
DICTIONARY = (
    " ".join(WORDS.split()) + " "
    "def class return import from self None True False function const let var public private static void string int long "
    "bool char byte new null undefined async await export default require module package namespace include "
    "username user_id userId client_id clientId client_secret access_token refresh_token api_key apiKey secret_key secretKey private_key "
    "password passwd credentials authorization Authorization Bearer Basic Content-Type application/json text/html charset utf-8 "
    "https://www.example.com/index.html http://localhost:8080/api/v1/users config settings environment production development "
    "example placeholder changeme your_token_here your-api-key-here xxxxxxxxxxxxxxxx 0000000000000000 0123456789abcdef "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 1234567890 getElementById addEventListener createElement "
    "request response session cookie header database connection timeout retries version signature algorithm sha256 hmac "
)


@functools.lru_cache(maxsize=1)
def compressor():
    import zstandard

    primed = zstandard.ZstdCompressionDict(DICTIONARY.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    # What level 9 is for short inputs, with tables and a window that hold the whole dictionary: left alone, its size would choose a coarser search.
    level = zstandard.ZstdCompressionParameters.from_level(9, source_size=512, dict_size=4096)
    params = zstandard.ZstdCompressionParameters(
        window_log=17, chain_log=17, hash_log=17, search_log=level.search_log, min_match=level.min_match, target_length=level.target_length, strategy=level.strategy,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    return zstandard.ZstdCompressor(dict_data=primed, compression_params=params)


def marginal_bytes(around: str, candidate: str) -> int:
    """Bytes that the candidate adds to the frame of its surroundings."""
    size = lambda s: len(compressor().compress(s.encode()))
    return size(around + candidate) - size(around)


def novel(text: str, start: int, stop: int, ratio: float) -> bool:
    found = text[start:stop]
    around = text[max(0, start - AROUND) : start] + "\n" + text[stop : stop + AROUND] + "\n"
    return marginal_bytes(around, found) >= ratio * len(found)


def sensitive(text: str) -> list[tuple[int, int]]:
    """Candidates in the context of a sensitive word, sorted. A word inside a run of candidate characters parts it in two."""
    contexts = [m.span() for m in CONTEXT.finditer(text)]
    if not contexts:
        return []
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    starts, ends = [a for a, _ in runs], [b for _, b in runs]
    joined = [bool((m := BREAK.match(text, b)) and m.end() == a) for b, a in zip(ends, starts[1:], strict=False)]
    found, after, before = set(), set(), set()
    for c, d in contexts:
        for k in range(bisect_right(ends, d), bisect_left(starts, d + NEAR)):
            a, b = max(starts[k], d), ends[k]
            if b - a >= 12:
                found.add((a, b))
                after.add(k)
        for k in range(bisect_right(ends, c - NEAR), bisect_left(starts, c)):
            a, b = starts[k], min(ends[k], c)
            if b - a >= 12:
                found.add((a, b))
                before.add(k)
    for k in range(len(joined)):
        if joined[k] and k in after:
            after.add(k + 1)
            found.add(runs[k + 1])
    for k in reversed(range(len(joined))):
        if joined[k] and k + 1 in before:
            before.add(k)
            found.add(runs[k])
    return sorted(found)


def spans(text: str | None, ratio: float = 0.7) -> list[tuple[int, int, str]]:
    """All spans, by start and then kind as listed."""
    if not text:
        return []
    out = []
    # lower() may fold further letters to a-z, so it can only let more texts through to the patterns.
    folded = text.lower()
    if any(x in folded for x in NAMES):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    base, fresh = sorted(out), []
    if any(x in folded for x in ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "authorization", "signature")):
        covered: list[list[int]] = []
        for a, b, _ in base:
            if covered and a <= covered[-1][1]:
                covered[-1][1] = max(b, covered[-1][1])
            else:
                covered.append([a, b])
        for a, b in sensitive(text):
            at = bisect_right(covered, a, key=lambda x: x[0])
            if at and covered[at - 1][1] >= b:
                continue
            if novel(text, a, b, ratio):
                if fresh and a < fresh[-1][1]:
                    fresh[-1] = (fresh[-1][0], max(b, fresh[-1][1]), "novel")
                else:
                    fresh.append((a, b, "novel"))
        out += fresh
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def listed(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", ratio: float = 0.7) -> DataFrame:
    """Counts and spans of every text."""

    def look(parts: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
        for x in parts:
            out = []
            for key, body in zip(x["doc_id"], x["text"], strict=True):
                found = spans(body, ratio)
                n = {k: sum(s[2] == k for s in found) for k in KINDS}
                base = listed([s for s in found if s[2] != "novel"])
                out.append((key, n["assign"], n["access"], n["hex"], n["novel"], hashlib.sha256(base.encode()).hexdigest(), listed(found)))
            yield out

    return by_batch(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")), look, FOUND)


def redacted(docs: DataFrame, text: str = "text", mark: str = "[secret]", ratio: float = 0.7) -> DataFrame:
    """The rows with every span replaced by the mark; overlapping spans are one."""

    @F.pandas_udf("string")
    def hide(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in parts:
            out = []
            for body in x:
                found = spans(body, ratio)
                if found:
                    made, at = [], 0
                    for a, b, _ in found:
                        if b <= at:
                            continue
                        if a >= at:
                            made += [body[at:a], mark]
                        at = max(at, b)
                    body = "".join(made) + body[at:]
                out.append(body)
            yield pd.Series(out, dtype=object)
        give_back()

    return docs.withColumn(text, hide(F.col(text)))
