"""Repair of text that was read in the wrong encoding, by segment.

UTF-8 read as another encoding turns each letter beyond ASCII into two to four characters beyond ASCII, so only runs of such characters are looked at, each by itself: good and bad segments may stand in one text. For
a run, chains of misreadings (Latin-1, Windows-1252, Mac Roman, up to three times) are undone; the result with the least cost stays, where the run itself is one of them. Costs count what prose doesn't have: control characters, letters and signs of the kind that
misreadings leave. A run that is not bad as a whole may have bad sequences, which are undone one by one.

Defined results. Null stays null; text without such runs stays and never reaches Python. Nothing is cut or lost: a run that no chain improves is as it was.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = re.compile("[^\x00-\x7f]+")
#: Where Windows-1252 has no character, its readers give the byte itself.
HOLES = {chr(b): b for b in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
TURNS = 3


def coded(encoding: str) -> dict[str, int]:
    """Characters that bytes from 80 on are read as."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


READERS = {name: coded(name) for name in ("latin-1", "cp1252", "mac_roman")}
#: Signs that misread lead bytes become; prose has them seldom, and hardly before another sign.
LEADS = [({c for c, b in own.items() if 0xC2 <= b <= 0xF4}, {c for c, b in own.items() if 0x80 <= b <= 0xBF}) for own in READERS.values()]


def cost(text: str) -> float:
    """Characters, and more for those that are no letter or common sign, and for a lead before what follows leads."""
    out = float(len(text))
    for a, b in zip(text, text[1:], strict=False):
        out += 2.0 * any(a in leads and b in signs for leads, signs in LEADS)
    for c in text:
        kind = unicodedata.category(c)
        # Rare Latin letters and bare accents: what a capital with an accent and a quotation mark would be.
        out += 4.0 if 0x180 <= ord(c) < 0x370 else 3.0 if kind in ("Cc", "Cn", "Co", "Cs") else 0.5 if kind[0] == "S" or kind == "No" else 0.0
    return out


def reread(text: str, reader: dict[str, int]) -> str | None:
    """The text whose UTF-8 bytes were read so; None if it is none. Mac Roman has plain accented letters for all kinds of bytes, so letters alone are no text of it."""
    if reader is READERS["mac_roman"] and text.isalpha():
        return None
    try:
        return bytes(reader[c] for c in text).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None


@functools.lru_cache(maxsize=100_000)
def mended_run(run: str) -> str:
    """The least costly of the run and all that chains make of it; else its bad sequences one by one."""
    best, open_ = (cost(run), run), [run]
    for _ in range(TURNS):
        found = []
        for text in open_:
            # Of what a chain gives, only runs beyond ASCII can have been misread once more.
            for reader in READERS.values():
                made = reread(text, reader)
                if made is not None and made != text:
                    best = min(best, (cost(made), made))
                    if not made.isascii() and RUN.fullmatch(made):
                        found.append(made)
        open_ = found
    return best[1] if best[1] != run or len(run) < 2 else parted(run)


def parted(run: str) -> str:
    """Bad sequences of two to four characters that give one letter or common sign of Latin scripts or punctuation; what stands around them stays."""
    out, at = [], 0
    while at < len(run):
        for n in (4, 3, 2):
            piece = run[at : at + n]
            made = next((m for r in READERS.values() if len(piece) == n and (m := reread(piece, r)) and len(m) == 1), None)
            if made and (ord(made) < 0x180 and (n == 2 or ord(made) >= 0x2000) or 0x2010 <= ord(made) <= 0x2122 or n == 4) and cost(made) < cost(piece):
                out.append(made)
                at += n
                break
        else:
            out.append(run[at])
            at += 1
    made = "".join(out)
    return made if made == run or made.isascii() else RUN.sub(lambda m: mended_run(m[0]) if m[0] != run else m[0], made)


def mended(text: str) -> str:
    return RUN.sub(lambda m: mended_run(m[0]) if len(m[0]) > 1 else m[0], text)


def repaired(text: Column) -> Column:
    """The text with its misread segments read right. Texts without two characters beyond ASCII in a row don't go to Python."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda s: None if s is None else mended(s))

    return F.coalesce(run(F.when(text.rlike("[^\\x00-\\x7f]{2}"), text)), text)
