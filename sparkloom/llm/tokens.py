"""Token ids of whole texts by the tokenizers library, with each distinct piece encoded once a worker."""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def public_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary file lies on this machine; any other path works as well."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of a text, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    A byte-level BPE with the usual split pattern never joins what lies before and after a lone space
    or a lone line end: a space begins a piece of its own, a line end is one. Of a longer run of white space all but the last character are one
    piece, and the last is like a lone one. So texts
    are cut there and their pieces, which repeat across texts, are kept; a piece of letters, which the split pattern
    leaves whole, goes to the tokenizer's model directly. Texts with a run that also hold an added token, and tokenizers of another kind, are encoded
    whole. At most ``most`` pieces are kept in each of two forms, and the older half goes first.

    ``packed_all`` takes many texts: Arrow splits about ``stretch`` characters at a time (the known pieces are indexed anew each time, so a longer one costs less and holds more), finds their pieces among at most ``most`` known ones and puts their ids
    in place, so that Python sees new pieces only.
    """

    TOGETHER = re.compile(r"\s\s")
    LONG, STRETCH = 64, 8_000_000
    #: Before the first piece of a text. After a space no other piece begins with white space but with a line end, for runs go another way.
    FIRST = "\r"

    def __init__(self, path: str, most: int, stretch: int = STRETCH):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size(True) <= 1 << 16 else np.dtype("<u4")
        rules = json.loads(self.tokenizer.to_str())
        before, added = rules.get("pre_tokenizer") or {}, rules.get("added_tokens") or []
        self.cuts = (
            rules.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
            and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or re.search(r"\s", x["content"]) or x["content"].isalpha() for x in added)
        )
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.added = tuple(x["content"] for x in added)
        self.run = functools.lru_cache(maxsize=1024)(self.whole)
        self.most, self.stretch = most, stretch
        self.known, self.known_ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.line_end = self.whole("\n")
        self.spaced, self.bare = _Pieces(self, " "), _Pieces(self, "")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def letters(self, piece: str) -> bytes:
        """Ids of letters after at most one space: one piece of the split pattern."""
        if piece.isascii():  # letters are named by themselves, so only the space is not
            raw = piece.replace(" ", SPACE_NAME)
        else:
            raw = piece.encode().decode("latin-1").translate(BYTE_NAMES)
        ids = array(self.code, [x.id for x in self.model.tokenize(raw)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def packed(self, text: str | None) -> bytes:
        """Ids as little-endian numbers of ``kind``; null has none."""
        if not text:
            return b""
        if not self.cuts:
            return self.whole(text)
        if self.TOGETHER.search(text):
            if any(x in text for x in self.added):
                return self.whole(text)
            out = b"".join(self.around(run) + (self.spaced if run.endswith(" ") else self.bare)[word] if word else self.run(run) for run, word in PARTS.findall(text) if run or word)
        else:
            first, *rest = text.split(" ")
            out = self.bare[first] + b"".join(map(self.spaced.__getitem__, rest))
        self.turn()
        return out

    def turn(self) -> None:
        for x in (self.spaced, self.bare):
            if len(x) > self.most // 4:
                x.turn()

    def packed_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """``packed`` of each text, in order."""
        held: list[str] = []  # stretches of texts
        owners: list[tuple[int, bytes]] = []  # by text: its stretches, or ids that are known
        size = 0
        for text, pair in self.marked(texts):
            if not text or not self.cuts or pair:
                owners.append((0, self.packed(text)))
            else:
                before = len(held)
                held += self.stretches(text)
                owners.append((len(held) - before, b""))
                size += len(text)
            if size >= self.stretch or len(owners) >= 20_000:
                yield from self.placed(held, owners)
                held, owners, size = [], [], 0
        yield from self.placed(held, owners)

    @staticmethod
    def marked(texts: Iterable[str | None]) -> Iterator[tuple[str | None, bool]]:
        """Each text, and whether it has white space together; some at a time."""
        rest = iter(texts)
        while part := list(itertools.islice(rest, 256)):
            yield from zip(part, pc.match_substring_regex(pa.array(part, pa.large_string()), WHITE_PAIR).to_pylist(), strict=True)

    def stretches(self, text: str) -> Iterator[str]:
        """The text with a space before each line end, cut at spaces into parts of about ``stretch`` characters."""
        spaced, at = self.FIRST + text.replace("\n", " \n"), 0
        while (end := spaced.find(" ", at + self.stretch)) >= 0:
            yield spaced[at:end]
            at = end + 1
        yield spaced[at:]

    def placed(self, held: list[str], owners: list[tuple[int, bytes]]) -> Iterator[bytes]:
        ready: list[bytes] = []
        group: list[str] = []
        size = 0
        for k, part in enumerate(held):
            group.append(part)
            size += len(part)
            if size >= self.stretch or k == len(held) - 1:
                ready += self.joined(group)
                group, size = [], 0
        at = 0
        for n, known in owners:
            yield (ready[at] if n == 1 else b"".join(ready[at : at + n])) if n else known
            at += n

    def joined(self, parts: list[str]) -> list[bytes]:
        """Ids of each stretch by its pieces between spaces."""
        split = pc.split_pattern(pa.array(parts, pa.large_string()), " ")
        words = split.flatten()
        at = pc.index_in(words, value_set=self.known)
        unknown = words.filter(at.is_null()).dictionary_encode()
        fresh = pa.array(self.pieces(unknown.dictionary.to_pylist()), pa.large_binary())
        self.turn()
        every = pa.concat_arrays([self.known_ids, fresh])
        spot = at.fill_null(0).to_numpy().astype(np.int64)
        spot[at.is_null().to_numpy(zero_copy_only=False)] = len(self.known) + unknown.indices.to_numpy()
        short = pc.less_equal(pc.binary_length(unknown.dictionary), 4 * self.LONG)
        self.known = pa.concat_arrays([self.known, unknown.dictionary.filter(short)])
        self.known_ids = pa.concat_arrays([self.known_ids, fresh.filter(short)])
        if len(self.known) > self.most:  # the newer ones stay
            self.known, self.known_ids = (x.slice(len(x) - self.most // 2) for x in (self.known, self.known_ids))
        _, ends, ids = every.take(pa.array(spot)).buffers()
        cuts = np.frombuffer(ends, np.int64)[split.offsets.to_numpy()].tolist()
        return [ids[a:b].to_pybytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def pieces(self, new: list[str]) -> Iterator[bytes]:
        """``piece`` of each. Letters, and letters with marks after them, take a short way: only the letters are kept here, since the whole piece will be known."""
        tokenize, code, names, swap = self.model.tokenize, self.code, BYTE_NAMES, sys.byteorder == "big"
        kept, old, bare = self.spaced, self.spaced.old, self.bare
        for piece in new:
            head = piece if piece.isalpha() else piece.rstrip(MARKS)
            if len(head) > self.LONG or not head.isalpha():
                yield self.piece(piece)
                continue
            found = kept.get(head) or old.get(head)
            if found is None:
                raw = head if head.isascii() else head.encode().decode("latin-1").translate(names)
                ids = array(code, [x.id for x in tokenize(SPACE_NAME + raw)])
                if swap:
                    ids.byteswap()
                found = kept[head] = ids.tobytes()
            yield found if head is piece else found + bare[piece[len(head) :]]

    def piece(self, piece: str) -> bytes:
        lead = piece[:1]
        if lead == self.FIRST:
            return self.bare[piece[1:]]
        return self.line_end + self.bare[piece[1:]] if lead == "\n" else self.spaced[piece]

    def around(self, run: str) -> bytes:
        """Ids of the white space before a word but for a last space, which is the word's."""
        head, last = run[:-1], run[-1:]
        return (self.run(head) if head else b"") + (self.run(last) if last and last != " " else b"")

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.packed(text), self.kind)


def byte_names() -> dict[int, int]:
    """How a byte-level BPE names bytes: printable ones of Latin-1 by themselves, the others by the letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain)}


BYTE_NAMES = byte_names()
SPACE_NAME = chr(BYTE_NAMES[ord(" ")])


class _Pieces(dict):
    """Ids of pieces that follow ``lead``."""

    def __init__(self, owner: Encoder, lead: str):
        super().__init__()
        self.owner, self.lead, self.old = owner, lead, {}

    def turn(self) -> None:
        self.old = dict(self)
        self.clear()

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = self.encoded(piece)
        if len(piece) <= Encoder.LONG and "\n" not in piece:
            self[piece] = found
        return found

    def encoded(self, piece: str) -> bytes:
        owner = self.owner
        if "\n" in piece:
            head, *tail = piece.split("\n")
            return self[head] + b"".join(owner.line_end + owner.bare[x] for x in tail)
        if piece.isalpha():
            return owner.letters(self.lead + piece)
        head = piece.rstrip(MARKS)
        if head and head != piece and head.isalpha():  # letters, then marks: two pieces of the split pattern
            return self[head] + owner.bare[piece[len(head) :]]
        return owner.whole(self.lead + piece) if self.lead or piece else b""


#: White space of the split pattern (the Unicode property), and runs of it with the word that follows.
GAP = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PARTS = re.compile(f"([{GAP}]*)([^{GAP}]*)")
#: Two characters of white space in a row, as ``str.isspace`` has it.
WHITE_PAIR = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2}"
#: Marks that follow words; none is a letter, a digit or white space.
MARKS = ".,;:!?*%&#$|"


@functools.lru_cache(maxsize=2)
def encoder(path: str, most: int = 600_000, stretch: int = Encoder.STRETCH) -> Encoder:
    """One a worker process and vocabulary file."""
    return Encoder(path, most, stretch)
