"""Where secrets are looked for, and which of the candidates are measured."""

import base64
import json
import random
import string

import pytest

from sparkloom.llm import secret_novelty


def novel(text):
    return [text[a:b] for a, b, kind in secret_novelty.spans(text) if kind == "novel"]


KEY = "qP9xZ2vL8wT4mK7rB1nY"
OTHER = "Zk4Gw8Xv0Lm5Tr2Yb6Qh"


def gap(n):
    """n characters without a candidate, blanks at both ends."""
    return f" {('a ' * n)[: n - 2]} "


@pytest.mark.parametrize("text", [f'{{"v": "{KEY}", "type": "bearer"}}', f"bearer{gap(53)}{KEY} x", f"bearer{gap(63)}{KEY} x", f"{KEY}{gap(63)}bearer"])
def test_both_sides_of_a_word(text):
    assert novel(text) == [KEY]


@pytest.mark.parametrize("text", [f"bearer{gap(64)}{KEY} x", f"{KEY}{gap(64)}bearer", f"bearer é{KEY[:11]}", gap(9) + KEY])
def test_outside_of_a_context(text):
    assert novel(text) == []


def test_word_inside_a_run():
    assert novel(f"x {KEY}_bearer_{OTHER} x") == [f"{KEY}_", f"_{OTHER}"]


@pytest.mark.parametrize("wire", [str, lambda t: t.replace("\n", "\r\n"), json.dumps, lambda t: t.split("-----", 2)[2], lambda t: t.rsplit("-----", 2)[0]])
def test_whole_keys_of_many_lines(wire):
    raw = base64.b64encode(random.Random(4).randbytes(640)).decode()
    lines = [raw[i : i + 64] for i in range(0, len(raw), 64)]
    text = wire("\n".join(["bye", "-----BEGIN PRIVATE KEY-----", *lines, "-----END PRIVATE KEY-----", "bye"]))
    found = novel(text)
    assert len(lines) == 14 and all(any(x in f for f in found) for x in lines)


def test_context_ends_with_the_lines():
    assert novel(f"bearer {KEY}\n{OTHER}\n{gap(90)}\n{OTHER[::-1]}") == [KEY, OTHER]
    assert novel(f"bearer {KEY}\n日本語の文\n{gap(60)}{OTHER}") == [KEY]


@pytest.mark.parametrize("alphabet", [string.ascii_letters, string.ascii_lowercase, string.digits, string.ascii_letters + string.digits + "+/"])
@pytest.mark.parametrize("n", [12, 16, 32])
def test_random_strings_of_any_characters(alphabet, n):
    made = random.Random(6)
    # 16 digits or more are the base kind hex.
    found = sum([s[:2] for s in secret_novelty.spans(f"bearer {x} here")] == [(7, 7 + n)] for x in ("".join(made.choices(alphabet, k=n)) for _ in range(100)))
    assert found >= 90


def test_ordinary_long_words():
    words = "authentication Implementation infrastructure administrator communication documentation international understanding specification approximately Gesellschaft desarrolladores"
    assert novel(" ".join(f"token {w}," for w in words.split())) == []
    assert novel("token ---------------- aaaaaaaaaaaaaaaa") == []
