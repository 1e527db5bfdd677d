"""Licenses at the coverage asked for are found, whichever of their words are missing."""

from itertools import combinations
from math import ceil

import pytest

from sparkloom.llm import license_patience as lp

SCAN = lp.Scanner(lp.TEMPLATES, 0.8).scan


@pytest.mark.parametrize(("text", "name"), [("Available under CC BY 4.0.", "cc-by-4.0"), ("Distributed under CC BY-NC 4.0.", "cc-by-nc-4.0")])
def test_a_word_may_be_another(text, name):
    assert [(x[2], x[3]) for x in SCAN(text)] == [(name, 0.8)]


@pytest.mark.parametrize("coverage", [0.55, 0.6, 0.7, 0.8, 0.9, 1.0])
@pytest.mark.parametrize("template", ["Licensed under CC BY 4.0.", "one two three four five six seven eight nine ten", "the use of the work is for all", "the alpha of the", "a a a b"])
def test_any_words_may_be_missing(template, coverage):
    """Words that are gone are replaced; of short templates each choice of them is tried. Finds need no anchor that occurs once, as the ends are matched first."""
    scanner = lp.Scanner({"x": (template,)}, coverage)
    words = lp.folded(template)
    missing = len(words) - ceil(coverage * len(words) - 1e-9)
    for gone in combinations(range(len(words)), missing):
        text = " ".join(f"zz{i}" if i in gone else w for i, w in enumerate(words))
        matched = len(lp.aligned(lp.folded(text), words))
        if matched == len(words) - missing:
            assert [x[2] for x in scanner.scan(text)] == ["x"], text
