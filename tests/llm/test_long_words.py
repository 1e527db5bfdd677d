"""Words that are joined without spaces count for the toxicity chain."""

import random

import numpy as np
import pytest

from sparkloom.llm import toxicity_chain

WORDS = "alpha bravo carrot delta eagle falcon garden hotel indigo jungle kettle lemon".split()


@pytest.mark.parametrize("join", [",", "/", "-", "_", ""])
def test_joined_words(join):
    toxic = np.array([i % 3 == 0 for i in range(300)])
    made = [[*random.Random(i).choices(WORDS, k=12), *(["vilelot"] if t else [])] for i, t in enumerate(toxic)]
    for x in made:
        random.Random(len(x)).shuffle(x)
    chain = toxicity_chain.fit_chain([" ".join(x) for x in made], {"toxic": toxic})
    got = toxicity_chain.Scorer(chain).probabilities([join.join(x) for x in made])[:, 0] >= 0.5
    assert all(len(join.join(x)) > 40 for x in made) and (got == toxic).mean() > 0.95


def test_fit_on_text_without_spaces():
    toxic = np.array([i % 3 == 0 for i in range(300)])
    letters = [chr(0x4E00 + i) for i in range(400)]
    texts = ["".join([*random.Random(i).choices(letters, k=30), *("\u9ed1\u9ed2\u9ed3\u9ed4" if t else ""), *random.Random(-i).choices(letters, k=30)]) for i, t in enumerate(toxic)]
    chain = toxicity_chain.fit_chain(texts, {"toxic": toxic})
    assert ((toxicity_chain.Scorer(chain).probabilities(texts)[:, 0] >= 0.5) == toxic).mean() > 0.95


def test_repeated_parts_count_as_words():
    assert set(toxicity_chain.word_features("foobar-" * 9)) == set(toxicity_chain.word_features("foobar"))
