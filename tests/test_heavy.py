"""Top keys by summaries against counts of all keys."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import heavy, profile


def both(spark, keys, n, capacity, parts=5):
    rows = spark.createDataFrame(list(enumerate(keys)), "ord long, k string").repartition(parts)
    tell = lambda df: [tuple(r) for r in df.collect()]
    return tell(heavy.most_common(rows, F.col("k"), "ord", n, "key", capacity)), tell(profile.most_common(rows, F.col("k"), "ord", n, "key"))


@pytest.mark.parametrize("capacity", [4, 40, 4000])
def test_top_keys(spark, capacity):
    rng = random.Random(1)
    frequent = [f"k{int(rng.paretovariate(0.9))}" for _ in range(6000)] + [None, ""] * 300
    rng.shuffle(frequent)
    for keys in (frequent, [f"k{k}" for k in range(900)], ["one"] * 50, [], [None]):
        got, want = both(spark, keys, 5, capacity)
        assert got == want


def test_counts_in_a_summary_are_bounds():
    rng = random.Random(4)
    for _ in range(50):
        keys = [f"k{int(rng.paretovariate(0.6)) % 500}" for _ in range(2000)]
        held = heavy.Summary(20)
        for i in range(0, len(keys), 130):
            held.add(pd.Series(keys[i : i + 130]))
        true = pd.Series(keys).value_counts()
        assert len(held.counts) <= 20
        for k, n in true.items():
            low = held.counts.get(k, 0)
            assert low <= n <= low + held.error


def test_no_count_of_all_keys_where_summaries_do(spark, monkeypatch):
    monkeypatch.setattr(heavy.profile, "most_common", lambda rows, *a, f=profile.most_common: f(rows, *a) if "_key" in rows.columns else pytest.fail("all keys are counted"))
    keys = ["a"] * 3000 + ["b"] * 2000 + [f"x{k}" for k in range(2000)]
    rows = spark.createDataFrame(list(enumerate(keys)), "ord long, k string").repartition(4)
    assert [(r.key, r.n) for r in heavy.most_common(rows, F.col("k"), "ord", 2, "key", 200).collect()] == [("a", 3000), ("b", 2000)]
