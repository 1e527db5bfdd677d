"""Pipeline stages on odd and empty tables, with columns that clash."""

import pytest

import corpus_pipeline as p
from sparkloom.llm import common

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, p_toxic string, component_id int, kept string, item_id long, spans string"
PROSE = "a quiet morning in the harbour with small boats and a low sun over the water before anyone was awake "
SECRET = "password = Zk9Qw8Xv7Lm5Rt3Py1"


def rows(texts):
    return [(k, t, None, "s", len(t or ""), "clash", 1, "clash", 2, "clash") for k, t in texts]


ODD = [
    (1, None), (2, ""), (3, " \n"), (4, PROSE + SECRET), (5, PROSE * 400), (6, "one two three " * 40), (6, "one two three " * 40), (None, "nobody knows this " * 30),
    (2**53, "first of two neighbours " * 20), (2**53 + 1, "second of two neighbours is unlike " * 20), (7, "one two three " * 40),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(ODD), SCHEMA).repartition(3).cache()


def through(spark, docs, sf_dir):
    found = {}
    for name, stage in p.STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"edge-{name}")
        found[name] = docs
    return found


def test_odd_documents(spark, odd, sf_dir):
    found = through(spark, odd, sf_dir)
    for name, _ in p.STAGES[:-1]:
        assert found[name].columns == odd.columns
    ids = lambda name: sorted((r.doc_id for r in found[name].select("doc_id").collect()), key=repr)
    every = sorted((k for k, _ in ODD), key=repr)
    assert ids("toxicity") == every
    # Equal rows of one id are one, and of copies the smallest id stays; null, empty and blank texts are no copies.
    once = sorted([1, 2, 3, 4, 5, 6, None, 2**53, 2**53 + 1], key=repr)
    assert ids("near_dedup") == ids("decontamination") == ids("secrets") == once
    hidden = {r.doc_id: r for r in found["secrets"].collect()}
    assert hidden[4].text == PROSE + "[secret]" and hidden[4].n_chars == len(hidden[4].text) and hidden[1].text is None
    assert hidden[5].text == PROSE * 400 and hidden[4].p_toxic == "clash"
    packed = found["packing"].collect()
    assert {r.doc_id for r in packed} == set(once) and all(r.offset + r.length <= 2048 for r in packed)
    assert next(r for r in packed if r.doc_id == 2).length == 1


def test_empty_documents(spark, odd, sf_dir):
    for name, docs in through(spark, odd.limit(0), sf_dir).items():
        assert docs.count() == 0, name


def test_each_stage_alone(spark, odd, sf_dir):
    """A stage takes documents as they are, not only what its predecessor leaves."""
    for _, stage in p.STAGES:
        assert stage(spark, odd, sf_dir).count() > 0
