"""Recall and false alarms of the chain on labelled documents that it has not seen."""

import os

import duckdb
import numpy as np
import pytest

from sparkloom.llm import toxicity_chain

SF = os.environ.get("TEST_LABELS_DIR", "/root/testdata/sf0.1")


@pytest.mark.skipif(not os.path.exists(f"{SF}/labels.parquet"), reason="needs the labelled documents of the larger tables")
def test_held_out_recall():
    rows = duckdb.sql(f"SELECT text, quality, toxic FROM '{SF}/documents.parquet' d JOIN '{SF}/labels.parquet' l ON d.doc_id = l.doc_id ORDER BY hash(d.doc_id)").fetchall()
    texts, quality, toxic = ([r[k] for r in rows] for k in range(3))
    low, bad = np.array(quality) == 0, np.array(toxic) == 1
    # Copies of a text are on one side.
    from hashlib import sha256

    held = np.array([sha256((x or "").encode()).digest()[0] % 2 == 0 for x in texts])
    chain = toxicity_chain.fit_chain([t for t, h in zip(texts, held, strict=True) if not h], {"low_quality": low[~held], "toxic": bad[~held]})
    p = toxicity_chain.Scorer(chain).probabilities([t for t, h in zip(texts, held, strict=True) if h])[:, 1]
    found, y = p >= chain.thresholds["toxic"], bad[held]
    recall, precision, alarms = (found & y).sum() / y.sum(), (found & y).sum() / found.sum(), (found & ~y).sum() / (~y).sum()
    print(f"recall {recall:.3f}, precision {precision:.3f}, false alarms {alarms:.4f}, threshold {chain.thresholds['toxic']:.3f}")
    assert recall >= 0.9 and precision >= 0.85 and alarms <= 0.02


def test_thresholds():
    p, y = np.array([0.9, 0.8, 0.7, 0.4, 0.1]), np.array([1, 1, 1, 1, 0])
    assert toxicity_chain.threshold_for(p, y, 1.0) == 0.4 and toxicity_chain.threshold_for(p, y, 0.5) == 0.5
    assert toxicity_chain.threshold_for(p * 0.1, y, 0.9) == 0.1
    for none in (np.zeros(5), np.ones(5)):
        assert toxicity_chain.threshold_for(p, none, 0.9) == 0.5
    assert toxicity_chain.fit_chain([], {"toxic": np.empty(0)}).thresholds == {"toxic": 0.5}
