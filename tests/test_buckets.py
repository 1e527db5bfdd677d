"""Merges into a table in buckets: what is not touched stays as it is, and repeated batches change nothing."""

import hashlib
import json

import pytest

from sparkloom.sources import buckets

SCHEMA = "id long, text string, at int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def files(path):
    return {str(p.relative_to(path)): hashlib.sha256(p.read_bytes()).hexdigest() for p in path.rglob("part-*.parquet")}


def held(spark, path):
    return {r.id: (r.text, r["at"]) for r in buckets.read(spark, str(path)).collect()}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = tmp_path / "t"
    rows = [(k, f"text {k}", 0) for k in range(400)]
    first = buckets.merge(frame(spark, rows), str(path), "id", "at", buckets=16)
    before = files(path)
    assert first.number == 0 and len(first.files) == 16 and len(before) == 16
    second = buckets.merge(frame(spark, [(7, "new", 1), (1000, "more", 1)]), str(path), "id", "at")
    after = files(path)
    moved = {b for b in first.files if first.files[b] != second.files[b]}
    assert 1 <= len(moved) <= 2 and before.items() <= after.items() and len(after) == len(before) + len(moved)
    want = {k: (t, a) for k, t, a in rows} | {7: ("new", 1), 1000: ("more", 1)}
    assert held(spark, path) == want
    # Again, as it is and with a row that is there already: no version, no file.
    assert buckets.merge(frame(spark, [(7, "new", 1), (1000, "more", 1), (8, "text 8", 0)]), str(path), "id", "at").number == 1
    assert files(path) == after and held(spark, path) == want
    assert buckets.cleared(spark, str(path), keep=1) == 0  # the first version's files are in the second's list
    assert held(spark, path) == want


def test_batches_by_number(spark, tmp_path):
    path = str(tmp_path / "t")
    buckets.merge(frame(spark, [(1, "a", 0)]), path, "id", "at", batch=0, buckets=4)
    buckets.merge(frame(spark, [(1, "b", 1), (1, "c", 0), (None, "lost", 9)]), path, "id", "at", batch=1)
    late = buckets.merge(frame(spark, [(1, "z", 9)]), path, "id", "at", batch=1)
    assert late.number == 1 and held(spark, path) == {1: ("b", 1)}
    assert buckets.merge(frame(spark, []), path, "id", "at", batch=2).batch == 2
    assert held(spark, path) == {1: ("b", 1)}


def test_a_version_is_committed_once(spark, tmp_path, monkeypatch):
    path = tmp_path / "t"
    buckets.merge(frame(spark, [(1, "a", 0)]), str(path), "id", "at", buckets=4)
    stale = buckets.latest(spark, str(path))
    buckets.merge(frame(spark, [(1, "b", 1)]), str(path), "id", "at")
    # A writer that has read the version before.
    monkeypatch.setattr(buckets, "latest", lambda *_: stale)
    with pytest.raises(RuntimeError):
        buckets.merge(frame(spark, [(1, "c", 2)]), str(path), "id", "at")
    monkeypatch.undo()
    assert held(spark, path) == {1: ("b", 1)}
    assert not list((path / "versions").glob("*.new"))
    assert buckets.cleared(spark, str(path), keep=1) == 2 and held(spark, path) == {1: ("b", 1)}
    assert json.loads((path / "versions/1.json").read_text())["number"] == 1


def test_odd_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        buckets.read(spark, path)
    buckets.merge(frame(spark, []), path, "id", "at", buckets=4)
    assert held(spark, path) == {}
    buckets.merge(spark.createDataFrame([(5, "five")], "id long, text string"), path, "id", "text")
    buckets.merge(frame(spark, [(2**53, None, None), (2**53 + 1, "", 1)]), path, "id", "at")
    assert held(spark, path) == {5: ("five", None), 2**53: (None, None), 2**53 + 1: ("", 1)}
    with pytest.raises(ValueError):
        buckets.merge(spark.createDataFrame([(5, 1)], "id long, other int"), path, "id", "id")
