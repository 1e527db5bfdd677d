"""JSON arrays read in ranges give what the standard parser gives."""

import json
import random

import pytest

from sparkloom.sources import json_array, kb

VALUES = ["plain", "bra{ce", "]}", 'quo"te\\', "line\nend", "é😀", "", "\\\\", None, 5, [1, {"a": "}"}], {"deep": [[{"x": "{"}]]}]


def some(n, seed=1):
    rng = random.Random(seed)
    return [{"text": rng.choice(VALUES), "source": f"s{k}", "n": rng.choice(VALUES), "long": "x" * rng.choice([0, 5, 300, 3000])} for k in range(n)]


def read(spark, path):
    return [json.loads(r.body) for r in json_array.records(spark, str(path)).orderBy("record_index").collect()], [r.record_index for r in json_array.records(spark, str(path)).orderBy("record_index").collect()]


@pytest.fixture
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "1024")
    spark.conf.set(names[1], "0")
    yield
    for n, v in zip(names, old, strict=True):
        spark.conf.set(n, v)


@pytest.mark.parametrize("indent", [2, 0, None])
def test_ranges(spark, tmp_path, small_ranges, indent):
    want = some(60)
    path = tmp_path / "kb.json"
    path.write_text(json.dumps(want, indent=indent, ensure_ascii=False), encoding="utf-8")
    got, places = read(spark, path)
    assert got == want and places == list(range(60))
    if indent is not None:
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 8


def test_written_records_round_trip(spark, tmp_path, small_ranges):
    docs = spark.createDataFrame([(k, f"text {k} \n\" }}{{ " * 40, f"s{k}", None) for k in range(50)], "ord long, text string, source string, type string")
    assert kb.write_records_json(docs, str(tmp_path / "out.json"), "ord") == 50
    want = json.loads((tmp_path / "out.json").read_text(encoding="utf-8"))
    got = [r.asDict() for r in kb.read_records(spark, str(tmp_path / "out.json")).orderBy("record_index").collect()]
    assert [{k: r[k] for k in ("text", "source", "type")} for r in got] == want and [r["record_index"] for r in got] == list(range(50))


def test_many_ranges_are_joined(spark, tmp_path, small_ranges, monkeypatch):
    monkeypatch.setattr(json_array, "SENT_RANGES", 0)
    want = some(40, 3)
    (tmp_path / "kb.json").write_text(json.dumps(want, indent=1))
    assert read(spark, tmp_path / "kb.json")[0] == want


def test_odd_arrays(spark, tmp_path):
    for body, want in (("[]", []), ("  \n ", []), ('[1, "two", {"a": 1}, [{"b": 2}], null]', [{"a": 1}]), ('[{"a": "unended', [])):
        (tmp_path / "x.json").write_text(body)
        assert [x for x in map(lambda r: r.body, json_array.records(spark, str(tmp_path / "x.json")).collect()) if x.endswith("}")] == [json.dumps(x) for x in want]
    with pytest.raises(Exception):  # noqa: B017
        json_array.records(spark, str(tmp_path / "none.json")).count()
