"""Reports, exports, file sizes, and the rules that ids fire."""

import json

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import chunks, profile, quality, structure
from sparkloom.plans import report
from sparkloom.sources import crawl, kb

LONG = " ".join(f"word{i}" for i in range(95)) + "."


@pytest.fixture(scope="module")
def parents(spark):
    rows = [("p1", "s1", "T1", 0, LONG), ("p2", "s2", "T2", 1, "short"), ("", "s2", "T2", 2, LONG), (None, "s3", "T3", 3, "again " * 90), ("p5", "s3", "<b>T</b>", 4, None)]
    return spark.createDataFrame(rows, "parent_id string, source string, title string, record_index long, text string").cache()


@pytest.fixture(scope="module")
def children(spark):
    rows = [("p1", "c1", 0, "s1", LONG[:300]), ("p1", "c2", 1, "s1", LONG[250:500]), ("p1", None, 2, "s1", LONG[480:700]), ("p2", "", 0, "s2", "tiny"), ("lost", "c9", 0, "s9", LONG[:200])]
    return spark.createDataFrame(rows, "parent_id string, child_id string, child_index int, source string, text string").cache()


def codes(found, key):
    return {tuple(r[k] for k in key): [f"{i.severity}:{i.code}" for i in r["issues"]] for r in found.collect()}


def test_id_rules(parents, children):
    own = codes(quality.reports(parents, quality.PARENT, "parent", F.col("parent_id")), ["record_index"])
    assert own[0,] == [] and own[2,] == ["error:NO_PARENT_ID"]
    assert own[3,] == ["warning:REPETITIVE", "error:NO_PARENT_ID"] and own[1,] == ["error:TOO_SHORT", "error:FEW_WORDS"]
    kids = codes(quality.reports(children, quality.CHILD, "child", F.col("parent_id"), F.col("child_id")), ["parent_id", "child_index"])
    assert "error:NO_CHILD_ID" in kids["p1", 2] and "error:NO_CHILD_ID" in kids["p2", 0] and "error:NO_CHILD_ID" not in kids["p1", 0]
    none = quality.reports(children.withColumn("parent_id", F.lit(None).cast("string")), quality.CHILD, "child", F.col("parent_id"), F.col("child_id"))
    assert all("error:NO_PARENT_ID" in x for x in codes(none, ["child_index", "child_id"]).values())


def test_export_round_trip(spark, parents, children, tmp_path):
    path = str(tmp_path / "debug.json")
    kb.write_export(parents.where("parent_id <> ''"), children, path, "record_index", n=2)
    told = json.loads((tmp_path / "debug.json").read_text())
    assert [x["parent_id"] for x in told] == ["p1", "p2"] and told[0]["num_children"] == 3 and told[0]["parent_preview"] == LONG[:300] + "…"
    up, down = kb.read_export(spark, path)
    assert [(r.parent_id, r.parent_length, r.num_children) for r in up.orderBy("parent_id").collect()] == [("p1", len(LONG), 3), ("p2", 5, 1)]
    assert [(r.parent_id, r.child_index, r.child_id, r.length) for r in down.orderBy("parent_id", "child_index").collect()] == [("p1", 0, "c1", 300), ("p1", 1, "c2", 250), ("p1", 2, None, len(LONG[480:700])), ("p2", 0, "", 4)]


def test_reports(parents, children):
    up = quality.reports(parents, quality.PARENT, "parent", F.col("parent_id"))
    down = quality.reports(children, quality.CHILD, "child", F.col("parent_id"), F.col("child_id"))
    whole = structure.integrity(parents.where("parent_id <> ''"), children, "record_index")
    made = json.loads(report.summary_json(quality.summary(up), quality.summary(down), whole))
    assert made["parent_summary"]["length_stats"]["count"] == 5 and made["structure"]["orphan_children"] == 1 and made["structure"]["childless_parents"] == 1 and made["structure"]["childless_sample"] == ["p5"]
    assert sum(made["child_summary"]["quality_dist"].values()) == 5
    text = report.console(made["parent_summary"], "PARENTS")
    assert text.startswith("== PARENTS ==\nchunks: 5\n") and f"issues: {made['parent_summary']['errors']} errors" in text and "error:NO_PARENT_ID: 2" in text
    pairs = structure.consecutive_overlap(children, "parent_id", "child_index")
    details = report.console_details(down.withColumn("at", F.concat_ws(" ", "parent_id", "child_index")), "at", made["structure"], pairs)
    assert "== worst 5 ==" in details and "p2 0: " in details and "orphan_children: 1" in details and "parent_id p1, child_index" in details
    page = report.html_report(up, down.withColumn("record_index", F.col("child_index")), "record_index", {"a & b": "<i>"})
    assert page.count("<tr style") == 10 and "&lt;i&gt;" in page and "a &amp; b" in page and "#f8d7da" not in page.split("<h2>")[0]
    assert "chunks: 0" in report.console(json.loads(quality.summary(up.where("1 = 0")).toJSON().first()), "NONE")


def test_file_sizes(spark, parents, tmp_path):
    parents.repartition(2).write.parquet(str(tmp_path / "t"))
    want = {p.name: p.stat().st_size for p in (tmp_path / "t").glob("part-*.parquet")}
    got = {r.file_path.rsplit("/", 1)[1]: r.file_size for r in profile.file_sizes(spark.read.parquet(str(tmp_path / "t"))).collect()}
    assert got and got.items() <= want.items()


def test_least_length_and_headers_of_children(spark):
    """Sections that are too short give no parent; headers go with each child."""
    text = "## One\n\n" + LONG * 3 + "\n\n## Two\n\nshort\n\n### Three\n\n" + LONG
    docs = spark.createDataFrame([("s", "T", "html", 0, text), ("s", "T", "html", 1, "x")], "source string, title string, type string, record_index long, text string")
    up = chunks.parents(docs).cache()
    assert {r.headers[1] for r in up.collect()} == {"One", "Two"} and all(len(r.text) >= chunks.MIN_PARENT for r in up.collect())
    assert not up.where(F.col("headers")[2].isNull() & (F.col("headers")[1] == "Two")).count()
    down = chunks.children(up).collect()
    assert {r.headers[2] for r in down if r.headers[1] == "Two"} == {"Three"} and all("Section: One" in r.text for r in down if r.headers[1] == "One")


def test_staff_and_structure_pages(spark):
    from sparkloom.functions import urls

    site = urls.Site(staff_path="/people", staff_key="id", staff_home="about", staff_teaching="lessons", structure_path="/units", year_key="y", min_year=2022)
    body = "<p>" + LONG + "</p>"
    pages = [
        (0, "https://a.org/", "<a href='/people?id=7'>x</a><a href='/units?id=1'>u</a><a href='/units?id=1'>u</a>"), (1, "https://a.org/units?id=1", body), (2, "https://a.org/s/000007/about", body + "<table><tr><td>x</td></tr></table>"),
        (3, "https://a.org/s/000007/lessons", "<a href='/s/000007/lessons?y=2023&id=1'>n</a><a href='/s/000007/lessons?y=2020&id=2'>o</a>"), (4, "https://a.org/s/000007/lessons?y=2023&id=1", body), (5, "https://a.org/s/000007/lessons?y=2020&id=2", body), (6, "https://a.org/s/000008/about", body),
    ]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    ids = crawl.staff_ids(rows, site)
    assert [r.staff_id for r in ids.collect()] == ["000007"]
    wanted = crawl.staff_urls(ids, "https://a.org/s", site)
    assert [r.source for r in crawl.staff_homes(rows, wanted, site=site).collect()] == ["https://a.org/s/000007/about"]
    assert [r.source for r in crawl.staff_courses(rows, wanted, site=site).collect()] == ["https://a.org/s/000007/lessons?y=2023&id=1"]
    assert [r.source for r in crawl.structures(rows, crawl.links(rows, site)).collect()] == ["https://a.org/units?id=1"]
