"""Scalar functions against hand-made cases."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import html, text, titles, urls


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) if not isinstance(x, tuple) else x for x in rows], schema).select(column).collect()]


def test_canonical(spark):
    cases = {"http://WWW.A.it:80/Home/": "https://www.a.it:80/Home", "http://a.it/home/?x=1": "https://a.it/home/?x=1", "http://a.it/home/#top": "https://a.it/home/#top", "https://u@A.it/?q=/": "https://u@a.it/?q="}
    assert values(spark, list(cases), urls.canonical(F.col("x"))) == list(cases.values())


def test_domain(spark):
    assert values(spark, [None, "", "src0", "http://A.it:80/x"], urls.source_domain(F.col("x"))) == ["missing", "missing", "local_or_unknown", "a.it:80"]


def test_unit_filter(spark):
    site = urls.Site(unit_key="branch", unit_id="17")
    cases = ["http://a.it/list?branch=17", "http://a.it/list?branch=171", "http://a.it/list", "http://a.it/?subBranch=8&branch=17", "http://a.it/?BRANCH=9"]
    assert values(spark, cases, F.coalesce(urls.wrong_unit(F.col("x"), site), F.lit(False))) == [False, True, False, True, True]


def test_extension_and_years(spark):
    assert values(spark, ["http://a.it/x.CSS?v=1", "http://a.it/x.cssx"], urls.forbidden_extension(F.col("x"))) == [True, False]
    site = urls.Site(year_key="anno")
    cases = ["http://a.it/?anno=2020", "http://a.it/?anno=2021", "http://a.it/?anno=abc", "http://a.it/"]
    assert values(spark, cases, urls.young_enough(F.col("x"), site)) == [False, True, True, True]
    assert values(spark, cases, urls.surely_young(F.col("x"), site)) == [False, True, False, False]


def test_staff_ids(spark):
    site = urls.Site(staff_path="/people", staff_key="m")
    assert values(spark, ["http://a.it/people?m=123", "http://a.it/people?m=1234567", "http://a.it/x?m=1"], urls.staff_id(F.col("x"), site)) == ["000123", "1234567", None]


@pytest.mark.parametrize(("href", "full"), [("y", "http://a.it/b/y"), ("/y", "http://a.it/y"), ("?q=1", "http://a.it/b/x?q=1"), ("//c.it/z", "http://c.it/z"), ("https://d.it", "https://d.it"), ("../y#f", "http://a.it/y"), ("#f", "http://a.it/b/x?o=1"), ("mailto:a@b", "mailto:a@b")])
def test_absolute(spark, href, full):
    assert values(spark, [href], urls.absolute(F.lit("http://a.it/b/x?o=1"), F.col("x"))) == [full]


def test_hrefs_and_kinds(spark):
    page = "<a class=k href=\"/a.pdf\">1</a><A HREF='/b'>2</A><a href=/c>3</a><a name=d>"
    assert values(spark, [page], urls.hrefs(F.col("x"))) == [["/a.pdf", "/b", "/c"]]
    site = urls.Site(course_host="corsi.", structure_path="/strutture")
    assert values(spark, ["http://corsi.it/a.PDF", "http://corsi.it/a", "http://a.it/strutture?id=1", "http://a.it"], urls.link_kind(F.col("x"), site)) == ["pdf", "course", "structure", None]


def test_counts(spark):
    assert values(spark, [" a  b c ", ""], text.word_count(F.col("x"))) == [3, 0]
    assert values(spark, ["x. y!", ""], text.sentence_count(F.col("x"))) == [3, 1]
    assert values(spark, ["a A b", "…"], text.repetition_ratio(F.col("x"))) == [pytest.approx(2 / 3), 0.0]
    assert values(spark, ["a\n## b", "#b", "###### c"], text.has_header(F.col("x"))) == [True, False, False]


def test_overlap(spark):
    got = values(spark, [("a b c", "b c d e"), ("", "a"), ("A b", "a b")], text.overlap_ratio(F.col("x"), F.col("y")), "x string, y string")
    assert got == [pytest.approx(2 / 3), 0.0, 0.5]


def test_repair(spark):
    good = "perché – “ok” 😀"
    bad = good.encode().decode("latin-1")
    assert values(spark, [bad, good, "plain", "Ã alone", None], text.repaired(F.col("x"))) == [good, good, "plain", "Ã alone", None]


def test_pdf_clean(spark):
    raw = "a**==> picture [10 x 10] intentionally omitted <==**\n\nb c d"
    assert values(spark, [raw], text.pdf_clean(F.col("x"))) == ["ab\nc\n\nd"]


def test_titles(spark):
    overrides = {"https://library.b.org": "Library", "https://library.b.org/hours": "Opening hours"}
    cases = {
        "https://library.b.org/catalogue/new-books": "Library > Catalogue > New Books", "https://library.b.org/hours": "Opening hours", "https://library.b.org": "Library", "https://c.org/a-b_c/o'neil.html": "A B C > O'Neil",
        "https://c.org/42/row/plans.pdf": "Plans", "": titles.UNKNOWN_TITLE, "unknown": titles.UNKNOWN_TITLE,
    }
    assert values(spark, list(cases), titles.readable_title(F.col("x"), overrides)) == list(cases.values())


def test_breadcrumb(spark):
    headers = F.array(*[F.lit(x).cast("string") for x in ("t", "A", "http://x", "B", None)])
    assert values(spark, ["T"], titles.section_context(headers, F.col("x"))) == ["\nSection: A > B"]
    assert values(spark, ["T"], titles.section_context(F.array(F.lit("t")), F.col("x"))) == [""]


def test_cleaner():
    page = "<html><head><title>t</title></head><body><header>h</header><nav>n</nav><h1>Top</h1><p>a <b>b</b><p>c<ul><li>one<li>two</ul><table><tr><td>x</td><td>y</td></tr></table><footer>f</footer><p>gone</p></body></html>"
    out = html.cleaned_text(page)
    assert "# Top" in out and "a b" in out and "- one" in out and "| x |" in out
    assert "gone" not in out and "h\n" not in out and html.cleaned_text(None) == "" and html.cleaned_text("  ") == ""
