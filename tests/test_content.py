"""Main content on hand-made pages, and repair of misread text."""

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import content, mojibake
from sparkloom.plans import web
from sparkloom.plans.registry import ORACLES

PROSE = "The river rises in the hills, crosses the plain, and reaches the sea after nine days. Boats go down it in spring, when the water is high. "
MENU = "<ul class='menu'>" + "".join(f"<li><a href='/{k}'>Entry {k} of the menu</a></li>" for k in range(12)) + "</ul>"
COOKIES = "<div id='cookie-banner'><p>We use cookies, and some of our partners do, to make this page work. Accept all of them or choose.</p><button>Accept</button></div>"
SIDE = "<div class='sidebar'><h3>More</h3><ul>" + "".join(f"<li><a href='/s{k}'>A story about something else {k}</a></li>" for k in range(8)) + "</ul></div>"
TABLE = "<table><tr><th>Day</th><th>Depth</th></tr><tr><td>1</td><td>20 cm</td></tr></table>"


def page(body):
    return f"<html><head><title>t</title><style>p{{}}</style></head><body>{body}</body></html>"


@pytest.mark.parametrize("holder", ["<article>{}</article>", "<main>{}</main>", "<div class='content'>{}</div>", "<div>{}</div>", "<div><div><section>{}</section></div></div>"])
def test_content_without_furniture(holder):
    own = f"<h1>The river</h1><p>{PROSE}</p><h2>Depth</h2>{TABLE}<p>{PROSE * 2}</p><ul><li>Boats</li><li>Rafts, too</li></ul><pre>a  b\n  c</pre>"
    made = content.main_text(page(COOKIES + MENU + holder.format(own) + SIDE + "<footer>Address</footer><p>After the footer</p>"))
    for kept in ("# The river", "## Depth", "| Day | Depth |", "| 1 | 20 cm |", "- Boats", "- Rafts, too", PROSE.strip()):
        assert kept in made, kept
    for gone in ("cookies", "Entry", "something else", "Address", "After the footer", "Accept"):
        assert gone not in made, gone


def test_boxes_inside_of_the_content():
    made = content.main_text(page(f"<article><h1>T</h1><p>{PROSE}</p><div class='share-bar'>Tell your friends about it</div>{MENU}<div class='related'><p>Read this as well, it is long enough to be prose.</p></div><p>{PROSE * 3}</p></article>"))
    assert "friends" not in made and "Entry" not in made and "as well" not in made and made.count("The river rises") >= 2


def test_neighbours_of_the_content_stay():
    made = content.main_text(page(f"<div id='wrap'><h1>Title</h1><div><p>{PROSE * 3}</p></div><div><p>{PROSE * 2}more</p></div>{SIDE}</div>"))
    assert made.startswith("# Title") and "more" in made and "something else" not in made


def test_pages_without_prose():
    assert content.main_text(None) == "" == content.main_text("  ")
    assert content.main_text("plain words") == "plain words"
    assert content.main_text(page("<p>short</p><nav>no</nav><div style='display: none'>no</div>")) == "short"
    assert content.main_text("<ul><li>one<li>two</ul><table><tr><td>x<td>y</table>") == "- one\n- two\n\n| x | y |"
    deep = "<div>" * 20_000 + f"<p>{PROSE}</p>"
    assert content.main_text(deep) == PROSE.strip()


def test_repeated_paragraphs_are_given_once():
    assert content.main_text(page(f"<article><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE * 2}</p></article>")).count("\n\n") == 1


def test_titles_with_open_references(spark, tmp_path):
    """Titles that end inside of a reference, have no letters, or share their page's id with another."""
    article = f"<article><h1>{{}}</h1><p>{PROSE * 2}</p></article>"
    rows = [(1, article.format("A &amp; B &amp")), (2, article.format("1 &lt; 2")), (3, article.format("Caf&eacute")), (3, article.format("<b>x</b> &lt;i&gt;")), (4, f"<p>{PROSE}</p>"), (5, None), (None, article.format("T"))]
    spark.createDataFrame([(k, "u", x) for k, x in rows], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [tuple(r) for r in web.main_content_kept(spark, str(tmp_path)).collect()]
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW pages AS FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = duckdb.sql(ORACLES["main_content_kept"]).fetchall()
    assert sorted(got, key=str) == sorted(want, key=str) and sum(r[1] is True for r in got) == 5


# ---- misread text

LETTERS = "àèéìòùçñöüßÀÈÉ’“”–…€"
GOOD = st.lists(st.sampled_from(["perché", "l’università", "“così”", "più…", "Größe", "niño", "plain", "words", "5 €", "a – b", "ÀÈ", "日本語", "Привет"]), min_size=1, max_size=8).map(" ".join)


def misread(text, encoding):
    back = {b: c for c, b in mojibake.READERS[encoding].items()}
    return "".join(chr(b) if b < 0x80 else back[b] for b in text.encode())


@settings(max_examples=300, deadline=None)
@given(GOOD, GOOD, st.sampled_from(sorted(mojibake.READERS)), st.integers(0, 2))
def test_misread_segments(left, right, encoding, times):
    bad = right
    for _ in range(times):
        bad = misread(bad, encoding)
    assert mojibake.mended(f"{left} {bad}") == f"{left} {right}"


def test_good_text_stays():
    for text in ("«PERCHÉ»", "È«vero»", "àèéìòù", "naïve—café", "Łódź, Škoda", "Ελλάδα", "ÄÖÜ", "100 °C ± 2 µm", "©®™", "日本語テキスト", "😀😀", "\xa0\xa0x"):
        assert mojibake.mended(text) == text


def test_bad_sequences_beside_good_letters():
    assert mojibake.mended("éÃ©") == "éé" and mojibake.mended("giàÃ\xa0") == "giàà"


def test_repair_of_columns(spark):
    rows = ["plain", None, "", "Ã¨ vero", "lâ€™ora è giÃ\xa0 qui", "a" * 100_000 + "Ã©"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "x string").select(mojibake.repaired(F.col("x"))).collect()]
    assert got == ["plain", None, "", "è vero", "l’ora è già qui", "a" * 100_000 + "é"]
