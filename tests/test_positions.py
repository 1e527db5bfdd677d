"""Sections and positions against plain Python."""

import random
import re

from pyspark.sql import functions as F

from sparkloom.operators import chunks, dedup


def plain_sections(text):
    """Line by line: headers outside of code fences open sections and clear the levels below their own."""
    done, headers, lines, fenced = [], [None] * 5, [], False
    for line in (text or "").split("\n"):
        fence = line.lstrip(" ").startswith(("```", "~~~"))
        found = None if fenced or fence else re.match(r"(#{1,5})[ \t\x0b\f\r]+[^ \t\n\x0b\f\r]", line)
        if found:
            if lines:
                done.append((list(headers), lines))
            level = len(found[1])
            headers[level - 1 :] = [re.sub(r"^#{1,5}[ \t\x0b\f\r]+", "", line).strip(" ")] + [None] * (5 - level)
            lines = [line]
        else:
            lines.append(line)
            fenced ^= fence
    done.append((list(headers), lines))
    return [(h, "\n".join(x).strip(" \t\r\n\f\v")) for h, x in done]


def test_sections_as_line_by_line(spark):
    rng = random.Random(7)
    parts = ["# A", "## B", "### C c", "#### D", "##### E", "###### no", "#", "# ", "#x", "```", "  ~~~ py", "text # no", "", " ", "\x01", "\x010 mark", "\x011", "# \x01 h", "#\tT", "é 😀", "a\rb", "a # no", "# A\u0085x"]
    texts = [None, "", "\n", "# A", "\n# A", "```", "```\n# A\n```\n# B", "## B\n# A\n### C", "# A\n## B\n# A2\n### C\n## B2\n##### E"]
    texts += ["\n".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "record_index long, text string")
    got = {}
    for r in chunks.header_sections(docs, ["record_index"]).orderBy("record_index", "section").collect():
        got.setdefault(r.record_index, []).append((r.section, r.headers, r.text))
    for k, text in enumerate(texts):
        assert got[k] == [(n, *x) for n, x in enumerate(plain_sections(text))], repr(text)


def test_sections_of_a_long_text(spark):
    body = "\n".join(f"## H{k}\nline {k}" for k in range(20_000))
    found = chunks.header_sections(spark.createDataFrame([(0, body)], "record_index long, text string"), ["record_index"])
    row = found.agg(F.count("*"), F.max("section"), F.max_by("text", "section")).first()
    assert tuple(row) == (20_000, 19_999, "## H19999\nline 19999")


def test_positions_over_record_blocks(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, rng.randrange(-3, 40), rng.randrange(10**6)])) for _ in range(400)]
    rows = [(s, n, k) for s, n in dict.fromkeys(rows) for k in range(rng.randrange(1, 4))]
    rng.shuffle(rows)
    found = dedup.running_position(spark.createDataFrame(rows, "source string, n long, k int"), "source", ["n", "k"])
    assert found.columns == ["source", "n", "k", "chunk_pos"]
    want = []
    for source in {s for s, _, _ in rows}:
        own = sorted((r for r in rows if r[0] == source), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want += [(*r, at) for at, r in enumerate(own)]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert dedup.running_position(spark.createDataFrame([], "source string, n long, k int"), "source", ["n", "k"]).count() == 0


def test_parents_of_records_without_a_source_stay(spark):
    text = "word " * 40
    docs = spark.createDataFrame([(None, "T", "html", 0, text), ("s", "T", "html", None, text), ("s", "T", "html", 1, text)], "source string, title string, type string, record_index long, text string")
    got = sorted(((r.source, r.record_index, r.chunk_pos) for r in chunks.parents(docs).collect()), key=repr)
    assert got == sorted([(None, 0, 0), ("s", None, 0), ("s", 1, 1)], key=repr)
