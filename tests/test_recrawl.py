"""Snapshots in turn give what one crawl over all of them gives."""

import random

from sparkloom.session import scratch
from sparkloom.sources import buckets, crawl, recrawl


def site(n, seed):
    rng = random.Random(seed)
    links = {k: [rng.randrange(n) for _ in range(rng.randrange(4))] for k in range(n)}
    return [(k, f"HTTP://a.org/p{k}{'/' * (k % 2)}", " ".join(f"<a href='/p{j}'>x</a>" for j in out) or "none") for k, out in links.items()]


def test_snapshots_in_turn(spark):
    pages = site(90, 5)
    frame = lambda rows: spark.createDataFrame(rows, "page_id long, url string, html string")
    seeds = spark.createDataFrame([("https://a.org/p3",), ("https://a.org/p80",), ("https://a.org/none",)], "url string")
    path = scratch(spark, "crawl")
    late = {k for k, _, _ in pages if k % 3 == 0}
    # The second snapshot has pages of the first again, changed: their first version counts.
    second = [r for r in pages if r[0] in late] + [(k, u, "<a href='/p1'>new</a>") for k, u, _ in pages if k % 10 == 1 and k not in late] + [(999, None, "x")]
    parts = [[r for r in pages if r[0] not in late], second]
    assert recrawl.update(frame(parts[0]), seeds, path, 5, n_buckets=8) == 60
    before = buckets.latest(spark, f"{path}/levels").number
    assert recrawl.update(frame(parts[1]), seeds, path, 5) == 30
    got = {r.url: r.level for r in recrawl.reached(spark, path).collect()}
    want = {r.url: r.level for r in crawl.reach(frame(pages), seeds, 5).collect()}
    assert got == want and len(set(got.values())) >= 3
    # Nothing new: no page, no version.
    assert recrawl.update(frame(pages), seeds, path, 5) == 0
    assert buckets.latest(spark, f"{path}/levels").number == before + 1


def test_filters_miss_no_url():
    rng = random.Random(1)
    own = [f"https://a.org/{rng.random()}" for _ in range(3000)]
    raw = recrawl.filter_of(own)
    assert recrawl.known(own, raw).all() and len(raw) <= 2 * 3000 + 8
    assert recrawl.known([f"https://b.org/{k}" for k in range(20_000)], raw).mean() < 0.002
    assert not recrawl.known(["x"], recrawl.filter_of([])).any() and not len(recrawl.known([], raw))


def test_first_snapshots(spark):
    path = scratch(spark, "crawl")
    none = spark.createDataFrame([], "url string, html string")
    seeds = spark.createDataFrame([("https://a.org/",)], "url string")
    assert recrawl.update(none, seeds, path) == 0
    assert recrawl.update(spark.createDataFrame([("https://a.org/b", "x")], "url string, html string"), seeds, path, n_buckets=4) == 1
    assert recrawl.reached(spark, path).count() == 0
    assert recrawl.update(spark.createDataFrame([("https://a.org/", "<a href='/b'>b</a>")], "url string, html string"), seeds, path) == 1
    assert {(r.url, r.level) for r in recrawl.reached(spark, path).collect()} == {("https://a.org", 1), ("https://a.org/b", 2)}


def test_pages_that_share_a_url(spark):
    """Links of all pages of a URL count: beside one another in a snapshot, and, told apart by a key, when one comes later, to a URL that has been reached or not."""
    rows = [(0, "https://a.org/s", "<a href='/p'>x</a>"), (1, "http://a.org/p/", "<a href='/q'>x</a>"), (2, "https://a.org/p", "<a href='/r'>x</a>")]
    late = [(3, "https://a.org/p", "<a href='/t'>x</a>"), (4, "https://a.org/q", "none"), (5, "https://a.org/r", "none"), (6, "https://a.org/t", "<a href='/u'>x</a>"), (7, "https://a.org/u", "<a href='/p'>x</a>"), (8, "https://a.org/s", "<a href='/u'>x</a>")]
    frame = lambda x: spark.createDataFrame(x, "page_id long, url string, html string")
    seeds = spark.createDataFrame([("https://a.org/s",)], "url string")
    levels = lambda df: {r.url[14:]: r.level for r in df.collect()}
    path = scratch(spark, "crawl")
    assert recrawl.update(frame(rows), seeds, path, n_buckets=4, key="page_id") == 3
    assert recrawl.update(frame(rows + late), seeds, path, key="page_id") == 6
    assert levels(recrawl.reached(spark, path)) == levels(crawl.reach(frame(rows + late), seeds, 4)) == {"s": 1, "p": 2, "u": 2, "q": 3, "r": 3, "t": 3}
    assert recrawl.update(frame(rows + late), seeds, path, key="page_id") == 0
    # Without a key, those of one snapshot count together.
    path = scratch(spark, "crawl")
    assert recrawl.update(frame(rows + late), seeds, path, n_buckets=4) == 6
    assert levels(recrawl.reached(spark, path)) == {"s": 1, "p": 2, "u": 2, "q": 3, "r": 3, "t": 3}
