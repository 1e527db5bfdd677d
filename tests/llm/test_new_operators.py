"""Filter audit, bit-sliced fingerprints and periodic runs: odd tables, brute force, whole queries."""

import hashlib
import random
import zlib
from itertools import combinations, permutations

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import bit_sliced, interaction_audit, periodic_runs, queries, sql
from sparkloom.session import table

SCHEMA = "doc_id long, text string, lang string, part string, A boolean, digest int, n long, first long, rep int, t int, print string, good int"
BIG = 2**53


def frame(spark, rows):
    return spark.createDataFrame([(k, t, lang, "clash", None, 1, 2, 3, 4, 5, "clash", 6) for k, t, lang in rows], SCHEMA)


def prose(seed, n, vocabulary=300):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [
    (1, prose(1, 260), "en"), (2, prose(1, 260), "en"), (2, prose(1, 260), "en"), (3, None, None), (4, "", "de"), (5, " \t\n", ""), (6, "one two", "en"), (7, "ONE $two", "en"), (None, prose(1, 260), "en"),
    (None, None, None), (8, prose(8, 30_000), "fr"), (9, "a b " * 300, "en"), (BIG, prose(2, 240), "fr"), (BIG + 1, prose(2, 239) + " new", "fr"), (10, "x" * 20_000, "de"), (11, "é😀 " * 210, "de"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD).repartition(3).cache()


# ---- 11 filter audit


def brute_failures(rows):
    out = []
    for k, t, _ in rows:
        t = t or ""
        ws = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        copied = k is not None and any(o is not None and o < k and (u or "") == t for o, u, _ in rows)
        out.append("".join(f for f, bad in zip("ABCDE", (len(ws) < 200, 100 * len(set(ws)) < 50 * len(ws), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), copied), strict=True) if bad))
    return out


def brute_report(rows, labels):
    fails = brute_failures(rows)
    out, shapley = {}, {}
    for part in {p or "" for _, _, p in rows}:
        own = [(k, f) for (k, _, p), f in zip(rows, fails, strict=True) if (p or "") == part]
        for order in permutations("ABCDE"):
            left = own
            for i, f in enumerate(order):
                gone = [k for k, bad in left if f in bad]
                left = [x for x in left if f not in x[1]]
                failing = sum(f in bad for _, bad in own)
                lost = [sum(any(y == k and k is not None and v[c] == 1 for y, *v in labels) for k in gone) for c in (0, 1)]
                out[part, "".join(order), i + 1] = [len(left), len(gone), failing - len(gone), sum(bad == f for _, bad in own), *lost]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(docs, labels):
    rows = interaction_audit.labelled(interaction_audit.failures(docs), labels, {"good": "quality = 1", "toxic": "toxic = 1"})
    found = interaction_audit.report(interaction_audit.subset_counts(rows)).collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found}


def test_audit_of_odd_rows(spark, odd):
    labels = [(1, 1, 0), (2, 1, 1), (2, None, 0), (None, 1, 1), (7, 0, 1), (BIG, 1, None), (BIG + 1, 0, 1), (77, 1, 1)]
    given_ = spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, quality int, toxic int, good int")
    assert audited(odd, given_) == brute_report(ODD, labels)
    empty = frame(spark, [])
    assert audited(empty, given_) == {}
    assert audited(odd, given_.limit(0)) == brute_report(ODD, [])


def test_audit_of_random_bits(spark):
    rng = random.Random(5)
    rows = [(rng.choice("xyz"), *(rng.random() < p for p in (0.3, 0.5, 0.1, 0.4)), rng.random() < 0.5) for _ in range(30_000)]
    flags = spark.createDataFrame(rows, "part string, p boolean, q boolean, r boolean, s boolean, y boolean").repartition(5)
    counts = interaction_audit.subset_counts(flags, ("p", "q", "r", "s"), ("y",))
    for r in counts.collect():
        own = [x for x in rows if x[0] == r.part and not any(x[1 + f] for f in range(4) if r.subset >> f & 1)]
        assert (r.n, r.n_y) == (len(own), sum(x[5] for x in own))
    assert counts.count() == 3 * 16
    assert interaction_audit.report(counts, ("p", "q", "r", "s"), ("y",)).count() == 3 * 24 * 4


def test_audit_equals_sql(spark, sf_dir):
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = queries.op11_bitmap_audit(spark, sf_dir)
    assert got.columns == names and dict(got.dtypes)["part"] == "string" and dict(got.dtypes)["step"] == "int" and dict(got.dtypes)["shapley"] == "bigint"
    with duckdb.connect() as db:
        for name in ("documents", "labels"):
            db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
        assert sorted(tuple(r) for r in got.collect()) == sorted(db.sql(sql.BITMAP_AUDIT).select(*names).fetchall())


# ---- 12 bit-sliced fingerprints


def brute_fingerprint(text):
    ws = "".join(" " if c in "\t\n\x0b\x0c\r" else c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ")
    ws = [w for w in ws if w]
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [" ".join(ws)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(pairs, radius=3):
    """Smallest id reachable, of (id, fingerprint); an id may come several times."""
    low = {k: k for k, _ in pairs}

    def top(k):
        while low[k] != k:
            k = low[k]
        return k

    for (a, x), (b, y) in combinations(pairs, 2):
        if (x ^ y).bit_count() <= radius:
            a, b = sorted((top(a), top(b)))
            low[b] = a
    return {k: top(k) for k in low}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "b", "é", "ﬁ", " ", "\n", "\x0b", "\x1c", "\xa0", "word"]), max_size=40))
def test_fingerprint(parts):
    text = "".join(parts)
    assert bit_sliced.fingerprint(text) & (2**64 - 1) == brute_fingerprint(text)


def clustered(rng, n):
    """Fingerprints near few centers, with chains that leave the radius."""
    out = []
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 30)):
            out.append(x)
            for _ in range(rng.randrange(0, 5)):
                x ^= 1 << rng.randrange(64)
    return out[:n]


@pytest.mark.parametrize("seed", range(6))
def test_cells_join_what_is_within(seed):
    rng = random.Random(seed)
    values = np.array(sorted(set(clustered(rng, [3, 65, 300, 700, 1500, 2500][seed]))), np.uint64)
    for radius in (3, 1, 5):
        label = bit_sliced.joined(values, list(range(64)), radius, 256)
        want = brute_components(list(enumerate(values.tolist())), radius)
        groups = {}
        for i, k in enumerate(label.tolist()):
            groups.setdefault(k, []).append(i)
        assert {min(g): g for g in groups.values()} == {k: [i for i in want if want[i] == k] for k in set(want.values())}


def test_a_dense_cell():
    rng = np.random.default_rng(3)
    center = np.uint64(0x0123456789ABCDEF)
    values = np.unique(center ^ (np.uint64(1) << rng.integers(0, 64, 6000, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 6000, np.uint64)))
    assert len(set(bit_sliced.joined(values, list(range(64))).tolist())) == 1


def test_links_by_keys(spark):
    """Every split of keys and cells finds what holding all pairs against one another finds."""
    rng = random.Random(9)
    values = list(dict.fromkeys([0, *clustered(rng, 900)]))
    signed = [int(np.array([v], np.uint64).view(np.int64)[0]) for v in values]
    classes = spark.createDataFrame([(v, k, 1) for k, v in enumerate(signed)], "print long, rep long, n_rows long").repartition(4)
    want = brute_components(list(enumerate(values)))
    for cell in (8192, 12):
        low = {r.node: r.component for r in bit_sliced.components(bit_sliced.links(classes, cell=cell)).collect()}
        assert {k: low.get(k, k) for k in want} == want


def test_bit_sliced_odd_rows(spark, odd):
    got = bit_sliced.near_duplicates(odd).collect()
    want = brute_components([(k, brute_fingerprint(t)) for k, t, _ in ODD if k is not None])
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == sorted(((k, f"{brute_fingerprint(t):016x}", want.get(k)) for k, t, _ in ODD), key=repr)
    assert bit_sliced.near_duplicates(frame(spark, [])).count() == 0


def test_rows_of_one_id_link_their_texts(spark):
    rows = [(5, prose(11, 90), "en"), (9, prose(11, 90), "en"), (9, prose(12, 90), "en"), (7, prose(12, 90), "en")]
    assert {(r.doc_id, r.component_id) for r in bit_sliced.near_duplicates(frame(spark, rows)).collect()} == {(5, 5), (9, 5), (7, 5)}


def test_op12_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in table(spark, sf_dir, "documents").collect()]
    want = brute_components(rows)
    got = queries.op12_bit_sliced(spark, sf_dir)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(tuple(r) for r in got.collect()) == sorted((k, f"{f:016x}", want[k]) for k, f in rows)


# ---- 13 periodic runs


def brute_runs(ws):
    """Every start and period, the longest stretch; smallest periods only, nothing that could go on."""
    out, n = {}, len(ws)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ws[j] == ws[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((a, m, q) for (a, m), q in out.items())


@settings(max_examples=600, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcd"), min_size=1, max_size=5), st.integers(1, 9)), max_size=8))
def test_runs_equal_brute_force(parts):
    ws = [w for p, n in parts for w in p * n]
    assert periodic_runs.runs(ws) == sorted(brute_runs(ws), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60))
def test_runs_of_two_words(ws):
    assert periodic_runs.runs(ws) == sorted(brute_runs(ws), key=lambda r: (r[0], r[2]))


def test_stretches_lose_no_run():
    rng = random.Random(2)
    for _ in range(300):
        ws = [rng.choice("abcdefgh") for _ in range(rng.randrange(200))]
        for _ in range(rng.randrange(4)):
            at, q = rng.randrange(len(ws) + 1), rng.randrange(1, 9)
            ws[at:at] = [rng.choice("abcdefgh") for _ in range(q)] * rng.randrange(3, 7)
        codes = np.array([ord(w) - 97 for w in ws], np.int64)
        for turns in (1, 32):
            held = periodic_runs.stretches(codes, turns) if len(ws) else []
            assert all(any(a <= s and s + m <= b for a, b in held) for s, m, _ in brute_runs(ws))
        assert periodic_runs.runs(ws) == sorted(brute_runs(ws), key=lambda r: (r[0], r[2]))


def brute_row(key, text, change=True):
    ws = "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ")
    ws = [w for w in ws if w]
    n, h = len(ws), zlib.crc32(str(key).encode())
    if change and key is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
    found = sorted(brute_runs(ws), key=lambda r: (r[0], r[2]))
    dropped = {i for a, m, q in found for i in range(a + q, a + m)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return key, len(found), *shown, digest("".join(f"{a},{m},{q}\n" for a, m, q in found)), digest(" ".join(w for i, w in enumerate(ws) if i not in dropped))


def test_runs_of_odd_rows(spark, odd):
    rows = [x for x in ODD if x[0] != 8]
    assert sorted((tuple(r) for r in periodic_runs.scan(odd).where("doc_id IS NULL OR doc_id <> 8").collect()), key=repr) == sorted((brute_row(k, t, False) for k, t, _ in rows), key=repr)
    assert periodic_runs.scan(frame(spark, [])).count() == 0
    cut = {r.doc_id: r.text for r in periodic_runs.deduplicated(odd).collect()}
    assert cut[9] == "a b" and cut[5] == " \t\n" and cut[3] is None


def test_long_runs_are_not_quadratic():
    one = ["x"] * 40_000
    assert periodic_runs.runs(one) == [(0, 40_000, 1)]
    many = [f"w{i}" for i in range(9_000)] * 4
    assert periodic_runs.runs(many) == [(0, 36_000, 9_000)]


def test_op13_equals_brute_force(spark, sf_dir):
    docs = [r for r in table(spark, sf_dir, "documents").collect() if len(r.text or "") < 12_000]
    want = {r.doc_id: brute_row(r.doc_id, r.text) for r in docs}
    got = {r.doc_id: tuple(r) for r in queries.op13_periodic_runs(spark, sf_dir).collect()}
    assert {k: got[k] for k in want} == want and sum(r[1] > 0 for r in want.values()) > 5
