"""MinHash near-duplicates, verified through odd sketches, with connected components.

Two documents are linked if their sets of distinct five-word shingles have a Jaccard similarity of at least ``share``.

1. Each text gives its set's size and digest, band keys of its MinHash values, and an odd sketch: every MinHash value flips one bit of
   a bitmap, so the bits in which two sketches differ count the values in which the sets differ.
2. Documents with one set are a class; its smallest id stands for it from here on.
3. In each band bucket the smallest id is the center. Pairs of center and member, one a member and bucket, are held
   against the sketches and the size bound; what may reach ``share`` is confirmed on the full sets. Confirmed links are joined to components.
4. Buckets that still hold several components are dealt to cells: a cell is a bucket, or two blocks of a large one, of at most ``block_bytes`` each with
   the sets. Every open pair, one of different components that sizes and sketches let through, belongs to the first bucket that both share.
   First the sketches alone go to the cells, and members without an open pair there leave. Then the others come with their full sets:
   a cell takes their pairs, the most similar first, confirms them on the sets and joins what is linked at once, so pairs that have
   become one component are passed over. Only links that joined something come out: fewer than a cell has members.
5. Those links join components, which are contracted, not found anew.

No pair is left out by a cap, and none comes out of a bucket unconfirmed. The work inside large buckets still grows with their size and the
members outside of the largest component. Only links inside a component that is already joined are
not looked for, as they change nothing. A pair at the threshold shares no band with a probability under
1e-7, and less above it; the sketch bound lies five standard deviations out.

Defined results. Null and empty texts have an empty set, no links, and are their own component; fewer than five words are one shingle. A row
with a null id is linked with nothing: its component is null and it is kept. Rows of one id are one document, linked by what either holds.
Empty tables give empty results. Extra columns are left out by ``near_duplicates`` and kept by ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import by_batch, joined_by, relieved, shingle_hashes, words, written

BANDS, ROWS, SAMPLES, BITS = 30, 3, 384, 4096
CELL = ["key", "kind", "lo", "hi"]
FEATURES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])
#: Ids that are sent to all executors at once, 8 bytes each; beyond it ids are joined by a shuffle.
SENT_IDS = 500_000

FACTORS = np.random.default_rng(11).integers(1, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(own: np.ndarray) -> np.ndarray:
    """MinHash values of a set of hashes; long sets in parts, so memory is bounded."""
    out = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), 1024):
        np.minimum(out, (own[None, i : i + 1024] * FACTORS[:, None]).min(axis=1), out=out)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def odd_sketch(low: np.ndarray) -> bytes:
    """Each value, with its place, flips one bit."""
    spots = mix(low + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(BITS)
    return np.packbits(np.bincount(spots.astype(np.int64), minlength=BITS).astype(np.uint8) & 1).tobytes()


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low[: BANDS * ROWS].reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
    for k in range(ROWS):
        key = mix(key + rows[:, k])
    return key.view(np.int64)


def most_differing(share: float) -> int:
    """The most differing bits of a pair at the threshold, five standard deviations out for the samples and three for the bitmap."""
    p = 1 - share
    flips = 2 * (SAMPLES * p + 5 * np.sqrt(SAMPLES * p * (1 - p)))
    mean = BITS / 2 * (1 - np.exp(-2 * flips / BITS))
    return int(mean + 3 * np.sqrt(flips * flips / BITS / 2 + 1)) + 1


def features(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    def look(parts: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
        for x in parts:
            out = []
            for key, body in zip(x["doc_id"], x["text"], strict=True):
                own = shingle_hashes(words(body))
                if len(own):
                    low = minima(own)
                    out.append((key, len(own), xxhash.xxh3_128_digest(own.tobytes()), band_keys(low), odd_sketch(low)))
                else:
                    out.append((key, 0, None, None, None))
            yield out

    return by_batch(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")), look, FEATURES)


def reachable(n_a, n_b, share: float):
    """Whether sets of these sizes can have the similarity at all."""
    return F.least(n_a, n_b) >= share * F.greatest(n_a, n_b)


def sketched(pairs: DataFrame, own: DataFrame, share: float) -> DataFrame:
    """Distinct pairs (``a``, ``b``), a written table, that sizes and sketches let through. One ``a`` may have any number of pairs."""
    side = lambda k: own.select(F.col("doc_id").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}"))
    centers = pairs.groupBy("a").agg(F.count("*").alias("n_rows")).join(side("a"), "a")

    @F.pandas_udf("int")
    def differing(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="int32")
        both = [np.frombuffer(b"".join(s), np.uint64).reshape(len(s), -1) for s in (x, y)]
        return pd.Series(np.bitwise_count(both[0] ^ both[1]).sum(axis=1, dtype=np.int32))

    near = joined_by(pairs.join(side("b"), "b"), centers, "a", pairs.count()).where(reachable(F.col("n_a"), F.col("n_b"), share))
    return near.where(differing("s_a", "s_b") <= most_differing(share)).select("a", "b").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, share: float, per_group: int = 256) -> DataFrame:
    """Pairs whose full sets reach ``share``.

    A center meets its members in groups of about ``per_group``: its text is given to each group, comes first in it, and members stream past.
    ``pairs`` is a written table. Texts are taken for the ids in it only.
    """
    ids = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    body = of_ids(docs, ids)
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n_rows"))
    groups = sizes.select("a", F.ceil(F.col("n_rows") / per_group).cast("int").alias("groups"), "n_rows")
    dealt = joined_by(pairs, groups, "a", pairs.count()).select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("part"))
    members = dealt.join(body.withColumnRenamed("doc_id", "b"), "b").select("a", "part", "b", "text")
    centers = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part")).join(body.withColumnRenamed("doc_id", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")

    def look(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sets = None, []
        for x in parts:
            out = []
            for a, part, b, center, body in zip(x["a"], x["part"], x["b"], x["center"], x["text"], strict=True):
                own = shingle_hashes(words(body))
                if (a, part) != at:
                    at, sets = (a, part), []
                if center:
                    sets.append(own)
                    continue
                for s in sets:
                    both = np.intersect1d(s, own, assume_unique=True).size
                    if both >= share * (len(s) + len(own) - both):
                        out.append((a, b))
                        break
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    rows = members.unionByName(centers).select("a", "part", F.coalesce("b", F.lit(0)).alias("b"), F.col("b").isNull().alias("center"), "text")
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("center").desc()).mapInPandas(relieved(look), "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) of all nodes in the links (``a``, ``b``).

    Star contraction: in turns, larger neighbours of each node, then smaller ones, are linked to the smallest around it; every
    turn is written to the shared folder. It ends when a turn changes nothing, with each node linked to its component alone.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = written(edges, "edges")
    n, before = edges.count(), None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n_rows"))
        large = joined_by(both, low, "u", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n_rows"))
        small = joined_by(large, least, "u", 2 * n).select(F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("e")).select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct()
        edges = written(small, "edges")
        now = tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if now == before:
            break
        n, before = now[0], now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def still_open(shared: DataFrame, joined: DataFrame, own: DataFrame, block_bytes: int) -> DataFrame:
    """Members of buckets of three or more that hold several components, with the blocks of their bucket. The center is left out: its pairs are done.

    ``shared`` has ``key``, ``doc_id``, ``center``, ``n`` and ``weight``, the bytes of a member with its set. ``major`` members are those of a bucket's largest component.
    """
    placed = shared.where("n > 2 AND doc_id <> center").join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    placed = written(placed.select("key", "doc_id", "weight", F.coalesce("component", "doc_id").alias("component")), "placed")
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    buckets = sizes.groupBy("key").agg(F.max_by("component", F.struct("w", "component")).alias("largest"), F.max("w").alias("w_major"), F.sum("w").alias("w"), F.sum("n").alias("n_rows"), F.count("*").alias("several"))
    blocks = lambda w: F.ceil(w / block_bytes).cast("int")
    several = buckets.where("several > 1").select("key", "largest", "n_rows", blocks(F.col("w_major")).alias("n_major"), blocks(F.col("w") - F.col("w_major")).alias("n_rest"))
    found = joined_by(placed, several, "key", placed.count()).withColumn("major", F.col("component") == F.col("largest"))
    return found.drop("largest", "weight").join(own, "doc_id")


def cells(members: DataFrame) -> DataFrame:
    """Deal the members of each bucket to cells of at most two blocks.

    No pair of two ``major`` members is open. A bucket of one block each is one cell (kind
    2). Else each block of major members meets each block of the rest (kind 0), and the blocks of the rest meet one another (kind 1).
    """
    spot = lambda n: F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col(n)).cast("int")
    cell = lambda kind, lo, hi: F.struct(F.lit(kind).alias("kind"), lo.alias("lo"), hi.alias("hi"))
    each = lambda n, body: F.transform(F.sequence(F.lit(0), F.col(n) - 1), body)
    found = members.withColumn("spot", F.when(F.col("major"), spot("n_major")).otherwise(spot("n_rest")))
    at = F.col("spot")
    meets_rest = each("n_rest", lambda k: cell(0, at, k))
    meets_major = each("n_major", lambda k: cell(0, k, at))
    meets_own = each("n_rest", lambda k: cell(1, F.least(at, k), F.greatest(at, k)))
    one = F.array(cell(2, F.lit(0), F.lit(0)))
    dealt = F.when((F.col("n_major") == 1) & (F.col("n_rest") == 1), one).when(F.col("major"), meets_rest).otherwise(F.concat(meets_major, meets_own))
    return found.withColumn("cell", F.explode(dealt)).select("key", "cell.kind", "cell.lo", "cell.hi", "doc_id", "digest", "component", "major", "spot", "n_shingles", "bands", "sketch")


class Cell:
    """Members of one cell as arrays. ``found`` are those of a member's open pairs that sizes and sketches let through and that no earlier bucket has."""

    def __init__(self, rows: pd.DataFrame, share: float):
        self.rows, self.share, self.bound = rows, share, most_differing(share)
        self.key, self.kind, self.lo, self.hi = (rows[k].iloc[0] for k in CELL)
        self.component, self.n, self.spot, self.major = (rows[k].to_numpy() for k in ("component", "n_shingles", "spot", "major"))
        self.label = self.component.copy()
        self.bits = np.frombuffer(b"".join(rows["sketch"]), np.uint64).reshape(len(rows), -1)
        self.bands = np.concatenate(rows["bands"].to_numpy()).reshape(len(rows), -1)

    def firsts(self) -> np.ndarray:
        """Members whose pairs are asked for; each pair is asked for by one of its two."""
        if self.kind == 0:
            return np.flatnonzero(~self.major)
        return np.flatnonzero(self.spot == self.lo) if self.kind == 1 else np.arange(len(self.n))

    def found(self, i: int) -> np.ndarray:
        """Places, the most similar first."""
        ok = (self.label != self.label[i]) & (np.minimum(self.n, self.n[i]) >= self.share * np.maximum(self.n, self.n[i]))
        if self.kind == 0:
            ok &= self.major
        elif self.kind == 1 and self.lo != self.hi:
            ok &= self.spot == self.hi
        else:
            ok[:i] = False
        here = np.flatnonzero(ok)
        if not len(here):
            return here
        bits = np.bitwise_count(self.bits[here] ^ self.bits[i]).sum(axis=1, dtype=np.int64)
        near = bits <= self.bound
        here, bits = here[near], bits[near]
        both = self.bands[here] == self.bands[i]
        mine = both.any(axis=1) & (self.bands[i][both.argmax(axis=1)] == self.key)
        return here[mine][np.argsort(bits[mine], kind="stable")]

    def active(self) -> pd.DataFrame:
        """The rows that have an open pair here."""
        out = np.zeros(len(self.n), bool)
        for i in self.firsts().tolist():
            here = self.found(i)
            if len(here):
                out[i] = out[here] = True
        return self.rows[out]

    def links(self) -> list[tuple[int, int]]:
        """Components that confirmed pairs join; fewer than the components here. In each turn the most similar pairs of one member are confirmed at once."""
        sets = [np.frombuffer(x, np.uint64) for x in self.rows["hashes"]]
        values, spots = np.unique(np.concatenate(sets), return_inverse=True)
        spots = np.split(spots, np.cumsum([len(x) for x in sets])[:-1])
        mine, out = np.zeros(len(values), bool), []
        for i in self.firsts().tolist():
            here, many = self.found(i), 1
            mine[spots[i]] = True
            while len(here):
                now, here = here[:many], here[many:]
                shared = np.array([np.count_nonzero(mine[spots[j]]) for j in now.tolist()])
                for j in now[shared >= self.share * (self.n[i] + self.n[now] - shared)].tolist():
                    if self.label[j] != self.label[i]:
                        out.append((int(self.component[i]), int(self.component[j])))
                        self.label[self.label == self.label[j]] = self.label[i]
                here, many = here[self.label[here] != self.label[i]], 4 * many
            mine[spots[i]] = False
        return out


def by_cell(parts: Iterator[pd.DataFrame], share: float) -> Iterator[Cell]:
    """Cells of rows that are sorted by them. A cell may go on in the next batch."""
    held: list[pd.DataFrame] = []
    for x in parts:
        if not len(x):
            continue
        own = x[CELL].to_numpy()
        cuts = [0, *(np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1).tolist(), len(x)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if held and tuple(own[i]) != tuple(held[0][CELL].iloc[0]):
                yield Cell(pd.concat(held) if len(held) > 1 else held[0], share)
                held = []
            held.append(x.iloc[i:j])
    if held:
        yield Cell(pd.concat(held) if len(held) > 1 else held[0], share)


def across(members: DataFrame, docs: DataFrame, share: float) -> DataFrame:
    """Links (``a``, ``b``) of components that members of one bucket have."""

    def open_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for cell in by_cell(parts, share):
            held.append(cell.active())
            size += len(held[-1])
            if size > 5000:
                yield pd.concat(held)
                held, size = [], 0
        if held:
            yield pd.concat(held)

    def confirm(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell in by_cell(parts, share):
            if found := cell.links():
                yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    dealt = cells(members)
    active = written(dealt.repartition(*CELL).sortWithinPartitions(*CELL).mapInPandas(relieved(open_rows), dealt.schema), "open")
    with_sets = active.join(hash_sets(docs, written(active.select("doc_id").distinct(), "ids")), ["doc_id", "digest"])
    return written(with_sets.repartition(*CELL).sortWithinPartitions(*CELL).mapInPandas(relieved(confirm), "a bigint, b bigint"), "links")


def hash_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id``, ``digest``, ``hashes`` of the documents whose ids are given."""

    def look(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            own = [shingle_hashes(words(body)) for body in x["text"]]
            yield pd.DataFrame({"doc_id": x["doc_id"], "digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in own], "hashes": [s.tobytes() for s in own]})

    return of_ids(docs, ids).mapInPandas(relieved(look), "doc_id bigint, digest binary, hashes binary").dropDuplicates(["doc_id", "digest"])


def of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of the documents whose ids are given in a written table."""
    body = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    return body.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= SENT_IDS else body.join(ids, "doc_id", "left_semi")


def near_duplicates(docs: DataFrame, share: float = 0.75, id_col: str = "doc_id", text: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` of every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = written(features(docs), "features")
    n_docs = found.count()
    sets = found.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    classes = written(sets.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_rows")), "classes")
    classed = written(joined_by(sets.select("doc_id", "digest", "n_shingles"), classes, "digest", n_docs), "classed")
    first = classes.select("digest", F.col("rep").alias("doc_id"))
    # Rows of one id and text are one.
    own = written(sets.join(first, ["digest", "doc_id"]).select("doc_id", "digest", "n_shingles", "sketch", "bands").dropDuplicates(["doc_id", "digest"]), "own")

    weight = (F.col("n_shingles") * 8 + 1024).alias("weight")
    banded = own.select(F.explode("bands").alias("key"), "doc_id", weight)
    buckets = banded.groupBy("key").agg(F.min("doc_id").alias("center"), F.max("doc_id").alias("last"), F.count("*").alias("n"), F.count("*").alias("n_rows")).where("center <> last").drop("last")
    shared = written(joined_by(banded, written(buckets, "buckets"), "key", BANDS * own.count()), "shared")
    stars = written(shared.where("doc_id <> center").select(F.col("center").alias("a"), F.col("doc_id").alias("b")).distinct(), "stars")
    likely = written(sketched(stars, own, share), "likely")
    # An id whose rows hold different sets belongs to several classes, which it links.
    torn = classed.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("doc_id")
    given = classed.where("rep <> doc_id").join(torn, "doc_id", "left_semi").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    joined = written(components(written(confirmed(likely, docs, share).union(given), "links")), "components")
    again = written(components(across(still_open(shared, joined, own, block_bytes), docs, share)), "components")

    # Class to component, then component to the one that it was joined to.
    nodes = classes.groupBy("rep").agg(F.sum("n_rows").alias("copies")).join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    nodes = written(nodes.select("rep", "copies", F.coalesce("component", "rep").alias("node")), "nodes")
    known = again.join(nodes.groupBy("node").agg(F.count("*").alias("n_rows")), "node")
    final = joined_by(nodes, known, "node", n_docs, "left").select("rep", F.col("copies").alias("n_rows"), F.coalesce("component", "node").alias("component_id"))
    linked = joined_by(classed.select("doc_id", "n_shingles", "rep"), final, "rep", n_docs).drop("rep")
    alone = found.where("doc_id IS NULL OR digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select("doc_id", "n_shingles", "component_id", (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))


def deduplicated(docs: DataFrame, share: float = 0.75, text: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id; columns as they were. Of rows that share an id one stays."""
    found = written(near_duplicates(docs, share, "doc_id", text), "found")
    kept = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"))
    gone = written(found.where("NOT kept").select("doc_id").distinct(), "gone")
    twice = written(kept.where("n > 1").select("doc_id"), "twice")
    left = docs.join(F.broadcast(gone), "doc_id", "left_anti") if gone.count() <= SENT_IDS else docs.join(gone, "doc_id", "left_anti")
    if not twice.limit(1).count():
        return left
    once = left.join(twice, "doc_id", "left_anti")
    return once.unionByName(left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(docs.columns)
