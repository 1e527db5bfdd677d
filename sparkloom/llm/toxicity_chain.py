"""Toxicity by a classifier chain of linear models.

Categories are predicted in order; the model of a category sees the words and the probabilities of the categories before
it. For training those probabilities are out-of-fold: neither a document's own label nor that of an equal text has shaped what the next model sees of it.
Features are the distinct words of a text (long ones are taken apart, ``word_features``), their beginnings of 4 to 6 characters, and the texture of the text (shares of upper case, symbols and
line ends, in steps). Each fit selects its features by their association with the label on its own rows.

A category's threshold is the highest at which its out-of-fold probabilities reach the recall asked for, within ``BOUNDS``: unlabelled oddities
don't drag it down to where clean texts lie, and easy categories don't push it up.

The fit runs on at most ``sample`` labelled rows (a documented bound, drawn by the hash of the id); scoring covers all
documents and whole texts.

Defined results. Null and empty texts have texture features alone. Without labels, or with one class only, a category's probability
is its base rate (0 without labels), so nothing is rejected for want of labels, and its threshold is the upper bound. Labels that are null are left out, those of unknown ids match nothing; an id of
several labels is in a category if any of them is, and of several texts of an id the least one is fitted on. Repeated documents get equal scores. Empty tables
give empty results. ``score`` leaves extra columns out, ``cleaned`` keeps them.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import by_batch, give_back, relieved

EDGES = ".,;:!?\"'()[]{}*#$%&|<>-_/\\~`+=@^"
SYMBOLS, UPPER = b"#*$%&|<>!", bytes(range(65, 91))
#: Words up to this length are one; longer ones are taken apart, and not kept.
LONG = 40
#: What share of a category's labelled texts its threshold is to find, and the least and highest threshold.
RECALL, BOUNDS = 0.93, (0.1, 0.5)
SPLIT = re.compile(f"[{re.escape(EDGES)}]+")


def word_features(word: str) -> list[str]:
    """A word ("w", word) and its beginnings ("^", beginning); a bare symbol has none.

    Words of more than ``LONG`` characters are taken apart at ``EDGES``; a part that is still longer gives the beginnings at each of its characters.
    """
    word = word.strip(EDGES)
    if not word:
        return []
    if len(word) > LONG:
        if SPLIT.search(word):
            return [f for part in sorted(set(SPLIT.split(word))) for f in word_features(part)]
        return [f"^{x}" for x in sorted({word[i : i + k] for k in (4, 5, 6) for i in range(len(word) - k + 1)})]
    return [f"w{word}"] + [f"^{word[:k]}" for k in (4, 5, 6) if len(word) >= k]


def texture(text: str) -> list[str]:
    """Steps of the shares of some characters ("=", name and step)."""
    n = max(1, len(text))
    raw = text.encode("utf-8", "surrogatepass")
    less = lambda drop: len(raw) - len(raw.translate(None, drop))
    counts = (("upper", less(UPPER)), ("marks", less(SYMBOLS)), ("lines", 10 * text.count("\n")), ("spaces", text.count(" ")))
    return [f"={k}{int(20 * v / n + 0.5)}" for k, v in counts]


def hashed(features: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(f) for f in features], np.uint64)


@dataclass
class Linear:
    """One category's model: selected features by hash, their weights, weights of earlier categories, bias."""

    keys: np.ndarray
    weights: np.ndarray
    chain: np.ndarray
    bias: float


@dataclass
class Chain:
    """Models in chain order. ``weights`` has the weights of each selected feature, one a category."""

    names: tuple[str, ...]
    models: list[Linear] = field(default_factory=list)
    weights: dict[str, tuple[float, ...]] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)

    def name_features(self, texts: list[str | None]) -> None:
        """Fill ``weights``: what the selected features of the texts it was fitted on are."""
        found: dict[int, list[float]] = {}
        for c, m in enumerate(self.models):
            for k, w in zip(m.keys.tolist(), m.weights.tolist(), strict=True):
                found.setdefault(k, [0.0] * len(self.models))[c] = w
        for i in range(0, len(texts), 1000):
            part = [x or "" for x in texts[i : i + 1000]]
            named = {f for x in part for f in texture(x)}
            named.update(f for w in set().union(*(x.lower().split() for x in part)) for f in word_features(w))
            for f in sorted(named):
                if f not in self.weights and (own := found.get(xxhash.xxh3_64_intdigest(f))):
                    self.weights[f] = tuple(own)

    def finish(self, sums: np.ndarray) -> np.ndarray:
        """Probabilities from the sums of feature weights, category by category."""
        out = np.zeros_like(sums)
        for c, m in enumerate(self.models):
            out[:, c] = logistic(sums[:, c] + m.bias + out[:, :c] @ m.chain)
        return out


def threshold_for(p: np.ndarray, y: np.ndarray, recall: float) -> float:
    """The highest threshold that finds ``recall`` of the labelled ones, within ``BOUNDS``; the upper bound without any."""
    own = p[y > 0]
    return float(np.clip(np.quantile(own, 1 - recall, method="lower"), *BOUNDS)) if 0 < len(own) < len(p) else BOUNDS[1]


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def member(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each value is among the sorted keys."""
    at = np.searchsorted(keys, x)
    return (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == x) if len(keys) else np.zeros(len(x), bool)


class Rows:
    """Distinct features of each training text: places into ``keys``, row after row. Features of fewer than ``least`` texts are left out."""

    def __init__(self, texts: list[str | None], least: int = 3):
        parts = []
        known: dict[str, np.ndarray] = {}
        for text in texts:
            text = text or ""
            own = [hashed(texture(text))]
            for w in set(text.lower().split()):
                if (f := known.get(w)) is None:
                    f = hashed(word_features(w))
                    if len(known) < 50_000 and len(w) <= LONG:
                        known[w] = f
                own.append(f)
            parts.append(np.unique(np.concatenate(own)))
        del known
        self.n = len(parts)
        # By ranges of the hash, so that no second copy of all features is made.
        found, bounds = [], [np.uint64(k << 61) for k in range(1, 8)]
        slices = [np.split(p, np.searchsorted(p, bounds)) for p in parts]
        for r in range(8):
            every = np.sort(np.concatenate([s[r] for s in slices])) if slices else np.empty(0, np.uint64)
            # Sorted, a feature of ``least`` texts equals the one ``least - 1`` places on.
            every = every[: max(0, len(every) - least + 1)][every[least - 1 :] == every[: max(0, len(every) - least + 1)]]
            found.append(every[np.concatenate([[True], every[1:] != every[:-1]])] if len(every) else every)
        self.keys = np.concatenate(found)
        del slices, every
        at = []
        for k, p in enumerate(parts):
            at.append(np.searchsorted(self.keys, p[member(p, self.keys)]).astype(np.int32))
            parts[k] = None
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(f) for f in at])
        self.at = np.concatenate(at) if at else np.empty(0, np.int32)

    def selected(self, y: np.ndarray, use: np.ndarray, most: int, least: int) -> np.ndarray:
        """Features most associated with the label (chi-square) on the rows in use."""
        here = use[self.row]
        rows, at = self.row[here], self.at[here]
        df = np.bincount(at, minlength=len(self.keys)).astype(float)
        pos = np.bincount(at, weights=y[rows], minlength=len(self.keys))
        n, p = use.sum(), y[use].sum()
        expected = df * p / n
        score = np.where(df >= least, (pos - expected) ** 2 / np.maximum(expected, 1e-9) + (pos - expected) ** 2 / np.maximum(df - expected, 1e-9), 0)
        best = np.argsort(-score, kind="stable")[:most]
        return best[score[best] > 3.0]


def fit_linear(rows: Rows, y: np.ndarray, use: np.ndarray, before: np.ndarray, most: int, least: int, l2: float = 0.05, steps: int = 150) -> tuple[Linear, np.ndarray]:
    """Logistic regression on the rows in use by Adam on the whole batch; also the probabilities of all rows."""
    n_chain = before.shape[1]
    p = float(y[use].mean()) if use.any() else 0.0
    flat = Linear(np.empty(0, np.uint64), np.empty(0), np.zeros(n_chain), float(np.log(max(p, 1e-9) / max(1 - p, 1e-9))))
    if not 0 < p < 1:
        return flat, np.full(rows.n, p)
    picked = rows.selected(y, use, most, least)
    column = np.full(len(rows.keys), -1, np.int32)
    column[picked] = np.arange(len(picked), dtype=np.int32)
    col = column[rows.at]
    row, col = rows.row[col >= 0].astype(np.intp), col[col >= 0].astype(np.intp)
    n_w = len(picked)
    theta = np.zeros(n_w + n_chain + 1)
    theta[-1] = flat.bias
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    fitted = use[row]
    frow, fcol = row[fitted], col[fitted]

    def scores(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.bincount(r, weights=theta[c], minlength=rows.n) + before @ theta[n_w:-1] + theta[-1]

    scale = 1 / use.sum()
    for t in range(1, steps + 1):
        error = np.where(use, logistic(scores(frow, fcol)) - y, 0.0) * scale
        grad = np.concatenate([np.bincount(fcol, weights=error[frow], minlength=n_w), error @ before, [error.sum()]])
        grad[:-1] += l2 * scale * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-12)
    return Linear(rows.keys[picked], theta[:n_w].copy(), theta[n_w:-1].copy(), float(theta[-1])), logistic(scores(row, col))


def fit_chain(texts: list[str | None], labels: dict[str, np.ndarray], folds: int = 3, most: int = 3000, least: int = 3, recall: float = RECALL) -> Chain:
    """Fit the chain; ``labels`` has one 0/1 array a category, in chain order. Copies of a text are in one fold, so none tells another's label."""
    rows, chain = Rows(texts), Chain(tuple(labels))
    fold = np.array([xxhash.xxh3_64_intdigest((x or "").encode("utf-8", "surrogatepass")) % folds for x in texts], np.int64)
    before = np.zeros((rows.n, 0))
    every = np.ones(rows.n, bool)
    for name, y in labels.items():
        y = y.astype(float)
        chain.models.append(fit_linear(rows, y, every, before, most, least)[0])
        out, known = np.zeros(rows.n), np.zeros(rows.n, bool)
        for f in range(folds):
            held = fold == f
            if held.any() and not held.all():
                out[held] = fit_linear(rows, y, ~held, before, most, least)[1][held]
                known |= held
        chain.thresholds[name] = threshold_for(out[known], y[known], recall)
        before = np.column_stack([before, out])
    chain.name_features(texts)
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text: str = "text", sample: int = 8_000) -> Chain:
    """Fit on at most ``sample`` labelled rows. ``categories``: conditions on the columns of ``labels``, in chain order."""
    names = list(categories)
    known = labels.select(F.col(id_col).alias("label_id"), *[c.cast("int").alias(f"y{i}") for i, c in enumerate(categories.values())]).dropna()
    # One label an id and one text an id: an id is in a category if any of its rows is, and its text is the least one.
    drawn = known.groupBy("label_id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(names))]).orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("label_id"), F.col(text).alias("text")).join(F.broadcast(drawn), "label_id")
    rows = rows.groupBy("label_id").agg(F.min("text").alias("text"), *[F.max(f"y{i}").alias(f"y{i}") for i in range(len(names))])
    # At most ``sample`` rows: they fit one task, whose model alone comes to the driver.

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = pd.concat([x for x in parts if len(x)] or [pd.DataFrame(columns=["label_id", "text", *[f"y{i}" for i in range(len(names))]])])
        found = found.sort_values(["label_id", "text"], kind="stable")
        chain = fit_chain(found["text"].tolist(), {k: found[f"y{i}"].to_numpy(float) for i, k in enumerate(names)})
        yield pd.DataFrame({"model": [pickle.dumps(chain)], "n": [len(found)]})

    made = rows.coalesce(1).mapInPandas(relieved(fit), "model binary, n long").collect()
    return pickle.loads(made[0].model) if made else fit_chain([], {k: np.empty(0) for k in names})


class Scorer:
    """Weights of the selected features by plain word and beginning; a word's first four characters tell most words without any."""

    def __init__(self, chain: Chain):
        self.chain, self.weights = chain, chain.weights
        self.whole = {f[1:]: f for f in self.weights if f[0] == "w"}
        self.begin = {f[1:]: f for f in self.weights if f[0] == "^"}
        self.starts = {x[:4] for x in (*self.whole, *self.begin)}

    def features(self, text: str) -> set[str]:
        """Those of the text that have weights."""
        own = {f for f in texture(text) if f in self.weights}
        starts, whole, begin = self.starts, self.whole, self.begin
        for w in {w.strip(EDGES) for w in set(text.lower().split())}:
            if len(w) > LONG:
                own.update(f for f in word_features(w) if f in self.weights)
            elif w[:4] in starts:
                if w in whole:
                    own.add(whole[w])
                for k in (4, 5, 6):
                    if len(w) >= k and w[:k] in begin:
                        own.add(begin[w[:k]])
        return own

    def probabilities(self, texts) -> np.ndarray:
        sums = np.zeros((len(texts), len(self.chain.names)))
        for i, text in enumerate(texts):
            if own := sorted(self.features(text or "")):
                sums[i] = np.array([self.weights[f] for f in own]).sum(axis=0)
        return self.chain.finish(sums)


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One probability a category, for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{x}" for x in chain.names]

    def look(parts: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
        scorer = Scorer(sent.value)
        for x in parts:
            yield [(key, *p) for key, p in zip(x["doc_id"], scorer.probabilities(x["text"]).tolist(), strict=True)]

    schema = pa.schema([("doc_id", pa.int64()), *((x, pa.float64()) for x in names)])
    return by_batch(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")), look, schema)


def cleaned(docs: DataFrame, chain: Chain, category: str = "toxic", threshold: float | None = None, text: str = "text") -> DataFrame:
    """The documents below the threshold, the chain's own if none is given; columns as they were."""
    threshold = chain.thresholds.get(category, BOUNDS[1]) if threshold is None else threshold
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    place = chain.names.index(category)

    @F.pandas_udf("boolean")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(sent.value)
        for x in parts:
            yield pd.Series(scorer.probabilities(x.tolist())[:, place] < threshold)
        give_back()

    return docs.where(clean(F.col(text)))
