"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features are densities of lexicons, nearness of lexicon words to the second person, capitals, punctuation and
obfuscation rates. Besides a fixed lexicon there are learned ones, of words and of word beginnings that are much
more frequent in documents labelled toxic. Lexicons are counted and trees fitted on a bounded sample of the training
documents; the calibration uses a part of it that the trees don't see.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import batched, labelled_sample, text_of

#: Insults, and words of the second person.
INSULTS = frozenset("idiot idiots moron morons stupid trash garbage scum loser losers pathetic worthless disgusting clown clowns dumb fool imbecile jerk freak filthy vermin shut hate kill die ugly cretin connard abruti salaud merde dummkopf arschloch trottel blöd idiota imbécil estúpido basura asqueroso".split())
SECOND = frozenset("you your yours u ur tu te toi vous votre vos du dich dir ihr euch dein deine tú usted ustedes vosotros os".split())
_LEET = str.maketrans("430157@$!", "aeoistasi")
_WORD = re.compile(r"[^\W_]+")
_HIDDEN = re.compile(r"[^\W\d_]+[0-9@$!*]+[^\W\d_]+")
#: Letters of a word's beginning that a learned lexicon of beginnings keeps.
STEM = 5

NAMES = ("insults", "insults_log", "learned", "learned_log", "stems", "stems_log", "best_weight", "near_second", "second", "capitals", "shouted", "exclaims", "questions", "punctuation", "hidden", "symbols", "words_log", "mean_length", "digits", "repeats")


def features(text: str, words_of: dict[str, float], stems_of: dict[str, float]) -> list[float]:
    """The dense features of a whole text, in the order of NAMES."""
    low = text.lower()
    words = _WORD.findall(low)
    n, size = max(1, len(words)), max(1, len(text))
    insult = learned = stems = near = second = 0
    best, last_second, last_bad = 0.0, -100, -100
    get, stem = words_of.get, stems_of.get
    for i, w in enumerate(words):
        bad = w in INSULTS
        insult += bad
        x = get(w)
        if x is not None:
            learned += 1
            best = max(best, x)
            bad = True
        x = stem(w[:STEM])
        if x is not None:
            stems += 1
            best = max(best, x)
        if w in SECOND:
            second += 1
            last_second = i
            near += i - last_bad <= 8
        if bad:
            last_bad = i
            near += i - last_second <= 8
    hidden = 0
    if any(c in text for c in "@$!*"):
        hidden = sum(m.translate(_LEET) in INSULTS for m in _HIDDEN.findall(low))
    upper = sum(map(str.isupper, text)) if text != low else 0
    count = text.count
    return [insult / n, np.log1p(insult), learned / n, np.log1p(learned), stems / n, np.log1p(stems), best, near / n, second / n, upper / size, float(upper * 2 > size), count("!") / n, count("?") / n, (count(".") + count(",")) / n, float(hidden), sum(map(count, "#$%&*")) / n, np.log1p(len(words)), size / n, float(any(c in text for c in "0123456789")), 1 - len(set(words)) / n if words else 0.0]


@dataclass
class Trees:
    """Boosted regression trees of logistic loss on binned features."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.15
    bins: int = 32
    ridge: float = 1.0
    least: int = 5
    cuts: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    start: float = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.cuts)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, self.bins)[1:-1])) if len(c) else np.empty(0) for c in x.T]
        z, n, f = self._binned(x), len(y), x.shape[1]
        rate = (y.sum() + 0.5) / (n + 1)
        self.start = float(np.log(rate / (1 - rate)))
        margin = np.full(n, self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, dtype=np.int64)
            total = 2 ** (self.depth + 1) - 1
            where, cut, value = np.full(total, -1), np.zeros(total, dtype=np.int64), np.zeros(total)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                best = np.full(width, 1e-6)
                local = node - first
                active = (local >= 0) & (local < width)
                for k in range(f):
                    key = local[active] * self.bins + z[active, k]
                    gs, hs, ns = (np.bincount(key, v, width * self.bins).reshape(width, self.bins).cumsum(1) for v in (g[active], h[active], np.ones(active.sum())))
                    gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(ns < self.least) | (nt - ns < self.least)] = 0
                    at = gain.argmax(1)
                    for m in np.flatnonzero(gain[np.arange(width), at] > best):
                        best[m] = gain[m, at[m]]
                        where[first + m], cut[first + m] = k, at[m]
                split = active & (where[node] >= 0)
                right = z[np.arange(n), np.maximum(where[node], 0)] > cut[node]
                node = np.where(split, 2 * node + 1 + right, node)
            sums, weights = np.bincount(node, g, total), np.bincount(node, h, total)
            value = self.rate * sums / (weights + self.ridge)
            margin += value[node]
            self.trees.append((where, cut, value))
        return self

    def margins(self, x: np.ndarray) -> np.ndarray:
        z, out, rows = self._binned(x), np.full(len(x), self.start), np.arange(len(x))
        for where, cut, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                split = where[node] >= 0
                right = z[rows, np.maximum(where[node], 0)] > cut[node]
                node = np.where(split, 2 * node + 1 + right, node)
            out += value[node]
        return out


def isotonic(score: np.ndarray, y: np.ndarray, smooth: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: knots and non-decreasing values, each block's share of ones slightly smoothed."""
    levels, at = np.unique(score, return_inverse=True)
    blocks: list[list[float]] = []
    for s, ones, n in zip(levels.tolist(), np.bincount(at, y).tolist(), np.bincount(at).tolist(), strict=True):
        blocks.append([ones, float(n), s, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            a = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a[0], blocks[-1][1] + a[1], blocks[-1][2], a[3]]
    xs, vs = [], []
    for ones, n, low, high in blocks:
        share = (ones + smooth * float(y.mean())) / (n + smooth)
        xs += [low, high] if high > low else [low]
        vs += [share, share] if high > low else [share]
    return np.array(xs), np.maximum.accumulate(np.array(vs))


@dataclass
class ToxicityModel:
    words: dict[str, float]
    stems: dict[str, float]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]
    prior: float

    def score(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.prior)
        x = np.array([features(t, self.words, self.stems) for t in texts], dtype=float).reshape(len(texts), len(NAMES))
        margin = self.trees.margins(x)
        # a trace of the margin keeps the order within a calibrated step
        return np.clip(np.interp(margin, *self.knots) * 0.998 + 0.002 / (1 + np.exp(-margin)), 0, 1)


def _lexicon(rows: DataFrame, key: Column, totals: tuple[int, int], size: int, least_docs: int, least_odds: float) -> dict[str, float]:
    """Keys whose smoothed log odds of a toxic document are high: a bounded list from counts over the sample."""
    n0, n1 = totals
    counted = rows.select("y", F.explode(F.array_distinct(key)).alias("k")).groupBy("k").agg(F.sum("y").alias("t"), F.count("*").alias("n")).filter(F.col("n") >= least_docs)
    odds = F.log((F.col("t") + 0.5) / (n1 + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (n0 + 1))
    return {r["k"]: float(r["o"]) for r in counted.withColumn("o", odds).filter(F.col("o") >= least_odds).orderBy(F.desc("o"), "k").limit(size).collect()}


def fit(docs: DataFrame, labels: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = 20_000, lexicon_size: int = 2_000, least_docs: int = 6, seed: int = 5) -> ToxicityModel:
    """Fit on about most_rows labelled documents at most, drawn by id (labelled_sample() says how).

    labels has id_col and label_col; without it, docs has the labels. Rows with a null label are ignored, texts may be
    empty, very long or repeated, and other columns are not read. Without both labels, on empty tables too, the model
    gives every text the smoothed share of ones. Ties between splits go to the first feature and the lowest cut.
    """
    rows = labelled_sample(docs, docs if labels is None else labels, label_col, id_col=id_col, text_col=text_col, most_rows=most_rows, seed=seed)
    count = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("t")).first()
    n, ones = count["n"], count["t"]
    prior = (ones + 1) / (n + 2)
    if ones in (0, n):
        return ToxicityModel({}, {}, None, (np.zeros(1), np.full(1, prior)), prior)
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    totals = (n - ones, ones)
    learned = _lexicon(rows, words, totals, lexicon_size, least_docs, 3.0)
    stems = _lexicon(rows, F.transform(F.filter(words, lambda w: F.length(w) >= STEM), lambda w: F.substring(w, 1, STEM)), totals, lexicon_size, 2 * least_docs, 3.0)
    empty = ToxicityModel(learned, stems, None, (np.zeros(1), np.zeros(1)), prior)
    shared = rows.sparkSession.sparkContext.broadcast(empty)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = [features(t, m.words, m.stems) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    got = batched(rows.select("text", "y"), run, "x array<double>, y int").toPandas()
    got = got.iloc[np.lexsort(np.c_[np.array(got["x"].tolist()), got["y"]].T)]  # in whatever order tasks end
    x, y = np.array(got["x"].tolist(), dtype=float), got["y"].to_numpy(float)
    fold = np.random.default_rng(seed).permutation(len(y)) % 4 == 0
    if len(set(y[fold])) < 2 or len(set(y[~fold])) < 2:
        fold = np.ones(len(y), dtype=bool)
        trees = Trees().fit(x, y)
    else:
        trees = Trees().fit(x[~fold], y[~fold])
    return ToxicityModel(learned, stems, trees, isotonic(trees.margins(x[fold]), y[fold]), prior)


def score(docs: DataFrame, model, *, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score >= limit) for every document; null texts count as empty.

    Repeated rows give repeated results, and an empty table gives none; null ids stay null. Whole texts are read, however
    long; other columns are not, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    scored = batched(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= limit).cast("int"))
