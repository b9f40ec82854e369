"""Quality classifier: naive-Bayes support vectors.

Indicators of hashed n-grams (of characters and of token shapes) are scaled by the log ratio of their smoothed
counts in good and bad documents; a linear hinge-loss model over the scaled indicators is fitted by dual coordinate
descent, mixed with the mean weight, and its margin is turned into a probability on rows it has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import batched, labelled_sample

#: log2 of the number of hashed indicators.
BITS = 18
_MASK = np.uint64((1 << BITS) - 1)
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def indicators(text: str) -> np.ndarray:
    """Sorted distinct indicators of a whole text: character 1- to 3-grams, and shapes of the text as grams of their own."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    grams = []
    h = np.zeros(len(c), dtype=np.uint64)
    for k in range(3):
        if len(c) <= k:
            break
        h = h[: len(c) - k] * _SPREAD[0] + c[k:] * _SPREAD[k]
        grams.append(((h ^ (h >> np.uint64(31))) * _SPREAD[1] >> np.uint64(64 - BITS)) & _MASK)
    words, lines = text.split(), text.split("\n")
    repeat = 1 - len(set(words)) / len(words) if words else 0.0
    pairs = len(words) - 1
    again = 1 - len(set(zip(words, words[1:], strict=False))) / pairs if pairs > 0 else 0.0
    twice = 1 - len(set(lines)) / len(lines)
    shapes = (0, min(12, len(words)), 20, int(np.log2(len(words) + 1)), 40, int(repeat * 10), 60, int(again * 10), 80, int(twice * 10))
    ids = np.array([a * 64 + b for a, b in zip(shapes[::2], shapes[1::2], strict=True)], dtype=np.uint64)
    grams.append((ids * _SPREAD[2]) >> np.uint64(64 - BITS))
    return np.unique(np.concatenate(grams)).astype(np.int64)


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum() / np.sqrt(max(1, len(found))) + self.bias)

    def score(self, texts: list[str]) -> np.ndarray:
        m = np.array([self.margin(indicators(t)) for t in texts], dtype=float)
        return 1 / (1 + np.exp(-np.clip(self.slope * m + self.shift, -30, 30)))


def dual_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear hinge-loss model over scaled, length-normed indicators."""
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    values = [scale[r] / np.sqrt(max(1, len(r))) for r in rows]
    norms = np.array([v @ v + 1.0 for v in values])
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r, v = rows[i], values[i]
            slack = 1 - y[i] * (w[r] @ v + bias)
            new = min(cost[i], max(0.0, alpha[i] + slack / norms[i]))
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w, bias


def fit(docs: DataFrame, labels: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 6_000, most_chars: int = 40_000_000, smooth: float = 1.0, mix: float = 0.5, rounds: int = 20, seed: int = 3) -> QualityModel:
    """Fit on about most_rows labelled documents at most, drawn by id (labelled_sample() says how).

    labels has id_col and label_col; without it, docs has the labels. Of samples with more than most_chars characters
    fewer documents are taken; texts are never cut. Null labels are ignored; texts may be empty or repeated; other columns
    are not read. Without both labels, on empty tables too, every text gets the smoothed share of ones.
    """
    rows = labelled_sample(docs, docs if labels is None else labels, label_col, id_col=id_col, text_col=text_col, most_rows=most_rows, most_chars=most_chars, seed=seed)
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("t")).first()
    n, ones = total["n"], total["t"]
    if ones in (0, n):
        share = (ones + 1) / (n + 2)
        return QualityModel(np.zeros(1 << BITS), 0.0, 1.0, float(np.log(share / (1 - share))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [indicators(t).astype("<i4").tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], names=["x", "y"])

    got = sorted(batched(rows.select("text", "y"), run, "x binary, y int").collect(), key=lambda r: (bytes(r["x"]), r["y"]))
    found = [np.frombuffer(r["x"], dtype="<i4") for r in got]
    y = np.array([1.0 if r["y"] else -1.0 for r in got])
    rng = np.random.default_rng(seed)
    fold = rng.permutation(len(y)) % 4 == 0
    if len(set(y[fold])) < 2 or len(set(y[~fold])) < 2:
        fold = np.zeros(len(y), dtype=bool)
    good, bad = np.full(1 << BITS, smooth), np.full(1 << BITS, smooth)
    for r, v, held in zip(found, y, fold, strict=True):
        if not held:
            (good if v > 0 else bad)[r] += 1
    ratio = np.log(good / good.sum()) - np.log(bad / bad.sum())
    train = np.flatnonzero(~fold)
    balance = np.where(y[train] > 0, 1.0, max(1.0, (y[train] > 0).sum() / max(1, (y[train] < 0).sum())) ** 0.5)
    w, bias = dual_descent([found[i] for i in train], ratio, y[train], balance, rounds, rng)
    w = mix * w + (1 - mix) * np.abs(w).mean()  # towards naive Bayes, whose weights are all alike
    model = QualityModel(w * ratio, bias, 1.0, 0.0)
    held = np.flatnonzero(fold) if fold.any() else train
    model.slope, model.shift = platt(np.array([model.margin(found[i]) for i in held]), y[held] > 0)
    return model


def platt(margin: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins, by Newton steps with a light ridge; the slope is positive."""
    a, b = 1.0, 0.0
    target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = p - target, p * (1 - p) + 1e-9
        ga, gb = g @ margin + 1e-3 * a, g.sum() + 1e-3 * b
        haa, hab, hbb = h @ margin**2 + 1e-3, h @ margin, h.sum() + 1e-3
        det = haa * hbb - hab**2
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
        if abs(da) + abs(db) < 1e-9:
            break
    return max(1e-3, float(a)), float(b)
