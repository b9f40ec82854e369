"""The learners against slow exact versions, and models on odd tables."""

import numpy as np
import pytest

from docloom.llm import quality_model, toxicity
from docloom.llm.common import labelled_sample


def test_isotonic_is_the_max_of_min_means():
    rng = np.random.default_rng(1)
    for _ in range(20):
        score, y = rng.integers(0, 12, 40).astype(float), rng.integers(0, 2, 40).astype(float)
        xs, vs = toxicity.isotonic(score, y, smooth=0.0)
        levels = np.unique(score)
        mean = lambda a, b: y[(score >= levels[a]) & (score <= levels[b])].mean()  # noqa: B023, E731
        for i, s in enumerate(levels):
            want = max(min(mean(a, b) for b in range(i, len(levels))) for a in range(i + 1))
            assert abs(np.interp(s, xs, vs) - want) < 1e-9


def test_first_split_is_the_best_one():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 8, (120, 3)).astype(float), rng.integers(0, 2, 120).astype(float)
    y[x[:, 1] > 4] = 1.0
    t = toxicity.Trees(rounds=1, depth=1, rate=1.0).fit(x, y)
    p = 1 / (1 + np.exp(-t.start))
    g, h = y - p, np.full(120, p * (1 - p))
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + t.ridge)
    gains = {(k, c): score(x[:, k] < c) + score(x[:, k] >= c) - score(slice(None)) for k in range(3) for c in range(1, 8) if min((x[:, k] < c).sum(), (x[:, k] >= c).sum()) >= t.least}
    k, c = max(gains, key=gains.get)
    left = x[:, k] < c
    want = np.where(left, g[left].sum() / (h[left].sum() + t.ridge), g[~left].sum() / (h[~left].sum() + t.ridge))
    assert np.allclose(t.margins(x), t.start + want)


def test_boosting_lowers_the_loss():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    loss = [np.logaddexp(0, -(2 * y - 1) * toxicity.Trees(rounds=r).fit(x, y).margins(x)).mean() for r in (1, 10, 60)]
    assert loss[0] > loss[1] > loss[2] < 0.2


def test_dual_descent_meets_the_dual_bound():
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(60)]
    scale, y, cost = rng.normal(size=30), np.where(rng.random(60) < 0.5, 1.0, -1.0), np.full(60, 0.7)
    w, b = quality_model.dual_descent(rows, scale, y, cost, 3000, rng)
    x = np.zeros((60, 31))
    for i, r in enumerate(rows):
        x[i, r] = scale[r] / np.sqrt(len(r))
        x[i, 30] = 1.0
    v = np.r_[w, b]
    primal = v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    # an independent projected gradient ascent of the dual gives a lower bound
    q, a = (y[:, None] * x) @ (y[:, None] * x).T, np.zeros(60)
    step = 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(20000):
        a = np.clip(a + step * (1 - q @ a), 0, cost)
    assert 0 <= primal - (a.sum() - a @ q @ a / 2) < 1e-3


SCHEMA = "doc_id long, text string, score double, y int, toxic int, quality int"


def test_sample_of_labels(spark):
    docs = spark.createDataFrame([(k % 90, f"text {k % 90}", 0.0, 9, None, None) for k in range(100)] + [(None, "none", 0.0, 9, None, None), (500, None, 0.0, 9, None, None)], SCHEMA)
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(3, 0), (3, 0), (4, 1), (None, 1), (500, None), (7, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in labelled_sample(docs, labels, "toxic", most_rows=1000, seed=1).collect()}
    assert set(got) == set(range(90)) and all(r["text"] == f"text {d}" for d, r in got.items())
    assert got[3]["y"] == 0 and got[4]["y"] == 1 and got[5]["y"] == 1
    few = labelled_sample(docs, labels, "toxic", most_rows=40, seed=1).count()
    assert 2 <= few <= 40 and labelled_sample(docs, labels, "toxic", most_rows=1000, most_chars=300, seed=1).count() < 60
    assert labelled_sample(docs, labels.limit(0), "toxic", most_rows=9, seed=1).count() == 0 == labelled_sample(docs.limit(0), labels, "toxic", most_rows=9, seed=1).count()


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality_model, "quality")])
def test_models_on_odd_tables(spark, module, label):
    rows = [(k, ("you idiot zorg " if k % 3 == 0 else "a calm garden ") * (1 + k % 7), 1.0, 5, int(k % 3 == 0), int(k % 3 != 0)) for k in range(150)]
    rows += [(900, None, None, None, 1, 0), (901, "", 0.0, 0, 0, 1), (902, "long " * 120_000, 0.0, 0, 0, 1), *rows[:5], (None, "null id", 0.0, 0, 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for n, table in ((len(rows), docs), (0, docs.limit(0))):
        model = module.fit(docs.select("doc_id", "text", "score", "y"), table.select("doc_id", label))
        got = toxicity.score(docs, model).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got), n
    assert toxicity.score(docs.limit(0), model).count() == 0
