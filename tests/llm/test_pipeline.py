"""The whole pipeline against plain loops over a small corpus: who stays, what is replaced, and how it is packed."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from docloom.llm import decontamination, quality_rules, registry, tokens
from tests.llm import brute
from tests.llm.test_near_copies import brute_components

WORDS = [f"{a}{b}" for a in "ba ko li mu ne po ra si tu ve".split() for b in "ba ko li mu ne po ra si tu ve".split()]
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def corpus():
    rng = random.Random(21)
    prose = lambda n: " ".join(rng.choice([*WORDS, "the", "of", "and"]) for _ in range(n))
    items = [(k, prose(25)) for k in range(4)]
    texts = [prose(rng.choice([15, 60, 150, 400])) for _ in range(40)]
    for k in range(0, 20, 3):
        words = texts[k].split()
        words[len(words) // 2] = "changed"
        texts += [texts[k], " ".join(words)]
    texts += [f"{prose(30)} {item} {prose(30)}" for _, item in items[:3]]
    texts += [f"{prose(20)} write to user{k}@mail.example.org {prose(20)}" for k in range(3)]
    texts += [None, "", "short", "#$% &| <> " * 20, "same words here again now " * 12, prose(9000)]
    rng.shuffle(texts)
    return [(k if k % 11 else None, t, "en", "src", len(t or "")) for k, t in enumerate(texts)], items


def good(text):
    """The threshold table over measures by plain Python."""
    base = brute.quality(text)
    words, lines = (text or "").split(), [x for x in (text or "").split("\n") if x.strip()]
    m = base | {"n_lines": len(lines), "n_capitals": sum(c.isupper() for c in text or ""), "n_pipes": (text or "").count("|"), "n_stop_words": sum(w.lower() in quality_rules.STOP_WORDS for w in words)}
    inside = all(m["n_words"] < least or ((low is None or m[top] >= low * m[bottom]) and (high is None or m[top] <= high * m[bottom])) for _, top, bottom, low, high, least in quality_rules.THRESHOLDS)
    return not base["base_failed"] and inside


def wanted(docs, items):
    left = [d for d in docs if good(d[1])]
    # null ids come last in a component
    order = sorted(range(len(left)), key=lambda i: (left[i][0] is None, left[i][0] or 0))
    names = brute_components([left[i][1] for i in order])
    left = [left[order[k]] for k in range(len(order)) if names[k] == k]
    left = [d for d in left if not any(brute.overlaps(d[1], item, decontamination.tokens) for _, item in items)]
    return [(d[0], EMAIL.sub("[EMAIL]", d[1])) for d in left]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    docs, items = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), docs, items


def test_pipeline_equals_loops(spark, folder):
    path, docs, items = folder
    want = wanted(docs, items)
    assert 30 < len(want) < len(docs) - 15
    enc = tokens.WordEncoder(registry.vocabulary())
    pieces = []
    for doc, text in want:
        ids = np.array([*enc.whole(text), 1], dtype="<u4")
        pieces += [(doc, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    rows = corpus_pipeline.run(spark, path).collect()
    assert sorted(map(repr, pieces)) == sorted(repr((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in rows)
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert len(at) <= -(-sum(at.values()) // 4096) + 1 and max(at.values()) <= 4096


def test_stages_keep_columns(spark, folder):
    path = folder[0]
    docs = registry.documents(spark, path)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns
        assert stage(spark, docs.limit(0), path).count() == 0
