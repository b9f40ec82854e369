"""Seeds reach every passage that the operator promises, at any number of blocks; odd tables."""

from itertools import combinations

import pytest

from docloom.llm import decontamination as dc


def hit(pattern, masks):
    ones = [[i for i, c in enumerate(m) if c == "1"] for m in masks]
    return any(all(pattern[s + i] for i in mask) for mask in ones for s in range(len(pattern) - mask[-1]))


@pytest.mark.parametrize("n", range(5, 13))
def test_short_items_by_enumeration(n):
    item = [f"w{i}" for i in range(n)]
    index = dc.SeedIndex([(1, " ".join(item))], 0.8, 13)
    for wrong in range(int(0.2 * n + 1e-9) + 1):
        for places in combinations(range(n), wrong):
            said = " ".join("no" if i in places else w for i, w in enumerate(item))
            whole = not {0, n - 1} & set(places)
            assert bool(index.find(f"a b {said} c d")) == whole, (n, places)


def test_long_passages_by_enumeration():
    for n in (13, 14, 15, 16):
        for wrong in range(int(0.2 * n + 1e-9) + 1):
            for places in combinations(range(1, n - 1), wrong):
                assert hit([i not in places for i in range(n)], dc.MASKS), (n, places)


def test_blocks_give_the_same(spark):
    words = [f"t{i}" for i in range(400)]
    items = [(k, " ".join(words[13 * k : 13 * k + 20])) for k in range(25)] + [(None, " ".join(words[5:30])), (99, None)]
    bench = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, doc_id string")
    texts = [" ".join(words[a : a + 15]) for a in range(0, 380, 17)] + [None, "", "none of it " * 30, " ".join(words[::2])]
    docs = spark.createDataFrame([(i % 9, t, "s", 2) for i, t in enumerate([*texts, *texts[:3]])], "doc_id long, text string, item_id string, start int")
    found = [sorted(map(repr, dc.find_overlaps(docs, bench, block_chars=c).collect())) for c in (10**6, 300)]
    kept = [sorted(map(repr, dc.decontaminate(docs, bench, block_chars=c).collect())) for c in (10**6, 300)]
    assert found[0] == found[1] and kept[0] == kept[1] and found[0]
    assert dc.seed_indexes(bench, block_chars=300)[0] > 5
    assert dc.decontaminate(docs, bench, block_chars=300).columns == docs.columns
    long = spark.createDataFrame([(1, "zz " * 300_000 + " ".join(words[20:40]))], "doc_id long, text string")
    assert {r["item_id"] for r in dc.find_overlaps(long, bench).collect()} >= {1, 2}
