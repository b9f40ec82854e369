"""The genetic search does the packing: crossovers reach the bound from random orders, and elites migrate."""

import random

import pandas as pd
from pyspark.sql import functions as F

from docloom.llm import packing

SCHEMA = "doc_id long, piece int, length long, island long, bin string, _n string"


def lengths(n, seed):
    rng = random.Random(seed)
    return [min(4095, int(rng.lognormvariate(5.5, 1.0)) + 1) for _ in range(n)]


def test_crossovers_reach_the_bound():
    p = packing.Packer(lengths(3000, 1), 4096, 5, generations=40)
    start = [p.newcomer() for _ in range(4)]
    assert min(map(len, start)) > p.least
    bins = p.evolve(start)
    assert len(bins) == p.least and p.crossovers > 0
    assert sorted(i for b in bins for i in b) == list(range(3000)) and max(map(p.fill, bins)) <= 4096


def test_elites_are_taken_over():
    run = packing._epoch(4096, 2, 16, 7, 5)
    rows = [pd.DataFrame({"island": k, "doc_id": range(400), "piece": 0, "length": lengths(400, 9), "bin": None, "pattern": None}) for k in (0, 1)]
    out = pd.concat([run(r) for r in rows], ignore_index=True)
    sent = out[out["pattern"].notna()]
    assert set(sent["island"]) == {0, 1} and len(sent) == 32
    mine = [list(p) for p in sent.loc[sent["island"] == 1, "pattern"]]
    p = packing.Packer(lengths(400, 9), 4096, 1)
    made = [sorted(p.lengths[i] for i in b) for b in p.realise(mine)[: len(mine)]]
    assert made == [sorted(x) for x in mine]


def test_rows_keep_their_places(spark):
    """Null and repeated ids, ties, full pieces and clashing names; every row is placed once, whatever is run again."""
    rows = [(None if k % 7 == 0 else k % 50, k % 3, size, 1, "b", "n") for k, size in enumerate([64] * 5 + [1 + (k * 37) % 63 for k in range(400)])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = packing.pack_documents(df.drop("_n"), capacity=64, island_pieces=90)
    assert got.count() == len(rows) and "bin" in got.columns
    first, again = (sorted(map(repr, got.collect())) for _ in range(2))
    assert first == again
    ends = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.countDistinct("offset").alias("k"), F.count("*").alias("m")).collect()
    assert all(r["n"] == r["end"] <= 64 and r["k"] == r["m"] for r in ends)
    whole = packing.Packer([r[2] for r in rows], 64, 1)
    assert len(ends) <= 1.06 * len(whole.best_fit([], whole.decreasing(range(len(rows)))))
