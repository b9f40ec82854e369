"""Near-duplicates of rows under null and repeated ids."""

import random

from docloom.llm import simhash


def test_null_ids_link_nothing(spark):
    rng = random.Random(3)
    words = lambda n=60: " ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(99)) for _ in range(n))
    long, other = words(400), words(400)
    rows = [(7, long), (9, other), (None, long + " x"), (None, other + " y"), (None, words()), (None, words()), (5, words()), (5, words()), (5, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    at = [got[i, f"{simhash.fingerprint(t):016x}"] for i, t in rows]
    assert at == [5, 9, 5, 9, None, None, 5, 5, 5]
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in simhash.drop_near_duplicates(docs).collect())
    assert kept == sorted((i or 0, t) for i, t in [rows[8], rows[1], *rows[4:8]])
