"""Personal data in odd and long texts: places, context, replacement, and work that grows with the matches."""

import time

from pyspark.sql import functions as F

from docloom.llm import pii
from tests.llm import brute

SCHEMA = "doc_id long, text string, pii string, _t string"


def spans(spark, texts):
    docs = spark.createDataFrame([(i, t, "p", "q") for i, t in enumerate(texts)], SCHEMA)
    return [r["pii"] for r in pii.find_pii(docs).orderBy("doc_id").collect()]


def test_context_raises_scores(spark):
    texts = ["call me at +1 377 555 0271", "x +1 377 555 0271", "server 10.0.0.1 up", "v 10.0.0.1 up", "visa 4111 1111 1111 1111", "n 4111111111111111", "mail a@b.org", "a@b.org", "tax 123-45-6789", "abc 123-45-6789"]
    got = [[(s["kind"], s["score"]) for s in r] for r in spans(spark, texts)]
    for near, bare in zip(got[::2], got[1::2], strict=True):
        assert len(near) == 1 and (not bare or bare[0][0] == near[0][0] and bare[0][1] < near[0][1])
    assert got[9] == [] and got[8][0][0] == "ssn"


def test_context_ends_where_it_reaches(spark):
    far = "phone " + "x" * pii.REACH + " +1 377 555 0271"
    assert [r[0]["score"] for r in spans(spark, [far, far[2:], "phone " + "x" * (pii.REACH - 7) + " +1 377 555 0271"])] == [0.6, 0.6, 0.95]


def test_many_matches(spark):
    text = " ".join(f"é{k} user{k}@mail.example.org, +1 377 555 {1000 + k} 4111-1111-1111-1111;" for k in range(700))
    rows = spans(spark, [text, None, "", "none"])
    base = [(s["start"], pii.BASE_KINDS.index(s["kind"]), s["end"], s["kind"]) for s in rows[0] if s["kind"] in pii.BASE_KINDS]
    assert brute._hash(base) == brute.pii(text)[1] and len(base) >= 700 and rows[1:] == [[], [], []]


def test_replacement_of_many(spark):
    docs = spark.createDataFrame([(1, "ä " + " ".join(f"{k} a{k}@b.org" for k in range(1000)) + " end", "p", "q"), (2, "+1 377 555 0271 10.0.0.1 a@+12345678901.com", "p", "q"), (3, None, "p", "q")], SCHEMA)
    got = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert got[1]["text"] == "ä " + " ".join(f"{k} [EMAIL]" for k in range(1000)) + " end"
    assert got[3]["text"] is None and got[1]["pii"] == "p"
    assert pii.redact(docs.limit(0)).count() == 0 == pii.find_pii(docs.limit(0)).count()


def test_overlapping_spans_become_one(spark):
    text = "x 1.2.3.4@b.org +12345678901@c.org y"
    found = spans(spark, [text])[0]
    want, at = "", 0
    for s in found:
        if s["start"] >= at:
            want += text[at : s["start"]] + f"[{s['kind'].upper()}]"
        at = max(at, s["end"])
    docs = spark.createDataFrame([(1, text, "p", "q"), (1, text, "p", "q")], SCHEMA)
    assert [r["text"] for r in pii.redact(docs).collect()] == [want + text[at:]] * 2


def test_work_grows_with_matches(spark):
    def took(n):
        docs = spark.range(1).select(F.lit(1).alias("doc_id"), F.repeat(F.lit("ab@cd.org "), n).alias("text"))
        began = time.time()
        assert docs.transform(pii.redact).select(F.length("text")).first()[0] == 8 * n
        return time.time() - began

    took(500)
    assert took(32_000) < 20 + 16 * took(2_000)
