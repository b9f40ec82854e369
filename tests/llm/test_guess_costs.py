"""Guess costs against every segmentation of short values, and what they decide."""

import math
import random
from itertools import combinations

import pytest

from docloom.llm import registry, secrets

SCHEMA = "doc_id long, text string, spans string, bits double"


@pytest.fixture(scope="module")
def ranks():
    return secrets.word_ranks(registry.vocabulary())


def piece(s, ranks, mixed):
    """The cheapest single segment that a string is."""
    bits = lambda x: sum(math.log2(10) if c.isdigit() else math.log2(26) if c.isascii() and c.isalpha() else math.log2(33) for c in x)
    low, n = s.lower(), len(s)
    costs = [bits(s) + mixed * 0.8 * sum(c.isalpha() for c in s)]
    if n >= 3:
        case = 0.0 if s.islower() else 1.0 if s[0].isupper() and s[1:].islower() else 3.0
        costs += [math.log2(ranks[f]) + more + case for f, more in ((low, 0.0), (low.translate(secrets._LEET), 2.0)) if f in ranks]
        costs += [bits(s[:w]) + math.log2(n // w) for w in range(1, n // 2 + 1) if n % w == 0 and s[:w] * (n // w) == s and w <= secrets.UNIT]
        row = lambda c: next((r for r, keys in enumerate(secrets.ROWS) if c in keys), None)
        if all((a, b) in secrets._neighbours() for a, b in zip(low, low[1:])):
            costs.append(math.log2(47) + math.log2(n) + 2.0 * (1 + sum(row(a) != row(b) for a, b in zip(low[1:], low[2:]))))
    if secrets._DATE.fullmatch(s):
        costs.append(secrets.DATE_BITS if n > 4 else math.log2(130))
    return min(costs)


def test_every_segmentation(ranks):
    rng = random.Random(9)
    parts = ["pass", "P4s", "1999", "0228", "aa", "xy", "qwe", "sd", "Z", "!", "k", "7", "the", "zaq"]
    for _ in range(120):
        value = "".join(rng.choice(parts) for _ in range(4))[:9]
        n, mixed = len(value), float(any(c.isupper() for c in value) and any(c.islower() for c in value))
        every = (sorted(c) for k in range(n) for c in combinations(range(1, n), k))
        best = min(sum(piece(value[a:b], ranks, mixed) for a, b in zip([0, *c], [*c, n])) + secrets.SEGMENT_BITS * len(c) for c in every)
        assert math.isclose(secrets.guess_bits(value, ranks), best, abs_tol=1e-6), value


def test_letters_alone_and_covered_values(ranks):
    kinds = lambda t: [(s[3], t[s[0] : s[2]]) for s in secrets.find_secrets(t, ranks)]
    assert kinds("pwd: qWkZpXvLmRtYbNcDxw") == [("guess", "qWkZpXvLmRtYbNcDxw")]
    assert kinds("password is Xk#vLq!TzWm@Rp") == [("guess", "Xk#vLq!TzWm@Rp")]
    assert kinds("password is correcthorse") == [] == kinds("pass protection") == kinds("secret garden")
    assert [k for k, _ in kinds("password=abcdefghijkl9$Zq!x7%K")] == ["assign", "guess"]
    assert [k for k, _ in kinds("password=abcdefghijkl9")] == ["assign"]
    spans, values = secrets.costed("token: passwordpassword pwd=aaaaaaaaaaaa key", ranks)
    assert [s[3] for s in spans] == ["assign"] and len(values) == 2 and all(bits < secrets.WEAK_BITS for *_, bits in values)


def test_many_and_odd_rows(spark, ranks):
    texts = [None, "", "token: " + "k9" * 50_000, " ".join(f"pwd:x{k}Zq{k}w#Lk" for k in range(3000)), "plain"]
    docs = spark.createDataFrame([(i % 4, t, "s", 1.0) for i, t in enumerate([*texts, *texts])], SCHEMA)
    got = secrets.scan_secrets(docs, words_path=registry.vocabulary()).collect()
    assert len(got) == 10 and sorted(len(r["values"]) for r in got) == [0] * 6 + [1, 1, 3000, 3000]
    assert secrets.scan_secrets(docs.limit(0)).count() == 0


def test_units_of_any_length_and_every_end(ranks, monkeypatch):
    """Against every repeat and walk, of whatever length and unit; long ones are found as well."""
    monkeypatch.setattr(secrets, "UNIT", math.inf)
    cost = lambda v: secrets.guess_bits(v, ranks, math.inf)
    rng = random.Random(4)

    def slow(value):
        n, low, best = len(value), value.lower(), [0.0] + [math.inf] * len(value)
        mixed = float(any(c.isupper() for c in value) and any(c.islower() for c in value))
        for j in range(1, n + 1):
            best[j] = min(best[i] + piece(value[i:j], ranks, mixed) + (secrets.SEGMENT_BITS if i else 0.0) for i in range(j))
        return best[n]

    for _ in range(60):
        unit = "".join(rng.choice("aZ7$k#9wq") for _ in range(rng.randint(1, 14)))
        value = (rng.choice(["", "x", "pass"]) + unit * rng.randint(2, 4) + rng.choice(["", unit[:3], "apple", "qwe"]) + rng.choice(["", "asasasasdf", "ababab"]))[:60]
        assert math.isclose(cost(value), slow(value), abs_tol=1e-6), value
    unit = "".join(rng.choice("abcdefghijkXYZ0189$") for _ in range(300))
    assert cost(unit * 40) < cost(unit) + 50
    tail = "a" * 300 + "pple"
    assert math.isclose(cost(tail), slow(tail[-20:]) + math.log2(299 / 15), abs_tol=1e-6)
    assert secrets.costed(f"token={unit * 4}", ranks)[1][0][2] < cost(unit) + 50
