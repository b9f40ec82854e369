"""Spans and guess costs of long values."""

import math
import random

from docloom.llm import registry, secrets


def slow_bits(value, ranks):
    """The dynamic program with every brute-force span, repeat and walk."""
    n, low = len(value), value.lower()
    plain, near = low.translate(secrets._LEET), secrets._neighbours()
    best = [0.0] + [math.inf] * n
    mixed = 1.0 if any(c.isupper() for c in value) and any(c.islower() for c in value) else 0.0
    bits = lambda s: sum(map(secrets._symbol_bits, s))
    for i in range(n):
        steps = [(j, bits(value[i:j]) + mixed * 0.8 * sum(c.isalpha() for c in value[i:j])) for j in range(i + 1, n + 1)]
        for j in range(i + 3, min(n, i + 24) + 1):
            for form, more in ((low, 0.0), (plain, 2.0)):
                if form[i:j] in ranks:
                    steps.append((j, math.log2(ranks[form[i:j]]) + more + (0.0 if value[i:j].islower() else 1.0 if value[i].isupper() and value[i + 1 : j].islower() else 3.0)))
        if m := secrets._DATE.match(value, i):
            steps.append((m.end(), secrets.DATE_BITS if len(m[0]) > 4 else math.log2(130)))
        for width in range(1, min(8, (n - i) // 2) + 1):
            times = 1
            while value.startswith(value[i : i + width], i + times * width):
                times += 1
                if times * width >= 3:
                    steps.append((i + times * width, bits(value[i : i + width]) + math.log2(times)))
        turns, k = 1, i + 1
        while k < n and (low[k - 1], low[k]) in near:
            turns += k > i + 1 and secrets.ROWS_AT.get(low[k]) != secrets.ROWS_AT.get(low[k - 1])
            k += 1
            if k - i >= 3:
                steps.append((k, math.log2(47) + math.log2(k - i) + 2.0 * turns))
        for j, cost in steps:
            best[j] = min(best[j], best[i] + cost + (secrets.SEGMENT_BITS if i else 0.0))
    return best[n]


def test_guess_cost_of_whole_values():
    ranks, rng = secrets.word_ranks(registry.vocabulary()), random.Random(5)
    parts = ["password", "P4ss", "1999-02-28", "aaaa", "xyxyxy", "qwerty", "asdfgh", "Zq9", "!", "k", "7", "zaq1", "abcabc"]
    for _ in range(150):
        value = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        assert math.isclose(secrets.guess_bits(value, ranks), slow_bits(value, ranks), abs_tol=1e-6), value
    assert secrets.guess_bits("x" * 20000, ranks) < 25


def test_long_values_are_whole():
    ranks, rng = secrets.word_ranks(registry.vocabulary()), random.Random(6)
    value = "eyJ" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJK") for _ in range(300)) + "0Zq9" * 3
    assert [s[:1] + s[2:4] for s in secrets.find_secrets(f"bearer {value} end", ranks)] == [(7, 7 + len(value), "guess")]
    short, whole = (secrets.find_secrets(f"token={v}", ranks)[0][4] for v in (value[:200], value))
    assert whole > short + 100
