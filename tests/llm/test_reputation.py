"""Host reputation against closed forms and a loop over hosts; rules and posterior verdicts together."""

import numpy as np

from docloom.llm import registry, urls

PAGES = [("http://a.good.com/x", 1)] * 60 + [("http://b.good.com/x", 1)] * 40 + [("http://c.good.com/x", 0)] * 2 + [("http://d.bad.net/x", 0)] * 50 + [("http://e.bad.net/x", 1)] * 9 + [("http://f.bad.co.uk/x", None)] * 3 + [(None, 1), ("plain", 0)]


def test_beta_quantile_has_closed_forms():
    for q in (0.05, 0.5, 0.9):
        for a in (0.3, 1.0, 7.5, 400.0, 1e6):
            assert abs(urls.beta_quantile([a], [1.0], q)[0] - q ** (1 / a)) < 5e-5
            assert abs(urls.beta_quantile([1.0], [a], q)[0] - (1 - (1 - q) ** (1 / a))) < 5e-5
    # P(X <= x) of beta(a, b) with whole a and b is a binomial tail
    from math import comb

    for a, b in ((3, 9), (20, 5), (80, 60)):
        x = urls.beta_quantile([a], [b], 0.05)[0]
        n = a + b - 1
        assert abs(sum(comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(a, n + 1)) - 0.05) < 1e-4


def brute(pages):
    """host: (mean, size) by plain loops over the four levels."""
    hosts = {}
    for url, y in pages:
        host = url.split("://", 1)[1].split("/")[0].lower() if url and "://" in url else ""
        n, k = hosts.get(host, (0, 0))
        hosts[host] = (n + (y is not None), k + (y or 0))
    domain = {h: ".".join(h.split(".")[-3 if h.endswith("co.uk") else -2 :]) for h in hosts}
    suffix = {d: ".".join(d.split(".")[1:]) or d for d in domain.values()}

    def up(level, parent):
        out = {}
        for name, (n, k) in level.items():
            a, b = out.get(parent[name], (0, 0))
            out[parent[name]] = (a + n, b + k)
        return out

    domains = up(hosts, domain)
    suffixes = up(domains, suffix)
    total = up(suffixes, dict.fromkeys(suffixes, ""))[""]
    over = {"": (*total, (total[1] + 1) / (total[0] + 2), total[0] + 2.0)}
    strength = 2.0
    for level, parent in ((suffixes, dict.fromkeys(suffixes, "")), (domains, suffix), (hosts, domain)):
        v = noise = w = 0.0
        for name, (n, k) in level.items():
            pn, pk, rate, _ = over[parent[name]]
            if n:
                free = rate * (1 - rate) * (1 - n / pn)
                v, noise, w = v + n * (k / n - pk / pn) ** 2, noise + free, w + free * (n - 1)
        if w:
            strength = np.inf if v <= noise else max(2.0, w / (v - noise) - 1)
        now = {}
        for name, (n, k) in level.items():
            rate, size = over[parent[name]][2:]
            weight = min(strength, size)
            now[name] = (n, k, (k + rate * weight) / (n + weight), n + weight)
        over = now
    return {h: x[2:] for h, x in over.items()}


def test_rates_equal_loops(spark):
    df = spark.createDataFrame([(u, y, "x") for u, y in PAGES], "url string, outcome int, host string")
    got = {r["host"]: r for r in urls.reputation(df).collect()}
    want = brute(PAGES)
    assert got.keys() == want.keys()
    for h, (mean, size) in want.items():
        assert abs(got[h]["mean"] - mean) < 1e-9
        assert abs(got[h]["bound"] - urls.beta_quantile([max(1e-3, mean * size)], [max(1e-3, (1 - mean) * size)], 0.05)[0]) < 1e-9


def test_bad_hosts_are_blocked(spark):
    rows = [(i, u, y, "z", 1.0) for i, (u, y) in enumerate([*PAGES, *PAGES[-5:]])]
    df = spark.createDataFrame(rows, "page_id long, url string, outcome int, rule string, bound double")
    got = urls.judge(df, [("e.bad.net", "/x", "allow")]).collect()
    verdict = {}
    for r in got:
        verdict.setdefault(r["host"], set()).add(r["verdict"])
    assert len(got) == len(rows) and verdict["a.good.com"] == verdict["b.good.com"] == verdict["e.bad.net"] == {"allow"}
    assert verdict["d.bad.net"] == verdict[""] == {"block"}


def test_outcomes_come_from_labels(spark, tmp_path):
    spark.createDataFrame([(1, "http://a.com/en/5?q"), (2, "http://a.com/en/5.html"), (3, "http://b.com/de/6/"), (4, "http://b.com/de/x"), (5, None), (6, "http://c.com/en/7")], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(5, 1, 0), (6, 1, 1), (7, 1, 0), (7, 0, 0), (8, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = sorted((str(r["url"]), r["outcome"]) for r in registry.labelled_pages(spark, str(tmp_path)).collect())
    assert got == [("None", None), ("http://a.com/en/5.html", 1), ("http://a.com/en/5?q", 1), ("http://b.com/de/6/", 0), ("http://b.com/de/x", None), ("http://c.com/en/7", 1)]
