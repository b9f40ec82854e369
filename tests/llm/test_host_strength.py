"""Bad hosts among hosts of uneven page counts."""

import random

from docloom.llm import urls


def test_bad_host_among_one_page_hosts(spark):
    rng = random.Random(7)
    pages = []
    sizes = [30000, *(rng.randint(100, 400) for _ in range(40)), *(rng.randint(1, 2) for _ in range(4000))]
    for h, n in enumerate(sizes):
        pages += [(f"h{h}", int(rng.random() < (0.05 if h % 10 == 3 else 0.95))) for _ in range(n)]
    for form in ("http://{}.com/", "http://{}.site.com/"):
        rows = spark.createDataFrame([(form.format(h), y) for h, y in pages], "url string, outcome int")
        got = {r["host"].split(".")[0]: r["mean"] - 1.645 * r["sd"] for r in urls.reputation(rows).collect()}
        assert all((got[f"h{h}"] < 0.3) == (h % 10 == 3) for h in range(41)), form
