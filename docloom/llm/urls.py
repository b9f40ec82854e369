"""URL filters: host rules first, then empirical-Bayes host reputation.

Labelled page outcomes are summed by host. Rates shrink through beta-binomial priors, each level towards its
parent: host, registered domain, suffix, all pages. The strength of a level's prior is estimated from how its
members differ around their parents, and is never more than the observations that the parent's own rate rests on. A
page passes if a low quantile of its host's posterior reaches a share of the rate of all pages. Only one row of totals
per level reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import batched, join_named, staged

#: Second-level labels under which domains are registered.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): empty for null or without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct<rule, verdict>, else null. Rules: (host, path, 'allow' or 'block')."""
    chain = None
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return chain if chain is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def site_levels(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix). The suffix is the last label, or two where domains are registered under the second."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    long = (n >= 3) & F.get(labels, n - 2).isin(*SECOND_LEVEL) & (F.length(F.get(labels, n - 1)) == 2)
    width = F.when(long, 2).otherwise(1)
    take = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), F.least(k, n)), ".")
    return take(width + 1), take(width)


#: Points of the grid on which a posterior is summed up.
GRID = 4097


def beta_quantile(a: np.ndarray, b: np.ndarray, q: float) -> np.ndarray:
    """The q-quantile of beta distributions, by the trapezoid rule over the log odds, where the density is log-concave."""
    a, b = np.asarray(a, dtype=float)[:, None], np.asarray(b, dtype=float)[:, None]
    mode, sd = np.log(a) - np.log(b), np.sqrt(1 / a + 1 / b)
    t = np.linspace(mode - np.maximum(9 * sd, 25 / a), mode + np.maximum(9 * sd, 25 / b), GRID, axis=1)[:, :, 0]
    log_density = a * t - (a + b) * np.logaddexp(0, t)
    density = np.exp(log_density - log_density.max(axis=1, keepdims=True))
    area = np.concatenate([np.zeros((len(a), 1)), np.cumsum((density[:, 1:] + density[:, :-1]) / 2, axis=1)], axis=1)
    area /= area[:, -1:]
    found = np.array([np.interp(q, row, x) for row, x in zip(area, t, strict=True)])
    return 1 / (1 + np.exp(-found))


def _strength(level: DataFrame, unknown: float) -> float:
    """Prior observations of a level by moments of its members' rates around their parent's; infinite if they differ no more than chance.

    n times a member's squared distance from its parent's rate has mean q (1 + (n - 1) / (s + 1)) (1 - n / N), q
    being the variance of one page and N the parent's pages. A member without siblings says nothing.
    """
    apart = F.col("n") * F.pow(F.try_divide("k", "n") - F.try_divide("pk", "pn"), 2)
    free = F.col("prate") * (1 - F.col("prate")) * (1 - F.try_divide("n", "pn"))
    s = level.filter("n > 0").agg(F.sum(apart).alias("v"), F.sum(free).alias("noise"), F.sum(free * (F.col("n") - 1)).alias("w")).first()
    if not s["w"]:
        return unknown
    share = (s["v"] - s["noise"]) / s["w"]
    return float("inf") if share <= 0 else max(2.0, 1 / share - 1)


def _shrunk(level: DataFrame, strength: float) -> DataFrame:
    """The level with its prior's weight, its rate and how many observations that rests on."""
    level = level.withColumn("weight", F.least(F.lit(strength), F.col("psize")))
    return level.withColumns({"rate": (F.col("k") + F.col("prate") * F.col("weight")) / (F.col("n") + F.col("weight")), "size": F.col("n") + F.col("weight")})


def reputation(pages: DataFrame, *, url_col: str = "url", outcome_col: str = "outcome", quantile: float = 0.05) -> DataFrame:
    """One row per host: pages, n (labelled), k (good outcomes), the posterior's mean and standard deviation, bound,
    its low quantile, and root, the rate of all pages.

    outcome is 1, 0 or null (unlabelled). Hosts without labels take their parent's prior. A
    level on which no member has siblings takes the strength of the level above. Repeated rows count as often as they
    occur; other columns are not read. An empty table gives none.
    """
    host, _ = url_parts(F.col(url_col))
    seen = pages.select(host.alias("host"), F.col(outcome_col).cast("long").alias("y"))
    hosts = staged(seen.groupBy("host").agg(F.count("*").alias("pages"), F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("k")), "hosts")
    domain, suffix = site_levels(F.col("host"))
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    sums = [F.count("*").alias("members"), F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    total = suffixes.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    root = (total["k"] + 1) / (total["n"] + 2)

    def under(level: DataFrame, parents: DataFrame, key: str) -> DataFrame:
        """level with its parents' counts, rate and size."""
        parents = parents.select(key, "members", F.col("n").alias("pn"), F.col("k").alias("pk"), F.col("rate").alias("prate"), F.col("size").alias("psize"))
        return join_named(level, parents, key, "members")

    top = suffixes.withColumns({"pn": F.lit(total["n"]), "pk": F.lit(total["k"]), "prate": F.lit(root), "psize": F.lit(total["n"] + 2.0)})
    s1 = _strength(top, 2.0)
    middle = staged(under(domains, _shrunk(top, s1), "suffix"), "domains")
    s2 = _strength(middle, s1)
    low = staged(under(hosts, _shrunk(middle, s2).drop("suffix"), "domain"), "priors")
    s3 = _strength(low, s2)
    rates = _shrunk(low, s3)
    a = F.greatest(F.col("rate") * F.col("size"), F.lit(1e-3))
    b = F.greatest((1 - F.col("rate")) * F.col("size"), F.lit(1e-3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = beta_quantile(batch.column("a").to_numpy(), batch.column("b").to_numpy(), quantile) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(found, pa.float64())], names=["host", "pages", "n", "k", "mean", "sd", "bound"])

    rows = rates.select("host", "pages", "n", "k", F.col("rate").alias("mean"), F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("size") + 1)).alias("sd"), a.alias("a"), b.alias("b"))
    return batched(rows, run, "host string, pages long, n long, k long, mean double, sd double, bound double").withColumn("root", F.lit(float(root)))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], rates: DataFrame | None = None, *, id_col: str = "page_id", url_col: str = "url", outcome_col: str = "outcome", share: float = 0.92) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, bound.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest decides. Other pages
    pass if the low quantile of their host's posterior, bound, is at least the given share of the rate of all pages. rates is
    what reputation() says of the hosts of these pages; without it, pages has the outcomes. Null urls and urls without
    '://' have empty host and path and share the reputation of the empty host. Repeated rows give repeated results, an
    empty table none; other columns are not read.
    """
    rates = staged(reputation(pages, url_col=url_col, outcome_col=outcome_col) if rates is None else rates, "rates")
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    hit = matching_rule(F.col("host"), F.col("path"), rules)
    rows = join_named(rows.withColumn("hit", hit), rates.select("host", "pages", "bound", "root"), "host", "pages")
    learned = F.when(F.col("bound") >= share * F.col("root"), "allow").otherwise("block")
    return rows.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", learned).alias("verdict"), "bound")
