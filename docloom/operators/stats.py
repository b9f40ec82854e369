"""Agreement of automatic with human scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def agreement(scores: DataFrame, by: list[str], x: str = "auto", y: str = "human") -> DataFrame:
    """Per group: n, pearson, spearman (ranks averaged over ties), mae and mean difference, rounded to 6 places.

    Rows are counted by their pair of scores first, so that windows run over distinct scores and no task holds a group's
    rows. Correlations are null for fewer than two rows and where a side is constant.
    """
    keys = by or ["_all"]
    df = scores if by else scores.withColumn("_all", F.lit(1))
    cells = df.groupBy(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("_c"))
    for side in ("_x", "_y"):
        values = cells.groupBy(*keys, side).agg(F.sum("_c").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(side))
        cells = cells.join(values.select(*keys, side, (upto - (F.col("_n") - 1) / 2).alias(f"_r{side}")), [*keys, side])
    r = lambda c: F.round(c, 6)
    mean = lambda c: F.sum(F.col("_c") * c) / F.sum("_c")

    def correlation(a: str, b: str) -> Column:
        a, b = F.col(a), F.col(b)
        varies = (F.sum("_c") >= 2) & (F.max(a) > F.min(a)) & (F.max(b) > F.min(b))
        spread = lambda c: mean(c * c) - mean(c) * mean(c)
        return F.when(varies, (mean(a * b) - mean(a) * mean(b)) / F.sqrt(spread(a) * spread(b)))

    apart = F.col("_y") - F.col("_x")
    out = cells.groupBy(*keys).agg(F.sum("_c").alias("n"), r(correlation("_x", "_y")).alias("pearson"), r(correlation("_r_x", "_r_y")).alias("spearman"), r(mean(F.abs(apart))).alias("mae"), r(mean(apart)).alias("delta"))
    return out if by else out.drop("_all")


def blind_spots(scores: DataFrame, by: str, *, delta: float = 1.5, floor: float = 0.4, least: int = 3) -> DataFrame:
    """Groups of at least `least` rows whose mean difference is large or whose correlation is low, with the reasons."""
    a = agreement(scores, [by]).filter(F.col("n") >= least)
    far = F.when(F.abs("delta") > delta, F.format_string(f"|Δ|=%.2f>{delta}", F.abs("delta")))
    low = F.when(F.col("pearson") < floor, F.format_string(f"Pearson=%.2f<{floor}", "pearson"))
    return a.select(by, "n", "delta", "pearson", F.concat_ws("; ", far, low).alias("flag")).filter("flag <> ''")


def _numbered(rows: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Adds i, from 0 within each group, in the order of md5 of the id: windows run over 256ths of a group."""
    rows = rows.withColumn("_h", F.md5(F.col(id_col).cast("string"))).withColumn("_p", F.substring("_h", 1, 2))
    sizes = rows.groupBy(*keys, "_p").agg(F.count("*").alias("_m"))
    before = F.sum("_m").over(Window.partitionBy(*keys).orderBy("_p")) - F.col("_m")
    own = F.row_number().over(Window.partitionBy(*keys, "_p").orderBy("_h", id_col))
    return rows.withColumn("_own", own).join(sizes.select(*keys, "_p", before.alias("_before")), [*keys, "_p"]).withColumn("i", F.col("_before") + F.col("_own") - 1).drop("_h", "_p", "_own", "_before")


def bootstrap_mae(scores: DataFrame, by: list[str] | None = None, *, rounds: int = 1000, seed: int = 42, alpha: float = 0.05, x: str = "auto", y: str = "human", id_col: str = "doc_id") -> DataFrame:
    """Percentile interval of the mean absolute error over resampled rows; per group: n, low, high, null for fewer than two rows.

    Each round draws as many rows as a group has, with replacement: draw j of round b takes the row whose number is the
    first 32 bits of md5(seed:b:j) modulo n, so that a run repeats exactly anywhere. Every row makes one draw of each round.
    """
    keys = by or ["_all"]
    df = scores if by else scores.withColumn("_all", F.lit(1))
    rows = _numbered(df.select(*keys, id_col, F.abs(F.col(x) - F.col(y)).alias("e")), keys, id_col)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"))
    draws = rows.select(*keys, F.col("i").alias("j")).join(sizes, keys).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), F.col("j").cast("string"))), 1, 8), 16, 10).cast("long") % F.col("n")
    # never broadcast: rows grow with the input, and the driver would hold them all
    means = draws.withColumn("i", draw).join(rows.select(*keys, "i", "e").hint("merge"), [*keys, "i"]).groupBy(*keys, "b").agg(F.avg("e").alias("m"))
    sorted_means = means.groupBy(*keys).agg(F.sort_array(F.collect_list("m")).alias("ms"))
    at = lambda p: F.when(F.col("n") >= 2, F.round(F.element_at("ms", min(rounds - 1, int(rounds * p)) + 1), 6))
    out = sizes.join(sorted_means, keys).select(*keys, "n", at(alpha / 2).alias("low"), at(1 - alpha / 2).alias("high"))
    return out if by else out.drop("_all")


def section_report(scores: DataFrame, by: str = "section", *, least: int = 3, floor: float = 0.5) -> DataFrame:
    """Per section with enough rows: n, pearson, mae, the interval of its error, and whether the correlation is low."""
    a = agreement(scores, [by]).filter(F.col("n") >= least).select(by, "n", "pearson", "mae")
    interval = bootstrap_mae(scores, [by]).select(by, "low", "high")
    return a.join(interval, by).withColumn("flagged", F.coalesce(F.col("pearson") < floor, F.lit(False)))


def verdict(n: Column, r: Column, error: Column) -> Column:
    return F.when(n < 5, "insufficient").when(r.isNull(), "undefined").when(r < 0.5, "fail").when(error > 2.5, "warn").otherwise("pass")
