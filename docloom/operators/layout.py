"""Reading order of page spans: columns, lines, text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reading_order(spans: DataFrame, *, gap_share: float = 0.15, right_share: float = 0.45, y_tol: float = 2.0) -> DataFrame:
    """One row per doc_id and page_no: n_columns, n_spans, n_lines and the text in reading order.

    A page has two columns if the widest gap between distinct rounded left edges is at least gap_share of the width
    and its right edge lies at right_share or beyond. A line takes the spans whose top is within y_tol of its first.
    Spans: doc_id, page_no, width, x0, y0, x1, text; blank ones are left out.
    """
    kept = spans.filter(F.trim("text") != "")
    page = kept.groupBy("doc_id", "page_no").agg(F.max("width").alias("width"), F.array_sort(F.collect_set(F.bround("x0"))).alias("xs"), F.sort_array(F.collect_list(F.struct("y0", "x0", "x1", "text"))).alias("spans"))
    gaps = F.transform(F.slice("xs", 2, 1_000_000), lambda x, i: F.struct((x - F.get("xs", i)).alias("gap"), (-i).alias("first"), x.alias("right"), ((x + F.get("xs", i)) / 2).alias("mid")))
    page = page.withColumn("g", F.array_max(gaps))
    two = F.coalesce((F.col("g.gap") >= gap_share * F.col("width")) & (F.col("g.right") >= right_share * F.col("width")), F.lit(False))
    page = page.withColumn("n_columns", F.when(two, 2).otherwise(1))
    zero = F.struct(F.lit(-1e18).alias("y"), F.lit(0).alias("n"), F.array().cast("array<struct<line:int,x:double,text:string>>").alias("out"))

    def step(a, s):
        fresh = F.abs(s["y0"] - a["y"]) > y_tol
        n = F.when(fresh, a["n"] + 1).otherwise(a["n"])
        return F.struct(F.when(fresh, s["y0"]).otherwise(a["y"]).alias("y"), n.alias("n"), F.array_append(a["out"], F.struct(n.alias("line"), s["x0"].alias("x"), s["text"].alias("text"))).alias("out"))

    side = lambda right: F.filter("spans", lambda s: (F.col("n_columns") == 1) & F.lit(not right) | (F.col("n_columns") == 2) & (((s["x0"] + s["x1"]) / 2 >= F.col("g.mid")) == F.lit(right)))
    page = page.withColumns({"l": F.aggregate(side(False), zero, step), "r": F.aggregate(side(True), zero, step)})
    text = lambda c: F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.col(f"{c}.n"), F.lit(1))), lambda k: F.array_join(F.transform(F.sort_array(F.filter(f"{c}.out", lambda s: s["line"] == k)), lambda s: F.trim(F.regexp_replace(s["text"], r"\s+", " "))), " ")), "\n")
    body = F.concat_ws("\n", F.nullif(text("l"), F.lit("")), F.nullif(text("r"), F.lit("")))
    return page.select("doc_id", "page_no", F.col("n_columns").cast("long").alias("n_columns"), F.size("spans").cast("long").alias("n_spans"), (F.col("l.n") + F.col("r.n")).cast("long").alias("n_lines"), body.alias("text"))
