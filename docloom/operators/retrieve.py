"""Vector search over stored embeddings, and the texts around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import blocks


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def top_k(queries: DataFrame, rows: DataFrame, k: int, *, role: bool = False) -> DataFrame:
    """Per query (query_id, query_vec) the k most similar rows (vec_id, embedding), ties by vec_id: rank and score.

    queries is a stated set, broadcast in blocks of a bounded size. Similarities are ranked as they are and shown to 4
    places; Spark keeps the best k of each task before rows are dealt out. With role, only rows whose label is the query's
    or 0 take part.
    """
    on = (F.col("label") == F.col("query_label")) | (F.col("label") == 0) if role else F.lit(True)
    rows = rows.withColumn("_norm", norm(F.col("embedding")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("similarity"), "vec_id"))
    out = None
    for part in blocks(queries, "query_id"):
        pairs = rows.join(F.broadcast(part.withColumn("_query_norm", norm(F.col("query_vec")))), on)
        scored = pairs.withColumn("similarity", dot(F.col("embedding"), F.col("query_vec")) / F.nullif(F.col("_norm") * F.col("_query_norm"), F.lit(0.0)))
        best = scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "vec_id", F.round("similarity", 4).alias("score"), "rank")
        out = best if out is None else out.unionByName(best)
    return out


def rules_for(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """top_k() within the query's role and the general rules, and over all rules for queries that this leaves without any."""
    found = top_k(queries, rows, k, role=True)
    rest = queries.join(found.select("query_id").distinct(), "query_id", "left_anti")
    return found.unionByName(top_k(rest, rows, k))


def missing_names(required: DataFrame, available: DataFrame, name: str = "name") -> DataFrame:
    """Required names that aren't available, each once, in order."""
    return required.select(name).distinct().join(available.select(name).distinct(), name, "left_anti").orderBy(name)


def query_text(section: Column, issues: Column, score: Column) -> Column:
    """What is asked of the rule store for a section: its name, three issues, and a plea if it scored low."""
    return F.concat_ws(" ", F.replace(section, F.lit("_"), F.lit(" ")), F.array_join(F.slice(issues, 1, 3), " "), F.when(score < 5, "improve this section"))


def rule_text(rule_id: Column, category: Column, role: Column, rule: Column, rationale: Column) -> Column:
    return F.format_string("Rule %s [%s | role=%s]: %s\nRationale: %s", rule_id, category, role, rule, rationale)
