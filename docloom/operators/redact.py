"""Reversible replacement of personal data by numbered placeholders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import lexicon as lx


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Replaces text and adds pii, array<struct<key,value>> in order of replacement. Kinds go one after another."""
    df = docs.withColumn("pii", F.array().cast("array<struct<key:string,value:string>>")).withColumn("_r", F.coalesce(F.col(text_col), F.lit("")))
    for label, pattern in lx.PII.items():
        p = "(?i)" + pattern
        df = df.withColumn("_any", F.col("_r").rlike(p))
        df = df.withColumns({"_parts": F.when(F.col("_any"), F.split("_r", p, -1)), "_hits": F.when(F.col("_any"), F.regexp_extract_all("_r", F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>"))})
        key = lambda i, label=label: F.concat(F.lit(f"[{label}_"), (i + 1).cast("string"), F.lit("]"))
        joined = F.array_join(F.transform("_parts", _with_key(key)), "")
        df = df.withColumns({"pii": F.concat("pii", F.transform("_hits", _entry(key))), "_r": F.when(F.size("_hits") > 0, joined).otherwise(F.col("_r"))}).drop("_parts", "_hits", "_any")
    return df.withColumn(text_col, F.col("_r")).drop("_r")


def _with_key(key):
    return lambda part, i: F.concat(part, F.when(i < F.size("_hits"), key(i)).otherwise(""))


def _entry(key):
    return lambda value, i: F.struct(key(i).alias("key"), value.alias("value"))


def unmask(text: Column, pii: Column) -> Column:
    """The text with placeholders replaced by their values, the last made first."""
    return F.aggregate(F.reverse(pii), text, lambda t, e: F.replace(t, e["key"], e["value"]))


def counts(redacted: DataFrame) -> list[Column]:
    return [F.size(F.filter("pii", lambda e: e["key"].startswith(f"[{label}_"))).cast("long").alias(f"n_{label.lower()}") for label in lx.PII]
