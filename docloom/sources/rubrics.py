"""Rubric files, one JSON array of rules for each role, and the store of rule vectors made from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import lexicon as lx
from docloom.operators.retrieve import rule_text

SCHEMA = "id string, category string, rule string, weight double, rationale string"
FIELDS = tuple(f.split()[0] for f in SCHEMA.split(", "))
ROLES = tuple(lx.RUBRICS)


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """The rules of one file; ValueError names the first rule that lacks a field, FileNotFoundError a missing file."""
    try:
        rules = spark.read.schema(SCHEMA).json(path, multiLine=True)
    except AnalysisException as e:
        raise FileNotFoundError(f"rubric file missing: {path}") from e
    lacking = rules.withColumn("gone", F.concat_ws(",", *(F.when(F.col(f).isNull(), f) for f in FIELDS))).filter("gone <> ''")
    if found := lacking.orderBy("id").select("id", "gone").first():
        raise ValueError(f"rule {found['id'] or '?'} of {path} lacks {found['gone']}")
    return rules


def read_role(spark: SparkSession, folder: str, role: str) -> DataFrame:
    """A role's rules, with the role; ValueError for an unknown role."""
    if role not in ROLES:
        raise ValueError(f"unknown role {role!r}; one of {sorted(ROLES)}")
    return read_file(spark, f"{folder}/{role}.json").withColumn("role", F.lit(role))


def read_all(spark: SparkSession, folder: str) -> DataFrame:
    """The rules of every role."""
    first, *rest = (read_role(spark, folder, role) for role in ROLES)
    for more in rest:
        first = first.unionByName(more)
    return first


def build_store(rules: DataFrame, embed: Callable[[Column], Column], path: str, *, rebuild: bool = False) -> DataFrame:
    """Write one vector per rule and read them back; a store that exists stays unless it is to be rebuilt.

    embed makes a vector column from a text column, a pandas UDF around a model for instance. Columns: vec_id, rule_id,
    category, role, weight, text, embedding.
    """
    text = rule_text(F.col("id"), F.col("category"), F.col("role"), F.col("rule"), F.col("rationale"))
    rows = rules.select(F.xxhash64("role", "id").alias("vec_id"), F.col("id").alias("rule_id"), "category", "role", "weight", text.alias("text"))
    rows.withColumn("embedding", embed(F.col("text"))).write.mode("overwrite" if rebuild else "ignore").parquet(path)
    return rules.sparkSession.read.parquet(path)
