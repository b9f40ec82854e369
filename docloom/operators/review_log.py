"""The log of reviewers' corrections: validation, tolerant reading, appending and summary, batch or streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "timestamp string, cv_filename string, section string, auto_score double, human_score double, auto_evidence string, human_evidence string, recruiter_id string, schema_version int"


def problem(cv: Column, section: Column, auto: Column, human: Column) -> Column:
    """'' if a correction is valid, else what is wrong first."""
    outside = lambda c: c.isNull() | ~c.between(0.0, 10.0) | F.isnan(c)
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.when(empty(cv), "cv_filename is required").when(empty(section), "section is required").when(outside(auto), "auto_score must be a number between 0 and 10").when(outside(human), "human_score must be a number between 0 and 10").otherwise("")


def parse(raw: DataFrame) -> DataFrame:
    """Valid corrections from a column `value` of JSON lines; malformed and invalid lines are left out."""
    rows = raw.select(F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    return rows.filter(problem(F.col("cv_filename"), F.col("section"), F.col("auto_score"), F.col("human_score")) == "")


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def persist(rows: DataFrame, path: str, rejected: str) -> None:
    """Append the valid corrections to path and the others, with what is wrong with them, to rejected, as JSON lines."""
    checked = rows.withColumn("error", problem(*(F.col(c) for c in ("cv_filename", "section", "auto_score", "human_score"))))
    append(checked.filter("error = ''").drop("error"), path)
    checked.filter("error <> ''").write.mode("append").json(rejected)


def append(rows: DataFrame, path: str) -> None:
    """Append corrections as JSON lines; empty optional fields are left out, a missing timestamp is now."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    optional = {c: F.nullif(F.col(c), F.lit("")) for c in ("auto_evidence", "human_evidence", "recruiter_id") if c in rows.columns}
    stamp = F.coalesce(F.nullif(F.col("timestamp"), F.lit("")), now) if "timestamp" in rows.columns else now
    rows.withColumns({**optional, "timestamp": stamp, "schema_version": F.lit(1)}).write.mode("append").json(path)


def report(rows: DataFrame) -> DataFrame:
    """summary() without spread, sections that are missing counted as Unknown, and a row of all sections together."""
    named = rows.withColumn("section", F.coalesce("section", F.lit("Unknown")))
    d = F.coalesce("human_score", F.lit(0.0)) - F.coalesce("auto_score", F.lit(0.0))
    both = named.rollup("section").agg(F.count("*").alias("n"), F.round(F.avg(d), 6).alias("mean_delta"), F.grouping("section").alias("_all"))
    return both.select(F.when(F.col("_all") == 1, "All").otherwise(F.col("section")).alias("section"), "n", "mean_delta")


def summary(rows: DataFrame) -> DataFrame:
    """Per section: n and the mean, least and greatest of human - auto. Runs on streams too."""
    d = F.col("human_score") - F.col("auto_score")
    return rows.groupBy("section").agg(F.count("*").alias("n"), F.round(F.avg(d), 6).alias("mean_delta"), F.min(d).alias("min_delta"), F.max(d).alias("max_delta"))
