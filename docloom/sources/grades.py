"""Human grades: reading grade files, matching them to files, and setting them beside automatic scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRADE = "__file__ string, human_overall double, human_role string, human_sections map<string,double>, notes string"
#: Suffixes tried, in this order, when a graded name is no file itself.
TRIED = ("", ".pdf", ".docx", ".txt")


def read_grades(spark: SparkSession, path: str) -> DataFrame:
    """filename, human_overall, human_role, human_sections and notes from objects keyed by file name.

    Entries that are no objects are left out; a missing role is general.
    """
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "body"))
    rows = raw.filter(F.col("body").startswith("{")).withColumn("g", F.from_json("body", GRADE))
    return rows.select(
        F.coalesce("g.__file__", "name").alias("filename"),
        "g.human_overall",
        F.coalesce("g.human_role", F.lit("general")).alias("human_role"),
        F.coalesce("g.human_sections", F.create_map().cast("map<string,double>")).alias("human_sections"),
        F.coalesce("g.notes", F.lit("")).alias("notes"),
    )


def resolve(grades: DataFrame, files: DataFrame) -> DataFrame:
    """grades whose filename is among files (file), as it stands or with a suffix of TRIED, the first that is; adds file."""
    tried = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.concat("filename", F.lit(s)).alias("file")) for k, s in enumerate(TRIED)))).alias("t")
    names = grades.filter(F.col("filename") != "").select("filename").distinct().select("filename", tried).select("filename", "t.*")
    found = names.join(files.select("file").distinct(), "file").groupBy("filename").agg(F.min_by("file", "k").alias("file"))
    return grades.join(found, "filename")


def beside(grades: DataFrame, scores: DataFrame) -> DataFrame:
    """file, section, human and auto for sections (file, section, auto) that have both grades."""
    human = grades.select("file", F.explode("human_sections").alias("section", "human"))
    return human.join(scores.select("file", "section", "auto"), ["file", "section"])


def read_deltas(spark: SparkSession, path: str) -> DataFrame:
    """section and delta, human - auto, of a corrections log with long or short keys; lines that are no objects are left out.

    A missing section is Unknown and a missing score counts as zero.
    """
    keys = "section string, human_score double, human double, auto_score double, auto double"
    rows = spark.read.text(path).filter(F.trim("value").startswith("{")).withColumn("map", F.from_json("value", "map<string,string>")).filter("map is not null")
    r = rows.select(F.from_json("value", keys).alias("r")).select("r.*")
    return r.select(F.coalesce("section", F.lit("Unknown")).alias("section"), (F.coalesce("human_score", "human", F.lit(0.0)) - F.coalesce("auto_score", "auto", F.lit(0.0))).alias("delta"))
