"""Scoring uses all cores, and reads each value once."""

from pyspark.sql import functions as F

from docloom import catalog
from docloom.functions import lexicon as lx
from docloom.functions import text as tx
from docloom.operators import scoring


def test_one_small_file_is_dealt_over_all_cores(spark):
    """The table has a single row group, which without dealing is one task."""
    for rows in (catalog.corpus(spark, "/root/testdata/sf0.001"), catalog.sections(spark, "/root/testdata/sf0.001")):
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_statements_are_counted_once(spark):
    df = spark.createDataFrame([("- Led a team\n- Cut costs by 5%",)], "t string")
    bullets, found = scoring.statements(F.col("t"))
    scored = df.withColumns({"b": bullets, "f": found}).select(scoring.experience(F.col("b"), F.col("f"), F.col("t")).alias("s"))
    assert scored._jdf.queryExecution().optimizedPlan().toString().count(lx.METRIC) <= 1


def test_words_and_lines_of_any_script(spark):
    spaces = "\t\n\x0b\x0c\r \x85\xa0       　"
    texts = [f"a{c}b {c}{c}é{c}" for c in spaces] + ["", " ", "a\x1cb", "naïve 東京 ok\x7f", "\x01 x​z", "one\r\ntwo\rthree\x85four\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.filter(F.split("t", r"(?U)\s+"), lambda w: w != "")
    got = rows.select("t", old.alias("old"), tx.words(F.col("t")).alias("new"), tx.has_words(F.col("t"), 2).alias("two"), tx.lines(F.col("t")).alias("lines")).collect()
    assert all(r["old"] == r["new"] and r["two"] == (len(r["old"]) >= 2) for r in got)
    assert all(r["lines"] == r["t"].splitlines() for r in got)
