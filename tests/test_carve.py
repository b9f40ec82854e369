"""A summary inside the header, and the repairs of segmentation."""

from pyspark.sql import functions as F

from docloom.operators import scoring, segment


def carved(spark, header, summary=None):
    row = spark.createDataFrame([(1, header, summary)], "doc_id int, header string, summary string")
    r = segment.carve_summary(row).first()
    return r["header"], r["summary"]


def test_prose_leaves_the_header(spark):
    prose = "Senior Software Engineer with 8 years of experience building services"
    assert carved(spark, f"Ana Lim\nana@x.org\n{prose}\nand many other things that people use every day\nJakarta") == ("Ana Lim\nana@x.org\nJakarta", f"{prose}\nand many other things that people use every day")
    assert carved(spark, "Ana Lim\nData Engineer: pipelines") == ("Ana Lim", "Data Engineer: pipelines")
    assert carved(spark, "Ana Lim\n\n5+ years building tools\n\n3 tahun di bank") == ("Ana Lim\n\n\n3 tahun di bank", "5+ years building tools")


def test_what_stays(spark):
    for header in ("Ana Lim\nSoftware Engineer", "write to ana@x.org for all of the eight words here", "see www.x.org for all of the many words on this line", "Ana\n8 years", "", None):
        assert carved(spark, header) == (header, None)
    long = "this line has more than the eight words that it needs"
    assert carved(spark, long, "Here.") == (long, "Here.") and carved(spark, long, " ") == ("", long)


def test_summary_in_header_scores(spark):
    df = spark.createDataFrame([(1, "Ana Lim\nSenior Software Engineer with 8 years of experience who leads small teams and builds reliable services for large banks in many regions today\nSkills\nPython")], "doc_id long, text string")
    assert scoring.score_documents(df).first()["s_summary"] == 10.0


def test_blank_tokens_are_no_skills(spark):
    rows = [(1, "Skills\nEducation\na, , , , b"), (2, "Skills\nEducation\nab, cd, ef, gh, ij")]
    got = segment.segment(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").select(F.col("skills").isNotNull().alias("s")).collect()
    assert [r["s"] for r in got] == [False, True]
