"""Where the skills of jobs occur is told for every job."""

from pyspark.sql import functions as F

from docloom import catalog

SF = "/root/testdata/sf0.001"


def test_places_cover_all_jobs(spark):
    """All skills that a match names have a place, whichever job asked for them."""
    named = catalog.jd_match_report(spark, SF).select("doc_id", "jd_id", F.explode(F.split("matched", ",")).alias("skill")).filter("skill <> ''")
    want = {tuple(r) for r in named.collect()}
    got = {tuple(r) for r in catalog.jd_skill_places(spark, SF).select("doc_id", "jd_id", "skill").collect()}
    assert {j for _, j, _ in want} == {r["jd_id"] for r in catalog.parsed_jobs(spark, SF).collect()}
    assert want <= got
