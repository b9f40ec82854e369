"""Golden rows of the scoring engine."""

import math

import pytest
from pyspark.sql import functions as F

from docloom.functions import lexicon as lx
from docloom.operators import jobs, layout, redact, retrieve, review_log, scoring, segment, stats


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_headings(spark):
    cases = {"  SUMMARY  ": "Summary", "Employment History": "Experience", "License & Certifications": "Certifications", "Riwayat Pekerjaan": "Experience", "Keahlian Teknis": "Skills", "Tautan": "Links", "Tino Santoso": None, "Python, Go, TypeScript": None}
    rows = spark.createDataFrame(list(cases.items()), "line string, want string").select(segment.heading(F.col("line")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in rows)


@pytest.mark.parametrize("text, want", [("a@x.com", 3.0), ("a@x.com +62 812 3456 7890 linkedin.com/in/a github.com/a", 9.0), ("", 0.0), ("hotmama99@x.com 0812-3456-7890 linkedin.com/in/a", 6.0)])
def test_contact(spark, text, want):
    assert one(spark, text, scoring.contact) == want


@pytest.mark.parametrize("text, want", [("Just five words right here", 2.0), ("word " * 150, 4.0), ("Software engineer with 8 years of experience " + "building things " * 10, 10.0), ("", 0.0)])
def test_summary(spark, text, want):
    assert one(spark, text, scoring.summary) == want


@pytest.mark.parametrize("text, want", [("B.S. Computer Science, Institut Teknologi Bandung, 2020", 10.0), ("Bachelor of Computer Science, Some University", 7.0), ("", 0.0)])
def test_education(spark, text, want):
    assert one(spark, text, scoring.education) == want


def test_skills(spark):
    score = lambda t: one(spark, t, lambda c: scoring.skills(c, segment.skill_set(c)))
    assert score("Python, Go, Docker, Kubernetes, AWS, Redis, Kafka, Spark, SQL") == 8.0
    assert score("Python, Go, Docker, AWS, team player, passionate, fast learner") == 5.0
    assert one(spark, "PHP - Advanced, Python (3 years), Java / Scala, Tools: Git, k8s", segment.skill_set) == ["Git", "Java", "Kubernetes", "PHP", "Python"]


def test_grades(spark):
    rows = spark.createDataFrame([(x,) for x in (9.5, 9.0, 8.9, 8.0, 7.0, 6.5, 6.4, 5.0, 4.9, 0.0)], "x double").select(scoring.grade(F.col("x")).substr(1, 1).alias("g")).collect()
    assert "".join(r["g"] for r in rows) == "AABBCCDDFF"


def test_redaction_round_trip(spark):
    texts = ["Reach me at a@x.com or b@y.com", "0812-3456-7890", "Python 3.9", "https://www.linkedin.com/in/jdoe", "Jl. Sudirman No. 45, Jakarta", "Tgl lahir: 17 Agustus 1945", "Jl. Sudirman 45 | a@b.com", None]
    df = redact.redact(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"))
    got = [r for r in df.withColumn("back", redact.unmask(F.col("text"), F.col("pii"))).orderBy("i").collect()]
    assert [r["text"] for r in got][:6] == ["Reach me at [EMAIL_1] or [EMAIL_2]", "[PHONE_1]", "Python 3.9", "[LINKEDIN_1]", "[ADDRESS_1], Jakarta", "Tgl [DOB_1]" if got[5]["text"].startswith("Tgl [") else "[DOB_1]"]
    assert [r["back"] for r in got] == [t or "" for t in texts]


def test_stranded_summary_moves_back(spark):
    prose = "Engineer who has built data platforms for banks\nand led teams that ship reliable software daily"
    text = f"Ann\nEducation\nSome School\n{prose}\nSummary\nshort\nSkills\nEducation\nPython, Go, Docker, AWS, Redis"
    r = segment.segment(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["summary"].endswith(prose) and "banks" not in (r["education"] or "")


def test_empty_and_null_documents(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "\n\n")], "doc_id long, text string")
    rows = scoring.score_documents(df).collect()
    assert len(rows) == 3 and all(r["grade"].startswith("F") for r in rows)


def test_unknown_role(spark):
    with pytest.raises(ValueError):
        scoring.score_documents(spark.createDataFrame([(1, "x")], "doc_id long, text string"), role="chef")


def test_published_agreement(spark):
    rows = [(1, 8.5, 8.5), (2, 8.0, 5.3), (3, 5.5, 5.8), (4, 4.5, 3.4), (5, 2.5, 2.3)]
    r = stats.agreement(spark.createDataFrame(rows, "doc_id long, human double, auto double"), []).first()
    assert (round(r["pearson"], 3), round(r["spearman"], 3), round(r["mae"], 2)) == (0.877, 0.9, 0.86)
    flat = stats.agreement(spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, 3.0)], "doc_id long, human double, auto double"), []).first()
    assert flat["pearson"] is None


def test_weights(spark):
    w = {(r["role"], r["section"]): r["weight"] for r in scoring.weights(scoring.rubric(spark)).collect()}
    assert w["general", "Experience"] == 0.4365 and w["swe", "Skills"] == 0.1987 and w["pm", "Experience"] == 0.5125
    assert all(math.isclose(sum(v for (r, _), v in w.items() if r == role), 1, abs_tol=1e-3) for role in lx.RUBRICS)


def test_job_match(spark):
    jd = jobs.parse_jobs(spark.createDataFrame([(1, "Software Engineer\nRequirements\npython go kubernetes postgresql"), (2, "")], "jd_id long, text string"))
    docs = segment.segment(spark.createDataFrame([(1, "Software Engineer\nSkills\npython, kubernetes, postgresql")], "doc_id long, text string"))
    got = {r["jd_id"]: r for r in jobs.match(docs, jd).collect()}
    assert "go" in got[1]["missing"] and got[2]["jd_score"] == 0.0


def test_review_log(spark, tmp_path):
    good = spark.createDataFrame([("a.pdf", "Skills", 3.0, 7.0, ""), ("b.pdf", "Skills", 4.0, 6.0, "x"), ("c.pdf", "Contact", 8.0, 9.0, None)], "cv_filename string, section string, auto_score double, human_score double, recruiter_id string")
    path = str(tmp_path / "log")
    review_log.append(good, path)
    (tmp_path / "log" / "bad.json").write_text('garbage\n\n{"cv_filename": "d", "section": "Skills", "auto_score": 11, "human_score": 1}\n')
    got = {r["section"]: (r["n"], r["mean_delta"]) for r in review_log.summary(review_log.read(spark, path)).collect()}
    assert got == {"Skills": (2, 3.0), "Contact": (1, 1.0)}


def test_review_stream(spark, tmp_path):
    from docloom.streaming.review_stream import start_summary

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"cv_filename": "d", "section": "Skills", "auto_score": 1, "human_score": 3}\n')
    q = start_summary(spark, str(folder), "live", str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [(r["section"], r["mean_delta"]) for r in spark.table("live").collect()] == [("Skills", 2.0)]


def test_reading_order(spark):
    rows = [("d", 1, 612.0, 40.0, 50.0, 100.0, "left one"), ("d", 1, 612.0, 330.0, 50.0, 400.0, "right one"), ("d", 1, 612.0, 40.0, 61.0, 100.0, "left two"), ("d", 1, 612.0, 110.0, 62.0, 150.0, "end"), ("d", 1, 612.0, 40.0, 70.0, 50.0, " ")]
    r = layout.reading_order(spark.createDataFrame(rows, "doc_id string, page_no int, width double, x0 double, y0 double, x1 double, text string")).first()
    assert (r["n_columns"], r["text"]) == (2, "left one\nleft two end\nright one")


def test_bootstrap_covers_what_resampling_does(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(k, float(a), float(h)) for k, (a, h) in enumerate(zip(rng.uniform(0, 10, 250), rng.uniform(0, 10, 250), strict=True))]
    df = spark.createDataFrame(rows, "doc_id long, auto double, human double")
    got = stats.bootstrap_mae(df).first()
    errors = np.array([abs(a - h) for _, a, h in rows])
    means = np.sort(errors[rng.integers(0, 250, (4000, 250))].mean(axis=1))
    assert abs(got["low"] - means[100]) < 0.08 and abs(got["high"] - means[3900]) < 0.08
    pairs = spark.createDataFrame([(k, g, float(k), float(2 * k)) for g in "abc" for k in range("abc".index(g) * 2 + 1)], "doc_id long, section string, auto double, human double")
    found = {r["section"]: (r["n"], r["low"], r["high"]) for r in stats.bootstrap_mae(pairs, ["section"], rounds=50).collect()}
    assert found["a"] == (1, None, None) and found["b"][0] == 3 and found["b"][1] <= found["b"][2]
    assert sorted(r["section"] for r in stats.section_report(pairs).collect()) == ["b", "c"]


def test_nearest_by_raw_similarity(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0001], 0), (2, [1.0, 0.0], 0), (3, [0.0, 0.0], 0)], "vec_id long, embedding array<double>, label int")
    queries = spark.createDataFrame([(9, [1.0, 0.0], 5)], "query_id long, query_vec array<double>, query_label int")
    got = retrieve.top_k(queries, rows, 3).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [2, 1, 3] and got[2]["score"] is None and got[1]["score"] == 1.0


def test_rules_fall_back_to_all_roles(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 3), (2, [0.0, 1.0], 4)], "vec_id long, embedding array<double>, label int")
    queries = spark.createDataFrame([(7, [1.0, 0.0], 3), (8, [1.0, 0.0], 9)], "query_id long, query_vec array<double>, query_label int")
    got = sorted((r["query_id"], r["vec_id"]) for r in retrieve.rules_for(queries, rows, 5).collect())
    assert got == [(7, 1), (8, 1), (8, 2)]
    assert [r["name"] for r in retrieve.missing_names(spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "name string"), spark.createDataFrame([("c",)], "name string")).collect()] == ["a", "b"]
