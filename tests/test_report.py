"""Bands, labels, prompts, and the messages of statements and skills."""

from pyspark.sql import functions as F

from docloom.functions import lexicon as lx
from docloom.operators import jobs, messages, report, scoring, segment


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_bands_and_labels(spark):
    r = one(spark, a=report.colour(F.lit(8.0)), b=report.colour(F.lit(3.9)), c=report.recommendation(F.lit("6.5")), d=report.recommendation(F.lit("none")), e=report.display_name(F.lit("Length_Formatting")), f=report.number(F.lit(None).cast("string")), g=report.role_label(F.lit("swe"), F.lit(0.49)), h=report.role_label(F.lit("pm"), F.lit(0.5)), i=report.issue_count(F.array(F.lit("x"), F.lit("y")), F.lit(None).cast("array<string>")))
    assert (r["a"], r["b"], r["e"], r["f"], r["g"], r["h"], r["i"]) == ("#16a34a", "#dc2626", "Length Formatting", 0.0, "SWE *", "PM", 2)
    assert r["c"].startswith("Solid candidate") and r["d"].startswith("Reject")


def test_section_prompt(spark):
    strings = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    rules = F.array(F.struct(F.lit("R5").alias("rule_id"), F.lit(2.0).alias("weight"), F.lit("Name tools.").alias("text")))
    p = one(spark, p=report.section_prompt(F.lit("Skills"), F.lit(4.0), strings(), strings("few", "vague"), rules))["p"]
    assert p.startswith("SECTION: Skills\nSCORE: 4.0/10\n\nDETECTED STRENGTHS:\n(none)\n\nDETECTED ISSUES:\n- few\n- vague\n\nRELEVANT RUBRIC RULES:\n- [R5] (weight 2.0) Name tools.\n\nWrite 2–4 short bullets")


def test_weakest_sections(spark):
    rows = [(1, i, n, s, 1, 2, 6.0, "C") for i, (n, s) in enumerate([("A", 5.0), ("B", 3.0), ("C", 5.0), ("D", 9.0)])]
    r = report.summary_prompts(spark.createDataFrame(rows, "doc_id long, ord int, name string, score double, n_issues int, n_evidence int, overall double, grade string")).first()
    assert r["weakest"] == "B (3.0/10), A (5.0/10)" and "- A: 5.0/10 (1 issues, 2 strengths)\n- B: 3.0/10" in r["prompt"] and r["prompt"].startswith("A candidate's CV scored 6.0/10 → C.")


def sections(spark, **text):
    names = [s.lower() for s in lx.SECTIONS]
    return spark.createDataFrame([(1, *(text.get(n) for n in names))], "doc_id long, " + ", ".join(f"{n} string" for n in names))


def test_statement_messages(spark):
    work = "Acme 2019 - 2021\n- Led a team of 5 people\n- Built tools for 300 users\n- Worked on the old site\nBeta 2021\nGamma 2022"
    r = messages.add_messages(sections(spark, experience=work, projects="I made a small game for my friends. Nice.", skills="Python, AWS, aws, team player")).first()
    assert r["evidence_experience"] == ["3 roles detected."]
    assert r["issues_experience"] == ["Only 2/4 statements start with strong action verbs.", "1 statement(s) start with weak phrases like 'Responsible for' or 'Helped'.", "Only 2/4 statements contain metrics — add more."]
    assert r["evidence_projects"] == [] and r["issues_projects"][0] == "Most project bullets lack strong action verbs." and r["issues_projects"][-1].startswith("Projects written in paragraph")
    assert r["issues_skills"] == ["Only 2 recognized technical skills found (of 4 listed). List named tools/tech — the scorer checks alias-normalized coverage, not raw count."]
    assert r["evidence_skills"][0] == "After alias normalization: 2 unique recognized skills (vs 3 raw tokens)." and r["evidence_skills"][1].startswith("By category: 1 ")
    none = messages.add_messages(sections(spark, experience="two words", skills="x" * 41)).first()
    assert none["issues_experience"] == ["No bullet points or statements detected."] and none["issues_skills"] == ["No skills detected — try a comma-separated list."] and none["issues_projects"] == ["No projects section found."]


def test_job_places_and_messages(spark):
    docs = segment.segment(spark.createDataFrame([(1, "Ann\nSummary\nSoftware engineer with 2 years in a small shop that runs (python) and more things every day\nSkills\nPython, SQL")], "doc_id long, text string"))
    jds = jobs.parse_jobs(spark.createDataFrame([(1, "Software Engineer\nAt least 5 years.\nRequirements\npython, kafka"), (2, "nothing here")], "jd_id long, text string"))
    got = {r["jd_id"]: r for r in jobs.adjust(jobs.match(scoring.score_sections(docs).withColumn("role", F.lit("general")), jds)).collect()}
    r = got[1]
    assert [(p["skill"], p["section"], p["snippet"]) for p in r["distribution"]] == [("python", "Summary", "a small shop that runs (python) and more things every day"), ("python", "Skills", "Python, SQL")]
    assert r["jd_issues_skills"] == "Missing 1 of 2 required JD skills (50% coverage). Top gaps: kafka." and r["years_gap"] == 3
    assert r["jd_issues_experience"] == "Job Description asks for 5+ years; CV may fall short by ~3 year(s)." and r["jd_evidence_summary"] == jobs.ALIGNED and r["overall"] is not None
    assert (got[2]["jd_score"], got[2]["years_gap"], got[2]["distribution"], got[2]["jd_issues_skills"]) == (0.0, 0, [], None)
