"""The engine's registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import lexicon as lx
from docloom.functions import text as tx
from docloom.operators import jobs, layout, messages, redact, report, retrieve, review_log, scoring, segment, stats
from docloom.plans import oracles as o
from docloom.plans.corpus import CORPUS, JDS
from docloom.session import spread, table
from docloom.sources import grades, reports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that it must equal."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)
    return spark.sql(text)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name")).createOrReplaceTempView("customer")
    return spark.sql(CORPUS)


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segment(corpus(spark, sf_dir)).drop("text")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_sections(sections(spark, sf_dir))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full scoring of the corpus: overall score, grade and role of each document."""
    return full_score(spark, sf_dir)


@query(CORPUS)
def corpus_texts(spark, sf_dir):
    return corpus(spark, sf_dir)


@query(f"{o.SECTIONS} select doc_id, section, text from sx")
def section_lines(spark, sf_dir):
    return segment.section_rows(sections(spark, sf_dir)).drop("ord")


@query(f"{o.SECTIONS} select section, count(*)::bigint as n, sum({o.count('text')})::bigint as n_words, max({o.count('text')})::bigint as most_words from sx group by section")
def section_sizes(spark, sf_dir):
    n = tx.word_count(F.col("text"))
    return segment.section_rows(sections(spark, sf_dir)).groupBy("section").agg(F.count("*").alias("n"), F.sum(n).alias("n_words"), F.max(n).cast("long").alias("most_words"))


def _section_score(name: str) -> Query:
    return lambda spark, sf_dir: _scored(spark, sf_dir).select("doc_id", F.col(f"s_{name}").alias("score"))


for _name, _oracle in (("contact", o.CONTACT), ("summary", o.SUMMARY), ("skills", o.SKILLS), ("education", o.EDUCATION)):
    QUERIES[f"score_{_name}"], ORACLES[f"score_{_name}"] = _section_score(_name), _oracle


def _acts(name: str, score) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = F.coalesce(F.col(name), F.lit(""))
        bullets, found = scoring.statements(text)
        df = sections(spark, sf_dir).select("doc_id", text.alias("t"), bullets.alias("b"), found.alias("s"))
        return df.select("doc_id", F.size("s").cast("long").alias("n_statements"), score(F.col("b"), F.col("s"), F.col("t")).alias("score"))

    return run


QUERIES["score_experience"], ORACLES["score_experience"] = _acts("experience", scoring.experience), o.EXPERIENCE
QUERIES["score_projects"], ORACLES["score_projects"] = _acts("projects", scoring.projects), o.PROJECTS


@query(o.LENGTH)
def score_length(spark, sf_dir):
    n = tx.word_count(F.concat_ws("\n", *(s.lower() for s in lx.SECTIONS))).cast("long")
    return sections(spark, sf_dir).select("doc_id", n.alias("n_words")).select("doc_id", "n_words", scoring.length(F.col("n_words")).alias("score"))


@query(o.LENGTH_DOCS)
def length_band_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.word_count(F.col("text")).cast("long").alias("n_words"))
    return docs.select("doc_id", "n_words", scoring.length(F.col("n_words")).alias("score"))


@query(o.LONG_SCORES)
def section_scores(spark, sf_dir):
    rows = F.array(*(F.struct(F.lit(s).alias("section"), F.col("s_length" if s == "Length_Formatting" else f"s_{s.lower()}").alias("score")) for s in lx.SCORED))
    return _scored(spark, sf_dir).select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")


@query(o.OVERALL)
def overall_by_role(spark, sf_dir):
    roles = F.explode(F.array(*map(F.lit, lx.RUBRICS))).alias("role")
    scored = _scored(spark, sf_dir)
    return scoring.combine(scored.select("doc_id", roles, *(c for c in scored.columns if c.startswith("s_"))), F.col("role")).select("doc_id", "role", "overall", "grade")


@query(o.PRESETS)
def preset_compare(spark, sf_dir):
    presets = spark.createDataFrame(list(lx.PRESETS.items()), "label string, role string")
    return overall_by_role(spark, sf_dir).join(F.broadcast(presets), "role").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("overall"), 4).alias("mean_overall"))


@query(o.CARVE)
def summary_carve(spark, sf_dir):
    """Header and summary after summary lines of the header have moved."""
    return segment.carve_summary(sections(spark, sf_dir)).select("doc_id", "header", "summary")


@query(o.FULL)
def full_score(spark, sf_dir):
    return scoring.score_documents(corpus(spark, sf_dir)).select("doc_id", "overall", "grade", "role", "role_confidence")


@query(o.WEIGHTS)
def rubric_weights(spark, sf_dir):
    return scoring.weights(scoring.rubric(spark))


@query(o.SKILL_EXTRACT)
def skill_extract(spark, sf_dir):
    found = sections(spark, sf_dir).select("doc_id", segment.skill_set(F.coalesce("skills", F.lit(""))).alias("s"))
    return found.select("doc_id", F.size("s").cast("long").alias("n_skills"), F.array_join("s", ",").alias("skills"))


@query(o.CATEGORY_HIST)
def skill_category_hist(spark, sf_dir):
    category = spark.createDataFrame([(s, c) for c, ss in lx.SKILLS.items() for s in ss], "skill string, category string")
    found = sections(spark, sf_dir).select("doc_id", F.explode(segment.skill_set(F.coalesce("skills", F.lit("")))).alias("skill"))
    return found.join(F.broadcast(category), "skill").groupBy("category").agg(F.count("*").alias("n_documents_skills"), F.countDistinct("doc_id").alias("n_documents"))


@query(o.ROLE)
def role_detect(spark, sf_dir):
    src = sections(spark, sf_dir).select("doc_id", F.concat_ws("\n", "skills", "summary", "header", "experience").alias("t"))
    found = scoring.detect_role(src, "t")
    return found.select("doc_id", *(F.col(f"n_{r}").cast("long").alias(f"n_{r}") for r in ("swe", "data", "pm")), "role", "role_confidence")


@query(o.LANG)
def lang_detect(spark, sf_dir):
    """The language test with a German signal set, which these documents can tell apart."""
    german = ("der", "die", "und", "den", "von", "zu", "das", "mit")
    return table(spark, sf_dir, "documents").select("doc_id", scoring.language(F.col("text"), german, 0.08, "de").alias("lang_found"))


@query(o.REDACT)
def redact_corpus(spark, sf_dir):
    df = redact.redact(corpus(spark, sf_dir))
    return df.select("doc_id", "text", *redact.counts(df), F.array_join(F.transform("pii", lambda e: F.concat_ws("=", e["key"], e["value"])), "\n").alias("pii"))


@query(o.REDACT_DOCS)
def pii_counts(spark, sf_dir):
    df = redact.redact(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", *redact.counts(df))


@query(o.UNMASK)
def unmask_roundtrip(spark, sf_dir):
    df = redact.redact(corpus(spark, sf_dir).withColumn("before", F.col("text")))
    wrong = (redact.unmask(F.col("text"), F.col("pii")) != F.col("before")).cast("long")
    return df.agg(F.count("*").alias("n"), F.sum(wrong).alias("n_wrong"))


def parsed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.parse_jobs(_sql(spark, sf_dir, JDS, "nation"))


@query(o.JD_PARSE)
def jd_parse(spark, sf_dir):
    return parsed_jobs(spark, sf_dir).select("jd_id", "role_title", F.col("years_required").cast("long").alias("years_required"), F.array_join("required_skills", ",").alias("required"), F.array_join("nice_to_have", ",").alias("nice"))


@query(o.JD_FREQ)
def jd_skill_freq(spark, sf_dir):
    rows = _sql(spark, sf_dir, JDS, "nation").select(F.explode(jobs.skill_counts(F.col("text"))).alias("s"))
    return rows.groupBy("s.skill").agg(F.sum("s.n").alias("n"), F.count("*").alias("n_jobs"))


@query(o.JD_MATCH)
def jd_match_report(spark, sf_dir):
    m = jobs.match(sections(spark, sf_dir), parsed_jobs(spark, sf_dir))
    return m.select("doc_id", "jd_id", "jd_score", "jd_grade", "required_ratio", "nice_ratio", "role_match", F.col("years_gap").cast("long").alias("years_gap"), F.array_join("matched", ",").alias("matched"), F.array_join("top_gaps", ",").alias("top_gaps"))


@query(o.JD_PLACES)
def jd_skill_places(spark, sf_dir):
    """Where the skills of a job occur, and the words around them."""
    m = jobs.match(sections(spark, sf_dir), parsed_jobs(spark, sf_dir))
    return m.select("doc_id", "jd_id", F.explode("distribution").alias("p")).select("doc_id", "jd_id", "p.*")


@query(o.JD_ADJUSTED)
def jd_adjusted_scores(spark, sf_dir):
    m = jobs.adjust(jobs.match(_scored(spark, sf_dir).withColumn("role", F.lit("general")), parsed_jobs(spark, sf_dir)))
    messages_of = F.concat_ws(" | ", "jd_issues_skills", "jd_evidence_summary", "jd_issues_experience")
    return m.select("doc_id", "jd_id", "s_skills", "s_summary", "overall", "grade", messages_of.alias("messages"))


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for human grades: labels as grades, and scores by arithmetic on the id."""
    auto = F.least(F.lit(10.0), F.lit(1.0) + F.col("doc_id") * 37 % 90 / 10.0)
    role = F.when(F.col("doc_id") % 4 == 0, "pm").when(F.col("doc_id") % 4 == 1, "swe").otherwise("data")
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 6.0 + 2).alias("human"), auto.alias("auto"), role.alias("role"))


@query(o.agreement(""))
def agreement_overall(spark, sf_dir):
    return stats.agreement(graded(spark, sf_dir), [])


@query(o.agreement("role"))
def agreement_by_role(spark, sf_dir):
    return stats.agreement(graded(spark, sf_dir), ["role"])


@query(o.BLIND)
def blind_spots(spark, sf_dir):
    return stats.blind_spots(graded(spark, sf_dir), "role")


@query(o.BOOTSTRAP)
def bootstrap_mae_ci(spark, sf_dir):
    return stats.bootstrap_mae(graded(spark, sf_dir))


@query(o.SECTION_REPORT)
def section_report(spark, sf_dir):
    """The validation report by section; sections are dealt out by id."""
    k = F.col("doc_id") % 5
    section = F.when(k == 0, "Contact").when(k == 1, "Summary").when(k == 2, "Skills").when(k == 3, "Education").otherwise("Experience")
    return stats.section_report(graded(spark, sf_dir).withColumn("section", section))


@query(o.VERDICT)
def verdict(spark, sf_dir):
    a = stats.agreement(graded(spark, sf_dir), [])
    return a.select("n", "pearson", "mae", stats.verdict(F.col("n"), F.col("pearson"), F.col("mae")).alias("verdict"))


def review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for the log of corrections, derived from events."""
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.when(k % 50 == 0, "").otherwise(F.concat(F.lit("cv"), (k % 97).cast("string"))).alias("cv_filename"), F.col("event_type").alias("section"), (k * 13 % 110 / 10.0).alias("auto_score"), (k * 29 % 103 / 10.0).alias("human_score"))


def _problem():
    return review_log.problem(*(F.col(c) for c in ("cv_filename", "section", "auto_score", "human_score")))


@query(o.LOG_CHECK)
def corrections_validate(spark, sf_dir):
    return review_rows(spark, sf_dir).select("event_id", _problem().alias("error"))


@query(o.LOG_SUMMARY)
def corrections_summary(spark, sf_dir):
    s = review_log.summary(review_rows(spark, sf_dir).filter(_problem() == ""))
    return s.withColumns({c: F.round(c, 6) for c in ("min_delta", "max_delta")})


@query(o.LOG_REPORT)
def corrections_report(spark, sf_dir):
    """All corrections by section, valid or not; some have lost their section."""
    rows = review_rows(spark, sf_dir)
    return review_log.report(rows.withColumn("section", F.when(F.col("event_id") % 9 != 0, F.col("section"))))


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings")
    return rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), F.col("label").alias("query_label")), rows


@query(o.topk("true"))
def vector_topk(spark, sf_dir):
    queries, rows = _vectors(spark, sf_dir)
    return retrieve.top_k(queries, rows, 5).withColumn("rank", F.col("rank").cast("long"))


@query(o.topk("(a.label = b.label or a.label = 0)"))
def vector_topk_filtered(spark, sf_dir):
    queries, rows = _vectors(spark, sf_dir)
    return retrieve.top_k(queries, rows, 5, role=True).withColumn("rank", F.col("rank").cast("long"))


@query(o.BAND_ORDERS)
def grade_bands_orders(spark, sf_dir):
    m = F.col("o_orderkey") % 101 / 10.0
    return table(spark, sf_dir, "orders").select("o_orderkey", scoring.grade(m).alias("grade"), scoring.status(m).alias("status"))


@query(o.MESSAGES)
def section_messages(spark, sf_dir):
    """What speaks for and against the sections that list statements or skills."""
    told = messages.add_messages(sections(spark, sf_dir))
    rows = F.array(*(F.struct(F.lit(s).alias("section"), F.array_join(f"evidence_{s}", " | ").alias("evidence"), F.array_join(f"issues_{s}", " | ").alias("issues")) for s in ("experience", "projects", "skills")))
    return told.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")


@query(o.ISSUE_COUNTS)
def issue_counts(spark, sf_dir):
    """How many issues the sections of statements and skills have in each document."""
    told = messages.add_messages(sections(spark, sf_dir))
    return told.select("doc_id", report.issue_count(*(F.col(f"issues_{n}") for n in ("experience", "projects", "skills"))).cast("long").alias("n_issues"))


@query(o.REPORT_BANDS)
def report_bands(spark, sf_dir):
    k = F.col("o_orderkey")
    m = k % 101 / 10.0
    said = F.when(k % 7 == 0, "n/a").otherwise(m.cast("string"))
    name = F.when(k % 3 == 0, "Length_Formatting").when(k % 3 == 1, "Skills").otherwise("work_history")
    confidence = k % 10 / 10.0
    return table(spark, sf_dir, "orders").select("o_orderkey", report.colour(m).alias("colour"), report.recommendation(said).alias("recommendation"), report.role_label(F.lit("pm"), confidence).alias("role_label"), report.display_name(name).alias("display"), report.number(said).alias("number"))


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for scored sections, five to an order."""
    names = ["Contact", "Summary", "Skills", "Education", "Length_Formatting"]
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.posexplode(F.array(*map(F.lit, names))).alias("ord", "name"))
    k, i = F.col("doc_id"), F.col("ord")
    return rows.withColumns({"score": (k * 7 + i * 31) % 101 / 10.0, "n_issues": (k + i) % 4, "n_evidence": (k * 3 + i) % 3, "overall": k % 101 / 10.0, "grade": F.concat(F.lit("grade "), (k % 5).cast("string"))})


@query(o.SUMMARY_PROMPTS)
def summary_prompts(spark, sf_dir):
    return report.summary_prompts(report_rows(spark, sf_dir))


@query(o.SECTION_PROMPTS)
def section_prompts(spark, sf_dir):
    rule = F.struct(F.col("id").alias("rule_id"), "weight", F.concat("category", F.lit(" rule")).alias("text"))
    rules = scoring.rubric(spark).filter("role = 'general'").groupBy(F.col("category").alias("name")).agg(F.sort_array(F.collect_list(rule)).alias("rules"))
    rows = report_rows(spark, sf_dir).join(F.broadcast(rules), "name", "left")
    said = lambda n: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n).cast("int") - 1), lambda i: F.concat("name", F.lit(" "), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    prompt = report.section_prompt(F.col("name"), F.col("score"), said("n_evidence"), said("n_issues"), F.coalesce("rules", F.array().cast("array<struct<rule_id:string,weight:double,text:string>>")))
    return rows.select("doc_id", "name", prompt.alias("prompt"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page spans derived from lineitem: one page an order, in one or two columns."""
    x0 = F.when((F.col("l_orderkey") % 2 == 0) & (F.col("l_linenumber") % 2 == 0), 330.0).otherwise(40.0) + F.col("l_partkey") % 3
    y0 = F.lit(50.0) + F.floor(F.col("l_linenumber") / 2) * 12
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), F.lit(612.0).alias("width"), x0.alias("x0"), y0.cast("double").alias("y0"), (x0 + 60).alias("x1"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"))


@query(o.COLUMNS)
def columns_detect(spark, sf_dir):
    return layout.reading_order(spans(spark, sf_dir)).select("doc_id", "n_columns", "n_spans")


@query(o.READING)
def reading_order(spark, sf_dir):
    return layout.reading_order(spans(spark, sf_dir))


@query(o.RESOLVE)
def grades_resolve(spark, sf_dir):
    names = _sql(spark, sf_dir, o.GRADED_NAMES, "labels")
    return grades.resolve(names, _sql(spark, sf_dir, o.GRADED_FILES, "documents")).select("doc_id", "filename", "file")


@query(o.ROLE_ACCURACY)
def role_accuracy(spark, sf_dir):
    """How often the detected role is the one that the corpus was written for."""
    expected = F.when(F.col("doc_id") % 3 == 0, "swe").when(F.col("doc_id") % 3 == 1, "data").otherwise("pm")
    rows = role_detect(spark, sf_dir).select(expected.alias("expected"), "role")
    return rows.groupBy("expected").agg(F.count("*").alias("n"), F.count_if(F.col("role") == F.col("expected")).alias("n_right"))


@query()
def report_payloads(spark, sf_dir):
    return reports.payloads(messages.add_messages(scoring.score_documents(corpus(spark, sf_dir))))


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
