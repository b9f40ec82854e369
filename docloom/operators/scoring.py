"""Section scores, weights and overall grade as column expressions over the sections of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import lexicon as lx
from docloom.functions import text as tx
from docloom.operators import segment as sg
from docloom.operators.redact import redact

_MARK = r"([-*•●▪]|\d+[.)])"


def contact(text: Column) -> Column:
    low = F.lower(text)
    at = text.contains("@")  # which both patterns of addresses need
    raw = (at & tx.has(text, lx.EMAIL, False)).cast("int") * 3 + tx.has(text, lx.PHONE, False).cast("int") * 3 + low.contains("linkedin").cast("int") * 2 + low.contains("github").cast("int") - (at & tx.has(low, lx.UNPROFESSIONAL)).cast("int") * 2
    return F.when(tx.blank(text), 0.0).otherwise(tx.clamp(raw.cast("double")))


def summary(text: Column) -> Column:
    n = tx.word_count(text)
    base = F.when(n < 20, 2.0).when(n > 120, 4.0).otherwise(7.0)
    base = F.least(F.lit(10.0), base + tx.has(text, lx.YEARS).cast("double") * 1.5)
    role = tx.has(text, r"\b(" + "|".join(lx.ROLE_KEYWORDS) + r")\b")
    return F.when(tx.blank(text), 0.0).otherwise(F.least(F.lit(10.0), base + role.cast("double") * 1.5))


def statements(text: Column) -> tuple[Column, Column]:
    """(has bullets, statements): marked lines of three words or more, or else sentences of six or more."""
    bullets = text.rlike(rf"(?m)^\s*{_MARK}\s+")
    listed = F.filter(F.transform(tx.lines(text), lambda x: F.regexp_replace(tx.strip(x), rf"^{_MARK}\s*", "")), lambda x: tx.has_words(x, 3))
    spoken = F.filter(F.transform(F.split(text, r"\s(?<=[.!?]\s)\s*"), tx.strip), lambda x: tx.has_words(x, 6))
    return bullets, F.when(bullets, listed).otherwise(spoken)


def is_strong(statement: Column) -> Column:
    return F.rtrim(F.lower(F.regexp_extract(statement, r"^\S+", 0)), F.lit(".,;:")).isin(*lx.STRONG_VERBS)


def is_weak(statement: Column) -> Column:
    low = F.lower(statement)
    return low.rlike("^(?:" + "|".join(lx.WEAK_VERBS) + ")") | F.arrays_overlap(F.slice(tx.words(low), 1, 3), tx.one_of(lx.WEAK_VERBS))


def has_metric(statement: Column) -> Column:
    return tx.has(statement, lx.METRIC)


def _acts(steps_verb, steps_metric, top: float):
    def score(bullets: Column, found: Column, text: Column) -> Column:
        shares = F.struct(*(tx.ratio(F.size(F.filter(found, f)), F.size(found)).alias(k) for k, f in (("strong", is_strong), ("metric", has_metric))))
        points = tx.bound(shares, lambda x: banded(bullets, x["strong"], x["metric"]))
        return F.when(tx.blank(text), 0.0).when(F.size(found) == 0, 1.0).otherwise(points)

    def banded(bullets: Column, strong: Column, metric: Column) -> Column:
        base = F.lit(2.0)
        for least, value in steps_verb:
            base = F.when(strong >= least, value).otherwise(base)
        more = F.lit(0.0)
        for least, value in steps_metric:
            more = F.when(metric >= least, value).otherwise(more)
        plain = base + more
        return tx.clamp(F.when(bullets, plain).otherwise(F.greatest(F.lit(0.0), plain - 2.0)), 0.0, top)

    return score


experience = _acts([(0.4, 5.0), (0.7, 7.0)], [(0.3, 1.5), (0.6, 2.5)], 10.0)
projects = _acts([(0.25, 4.0), (0.5, 6.0)], [(0.2, 1.0), (0.4, 2.0)], 10.0)


def skills(text: Column, canonical: Column) -> Column:
    listed = F.filter(sg.skill_tokens(text), lambda t: F.length(t) <= 40)
    counts = tx.bound(listed, lambda x: F.struct(F.size(x).alias("n"), F.size(F.filter(x, lambda t: F.lower(t).isin(*lx.VAGUE))).alias("vague")))
    return tx.bound(counts, lambda x: _skill_points(text, F.size(canonical), x["n"], tx.ratio(x["vague"], x["n"])))


def _skill_points(text: Column, known: Column, n: Column, vague: Column) -> Column:
    base = F.when(known < 3, 3.0).when(known < 8, 6.0).otherwise(8.0)
    base = F.when(vague >= 0.5, F.greatest(F.lit(0.0), base - 2)).when(vague >= 0.25, F.greatest(F.lit(0.0), base - 1)).otherwise(base)
    return F.when(tx.blank(text), 0.0).when(n == 0, 1.0).otherwise(F.least(F.lit(10.0), base + tx.has(text, lx.SKILL_GROUP).cast("double")))


def education(text: Column) -> Column:
    points = tx.has(text, lx.DEGREE).cast("int") * 4 + tx.has(text, lx.YEAR).cast("int") * 3 + (tx.word_count(text) >= 5).cast("int") * 3
    return F.when(tx.blank(text), 0.0).otherwise(points.cast("double"))


def length(n_words: Column) -> Column:
    return F.when(n_words < 200, 3.0).when(n_words < 400, 7.0).when(n_words <= 900, 9.0).when(n_words <= 1300, 6.0).otherwise(4.0)


def grade(x: Column) -> Column:
    return F.when(x >= 9, "A — Excellent").when(x >= 8, "B — Strong").when(x >= 6.5, "C — Solid, improvable").when(x >= 5, "D — Weak").otherwise("F — Needs rewrite")


def status(x: Column) -> Column:
    return F.when(x >= 8, "Strong").when(x >= 6, "Solid").when(x >= 4, "Needs work").otherwise("Weak")


def detect_role(df: DataFrame, text_col: str, *, threshold: int = 3, margin: int = 2) -> DataFrame:
    """Adds role, role_confidence and the signal counts n_swe, n_data, n_pm."""
    df = df.withColumn("_tok", tx.tokens(F.coalesce(F.col(text_col), F.lit(""))))
    df = df.withColumn("_phr", F.array_distinct(tx.phrases(F.col("_tok"))))
    size = lambda terms: F.size(F.array_intersect("_phr", tx.one_of(terms)))
    df = df.withColumns({**{f"n_{r}": size(lx.SIGNALS[r]) for r in ("swe", "data", "pm")}, **{f"_d_{r}": size(lx.DISAMBIGUATORS[r]) for r in ("swe", "data", "pm")}})
    n, d = (lambda r: F.col(f"n_{r}")), (lambda r: F.col(f"_d_{r}"))
    # ties: disambiguators prefer pm, then data; plain signals prefer swe, then data
    best_d, best = F.greatest(d("pm"), d("data"), d("swe")), F.greatest(n("swe"), n("data"), n("pm"))
    by_d = F.when(d("pm") == best_d, "pm").when(d("data") == best_d, "data").otherwise("swe")
    by_n = F.when(n("swe") == best, "swe").when(n("data") == best, "data").otherwise("pm")
    second = F.element_at(F.array_sort(F.array(n("swe"), n("data"), n("pm"))), 2)
    clear = (best >= threshold) & (best - second >= margin)
    role = F.when(best_d > 0, by_d).when(clear, by_n).otherwise("general")
    sure = F.when(best_d > 0, F.least(F.lit(0.99), F.lit(0.7) + best_d * 0.1)).when(clear, F.round(F.least(F.lit(0.95), F.lit(0.5) + best * 0.05 + (best - second) * 0.05), 2)).when(best == 0, 0.3).otherwise(F.round(F.lit(0.3) + best * 0.05, 2))
    return df.withColumns({"role": role, "role_confidence": F.round(sure, 2)}).drop("_tok", "_phr", "_d_swe", "_d_data", "_d_pm")


def language(text: Column, signals: tuple[str, ...] = lx.INDONESIAN, least: float = 0.08, code: str = "id") -> Column:
    found = F.slice(tx.words(F.lower(text)), 1, 2000)
    hits = F.size(F.filter(found, lambda w: w.isin(*signals)))
    return F.when(tx.ratio(hits, F.size(found)) >= least, code).otherwise("en")


def rubric(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(role, *rule) for role, rules in lx.RUBRICS.items() for rule in rules], "role string, id string, category string, weight double")


def weights(rules: DataFrame) -> DataFrame:
    """role, section, weight: each category's share of its role's total, to 4 places."""
    by = rules.groupBy("role", "category").agg(F.sum("weight").alias("w"))
    total = rules.groupBy("role").agg(F.sum("weight").alias("t"))
    return by.join(F.broadcast(total), "role").select("role", F.col("category").alias("section"), F.round(F.col("w") / F.col("t"), 4).alias("weight"))


def weight_of(role: Column, section: str) -> Column:
    """A section's weight for a role, from the fixed rubrics."""
    chain = None
    for name, rules in lx.RUBRICS.items():
        total = sum(r[2] for r in rules)
        w = F.lit(round(sum(r[2] for r in rules if r[1] == section) / total, 4))
        chain = F.when(role == name, w) if chain is None else chain.when(role == name, w)
    return chain.otherwise(0.0)


def score_sections(segmented: DataFrame) -> DataFrame:
    """Adds a score column per scored section: s_contact, s_summary, and so on. Null sections count as empty."""
    c = lambda name: F.coalesce(F.col(name), F.lit(""))
    everything = F.concat_ws("\n", *(s.lower() for s in lx.SECTIONS))
    raw = F.col("raw_contact") if "raw_contact" in segmented.columns else F.concat_ws("\n", *(c(s) for s in ("header", "contact", "links", "summary")))
    df = segmented.withColumns({"_contact": raw, "_skills": sg.skill_set(c("skills"))})
    for name in ("experience", "projects"):
        bullets, found = statements(c(name))
        df = df.withColumns({f"_b_{name}": bullets, f"_st_{name}": found})
    return df.withColumns({
        "s_contact": contact(F.col("_contact")),
        "s_summary": summary(c("summary")),
        "s_experience": experience(F.col("_b_experience"), F.col("_st_experience"), c("experience")),
        "s_skills": skills(c("skills"), F.col("_skills")),
        "s_education": education(c("education")),
        "s_projects": projects(F.col("_b_projects"), F.col("_st_projects"), c("projects")),
        "s_length": length(tx.word_count(everything)),
    }).drop("_contact", "_skills", "_b_experience", "_st_experience", "_b_projects", "_st_projects")


def combine(scored: DataFrame, role: Column) -> DataFrame:
    """Adds overall (to 1 place) and grade (of the unrounded mean), weighted by the role's rubric."""
    names = {s: "s_length" if s == "Length_Formatting" else f"s_{s.lower()}" for s in lx.SCORED}
    top = sum((F.col(col) * weight_of(role, s) for s, col in names.items()), F.lit(0.0))
    bottom = sum((weight_of(role, s) for s in names), F.lit(0.0))
    # nine places: sums in another order then round alike
    df = scored.withColumn("_mean", F.round(top / F.when(bottom > 0, bottom).otherwise(1.0), 9))
    return df.withColumns({"overall": F.round("_mean", 1), "grade": grade(F.col("_mean"))}).drop("_mean")


def score_documents(docs: DataFrame, *, role: str | None = None, redacted: bool = True) -> DataFrame:
    """Full scoring: segment, replace personal data, segment again, detect the role, carve a summary, score, weigh and grade."""
    if role is not None and role not in lx.RUBRICS:
        raise ValueError(f"unknown role {role!r}; one of {sorted(lx.RUBRICS)}")
    df = segment_redacted(docs) if redacted else sg.segment(docs)
    corpus = F.concat_ws("\n", *(F.when(~tx.blank(F.coalesce(F.col(s), F.lit(""))), F.col(s)) for s in ("skills", "summary", "header", "experience")))
    df = detect_role(df.withColumn("_corpus", corpus), "_corpus").drop("_corpus")
    if role is not None:
        df = df.withColumns({"role": F.lit(role), "role_confidence": F.lit(1.0)})
    return combine(score_sections(sg.carve_summary(df)), F.col("role"))


def segment_redacted(docs: DataFrame) -> DataFrame:
    """Sections of the text whose personal data is replaced; the first pass's sections keep their names in the text."""
    first = sg.segment(docs)
    joined = F.concat_ws("\n", *(F.concat(F.lit(s + "\n"), F.col(s.lower())) for s in lx.SECTIONS))
    raw = F.concat_ws("\n", *(F.coalesce(F.col(s), F.lit("")) for s in ("header", "contact", "links", "summary")))
    kept = [c for c in docs.columns if c != "text"]
    second = sg.segment(redact(first.select(*kept, joined.alias("text"), raw.alias("raw_contact"))).drop("pii"))
    return second
