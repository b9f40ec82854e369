"""Job descriptions: parsing, and matching them with scored documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import lexicon as lx
from docloom.functions import text as tx
from docloom.operators.scoring import combine, grade
from docloom.session import blocks


def _pattern(term: str) -> str:
    return r"\b" + "".join("\\" + c if c in ".+#*()[]{}?|^$\\" else c for c in term) + r"\b"


def skill_counts(text: Column) -> Column:
    """array<struct<n,skill>> of lexicon terms that occur, the most frequent first, then by name."""
    # a term's pattern is tried only where its characters are
    count = lambda low, t: F.when(low.contains(t), -F.regexp_count(low, F.lit(_pattern(t)))).otherwise(0)
    found = tx.bound(F.lower(text), lambda low: F.array(*(F.struct(count(low, t).alias("n"), F.lit(t).alias("skill")) for t in lx.TECH)))
    return F.transform(F.sort_array(F.filter(found, lambda x: x["n"] < 0)), lambda x: F.struct((-x["n"]).alias("n"), x["skill"].alias("skill")))


def parse_jobs(jobs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds role_title, years_required, required_skills and nice_to_have; a blank text gives '', 0 and empty lists."""
    t = tx.strip(F.coalesce(F.col(text_col), F.lit("")))
    df = jobs.withColumns({"_t": t, "_low": F.lower(t)})
    find = lambda *terms: F.coalesce(*(F.when(F.instr("_low", x) > 0, F.instr("_low", x)) for x in terms))
    df = df.withColumns({"_must": find("requirement", "qualification"), "_nice": find("nice to have", "bonus", "preferred")})
    after = F.col("_nice") > F.col("_must")
    must_text = F.when(F.col("_must").isNull(), F.col("_t")).when(after, F.substring("_t", F.col("_must"), F.col("_nice") - F.col("_must"))).otherwise(F.substring("_t", F.col("_must"), F.length("_t")))
    nice_text = F.when(F.col("_must").isNotNull() & after, F.substring("_t", F.col("_nice"), F.length("_t"))).otherwise("")
    names = lambda x: F.transform(skill_counts(x), lambda s: s["skill"])
    df = df.withColumns({"_all": names(F.col("_t")), "_ms": names(must_text), "_ns": names(nice_text)})
    # without a block of required skills everything is required
    plain = F.size("_ms") == 0
    head = F.substring("_t", 1, 500)
    role = F.regexp_extract(head, lx.JD_ROLE, 1)
    role = tx.strip(F.when(role != "", role).otherwise(F.regexp_extract(head, "(?i)" + lx.JD_ROLE, 1)))
    years = F.coalesce(F.array_max(F.transform(F.regexp_extract_all("_t", F.lit("(?i)" + lx.JD_YEARS), F.lit(1)), lambda y: y.cast("int"))), F.lit(0))
    required = F.filter("_all", lambda s: F.array_contains("_ms", s) & ~F.array_contains("_ns", s))
    nice = F.filter("_all", lambda s: F.array_contains("_ns", s))
    return df.withColumns({"role_title": role, "years_required": years, "required_skills": F.when(plain, F.col("_all")).otherwise(required), "nice_to_have": F.when(plain, F.array().cast("array<string>")).otherwise(nice)}).drop("_t", "_low", "_must", "_nice", "_all", "_ms", "_ns")


def snippet(text: Column, at: Column, window: int = 6) -> Column:
    """The words around character at (from 1): window before the one that begins there and as many after it."""
    word = F.size(tx.words(F.substring(text, F.lit(1), at - 1)))
    first = F.greatest(F.lit(0), word - window)
    return F.array_join(F.slice(tx.words(text), first + 1, word + window + 1 - first), " ")


def _places(found: Column) -> Column:
    """array<struct<skill,section,snippet>>: where each found skill first occurs in each section."""
    parts = F.filter(F.array(*(F.struct(F.lit(s).alias("section"), F.col(s.lower()).alias("text"), F.lower(s.lower()).alias("low")) for s in lx.SECTIONS)), lambda p: p["text"].isNotNull())

    def of(skill: Column, parts: Column) -> Column:
        near = F.filter(parts, lambda p: p["low"].contains(skill))
        spots = F.transform(near, lambda p: F.struct(p["section"].alias("section"), p["text"].alias("text"), F.regexp_instr(p["low"], F.concat(F.lit(r"\b\Q"), skill, F.lit(r"\E\b"))).alias("at")))
        return F.transform(F.filter(spots, lambda p: p["at"] > 0), lambda p: F.struct(skill.alias("skill"), p["section"].alias("section"), snippet(p["text"], p["at"]).alias("snippet")))

    return tx.bound(parts, lambda all_parts: F.flatten(F.transform(found, lambda skill: of(skill, all_parts))))


def match(docs: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row per document and job: documents with section columns against parsed jobs.

    jobs is a stated query set, joined in blocks of a bounded size; the terms looked for are those of the lexicon, so each
    document is scanned once for all terms before the join. A job without role and required skills matches nothing.
    distribution says in which sections the matched skills occur, with the words around.
    """
    sections = F.concat_ws("\n", *(s.lower() for s in lx.SECTIONS))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    mine = docs.withColumns({
        "_found": F.transform(skill_counts(sections), lambda s: s["skill"]),
        "_role_text": F.lower(F.concat_ws(" ", blank("summary"), blank("header"))),
        "_years": F.coalesce(F.regexp_extract(F.concat_ws("\n", blank("summary"), blank("experience")), "(?i)" + lx.MATCH_YEARS, 1).try_cast("int"), F.lit(0)),
    })
    mine = mine.withColumn("_places", _places(F.col("_found")))
    title = F.filter(F.regexp_extract_all(F.lower("role_title"), F.lit("[a-z]+"), F.lit(0)), lambda w: ~w.isin(*lx.SENIORITY) & w.isin(*lx.ROLE_KEYWORDS))
    out = None
    for part in blocks(jobs, "jd_id"):
        asked = part.select("jd_id", "role_title", "years_required", "required_skills", "nice_to_have", title.alias("_title"))
        pairs = _compared(mine.crossJoin(F.broadcast(asked)))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def _compared(df: DataFrame) -> DataFrame:
    """match() of pairs."""
    some = (F.col("role_title") != "") | (F.size("required_skills") > 0)
    kept = lambda c: F.filter(c, lambda s: F.array_contains("_found", s))
    df = df.withColumns({"matched": kept("required_skills"), "nice_matched": kept("nice_to_have"), "missing": F.filter("required_skills", lambda s: ~F.array_contains("_found", s)), "_some": some})
    hits = F.size(F.filter("_title", lambda w: F.col("_role_text").contains(w)))
    part = lambda a, b: F.when(F.size(b) > 0, F.size(a) / F.size(b)).otherwise(0.0)
    df = df.withColumns({
        "role_match": (F.size("_title") > 0) & (hits >= F.greatest(F.lit(1), F.floor(F.size("_title") / 2))),
        "required_ratio": part("matched", "required_skills"), "nice_ratio": part("nice_matched", "nice_to_have"),
        "years_gap": F.when(F.col("_some") & (F.col("years_required") > 0), F.greatest(F.lit(0), F.col("years_required") - F.col("_years"))).otherwise(0),
        "distribution": F.filter("_places", lambda p: F.array_contains("required_skills", p["skill"]) | F.array_contains("nice_to_have", p["skill"])),
    })
    years = F.when(F.col("years_required") > 0, F.greatest(F.lit(0.0), F.lit(10.0) - F.col("years_gap") * 2)).otherwise(10.0)
    total = F.col("required_ratio") * 7 + F.col("nice_ratio") * 1.5 + F.when(F.col("role_match"), 1.0).otherwise(0.5) + years * 0.05
    # nine places first: sums in another order then round alike
    df = df.withColumns({"jd_score": F.when(F.col("_some"), F.round(F.round(total, 9), 2)).otherwise(0.0), "top_gaps": F.slice("missing", 1, 5)})
    return df.withColumn("jd_grade", grade(F.col("jd_score"))).drop("_found", "_places", "_role_text", "_years", "_title", "_some")


#: What a match says about the sections that it changes.
GAPS = "Missing %d of %d required JD skills (%d%% coverage). Top gaps: %s."
ALIGNED = "Role title aligns with the Job Description."
FEWER_YEARS = "Job Description asks for %d+ years; CV may fall short by ~%d year(s)."


def adjust(matched: DataFrame) -> DataFrame:
    """Scores changed by a match: s_skills less the gap's penalty, s_summary one more for the role; overall and grade if there is a role.

    Adds jd_issues_skills, jd_evidence_summary and jd_issues_experience, each a message or null.
    """
    penalty = F.when(F.size("required_skills") > 0, F.round((1 - F.col("required_ratio")) * 3, 1)).otherwise(0.0)
    better = F.col("role_match") & (F.col("s_summary") < 10)
    gaps = F.when(F.size("top_gaps") > 0, F.array_join("top_gaps", ", ")).otherwise("n/a")
    df = matched.withColumns({
        "jd_issues_skills": F.when(penalty > 0, F.format_string(GAPS, F.size("missing"), F.size("required_skills"), F.bround(F.col("required_ratio") * 100).cast("int"), gaps)),
        "jd_evidence_summary": F.when(better, ALIGNED),
        "jd_issues_experience": F.when(F.col("years_gap") > 0, F.format_string(FEWER_YEARS, "years_required", "years_gap")),
        "s_skills": F.greatest(F.lit(0.0), F.round(F.col("s_skills") - penalty, 1)),
        "s_summary": F.when(better, F.least(F.lit(10.0), F.round(F.col("s_summary") + 1, 1))).otherwise(F.col("s_summary")),
    })
    return combine(df, F.col("role")) if "role" in matched.columns else df
