"""Bands, labels and prompts of a score report, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values: (least score, colour), the last one for all below.
COLOURS = [(8, "#16a34a"), (6, "#ca8a04"), (4, "#ea580c"), (None, "#dc2626")]
#: Fixed values: (least overall score, recommendation).
RECOMMENDATIONS = [
    (8, "Strong candidate — fast-track to phone screen. Verify any claimed metrics during the interview."),
    (6.5, "Solid candidate — worth a phone screen. Probe the weakest section during the interview."),
    (5, "Borderline — request specific examples before advancing. The CV needs quantification."),
    (None, "Reject (or hold for re-submission). Multiple sections fall below the bar; a rewrite is the fastest path forward."),
]
#: The parts of the prompts.
SECTION_PROMPT = ("SECTION: ", "\nSCORE: ", "/10\n\nDETECTED STRENGTHS:\n", "\n\nDETECTED ISSUES:\n", "\n\nRELEVANT RUBRIC RULES:\n", '\n\nWrite 2–4 short bullets of specific feedback. Cite rule IDs (e.g. "[R5]") when referencing rubric.')
SUMMARY_PROMPT = (
    "A candidate's CV scored ", "/10 → ", ".\n\nSection scores:\n", "\n\nThe two weakest sections are: ",
    ".\n\nWrite a 3-sentence executive summary:\n1. State the strongest section and why it works\n2. State the weakest section and the single highest-impact fix\n"
    "3. One sentence on overall readiness for ATS systems\n\nTone: candid, professional, no fluff. No greetings, no sign-offs.",
)


def _band(x: Column, bands: list[tuple]) -> Column:
    """The text of the first band that x reaches; nulls are in the last."""
    return reduce(lambda rest, b: F.when(x >= b[0], b[1]).otherwise(rest), reversed(bands[:-1]), F.lit(bands[-1][1]))


def number(x: Column) -> Column:
    """A value as a number, 0 if it is none."""
    return F.coalesce(x.cast("string").try_cast("double"), F.lit(0.0))


def colour(x: Column) -> Column:
    return _band(x, COLOURS)


def recommendation(overall: Column) -> Column:
    return _band(number(overall), RECOMMENDATIONS)


def low_confidence(confidence: Column) -> Column:
    return F.coalesce(confidence < 0.5, F.lit(False))


def role_label(role: Column, confidence: Column) -> Column:
    """The role in capitals, starred where it is uncertain."""
    return F.concat(F.upper(role), F.when(low_confidence(confidence), " *").otherwise(""))


def display_name(name: Column) -> Column:
    """A section's name with blanks for underscores and capitals at the words' beginnings."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def issue_count(*issues: Column) -> Column:
    """How many issues all sections have; null lists have none."""
    return sum((F.coalesce(F.size(i), F.lit(0)) for i in issues), F.lit(0))


def _listed(items: Column, mark: str) -> Column:
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit(mark), x)), "\n")).otherwise("(none)")


def shown(score: Column) -> Column:
    """A score as it is written: at least one decimal."""
    return score.cast("double").cast("string")


def section_prompt(name: Column, score: Column, evidence: Column, issues: Column, rules: Column) -> Column:
    """What a language model is asked about a section. rules: array<struct<rule_id,weight,text>>."""
    told = F.array_join(F.transform(rules, lambda r: F.concat(F.lit("- ["), r["rule_id"], F.lit("] (weight "), shown(r["weight"]), F.lit(") "), r["text"])), "\n")
    parts = (name, shown(score), _listed(evidence, "+ "), _listed(issues, "- "), told)
    return F.concat(*(x for text, value in zip(SECTION_PROMPT, parts, strict=False) for x in (F.lit(text), value)), F.lit(SECTION_PROMPT[-1]))


def summary_prompts(sections: DataFrame) -> DataFrame:
    """One row per document: doc_id, weakest (the two lowest sections, ties in the report's order) and prompt.

    sections: doc_id, ord, name, score, n_issues, n_evidence, and the document's overall and grade on each row.
    """
    line = F.concat(F.lit("- "), "name", F.lit(": "), shown(F.col("score")), F.lit("/10 ("), F.col("n_issues").cast("string"), F.lit(" issues, "), F.col("n_evidence").cast("string"), F.lit(" strengths)"))
    by = Window.partitionBy("doc_id").orderBy("score", "ord")
    rows = sections.select("doc_id", "ord", "overall", "grade", line.alias("line"), F.concat("name", F.lit(" ("), shown(F.col("score")), F.lit("/10)")).alias("told"), F.row_number().over(by).alias("place"))
    told = lambda c, order: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c, F.struct(F.col(order).alias("o"), F.col("told").alias("t"))))), lambda x: x["t"]), ", ")
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n")
    docs = rows.groupBy("doc_id").agg(F.first("overall").alias("overall"), F.first("grade").alias("grade"), lines.alias("lines"), told(F.col("place") <= 2, "place").alias("weakest"))
    p = SUMMARY_PROMPT
    prompt = F.concat(F.lit(p[0]), shown(F.col("overall")), F.lit(p[1]), "grade", F.lit(p[2]), "lines", F.lit(p[3]), "weakest", F.lit(p[4]))
    return docs.select("doc_id", "weakest", prompt.alias("prompt"))
