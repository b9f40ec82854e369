"""Review reports as JSON lines, one object per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import lexicon as lx

_NOTES = {"evidence": "array<string>", "issues": "array<string>"}


def _or_empty(df: DataFrame, name: str, kind: str) -> Column:
    empty = F.lit("") if kind == "string" else F.array().cast(kind)
    return F.coalesce(F.col(name), empty) if name in df.columns else empty


def payloads(scored: DataFrame, *, file_col: str = "doc_id") -> DataFrame:
    """file and report, the JSON text of a scored document.

    A section's messages come from columns such as evidence_skills, issues_skills and feedback_skills, the summary
    from review_summary; where a column is missing or null they are empty.
    """
    one = lambda s: F.struct(
        F.col(f"s_{s}").alias("score"),
        *(_or_empty(scored, f"{k}_{s}", t).alias(k) for k, t in _NOTES.items()),
        _or_empty(scored, f"feedback_{s}", "string").alias("feedback"),
    )
    sections = F.struct(*(one("length" if s == "Length_Formatting" else s.lower()).alias(s) for s in lx.SCORED))
    file = F.col(file_col).cast("string")
    report = F.struct(file.alias("file"), "overall", "grade", _or_empty(scored, "review_summary", "string").alias("summary"), "role", "role_confidence", sections.alias("sections"))
    return scored.select(file.alias("file"), F.to_json(report).alias("report"))


def write(scored: DataFrame, path: str, *, file_col: str = "doc_id") -> None:
    """Replace path by the reports, one line each."""
    payloads(scored, file_col=file_col).select("report").write.mode("overwrite").text(path)
