"""Ordered segmentation of documents into named sections, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import lexicon as lx
from docloom.functions import text as tx

SPARSE_SUMMARY = 100
#: How a bullet and a month begin.
_BULLET = r"^\s*[•●▪\-\*]\s"
_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)(?:[a-z]+)?"


#: What any heading looks like, anchored once, so that a line is tried from its beginning only.
ANY_HEADING = r"^\s*(?:" + "|".join(pattern.removeprefix(r"^\s*") for _, pattern in lx.HEADINGS) + ")"
#: No heading has more characters, unless it has runs of blanks.
LONGEST_HEADING = 40


def heading(line: Column) -> Column:
    """The section that a line opens, else null."""
    return _opens(F.trim(F.lower(line)))


def _opens(low: Column) -> Column:
    """heading() of a line that is trimmed and lower-cased; a plain column, as each pattern reads it."""
    chain = None
    for section, pattern in lx.HEADINGS:
        chain = F.when(low.rlike(pattern), section) if chain is None else chain.when(low.rlike(pattern), section)
    short = (F.length(low) <= LONGEST_HEADING) | low.rlike(r"\s\s")
    return F.when(short & low.rlike(ANY_HEADING), chain)


def date_range(strict_compat: bool = True) -> str:
    """Pattern of a date range. In the compatible form plain year ranges are seen only from years that end in 2."""
    year = r"(19|20)\d2" if strict_compat else r"(19|20)\d{2}"
    dated = rf"(?:\b{_MONTH}\b\.?\s+(?:19|20)\d{{2}})"
    return rf"(?:(?:\b{year})\s*[\-–—]\s*(?:\d{{4}}|present|now))|(?:{dated}\s*[\-–—]\s*(?:{dated}|present|now))"


def prose_line(line: Column, strict_compat: bool = True) -> Column:
    """Whether a line reads like a summary: long, no bullet, no date range, no list of short terms."""
    s = tx.strip(line)
    parts = F.split(s, ",")
    short = (F.size(parts) >= 4) & F.forall(F.slice(parts, 2, 1_000_000), lambda t: F.length(tx.strip(t)) < 18)
    return (F.length(s) >= 30) & ~s.rlike(_BULLET) & ~tx.has(s, date_range(strict_compat)) & ~short


def skill_set(text: Column) -> Column:
    """Distinct canonical skills of a text."""
    known = lx.skill_lookup()
    lookup = F.create_map(*(F.lit(x) for pair in sorted(known.items()) for x in pair))
    listed = F.filter(F.transform(skill_tokens(text), lambda t: F.lower(clean_skill(t))), lambda t: t.isin(*sorted(known)))
    return F.array_sort(F.array_distinct(F.transform(listed, lambda t: lookup[t])))


def skill_tokens(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[,;|\n•·]+"), tx.strip), lambda t: t != "")


def clean_skill(token: Column) -> Column:
    """A listed skill without label, level, remark or second choice."""
    plain = t = F.substring_index(tx.strip(token), ": ", -1)
    for tail in (r"\s+[-–—]\s+\S.*$", r"\s+\(.*\)$", r"\s+/\s+\S.*$"):
        t = F.regexp_replace(t, tail, "")
    # every tail begins with a blank and one of these
    return F.btrim(F.when(plain.rlike(r"\s[-–—(/]"), t).otherwise(plain), F.lit(""" .;:()[]"'"""))


def _skills_block(lines: Column) -> Column:
    body = F.array_join(lines, " ")
    listed = F.filter(F.transform(F.split(body, ","), tx.strip), lambda t: t != "")
    many = tx.bound(listed, lambda x: (F.size(x) >= 5) & (F.size(F.filter(x, lambda t: F.length(t) < 20)) >= 4))
    return many | (F.size(skill_set(body)) >= 3)


def _longest_run(lines: Column, flags: Column) -> Column:
    """struct<n,start> of the first longest run of true flags; flags must be a plain column."""
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("start"))

    def step(a: Column, flag: Column) -> Column:
        run = F.when(flag, a["run"] + 1).otherwise(0)
        better = run > a["n"]
        return F.struct(run.alias("run"), (a["at"] + 1).alias("at"), F.when(better, run).otherwise(a["n"]).alias("n"), F.when(better, a["at"] + 1 - run).otherwise(a["start"]).alias("start"))

    return F.aggregate(flags, zero, step, lambda a: F.struct(a["n"].alias("n"), a["start"].alias("start")))


def segment(docs: DataFrame, text_col: str = "text", *, repair: bool = True, strict_compat: bool = True) -> DataFrame:
    """Adds a string column per section (null where a section has no lines): header, contact, and so on.

    Text before the first heading is the header; headings that repeat add to their section. Two repairs follow: a
    summary stranded in another section moves back if the summary is sparse, and a block of skills moves to an
    empty skills section.
    """
    df = docs.withColumn("_lines", tx.lines(F.coalesce(F.col(text_col), F.lit(""))))
    df = df.withColumn("_heads", F.transform(F.transform("_lines", lambda x: F.trim(F.lower(x))), _opens))
    df = df.withColumn("_at", F.filter(F.transform("_heads", lambda h, i: F.when(h.isNotNull(), i)), lambda i: i.isNotNull()))
    n, at = F.size("_lines"), F.col("_at")
    first = F.struct(F.lit("Header").alias("s"), F.lit(0).alias("a"), F.coalesce(F.get(at, F.lit(0)), n).alias("b"))
    rest = F.transform(at, lambda p, j: F.struct(F.get(F.col("_heads"), p).alias("s"), (p + 1).alias("a"), F.coalesce(F.get(at, j + 1), n).alias("b")))
    df = df.withColumn("_blocks", F.concat(F.array(first), rest))
    body = lambda name: F.flatten(F.transform(F.filter("_blocks", lambda b: b["s"] == name), lambda b: F.slice(F.col("_lines"), b["a"] + 1, b["b"] - b["a"])))
    df = df.withColumns({f"_s_{s}": body(s) for s in lx.SECTIONS})
    if repair:
        donors = ("Education", "Experience", "Other")
        total = F.aggregate(F.transform("_s_Summary", lambda x: F.length(tx.strip(x))), F.lit(0), lambda a, x: a + x)
        df = df.withColumn("_sparse", total < SPARSE_SUMMARY)
        df = df.withColumns({f"_f_{s}": F.when(F.col("_sparse"), F.transform(f"_s_{s}", lambda x: prose_line(x, strict_compat))) for s in donors})
        df = df.withColumns({f"_r_{s}": _longest_run(F.col(f"_s_{s}"), F.col(f"_f_{s}")) for s in donors})
        giver = F.when(F.col("_sparse"), F.coalesce(*(F.when(F.col(f"_r_{s}.n") >= 2, s) for s in donors)))
        df = df.withColumn("_giver", giver)
        moved = F.coalesce(*(F.when(F.col("_giver") == s, F.slice(f"_s_{s}", F.col(f"_r_{s}.start") + 1, F.col(f"_r_{s}.n"))) for s in donors), F.array().cast("array<string>"))
        left = {f"_s_{s}": F.when(F.col("_giver").eqNullSafe(F.lit(s)), F.concat(F.slice(f"_s_{s}", 1, F.col(f"_r_{s}.start")), F.slice(f"_s_{s}", F.col(f"_r_{s}.start") + F.col(f"_r_{s}.n") + 1, 1_000_000))).otherwise(F.col(f"_s_{s}")) for s in donors}
        df = df.withColumns({"_s_Summary": F.concat("_s_Summary", moved), **left})
        donors = ("Experience", "Education", "Other")
        df = df.withColumn("_giver", F.when(F.size("_s_Skills") == 0, F.coalesce(*(F.when((F.size(f"_s_{s}") > 0) & _skills_block(F.col(f"_s_{s}")), s) for s in donors))))
        given = F.coalesce(*(F.when(F.col("_giver") == s, F.col(f"_s_{s}")) for s in donors), F.col("_s_Skills"))
        df = df.withColumns({"_s_Skills": given, **{f"_s_{s}": F.when(F.col("_giver").eqNullSafe(F.lit(s)), F.array().cast("array<string>")).otherwise(F.col(f"_s_{s}")) for s in donors}})
    df = df.withColumns({s.lower(): F.when(F.size(f"_s_{s}") > 0, tx.strip(F.array_join(f"_s_{s}", "\n"))) for s in lx.SECTIONS})
    return df.drop(*[c for c in df.columns if c.startswith("_") and c not in docs.columns])


def summary_line(line: Column) -> Column:
    """Whether a stripped header line belongs to a summary: no contact, and prose, a job title with a tail, or years of experience."""
    n = tx.word_count(line)
    contact = line.rlike(lx.EMAIL) | line.rlike(lx.PHONE) | tx.has(line, lx.URL)
    headline = (n >= 3) & (tx.has(line, lx.TITLE_LINE) | (tx.has(line, lx.YEARS_LINE) & (n <= 12)))
    return (F.length(line) > 2) & ~contact & (headline | (n >= 8))


def carve_summary(segmented: DataFrame) -> DataFrame:
    """Moves the first run of summary lines from the header to a summary that is missing; other documents stay as they are.

    Null headers and headers without such a line give nothing. What stays in the header is stripped.
    """
    blank = tx.blank(F.coalesce("summary", F.lit("")))
    df = segmented.withColumn("_lines", F.when(blank, tx.lines(F.coalesce("header", F.lit("")))))
    df = df.withColumn("_in", F.transform("_lines", lambda x: summary_line(tx.strip(x))))
    df = df.withColumn("_at", F.array_position("_in", True).cast("int"))
    df = df.withColumn("_stop", F.when(F.col("_at") > 0, F.array_position(F.slice("_in", F.col("_at"), F.size("_in")), False).cast("int")))
    n = F.when(F.col("_stop") > 0, F.col("_stop") - 1).otherwise(F.size("_in") - F.col("_at") + 1)
    df = df.withColumn("_n", n)
    kept = F.concat(F.slice("_lines", 1, F.col("_at") - 1), F.slice("_lines", F.col("_at") + F.col("_n"), F.size("_lines")))
    moved = F.transform(F.slice("_lines", F.col("_at"), F.col("_n")), tx.strip)
    found = F.coalesce(F.col("_at") > 0, F.lit(False))
    out = {"summary": F.when(found, F.array_join(moved, "\n")).otherwise(F.col("summary")), "header": F.when(found, tx.strip(F.array_join(kept, "\n"))).otherwise(F.col("header"))}
    return df.withColumns(out).drop("_lines", "_in", "_at", "_stop", "_n")


def section_rows(segmented: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Long form: doc_id, section, ord, text of the sections that have lines."""
    parts = F.array(*(F.struct(F.lit(s).alias("section"), F.lit(i).alias("ord"), F.col(s.lower()).alias("text")) for i, s in enumerate(lx.SECTIONS)))
    return segmented.select(id_col, F.explode(F.filter(parts, lambda p: p["text"].isNotNull())).alias("p")).select(id_col, "p.*")
