"""What speaks for a section and what is amiss in it, as column expressions beside the section scores.

Covers all scored sections. A message is a template and the condition that it needs; a document's messages keep the
table's order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import lexicon as lx
from docloom.functions import text as tx
from docloom.operators import scoring
from docloom.operators import segment as sg

#: Fixed values: (condition, message if it holds, message if it does not); {} stands for the condition's detail.
CONTACT = [
    ("email", "Email found: {}", "Missing email address."),
    ("phone", "Phone found.", "Missing phone number."),
    ("linkedin", "LinkedIn URL present.", "No LinkedIn URL detected."),
    ("github", "GitHub/portfolio URL present.", None),
]
SUMMARY = [("years", "States years of experience.", "Does not state years of experience."), ("role", "Targets a role: '{}'.", "No target role / job title mentioned.")]
EDUCATION = [
    ("degree", "Degree mentioned.", "No clear degree title detected."),
    ("year", "Graduation year present.", "No graduation year found."),
    ("place", "Institution appears to be listed.", "Institution not clearly listed."),
]
BULLETS = [("bullets", "Bullet points detected.", "No bullet markers detected — CV may read as a wall of text.")]
#: Fixed values: (most words, whether it speaks for the section, message).
SUMMARY_BANDS = [(19, False, "Summary too short ({} words). Aim for 40–80."), (120, True, "Summary length is appropriate ({} words)."), (None, False, "Summary too long ({} words). Aim for 40–80.")]
LENGTH_BANDS = [
    (199, False, "CV is very short ({} words). Likely missing content."),
    (399, True, "Concise ({} words)."),
    (900, True, "Length appropriate ({} words)."),
    (1300, False, "CV is getting long ({} words). Trim if under 7 years experience."),
    (None, False, "CV is too long ({} words). Cut to 1 page if <7 yrs exp, 2 pages max."),
]
MISSING = {"contact": "No contact information detected.", "summary": "No professional summary section found.", "education": "No education section found.", "experience": "No experience section found.", "skills": "No skills section found.", "projects": "No projects section found."}
UNPROFESSIONAL = "Email handle looks unprofessional."
#: Fixed values of the sections that list statements: (least share, whether it speaks for the section, message) of strong
#: verbs and of metrics, what is amiss otherwise, and in which order. {n}: statements, {k}: those in question.
STATEMENTS = {
    "experience": {
        "verbs": [(0.7, True, "{k}/{n} statements start with strong action verbs."), (0.4, False, "Only {k}/{n} statements start with strong action verbs."), (0.0, False, "Only {k}/{n} statements start with strong action verbs. Most are weak/passive.")],
        "metrics": [(0.6, True, "{k}/{n} statements include measurable metrics."), (0.3, False, "Only {k}/{n} statements contain metrics — add more."), (0.0, False, "Only {k}/{n} statements contain metrics. Add numbers, percentages, or scale to every bullet.")],
        "weak": "{k} statement(s) start with weak phrases like 'Responsible for' or 'Helped'.",
        "prose": "Experience is written in paragraph format. Convert to bullet points — recruiters scan, they don't read prose.",
        "none": "No bullet points or statements detected.",
        "order": ("verbs", "weak", "metrics", "prose"),
    },
    "projects": {
        "verbs": [(0.5, True, "{k}/{n} project bullets start with strong verbs."), (0.25, None, ""), (0.0, False, "Most project bullets lack strong action verbs.")],
        "metrics": [(0.4, True, "{k}/{n} project bullets include metrics."), (0.2, None, ""), (0.0, False, "Add metrics (%, $, scale) to project bullets — what was the impact?")],
        "weak": "{k} project bullet(s) start with weak phrases.",
        "prose": "Projects written in paragraph format. Use bullets — one line per project.",
        "none": "No project bullets or statements detected.",
        "order": ("verbs", "metrics", "prose", "weak"),
    },
}
ROLES = "{k} roles detected."
#: What is said about the skills that are known, vague, spelt differently, and grouped.
KNOWN_SKILLS = {
    "few": "Only {k} recognized technical skills found (of {n} listed). List named tools/tech — the scorer checks alias-normalized coverage, not raw count.",
    "some": "{k} recognized skills listed.",
    "more": "Consider adding 5–10 more role-relevant tools.",
    "many": "{k} recognized skills listed — solid breadth.",
    "vague": "{k}% of listed skills are vague phrases ({n}). Replace with named tools.",
    "aliases": "After alias normalization: {k} unique recognized skills (vs {n} raw tokens).",
    "categories": "By category: {k}.",
    "grouped": "Skills appear to be grouped by category.",
    "none": "No skills detected — try a comma-separated list.",
}

Pair = tuple[list[Column], list[Column]]


def _told(template: str, detail: Column | None) -> Column:
    before, _, after = template.partition("{}")
    return F.lit(template) if detail is None else F.concat(F.lit(before), detail, F.lit(after))


def _checks(table: list[tuple], facts: dict[str, tuple[Column, Column | None]]) -> Pair:
    good, bad = [], []
    for name, held, failed in table:
        holds, detail = facts[name]
        good.append(F.when(holds, _told(held, detail)))
        if failed:
            bad.append(F.when(~holds, F.lit(failed)))
    return good, bad


def _band(bands: list[tuple], n: Column) -> Pair:
    sides: dict[bool, list[Column]] = {True: [], False: []}
    low = 0
    for high, speaks_for, text in bands:
        inside = (n >= low) if high is None else n.between(low, high)
        sides[speaks_for].append(F.when(inside, _told(text, n.cast("string"))))
        low = 0 if high is None else high + 1
    return sides[True], sides[False]


def contact(text: Column) -> Pair:
    low = F.lower(text)
    email = F.regexp_extract(low, lx.EMAIL, 0)
    good, bad = _checks(CONTACT, {"email": (email != "", email), "phone": (tx.has(low, lx.PHONE, False), None), "linkedin": (low.contains("linkedin"), None), "github": (low.contains("github"), None)})
    return good, [*bad, F.when(tx.has(email, lx.UNPROFESSIONAL), UNPROFESSIONAL)]


def summary(text: Column) -> Pair:
    role = F.regexp_extract(text, r"(?i)\b(" + "|".join(lx.ROLE_KEYWORDS) + r")\b", 0)
    size, checks = _band(SUMMARY_BANDS, tx.word_count(text)), _checks(SUMMARY, {"years": (tx.has(text, lx.YEARS), None), "role": (role != "", role)})
    return size[0] + checks[0], size[1] + checks[1]


def education(text: Column) -> Pair:
    return _checks(EDUCATION, {"degree": (tx.has(text, lx.DEGREE), None), "year": (tx.has(text, lx.YEAR), None), "place": (tx.word_count(text) >= 5, None)})


def length(text: Column) -> Pair:
    size, checks = _band(LENGTH_BANDS, tx.word_count(text)), _checks(BULLETS, {"bullets": (text.rlike(r"(?m)^[-*•●▪]"), None)})
    return size[0] + checks[0], size[1] + checks[1]


def _filled(template: str, k: Column | None = None, n: Column | None = None) -> Column:
    """The template with {k} and {n} replaced."""
    parts: list[Column] = []
    for piece in template.replace("{n}", "{k}\0").split("{k}"):
        if parts:
            parts.append((n if piece.startswith("\0") else k).cast("string"))
        parts.append(F.lit(piece.lstrip("\0")))
    return F.concat(*parts)


def counted(found: Column) -> Column:
    """struct<n,strong,weak,metric> of statements."""
    kinds = (("strong", scoring.is_strong), ("weak", scoring.is_weak), ("metric", scoring.has_metric))
    return F.struct(F.size(found).alias("n"), *(F.size(F.filter(found, f)).alias(k) for k, f in kinds))


def statements(kind: str, text: Column, bullets: Column, counts: Column) -> Pair:
    """Messages of experience or projects over their counted() statements, a plain column, as each message reads it."""
    table = STATEMENTS[kind]
    n, strong, weak, metric = (counts[k] for k in ("n", "strong", "weak", "metric"))
    good: dict[str, Column] = {}
    bad = {"weak": F.when(weak > 0, _filled(table["weak"], weak)), "prose": F.when(~bullets, F.lit(table["prose"]))}
    for name, k in (("verbs", strong), ("metrics", metric)):
        sides: dict[bool, Column] = {}
        above = F.lit(False)
        for least, speaks_for, told in table[name]:
            inside = ~above & (tx.ratio(k, n) >= least)
            above = tx.ratio(k, n) >= least
            if speaks_for is not None:
                sides[speaks_for] = F.coalesce(*([sides[speaks_for]] if speaks_for in sides else []), F.when(inside, _filled(told, k, n)))
        good[name], bad[name] = sides[True], sides[False]
    pros = [good["verbs"], good["metrics"]]
    if kind == "experience":
        dated = F.size(F.filter(F.transform(tx.lines(text), tx.strip), lambda x: x.rlike(lx.YEAR) & (tx.word_count(x) <= 15)))
        pros.append(F.when(dated >= 3, _filled(ROLES, dated)))
    some = n > 0
    return [F.when(some, x) for x in pros], [F.when(~some, F.lit(table["none"])), *(F.when(some, bad[name]) for name in table["order"])]


def skills(text: Column, listed: Column, known: Column) -> Pair:
    """Messages of the skills section; listed (tokens of at most 40 characters) and known must be plain columns."""
    m, n, k = KNOWN_SKILLS, F.size(listed), F.size(known)
    is_vague = lambda t: F.lower(t).isin(*lx.VAGUE)
    vague, concrete = F.filter(listed, is_vague), F.size(F.filter(listed, lambda t: ~is_vague(t) & ~F.lower(t).startswith("etc")))
    by = F.array(*(F.struct((-F.size(F.array_intersect(known, tx.one_of(names)))).alias("n"), F.lit(c).alias("c")) for c, names in lx.SKILLS.items()))
    kinds = F.array_join(F.transform(F.filter(F.sort_array(by), lambda x: x["n"] < 0), lambda x: F.concat((-x["n"]).cast("string"), F.lit(" "), x["c"])), ", ")
    share = tx.ratio(F.size(vague), n)
    some = n > 0
    good = [
        F.when(k.between(3, 7), _filled(m["some"], k)).when(k >= 8, _filled(m["many"], k)),
        F.when((k > 0) & (k < concrete), _filled(m["aliases"], k, concrete)),
        F.when(k > 0, _filled(m["categories"], kinds)),
        F.when(tx.has(text, lx.SKILL_GROUP), F.lit(m["grouped"])),
    ]
    bad = [F.when(k < 3, _filled(m["few"], k, n)).when(k < 8, F.lit(m["more"])), F.when(share >= 0.5, _filled(m["vague"], F.floor(share * 100), F.array_join(F.slice(vague, 1, 3), ", ")))]
    return [F.when(some, x) for x in good], [F.when(~some, F.lit(m["none"])), *(F.when(some, x) for x in bad)]


def add_messages(segmented: DataFrame) -> DataFrame:
    """Adds evidence_X and issues_X, arrays of messages, for every scored section.

    A blank or null section has no evidence and one issue, that it is missing; length always counts all sections.
    """
    c = lambda name: F.coalesce(F.col(name), F.lit(""))
    raw = c("raw_contact") if "raw_contact" in segmented.columns else F.concat_ws("\n", *(c(s) for s in ("header", "contact", "links", "summary")))
    texts = {"contact": raw, "summary": c("summary"), "experience": c("experience"), "skills": c("skills"), "education": c("education"), "projects": c("projects"), "length": F.concat_ws("\n", *(s.lower() for s in lx.SECTIONS))}
    df = segmented.withColumns({f"_m_{k}": t for k, t in texts.items()})
    for name in STATEMENTS:
        bullets, found = scoring.statements(F.col(f"_m_{name}"))
        df = df.withColumns({f"_m_b_{name}": bullets, f"_m_s_{name}": found})
    df = df.withColumns({f"_m_c_{name}": counted(F.col(f"_m_s_{name}")) for name in STATEMENTS})
    df = df.withColumns({"_m_listed": F.filter(sg.skill_tokens(F.col("_m_skills")), lambda t: F.length(t) <= 40), "_m_known": sg.skill_set(F.col("_m_skills"))})
    made = {"contact": contact, "summary": summary, "education": education, "length": length, "skills": lambda t: skills(t, F.col("_m_listed"), F.col("_m_known"))}
    made |= {k: (lambda t, k=k: statements(k, t, F.col(f"_m_b_{k}"), F.col(f"_m_c_{k}"))) for k in STATEMENTS}
    out = {}
    for name in texts:
        text = F.col(f"_m_{name}")
        good, bad = (F.array_compact(F.array(*side)) for side in made[name](text))
        if name in MISSING:
            gone = tx.blank(text)
            good = F.when(gone, F.array().cast("array<string>")).otherwise(good)
            bad = F.when(gone, F.array(F.lit(MISSING[name]))).otherwise(bad)
        out |= {f"evidence_{name}": good, f"issues_{name}": bad}
    return df.withColumns(out).drop(*(c for c in df.columns if c.startswith("_m_")))
