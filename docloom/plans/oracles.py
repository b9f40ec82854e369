"""DuckDB SQL that the engine's queries are compared with; written apart from the DataFrame code."""

from __future__ import annotations

from docloom.functions import lexicon as lx
from docloom.operators import messages, report
from docloom.operators.segment import date_range
from docloom.plans.corpus import CORPUS, JDS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def terms(values) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


HEAD = "case " + " ".join(f"when regexp_matches(trim(lower(line)), {q(p)}) then {q(s)}" for s, p in lx.HEADINGS) + " end"
PIVOT = ", ".join(f"max(case when section = {q(s)} then text end) as {s.lower()}" for s in lx.SECTIONS)

def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


_LOOKUP = "(values " + ", ".join(f"({q(k)}, {q(v)})" for k, v in sorted(lx.skill_lookup().items())) + ") as lk(key, skill)"
_PROSE = rf"length(s) >= 30 and not regexp_matches(s, '^\s*[•●▪\-\*]\s') and not regexp_matches(s, {q(date_range())}, 'i') and not (len(string_split(s, ',')) >= 4 and len(list_filter(string_split(s, ',')[2:], lambda t: length({strip('t')}) >= 18)) = 0)"


def canonical(rows: str, keys: str) -> str:
    """CTEs from rows (keys, body) to k9 (keys, skill): the skills of a body, each once."""
    return rf"""k1 as (select {keys}, unnest(regexp_split_to_array(body, '[,;|\n•·]+')) as raw from {rows}),
k2 as (select {keys}, list_last(string_split({strip('raw')}, ': ')) as c from k1 where {strip('raw')} <> ''),
k3 as (select {keys}, regexp_replace(regexp_replace(regexp_replace(c, '\s+[-–—]\s+\S.*$', ''), '\s+\(.*\)$', ''), '\s+/\s+\S.*$', '') as c from k2),
k9 as (select distinct {keys}, skill from k3 join {_LOOKUP} on lower(trim(c, ' .;:()[]"''')) = key)"""


def segmented(source: str) -> str:
    """CTEs from a source of doc_id and text to sx (doc_id, section, text), both repairs included."""
    listed = f"list_filter(list_transform(string_split(body, ','), lambda t: {strip('t')}), lambda t: t <> '')"
    return rf"""ln as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from {source}),
cl as (select *, {HEAD} as h from ln),
ff as (select *, coalesce(last_value(h ignore nulls) over (partition by doc_id order by pos rows unbounded preceding), 'Header') as section from cl),
u0 as (select doc_id, section, line, {strip('line')} as s, row_number() over (partition by doc_id, section order by pos) as i from ff where h is null),
tt as (select doc_id, sum(length(s)) as total from u0 where section = 'Summary' group by doc_id),
is0 as (select doc_id, section, i, i - row_number() over (partition by doc_id, section order by i) as g from u0 where section in ('Education', 'Experience', 'Other') and {_PROSE}),
is1 as (select doc_id, section, min(i) as a, count(*) as n from is0 group by doc_id, section, g),
is2 as (select * from is1 qualify row_number() over (partition by doc_id, section order by n desc, a) = 1),
gv as (select is2.* from is2 left join tt using (doc_id) where n >= 2 and coalesce(total, 0) < 100 qualify row_number() over (partition by doc_id order by case section when 'Education' then 0 when 'Experience' then 1 else 2 end) = 1),
u1 as (select u0.doc_id, case when gv.doc_id is null then u0.section else 'Summary' end as section, gv.doc_id is not null as late, i, line from u0 left join gv on gv.doc_id = u0.doc_id and gv.section = u0.section and i between gv.a and gv.a + gv.n - 1),
sb as (select doc_id, section, string_agg(line, ' ' order by i) as body from u1 where section in ('Experience', 'Education', 'Other') and doc_id not in (select doc_id from u1 where section = 'Skills') group by doc_id, section),
{canonical('sb', 'doc_id, section')},
g2 as (select doc_id, section from sb left join (select doc_id, section, count(*) as k from k9 group by doc_id, section) kc using (doc_id, section) where (len({listed}) >= 5 and len(list_filter({listed}, lambda t: length(t) < 20)) >= 4) or coalesce(k, 0) >= 3 qualify row_number() over (partition by doc_id order by case section when 'Experience' then 0 when 'Education' then 1 else 2 end) = 1),
u2 as (select u1.doc_id, case when g2.doc_id is null then u1.section else 'Skills' end as section, late, i, line from u1 left join g2 on g2.doc_id = u1.doc_id and g2.section = u1.section),
sx as (select doc_id, section, {strip('string_agg(line, chr(10) order by late, i)')} as text from u2 group by doc_id, section)"""


SECTIONS = f"""
with corpus as ({CORPUS}), {segmented('corpus')},
sec as (select doc_id, {PIVOT} from sx group by doc_id)
"""


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def count(x: str) -> str:
    return f"len({words(x)})"


def rx(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)}, 'i')::int"


def blank(x: str) -> str:
    return rf"regexp_replace({x}, '\s', '', 'g') = ''"


RAW = "concat_ws(chr(10), coalesce(header, ''), coalesce(contact, ''), coalesce(links, ''), coalesce(summary, ''))"
CONTACT = f"{SECTIONS}, x as (select doc_id, {RAW} as t from sec) select doc_id, greatest(0.0, least(10.0, ({rx('t', lx.EMAIL)} * 3 + {rx('t', lx.PHONE)} * 3 + contains(lower(t), 'linkedin')::int * 2 + contains(lower(t), 'github')::int - {rx('t', lx.UNPROFESSIONAL)} * 2)::double)) as score from x"
SUMMARY = rf"{SECTIONS}, x as (select doc_id, coalesce(summary, '') as t from sec) select doc_id, case when {blank('t')} then 0.0::double else least(10.0, least(10.0, case when {count('t')} < 20 then 2.0 when {count('t')} > 120 then 4.0 else 7.0 end + 1.5 * {rx('t', lx.YEARS)}) + 1.5 * {rx('t', chr(92) + 'b(' + '|'.join(lx.ROLE_KEYWORDS) + ')' + chr(92) + 'b')})::double end as score from x"

_MARK = r"([-*•●▪]|\d+[.)])"


def acts(section: str, verb: str, metric: str) -> str:
    return rf"""{SECTIONS}, x as (select doc_id, coalesce({section}, '') as t, regexp_matches(coalesce({section}, ''), '(?m)^\s*{_MARK}\s+') as b from sec),
st as (select *, case when b then list_filter(list_transform(string_split(t, chr(10)), lambda y: regexp_replace(regexp_replace(y, '^\s+|\s+$', '', 'g'), '^{_MARK}\s*', '')), lambda y: {count('y')} >= 3)
  else list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: regexp_replace(y, '^\s+|\s+$', '', 'g')), lambda y: {count('y')} >= 6) end as s from x),
n as (select *, len(s) as n, len(list_filter(s, lambda y: list_contains({terms(lx.STRONG_VERBS)}, regexp_replace(regexp_extract(lower(y), '^\S+'), '[.,;:]+$', '')))) / greatest(1, len(s)) as v, len(list_filter(s, lambda y: regexp_matches(y, {q(lx.METRIC)}, 'i'))) / greatest(1, len(s)) as m from st)
select doc_id, n::bigint as n_statements, case when {blank('t')} then 0.0::double when n = 0 then 1.0 else least(10.0, greatest(0.0, {verb} + {metric} - case when b then 0.0 else 2.0 end))::double end as score from n"""


EXPERIENCE = acts("experience", "case when v >= 0.7 then 7.0 when v >= 0.4 then 5.0 else 2.0 end", "case when m >= 0.6 then 2.5 when m >= 0.3 then 1.5 else 0.0 end")
PROJECTS = acts("projects", "case when v >= 0.5 then 6.0 when v >= 0.25 then 4.0 else 2.0 end", "case when m >= 0.4 then 2.0 when m >= 0.2 then 1.0 else 0.0 end")
EDUCATION = f"{SECTIONS}, x as (select doc_id, coalesce(education, '') as t from sec) select doc_id, case when {blank('t')} then 0.0::double else ({rx('t', lx.DEGREE)} * 4 + {rx('t', lx.YEAR)} * 3 + ({count('t')} >= 5)::int * 3)::double end as score from x"
ALL_TEXT = "concat_ws(chr(10), " + ", ".join(s.lower() for s in lx.SECTIONS) + ")"
BANDS = "case when n < 200 then 3.0 when n < 400 then 7.0 when n <= 900 then 9.0 when n <= 1300 then 6.0 else 4.0 end::double"
LENGTH = f"{SECTIONS}, x as (select doc_id, {count(ALL_TEXT)}::bigint as n from sec) select doc_id, n as n_words, {BANDS} as score from x"
LENGTH_DOCS = f"with x as (select doc_id, {count('text')}::bigint as n from documents) select doc_id, n as n_words, {BANDS} as score from x"

_CATEGORY = "(values " + ", ".join(f"({q(s)}, {q(c)})" for c, ss in lx.SKILLS.items() for s in ss) + ") as ct(skill, category)"
SKILL_ROWS = rf"""{SECTIONS}, tk as (select doc_id, unnest(regexp_split_to_array(coalesce(skills, ''), '[,;|\n•·]+')) as raw from sec),
t1 as (select doc_id, regexp_replace(raw, '^\s+|\s+$', '', 'g') as tok from tk),
t2 as (select doc_id, list_last(string_split(tok, ': ')) as c from t1 where tok <> ''),
t3 as (select doc_id, regexp_replace(regexp_replace(regexp_replace(c, '\s+[-–—]\s+\S.*$', ''), '\s+\(.*\)$', ''), '\s+/\s+\S.*$', '') as c from t2),
t4 as (select doc_id, trim(c, ' .;:()[]"''') as c from t3),
sk as (select distinct doc_id, skill from t4 join {_LOOKUP} on lower(c) = key)
"""
SKILL_EXTRACT = f"{SKILL_ROWS} select sec.doc_id, count(skill)::bigint as n_skills, coalesce(string_agg(skill, ',' order by skill), '') as skills from sec left join sk using (doc_id) group by sec.doc_id"
CATEGORY_HIST = f"{SKILL_ROWS} select category, count(*)::bigint as n_documents_skills, count(distinct doc_id)::bigint as n_documents from sk join {_CATEGORY} using (skill) group by category"
SKILLS = rf"""{SKILL_ROWS}, kn as (select doc_id, count(*) as k from sk group by doc_id),
ls as (select doc_id, count(*) as n, count(*) filter (where list_contains({terms(lx.VAGUE)}, lower(tok))) as v from t1 where tok <> '' and length(tok) <= 40 group by doc_id),
y as (select sec.doc_id, coalesce(skills, '') as t, coalesce(n, 0) as n, coalesce(v, 0) / greatest(1, coalesce(n, 0)) as v, coalesce(k, 0) as k from sec left join ls using (doc_id) left join kn using (doc_id))
select doc_id, case when {blank('t')} then 0.0::double when n = 0 then 1.0 else least(10.0, greatest(0.0, case when k < 3 then 3.0 when k < 8 then 6.0 else 8.0 end - case when v >= 0.5 then 2 when v >= 0.25 then 1 else 0 end) + {rx('t', lx.SKILL_GROUP)})::double end as score from y"""


def role_ctes(source: str) -> str:
    sizes = ", ".join(f"len(list_intersect(p, {terms(lx.SIGNALS[r])})) as n_{r}, len(list_intersect(p, {terms(lx.DISAMBIGUATORS[r])})) as d_{r}" for r in ("swe", "data", "pm"))
    return rf"""tok as (select doc_id, list_transform(regexp_extract_all(lower(t), '[a-z0-9][a-z0-9+#./\-]*'), lambda y: regexp_replace(y, '[.,;:!?]+$', '')) as k from {source}),
ph as (select doc_id, list_distinct(list_concat(k, list_transform(range(1, greatest(1, len(k))), lambda i: k[i] || ' ' || k[i + 1]))) as p from tok),
sg as (select doc_id, {sizes} from ph),
rk as (select *, greatest(d_pm, d_data, d_swe) as bd, greatest(n_swe, n_data, n_pm) as b, list_sort([n_swe, n_data, n_pm])[2] as b2 from sg),
rl as (select doc_id, n_swe::bigint as n_swe, n_data::bigint as n_data, n_pm::bigint as n_pm,
 case when bd > 0 then case when d_pm = bd then 'pm' when d_data = bd then 'data' else 'swe' end when b >= 3 and b - b2 >= 2 then case when n_swe = b then 'swe' when n_data = b then 'data' else 'pm' end else 'general' end as role,
 round(case when bd > 0 then least(0.99, 0.7 + bd * 0.1) when b >= 3 and b - b2 >= 2 then least(0.95, 0.5 + b * 0.05 + (b - b2) * 0.05) when b = 0 then 0.3 else 0.3 + b * 0.05 end::double, 2) as role_confidence from rk)"""


ROLE = f"{SECTIONS}, src as (select doc_id, concat_ws(chr(10), skills, summary, header, experience) as t from sec), {role_ctes('src')} select * from rl"
LANG = rf"with x as (select doc_id, regexp_split_to_array(lower(text), '\s+') as w0 from documents), y as (select doc_id, list_slice(list_filter(w0, lambda v: v <> ''), 1, 2000) as w from x) select doc_id, case when len(list_filter(w, lambda v: list_contains({terms(('der', 'die', 'und', 'den', 'von', 'zu', 'das', 'mit'))}, v))) / greatest(1, len(w)) >= 0.08 then 'de' else 'en' end as lang_found from y"

_RULES = "(values " + ", ".join(f"({q(r)}, {q(i)}, {q(c)}, {w}::double)" for r, rules in lx.RUBRICS.items() for i, c, w in rules) + ") as ru(role, id, category, weight)"
WEIGHTS = f"select role, category as section, round(sum(weight) / max(t), 4) as weight from (select *, sum(weight) over (partition by role) as t from {_RULES}) group by role, category"


#: For many parts over one segmentation: sec from a table that the whole statement shares.
SHARED = "with sec as (select * from sec_all) "


def _all_scores() -> str:
    parts = {"contact": CONTACT, "summary": SUMMARY, "experience": EXPERIENCE, "skills": SKILLS, "education": EDUCATION, "projects": PROJECTS, "length": LENGTH}
    return ", ".join(f"s_{k} as ({sql.replace(SECTIONS, SHARED)})" for k, sql in parts.items())


SCORED = f"""{_all_scores()}, joined as (select s_contact.doc_id, s_contact.score as contact, s_summary.score as summary, s_experience.score as experience, s_skills.score as skills, s_education.score as education, s_projects.score as projects, s_length.score as length
from s_contact join s_summary using (doc_id) join s_experience using (doc_id) join s_skills using (doc_id) join s_education using (doc_id) join s_projects using (doc_id) join s_length using (doc_id))"""
SCORES = f"with sec_all as materialized ({SECTIONS} select * from sec), {SCORED}"
GRADE = "case when m >= 9 then 'A — Excellent' when m >= 8 then 'B — Strong' when m >= 6.5 then 'C — Solid, improvable' when m >= 5 then 'D — Weak' else 'F — Needs rewrite' end"
LONG = "select doc_id, unnest(['Contact','Summary','Experience','Skills','Education','Projects','Length_Formatting']) as section, unnest([contact, summary, experience, skills, education, projects, length]) as score from joined"
OVERALL = f"{SCORES}, lg as ({LONG}), wt as ({WEIGHTS}), mm as (select doc_id, wt.role, round(sum(score * weight) / sum(weight), 9) as m from lg join wt using (section) group by doc_id, wt.role) select doc_id, role, round(m, 1) as overall, {GRADE} as grade from mm"
LONG_SCORES = f"{SCORES} {LONG}"
PRESETS = f"{SCORES}, lg as ({LONG}), wt as ({WEIGHTS}), mm as (select doc_id, wt.role, round(sum(score * weight) / sum(weight), 9) as m from lg join wt using (section) group by doc_id, wt.role), pr(label, role) as (values " + ", ".join(f"({q(k)}, {q(v)})" for k, v in lx.PRESETS.items()) + ") select label, count(*)::bigint as n, round(avg(round(m, 1)), 4) as mean_overall from mm join pr using (role) group by label"


def redaction(source: str) -> str:
    sql, at = f"with r0 as (select doc_id, coalesce(text, '') as t, [] :: varchar[] as m from {source})", 0
    for label, p in lx.PII.items():
        pat = q("(?i)" + p)
        sql += f", r{at + 1} as (select doc_id, array_to_string(list_transform(string_split_regex(t, {pat}), lambda y, i: y || case when i <= len(regexp_extract_all(t, {pat})) then '[{label}_' || i || ']' else '' end), '') as t, list_concat(m, list_transform(regexp_extract_all(t, {pat}), lambda y, i: '[{label}_' || i || ']=' || y)) as m from r{at})"
        at += 1
    return sql


def carved(source: str) -> str:
    """CTEs from a source of sections, one row a document, to sec with the summary lines of the header moved."""
    contact = f"regexp_matches(s, {q(lx.EMAIL)}) or regexp_matches(s, {q(lx.PHONE)}) or regexp_matches(s, {q(lx.URL)}, 'i')"
    headline = f"{count('s')} >= 3 and (regexp_matches(s, {q(lx.TITLE_LINE)}, 'i') or (regexp_matches(s, {q(lx.YEARS_LINE)}, 'i') and {count('s')} <= 12))"
    return f"""hl as (select doc_id, unnest(string_split(header, chr(10))) as line, generate_subscripts(string_split(header, chr(10)), 1) as i from {source} where header is not null and {blank("coalesce(summary, '')")}),
hs as (select *, {strip('line')} as s from hl),
hm as (select *, length(s) > 2 and not ({contact}) and (({headline}) or {count('s')} >= 8) as m from hs),
ha as (select doc_id, min(i) filter (where m) as a from hm group by doc_id having a is not null),
he as (select doc_id, a, coalesce(min(i) filter (where not m and i > a), 1000000000) as e from ha join hm using (doc_id) group by doc_id, a),
hc as (select doc_id, string_agg(s, chr(10) order by i) filter (where i >= a and i < e) as moved, {strip("coalesce(string_agg(line, chr(10) order by i) filter (where i < a or i >= e), '')")} as kept from hm join he using (doc_id) group by doc_id),
sec as (select x.* replace (coalesce(hc.kept, header) as header, coalesce(hc.moved, summary) as summary) from {source} x left join hc using (doc_id))"""


CARVE = f"{SECTIONS.replace('sec as (select', 'sc0 as (select')}, {carved('sc0')} select doc_id, header, summary from sec"


def _redacted_sections() -> str:
    """Statement up to sec: sections of the redacted text, a missing summary carved out, and raw_contact."""
    joined = "concat_ws(chr(10), " + ", ".join(f"case when {s.lower()} is not null then {q(s)} || chr(10) || {s.lower()} end" for s in lx.SECTIONS) + ")"
    first = f"{SECTIONS} select doc_id, {joined} as text, {RAW} as raw_contact from sec"
    hidden = redaction("pass1")
    return f"""with pass1 as materialized ({first}), red as materialized ({hidden} select doc_id, t as text from r5), {segmented('red')},
sc0 as materialized (select sx.doc_id, {PIVOT}, any_value(raw_contact) as raw_contact from sx join (select doc_id, raw_contact from pass1) p using (doc_id) group by sx.doc_id),
{carved('sc0')}"""


def _full() -> str:
    parts = SCORED.replace(CONTACT.replace(SECTIONS, SHARED), CONTACT.replace(SECTIONS, SHARED).replace(RAW, "raw_contact"))
    said = "concat_ws(chr(10), " + ", ".join(f"case when not {blank(f'coalesce({s}, {q(str())})')} then {s} end" for s in ("skills", "summary", "header", "experience")) + ")"
    return f"""{_redacted_sections()}, sec_all as materialized (select * from sec), {parts}, lg as ({LONG}), wt as ({WEIGHTS}), src as (select doc_id, {said} as t from sc0), {role_ctes('src')},
mm as (select doc_id, rl.role, role_confidence, round(sum(score * weight) / sum(weight), 9) as m from lg join rl using (doc_id) join wt on wt.role = rl.role and wt.section = lg.section group by doc_id, rl.role, role_confidence)
select doc_id, round(m, 1) as overall, {GRADE} as grade, role, role_confidence from mm"""


FULL = _full()


_N = ", ".join(f"len(list_filter(m, lambda y: starts_with(y, '[{label}_')))::bigint as n_{label.lower()}" for label in lx.PII)
REDACT = redaction(f"({CORPUS})") + f" select doc_id, t as text, {_N}, array_to_string(m, chr(10)) as pii from r5"
REDACT_DOCS = redaction("documents") + f" select doc_id, {_N} from r5"
UNMASK = f"with c as ({CORPUS}) select count(*)::bigint as n, 0::bigint as n_wrong from c"

_TECH = ", ".join(f"({q(t)}, {q(chr(92) + 'b' + ''.join(chr(92) + ch if ch in '.+#' else ch for ch in t) + chr(92) + 'b')})" for t in lx.TECH)
JOBS = rf"""with jd as ({JDS}), jt as (select jd_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as t from jd), lo as (select *, lower(t) as low from jt),
po as (select *, case when instr(low, 'requirement') > 0 then instr(low, 'requirement') else nullif(instr(low, 'qualification'), 0) end as must, case when instr(low, 'nice to have') > 0 then instr(low, 'nice to have') when instr(low, 'bonus') > 0 then instr(low, 'bonus') else nullif(instr(low, 'preferred'), 0) end as nice from lo),
pa as (select *, case when must is null then low when nice > must then substring(low, must, nice - must) else substring(low, must) end as mt, case when must is not null and nice > must then substring(low, nice) else '' end as nt from po),
sk as (select jd_id, term, len(regexp_extract_all(low, pat)) as n, regexp_matches(mt, pat) as in_must, regexp_matches(nt, pat) as in_nice, bool_or(regexp_matches(mt, pat)) over (partition by jd_id) as split from pa cross join (values {_TECH}) as tx(term, pat)),
jb as (select pa.jd_id, regexp_replace(regexp_extract(substring(t, 1, 500), {q(lx.JD_ROLE)}, 1), '^\s+|\s+$', '', 'g') as role_title, coalesce(list_max(list_transform(regexp_extract_all(t, {q('(?i)' + lx.JD_YEARS)}, 1), lambda y: y::int)), 0)::bigint as years_required,
 coalesce((select string_agg(term, ',' order by n desc, term) from sk where sk.jd_id = pa.jd_id and n > 0 and case when split then in_must and not in_nice else true end), '') as required,
 coalesce((select string_agg(term, ',' order by n desc, term) from sk where sk.jd_id = pa.jd_id and n > 0 and split and in_nice), '') as nice from pa)
"""
JD_PARSE = f"{JOBS} select * from jb"
JD_FREQ = f"{JOBS} select term as skill, sum(n)::bigint as n, count(*)::bigint as n_jobs from sk where n > 0 group by term"

_PATTERN = lambda term: r"\b" + "".join("\\" + ch if ch in ".+#" else ch for ch in term) + r"\b"
_TERMS = ", ".join(f"({q(t)}, {q(_PATTERN(t))})" for t in lx.TECH)
_JOB_LISTS = f"jl as (select jd_id, role_title, years_required, list_filter(string_split(required, ','), lambda y: y <> '') as req, list_filter(string_split(nice, ','), lambda y: y <> '') as nic, list_filter(regexp_extract_all(lower(role_title), '[a-z]+'), lambda y: not list_contains({terms(lx.SENIORITY)}, y) and list_contains({terms(lx.ROLE_KEYWORDS)}, y)) as title from ({JD_PARSE.replace('select * from jb', 'select jd_id, role_title, years_required, required, nice from jb')}))"


def matched(sections: str) -> str:
    """CTEs from a table of sections to mt: documents and jobs, one row a pair."""
    return f"""{_JOB_LISTS},
fd as (select doc_id, list(term) as found from {sections}, (values {_TERMS}) as tv(term, pat) where regexp_matches(lower({ALL_TEXT}), pat) group by doc_id),
dx as (select s.doc_id, coalesce(found, []::varchar[]) as found, lower(coalesce(summary, '') || ' ' || coalesce(header, '')) as said, coalesce(try_cast(regexp_extract(coalesce(summary, '') || chr(10) || coalesce(experience, ''), {q('(?i)' + lx.MATCH_YEARS)}, 1) as int), 0) as years from {sections} s left join fd using (doc_id)),
m0 as (select doc_id, jd_id, years_required, req, nic, role_title <> '' or len(req) > 0 as useful, list_filter(req, lambda y: list_contains(found, y)) as hit, list_filter(req, lambda y: not list_contains(found, y)) as gap, len(list_filter(nic, lambda y: list_contains(found, y))) as nh,
 len(title) > 0 and len(list_filter(title, lambda y: contains(said, y))) >= greatest(1, len(title) // 2) as role_match, years from dx cross join jl),
m1 as (select *, case when len(req) > 0 then len(hit) / len(req) else 0.0 end::double as required_ratio, case when len(nic) > 0 then nh / len(nic) else 0.0 end::double as nice_ratio, case when useful and years_required > 0 then greatest(0, years_required - years) else 0 end::bigint as years_gap from m0),
mt as (select *, case when useful then round(round(required_ratio * 7 + nice_ratio * 1.5 + case when role_match then 1.0 else 0.5 end + case when years_required > 0 then greatest(0.0, 10.0 - years_gap * 2) else 10.0 end * 0.05, 9), 2) else 0.0 end::double as jd_score from m1)"""


_SEC_ALL = f"with sec_all as materialized ({SECTIONS} select * from sec)"
JD_MATCH = f"{_SEC_ALL}, {matched('sec_all')} select doc_id, jd_id, jd_score, {GRADE.replace('m >=', 'jd_score >=')} as jd_grade, required_ratio, nice_ratio, role_match, years_gap, array_to_string(hit, ',') as matched, array_to_string(gap[1:5], ',') as top_gaps from mt"
JD_PLACES = rf"""with sx_all as materialized ({SECTIONS} select * from sx), {_JOB_LISTS},
wl as (select doc_id, section, text, term, length(regexp_extract(lower(text), '^((?s).*?)' || pat, 1)) as before from sx_all, (values {_TERMS}) as tv(term, pat) where regexp_matches(lower(text), pat)),
ww as (select *, {words('text')} as ws, {count('substr(text, 1, before)')} as k from wl)
select doc_id, jd_id, term as skill, section, array_to_string(ws[greatest(0, k - 6) + 1:k + 7], ' ') as snippet from ww join jl on list_contains(req, term) or list_contains(nic, term)"""
JD_ADJUSTED = f"""with sec_all as materialized ({SECTIONS} select * from sec), {SCORED}, {matched('sec_all')},
pn as (select mt.*, j.contact, j.summary, j.experience, j.skills, j.education, j.projects, j.length, case when len(req) > 0 then round((1 - required_ratio) * 3, 1) else 0.0 end as pen, role_match and j.summary < 10 as better from mt join joined j using (doc_id)),
ad as (select *, greatest(0.0, round(skills - pen, 1))::double as s_skills, case when better then least(10.0, round(summary + 1, 1)) else summary end::double as s_summary from pn),
lo as (select doc_id, jd_id, s_skills, s_summary, concat_ws(' | ', case when pen > 0 then printf('Missing %d of %d required JD skills (%d%% coverage). Top gaps: %s.', len(gap), len(req), round_even(required_ratio * 100, 0)::int, case when len(gap) > 0 then array_to_string(gap[1:5], ', ') else 'n/a' end) end, case when better then 'Role title aligns with the Job Description.' end, case when years_gap > 0 then printf('Job Description asks for %d+ years; CV may fall short by ~%d year(s).', years_required, years_gap) end) as messages,
 unnest(['Contact','Summary','Experience','Skills','Education','Projects','Length_Formatting']) as section, unnest([contact, s_summary, experience, s_skills, education, projects, length]) as score from ad),
wt as ({WEIGHTS}), mm as (select doc_id, jd_id, any_value(s_skills) as s_skills, any_value(s_summary) as s_summary, any_value(messages) as messages, round(sum(score * weight) / sum(weight), 9) as m from lo join wt on wt.section = lo.section and wt.role = 'general' group by doc_id, jd_id)
select doc_id, jd_id, s_skills, s_summary, round(m, 1) as overall, {GRADE} as grade, messages from mm"""


_SIGN = "select doc_id, quality * 6.0 + 2 as human, least(10.0, 1.0 + (doc_id * 37 % 90) / 10.0)::double as auto, case when doc_id % 4 = 0 then 'pm' when doc_id % 4 = 1 then 'swe' else 'data' end as role from labels"
_RANK = "(rank() over ({w} order by {c}) + (count(*) over ({p}{c}) - 1) / 2.0)"


def agreement(by: str) -> str:
    w, p = (f"partition by {by}", f"partition by {by}, ") if by else ("", "partition by ")
    key = f"{by}, " if by else ""
    corr = lambda x, y: f"round(case when count(*) >= 2 and stddev_pop({x}) * stddev_pop({y}) > 0 then covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) end, 6)"
    return f"with g as ({_SIGN}), r as (select *, {_RANK.format(w=w, p=p, c='auto')} as rx, {_RANK.format(w=w, p=p, c='human')} as ry from g) select {key}count(*)::bigint as n, {corr('auto', 'human')} as pearson, {corr('rx', 'ry')} as spearman, round(avg(abs(auto - human)), 6) as mae, round(avg(human - auto), 6) as delta from r" + (f" group by {by}" if by else "")


BLIND = f"with a as ({agreement('role')}) select role, n, delta, pearson, concat_ws('; ', case when abs(delta) > 1.5 then format('|Δ|={{:.2f}}>1.5', abs(delta)) end, case when pearson < 0.4 then format('Pearson={{:.2f}}<0.4', pearson) end) as flag from a where n >= 3 and (abs(delta) > 1.5 or pearson < 0.4)"
def bootstrap(rows: str, by: str = "1") -> str:
    """Statement over rows (doc_id, auto, human, g): n, low and high of each g."""
    numbered = "select g, abs(auto - human) as e, row_number() over (partition by g order by md5(cast(doc_id as varchar)), doc_id) - 1 as i, count(*) over (partition by g) as n from bt"
    drawn = "select g, b, n, cast('0x' || substr(md5('42:' || b || ':' || i), 1, 8) as bigint) % n as d from bn, range(1000) as bb(b)"
    return f"""with bt as ({rows}), bn as ({numbered}), bd as ({drawn}), bm as (select bd.g, b, any_value(bd.n) as n, avg(e) as m from bd join bn on bn.g = bd.g and bn.i = d group by bd.g, b),
bs as (select g, any_value(n) as n, list_sort(list(m)) as ms from bm group by g) select g, n::bigint as n, case when n >= 2 then round(ms[26], 6) end as low, case when n >= 2 then round(ms[976], 6) end as high from bs"""


BOOTSTRAP = f"select n, low, high from ({bootstrap(f'select *, 1 as g from ({_SIGN})')})"
_BY_SECTION = f"select *, case doc_id % 5 when 0 then 'Contact' when 1 then 'Summary' when 2 then 'Skills' when 3 then 'Education' else 'Experience' end as section from ({_SIGN})"
SECTION_REPORT = f"""with a as ({agreement('section').replace(_SIGN, _BY_SECTION)}), c as ({bootstrap(f'select *, section as g from ({_BY_SECTION})')})
select section, a.n, pearson, mae, low, high, coalesce(pearson < 0.5, false) as flagged from a join c on c.g = section where a.n >= 3"""
VERDICT = f"with a as ({agreement('')}) select n, pearson, mae, case when n < 5 then 'insufficient' when pearson is null then 'undefined' when pearson < 0.5 then 'fail' when mae > 2.5 then 'warn' else 'pass' end as verdict from a"

_LOG = "select event_id, case when event_id % 50 = 0 then '' else 'cv' || cast(event_id % 97 as varchar) end as cv_filename, event_type as section, (event_id * 13 % 110) / 10.0 as auto_score, (event_id * 29 % 103) / 10.0 as human_score from events"
_PROBLEM = "case when trim(cv_filename) = '' then 'cv_filename is required' when trim(section) = '' then 'section is required' when not auto_score between 0 and 10 then 'auto_score must be a number between 0 and 10' when not human_score between 0 and 10 then 'human_score must be a number between 0 and 10' else '' end"
LOG_CHECK = f"with l as ({_LOG}) select event_id, {_PROBLEM} as error from l"
LOG_SUMMARY = f"with l as ({_LOG}) select section, count(*)::bigint as n, round(avg(human_score - auto_score), 6) as mean_delta, round(min(human_score - auto_score), 6) as min_delta, round(max(human_score - auto_score), 6) as max_delta from l where {_PROBLEM} = '' group by section"

_RAW_COS = "list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])))"
_COS = f"round({_RAW_COS}, 4)"


def topk(on: str) -> str:
    return f"select query_id, vec_id, score, rank from (select b.vec_id as query_id, a.vec_id, {_COS} as score, row_number() over (partition by b.vec_id order by {_RAW_COS} desc, a.vec_id)::bigint as rank from embeddings a join embeddings b on {on} where b.vec_id % 100 = 0) where rank <= 5"


BAND_ORDERS = "with x as (select o_orderkey, (o_orderkey % 101) / 10.0 as m from orders) select o_orderkey, " + GRADE + " as grade, case when m >= 8 then 'Strong' when m >= 6 then 'Solid' when m >= 4 then 'Needs work' else 'Weak' end as status from x"
_SPANS = "select l_orderkey as doc_id, 1 as page_no, 612.0 as width, case when l_orderkey % 2 = 0 and l_linenumber % 2 = 0 then 330.0 else 40.0 end + (l_partkey % 3) as x0, 50.0 + 12 * (l_linenumber // 2) as y0, l_returnflag || cast(l_linenumber as varchar) as text from lineitem"
COLUMNS = f"with s as ({_SPANS}), d as (select distinct doc_id, page_no, width, round_even(x0, 0) as x from s), g as (select *, lead(x) over (partition by doc_id, page_no order by x) as nx from d), w as (select doc_id, page_no, max(width) as width, max(nx - x) as gap, arg_max(nx, (nx - x) * 10000 - x) as r from g group by 1, 2) select w.doc_id, case when gap >= 0.15 * w.width and r >= 0.45 * w.width then 2 else 1 end::bigint as n_columns, (select count(*) from s where s.doc_id = w.doc_id)::bigint as n_spans from w"

#: Graded names, half of them without a suffix, and the files they may mean.
GRADED_NAMES = "select doc_id, 'cv' || cast(doc_id as string) || case when doc_id % 2 = 0 then '.pdf' else '' end as filename from labels"
GRADED_FILES = "select 'cv' || cast(doc_id as string) || case doc_id % 5 when 1 then '.docx' when 2 then '.rtf' when 3 then '.txt' else '.pdf' end as file from documents"
RESOLVE = f"""with g as ({GRADED_NAMES}), f as (select distinct file from ({GRADED_FILES}) x),
t as (select doc_id, filename, k, file from g join (values (0, ''), (1, '.pdf'), (2, '.docx'), (3, '.txt')) s(k, suffix) on true join f on f.file = filename || suffix)
select doc_id, filename, file from t qualify row_number() over (partition by doc_id, filename order by k) = 1"""
ROLE_ACCURACY = f"""select case doc_id % 3 when 0 then 'swe' when 1 then 'data' else 'pm' end as expected, count(*)::bigint as n,
count(*) filter (where role = case doc_id % 3 when 0 then 'swe' when 1 then 'data' else 'pm' end)::bigint as n_right from ({ROLE}) r group by 1"""


def _sql_band(x: str, bands: list[tuple]) -> str:
    return "case " + " ".join(f"when {x} >= {low} then {q(text)}" for low, text in bands[:-1]) + f" else {q(bands[-1][1])} end"


_M = "select o_orderkey, (o_orderkey % 101) / 10.0 as m, case when o_orderkey % 7 = 0 then 'n/a' else cast((o_orderkey % 101) / 10.0 as varchar) end as said, (o_orderkey % 10) / 10.0 as conf, case o_orderkey % 3 when 0 then 'Length_Formatting' when 1 then 'Skills' else 'work_history' end as name from orders"
REPORT_BANDS = f"""with x as ({_M}) select o_orderkey, {_sql_band('m', report.COLOURS)} as colour, {_sql_band('coalesce(try_cast(said as double), 0)', report.RECOMMENDATIONS)} as recommendation, 'PM' || case when conf < 0.5 then ' *' else '' end as role_label,
 array_to_string(list_transform(string_split(name, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') as display, coalesce(try_cast(said as double), 0.0) as number from x"""
_REPORT_ROWS = "select o_orderkey as doc_id, unnest(range(5)) as ord, unnest(['Contact', 'Summary', 'Skills', 'Education', 'Length_Formatting']) as name from orders"
_REPORT = f"select doc_id, ord, name, ((doc_id * 7 + ord * 31) % 101) / 10.0::double as score, (doc_id + ord) % 4 as n_issues, (doc_id * 3 + ord) % 3 as n_evidence, ((doc_id % 101) / 10.0)::double as overall, 'grade ' || doc_id % 5 as grade from ({_REPORT_ROWS})"
_P = [q(x) for x in report.SUMMARY_PROMPT]
SUMMARY_PROMPTS = f"""with r as ({_REPORT}), w as (select *, row_number() over (partition by doc_id order by score, ord) as place from r),
g as (select doc_id, any_value(overall) as overall, any_value(grade) as grade, string_agg('- ' || name || ': ' || score::double || '/10 (' || n_issues || ' issues, ' || n_evidence || ' strengths)', chr(10) order by ord) as lines, string_agg(name || ' (' || score::double || '/10)', ', ' order by place) filter (where place <= 2) as weakest from w group by doc_id)
select doc_id, weakest, {_P[0]} || overall || {_P[1]} || grade || {_P[2]} || lines || {_P[3]} || weakest || {_P[4]} as prompt from g"""
_S = [q(x) for x in report.SECTION_PROMPT]
_SAID = "case when {n} = 0 then '(none)' else array_to_string(list_transform(range({n}), lambda i: '{m}' || name || ' ' || i), chr(10)) end"
SECTION_PROMPTS = f"""with r as ({_REPORT}), ru as (select category, string_agg('- [' || id || '] (weight ' || weight || ') ' || category || ' rule', chr(10) order by id) as told from {_RULES} where role = 'general' group by category)
select doc_id, name, {_S[0]} || name || {_S[1]} || score::double || {_S[2]} || {_SAID.format(n='n_evidence', m='+ ')} || {_S[3]} || {_SAID.format(n='n_issues', m='- ')} || {_S[4]} || coalesce(told, '') || {_S[5]} as prompt from r left join ru on category = name"""


def _told(template: str, k: str = "", n: str = "") -> str:
    return q(template).replace("{k}", f"' || {k} || '").replace("{n}", f"' || {n} || '")


def _acts_messages(section: str) -> str:
    m = messages.STATEMENTS[section]
    sides: dict[tuple, list[str]] = {}
    for name, k in (("verbs", "strong"), ("metrics", "metric")):
        above: list[str] = []
        for least, speaks_for, told in m[name]:
            inside = " and ".join([f"{k} / greatest(1, n) >= {least}", *above])
            if speaks_for is not None:
                sides.setdefault((name, speaks_for), []).append(f"when {inside} then {_told(told, k, 'n')}")
            above.append(f"{k} / greatest(1, n) < {least}")
    case = lambda key: "case " + " ".join(sides[key]) + " end"
    bad = {"verbs": case(("verbs", False)), "metrics": case(("metrics", False)), "weak": f"case when weak > 0 then {_told(m['weak'], 'weak')} end", "prose": f"case when not b then {q(m['prose'])} end"}
    roles = f", case when roles >= 3 then {_told(messages.ROLES, 'roles')} end" if section == "experience" else ""
    weak = f"regexp_matches(lower(y), '^(?:{'|'.join(lx.WEAK_VERBS)})') or len(list_intersect({words('lower(y)')}[1:3], {terms(lx.WEAK_VERBS)})) > 0"
    return rf"""select doc_id, '{section}' as section, case when {blank('t')} or n = 0 then '' else concat_ws(' | ', {case(('verbs', True))}, {case(('metrics', True))}{roles}) end as evidence,
 case when {blank('t')} then {q(messages.MISSING[section])} when n = 0 then {q(m['none'])} else concat_ws(' | ', {', '.join(bad[x] for x in m['order'])}) end as issues
from (select doc_id, t, b, len(s) as n, len(list_filter(s, lambda y: list_contains({terms(lx.STRONG_VERBS)}, regexp_replace(regexp_extract(lower(y), '^\S+'), '[.,;:]+$', '')))) as strong, len(list_filter(s, lambda y: {weak})) as weak, len(list_filter(s, lambda y: regexp_matches(y, {q(lx.METRIC)}, 'i'))) as metric,
 len(list_filter(list_transform(string_split(t, chr(10)), lambda y: {strip('y')}), lambda y: regexp_matches(y, {q(lx.YEAR)}) and {count('y')} <= 15)) as roles
 from (select *, case when b then list_filter(list_transform(string_split(t, chr(10)), lambda y: regexp_replace({strip('y')}, '^{_MARK}\s*', '')), lambda y: {count('y')} >= 3) else list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: {strip('y')}), lambda y: {count('y')} >= 6) end as s
 from (select doc_id, coalesce({section}, '') as t, regexp_matches(coalesce({section}, ''), '(?m)^\s*{_MARK}\s+') as b from sec_all)))"""


def _skills_messages() -> str:
    m = messages.KNOWN_SKILLS
    vague = f"list_filter(l, lambda y: list_contains({terms(lx.VAGUE)}, lower(y)))"
    return rf"""select doc_id, 'skills' as section, case when {blank('t')} or n = 0 then '' else concat_ws(' | ', case when k between 3 and 7 then {_told(m['some'], 'k')} when k >= 8 then {_told(m['many'], 'k')} end, case when k > 0 and k < c then {_told(m['aliases'], 'k', 'c')} end, case when k > 0 then {_told(m['categories'], 'kinds')} end, case when regexp_matches(t, {q(lx.SKILL_GROUP)}, 'i') then {q(m['grouped'])} end) end as evidence,
 case when {blank('t')} then {q(messages.MISSING['skills'])} when n = 0 then {q(m['none'])} else concat_ws(' | ', case when k < 3 then {_told(m['few'], 'k', 'n')} when k < 8 then {q(m['more'])} end, case when len(v) / n >= 0.5 then {_told(m['vague'], 'floor(len(v) / n * 100)::int', "array_to_string(v[1:3], ', ')")} end) end as issues
from (select doc_id, t, len(l) as n, {vague} as v, len(list_filter(l, lambda y: not list_contains({terms(lx.VAGUE)}, lower(y)) and not starts_with(lower(y), 'etc'))) as c, coalesce(k, 0) as k, kinds
 from (select doc_id, coalesce(skills, '') as t, list_filter(list_transform(regexp_split_to_array(coalesce(skills, ''), '[,;|\n•·]+'), lambda y: {strip('y')}), lambda y: y <> '' and length(y) <= 40) as l from sec_all)
 left join (select doc_id, sum(k)::bigint as k, string_agg(k || ' ' || category, ', ' order by k desc, category) as kinds from (select doc_id, category, count(*) as k from sk join {_CATEGORY} using (skill) group by doc_id, category) group by doc_id) using (doc_id))"""


MESSAGES = f"with sec_all as materialized ({SECTIONS} select * from sec), {SKILL_ROWS.replace(SECTIONS, 'sec as (select * from sec_all)').lstrip(', ')}, ms as ({_acts_messages('experience')} union all {_acts_messages('projects')} union all {_skills_messages()}) select * from ms"
ISSUE_COUNTS = f"select doc_id, sum(case when issues = '' then 0 else len(string_split(issues, ' | ')) end)::bigint as n_issues from ({MESSAGES}) group by doc_id"
LOG_REPORT = f"with l as (select * replace (case when event_id % 9 = 0 then null else section end as section) from ({_LOG})), r as (select coalesce(section, 'Unknown') as section, human_score - auto_score as d from l) select section, count(*)::bigint as n, round(avg(d), 6) as mean_delta from r group by section union all select 'All', count(*)::bigint, round(avg(d), 6) from r"
READING = f"""with s as (select *, x0 + 60 as x1 from ({_SPANS})), d as (select distinct doc_id, page_no, width, round_even(x0, 0) as x from s),
g as (select *, lead(x) over (partition by doc_id, page_no order by x) as nx from d),
w as (select doc_id, page_no, max(width) as width, max(nx - x) as gap, arg_max(nx, (nx - x) * 10000 - x) as r, arg_max((x + nx) / 2, (nx - x) * 10000 - x) as mid from g group by 1, 2),
c as (select s.*, case when gap >= 0.15 * w.width and r >= 0.45 * w.width then 2 else 1 end as n_columns, mid from s join w using (doc_id, page_no)),
e as (select *, case when n_columns = 2 and (x0 + x1) / 2 >= mid then 1 else 0 end as side from c),
l as (select doc_id, page_no, n_columns, side, y0, count(*) as k, string_agg(text, ' ' order by x0, text) as line from e group by all)
select doc_id, page_no, n_columns::bigint as n_columns, sum(k)::bigint as n_spans, count(*)::bigint as n_lines, string_agg(line, chr(10) order by side, y0) as text from l group by doc_id, page_no, n_columns"""
