"""DuckDB SQL of those operators that SQL can express: chat formatting (3), personal data (7) and quality rules (8).

Written from the contracts rather than from the operators: matches are plain leftmost ones, word windows are compared
as text, and conversations are digested from their rows. Tokenisation, genetic search, model fitting, XXH64, seeded
search, guess costs and posterior bounds have no such form.
"""

from __future__ import annotations

from docloom.llm import pii, quality_rules

_BLANK = r"[\x20\x09-\x0D]+"
#: Conversation -7 of the query.
_EXTRA = r"select -7 as conv_id, unnest([0, 1]) as turn, unnest(['user', 'assistant']) as role, '\### Assistant: </turn> ok' as text"


def _escapes(x: str) -> str:
    """How many backslashes escaping puts into a text."""
    runs = f"coalesce(list_sum(list_transform(regexp_extract_all({x}, '#{{3,}}'), lambda m: length(m) - 2)), 0)"
    return rf"(len(regexp_extract_all({x}, '\\|</turn>')) + {runs})"


def chat() -> str:
    rows = f"select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from (select conv_id, turn, role, text from conversations union all {_EXTRA})"
    said = "coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')"
    shown = f"14 + length(role) + {_escapes('role')} + len(regexp_extract_all(role, '[:\\n]')) + length(text) + {_escapes('text')}"
    return f"""with r as ({rows}), c as (select conv_id, count(*) as n, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as whole, {said} as said, sum({shown}) as shown from r group by conv_id)
select conv_id, n::bigint as n_turns, sha256(whole) as turns_sha256, length(said)::bigint as loss_chars, sha256(said) as loss_sha256, shown::bigint as formatted_chars, false as rewrites_history from c"""


#: Kind: (pattern of the leftmost matches, which of these are proposed, which of the proposed are accepted); h: the match, d: its digits.
_LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: case when i % 2 = 1 then substr(reverse(d), i, 1)::int when substr(reverse(d), i, 1)::int > 4 then substr(reverse(d), i, 1)::int * 2 - 9 else substr(reverse(d), i, 1)::int * 2 end)) % 10 = 0"
_MOD97 = "list_reduce(list_transform(range(1, length(h) + 1), lambda i: ascii(substr(substr(h, 5) || substr(h, 1, 4), i, 1))::bigint), lambda a, c: case when c < 58 then (a * 10 + c - 48) % 97 else (a * 100 + c - 55) % 97 end, 0::bigint) = 1"
_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "true", "len(list_filter(string_split(h, '.'), lambda p: length(ltrim(p, '0')) > 3 or coalesce(try_cast(p as hugeint), 999) > 255)) = 0"),
    "card": (r"[0-9]([\x20-]?[0-9])+", "length(d) >= 12", f"length(d) <= 19 and {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "true", "length(d) between 9 and 15"),
    "iban": ("[A-Za-z0-9]+", "regexp_full_match(h, '[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}')", _MOD97),
    "ssn": ("[0-9-]+", "regexp_full_match(h, '[0-9]{3}-[0-9]{2}-[0-9]{4}')", "near"),
}


def personal_data() -> str:
    parts = []
    for rank, (kind, (pattern, shape, fits)) in enumerate(_KINDS.items()):
        cut = f"select rid, t, regexp_split_to_array(t, '{pattern}') as gs, regexp_extract_all(t, '{pattern}') as hs from d where regexp_matches(t, '{pattern}')"
        flat = f"select rid, t, unnest(range(1, len(gs) + 1)) as k, unnest(gs) as g, unnest(hs) as h from ({cut})"
        placed = f"select rid, t, h, regexp_replace(h, '[^0-9]', '', 'g') as d, (sum(length(g) + coalesce(length(h), 0)) over (partition by rid order by k))::bigint as e from ({flat})"
        shaped = f"select *, e - length(h) as s from ({placed}) where h is not null and {shape}"
        words = f"lower(substr(t, greatest(s - {pii.REACH}, 0) + 1, least({pii.REACH}, s)) || ' ' || substr(t, e + 1, {pii.REACH}))"
        near = f"regexp_matches({words}, '(^|[^a-z])({'|'.join(pii.CONTEXT[kind])})([^a-z]|$)')"
        parts.append(f"select rid, {rank} as rank, '{kind}' as kind, s, e, near from (select *, {near} as near from ({shaped})) where {fits}")
    base = ", ".join(f"'{k}'" for k in pii.BASE_KINDS)
    counts = ", ".join([*(f"count(*) filter (where kind = '{k}') as n_{k}" for k in pii.BASE_KINDS), "count(*) filter (where near) as n_in_context"])
    names = ", ".join(f"coalesce(n_{k}, 0)::bigint as n_{k}" for k in (*pii.BASE_KINDS, "in_context"))
    shown = "string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by s, rank)"
    return f"""with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents), f as ({" union all ".join(parts)}),
g as (select rid, {counts}, {shown} filter (where kind in ({base})) as base, {shown} as spans from f group by rid)
select doc_id, {names}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (rid)"""


def quality() -> str:
    bounds = []
    for _, top, bottom, low, high, least in quality_rules.THRESHOLDS:
        inside = " and ".join([f"{top} >= {low}::double * {bottom}"] * (low is not None) + [f"{top} <= {high}::double * {bottom}"] * (high is not None))
        bounds.append(f"(n_words < {least} or ({inside}))")
    stop = ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS)))
    gone = lambda pattern: f"(length(t) - length(regexp_replace(t, '{pattern}', '', 'g')))::bigint"
    return rf"""with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select rid, doc_id, t, list_filter(regexp_split_to_array(t, '{_BLANK}'), lambda x: x <> '') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
g as (select rid, i, ws[i:i + 4] as five from (select rid, ws, unnest(range(1, len(ws) - 3)) as i from w)),
m as (select rid, i from g qualify count(*) over (partition by rid, five) > 1),
r as (select rid, sum(new)::bigint as n_repeat_words from (select rid, least(5, coalesce(i - lag(i) over (partition by rid order by i), 5)) as new from m) group by rid),
q as (select doc_id, len(ws)::bigint as n_words, length(regexp_replace(t, '{_BLANK}', '', 'g'))::bigint as word_chars, {gone("[#*$%&|<>]")} as n_symbols, (len(ls) - list_unique(ls))::bigint as n_dup_lines,
 coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(ls)::bigint as n_lines, {gone(chr(92) + "p{Lu}")} as n_capitals, {gone("[|]")} as n_pipes, len(list_filter(ws, lambda x: list_contains([{stop}], lower(x))))::bigint as n_stop_words from w left join r using (rid)),
v as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from q)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {" and ".join(bounds)} as kept from v"""


ORACLES: dict[str, str] = {"op3_chat_formatting": chat(), "op7_pii": personal_data(), "op8_quality_rules": quality()}
