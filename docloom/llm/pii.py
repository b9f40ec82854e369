"""Personal data by DataFrame functions alone.

Regular expressions propose spans, checksums (Luhn, mod 97) confirm them, and words nearby raise their scores, which
decides about the kinds that nothing else confirms. Matches come from regexp_extract_all and their places from the lengths
of what split leaves between them, so no text leaves the JVM. Patterns are written so that each run of characters is read
once: they start at a run's start or where the last match ended, and use possessive quantifiers. Sums over a text's matches
run in blocks, so that the work hardly grows faster than the number of matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import numbered, text_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")

_LOCAL = r"A-Za-z0-9._%+-"
#: Kind: pattern over the text.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Words that make a match of a kind likelier.
CONTEXT = {
    "email": ("mail", "email", "contact", "write", "reach"),
    "ip": ("ip", "address", "server", "host", "login"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "payment"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "cell", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security", "tax", "taxpayer"),
}
#: Score of a confirmed match without context, what context adds (up to 1), and the least score of a span.
BARE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
RAISE, LIMIT = 0.35, 0.5
#: Characters on either side in which context words count.
REACH = 40
#: Matches to a block of running sums.
BLOCK = 64


def _let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(values: Column) -> Column:
    """A non-empty array, a plain column or lambda variable, cut into blocks."""
    last = F.floor((F.size(values) - 1) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))


def _before(values: Column, join) -> Column:
    """For each whole number of an array, what join makes of all numbers before it, from 0; block by block."""
    none = F.array().cast("array<int>")

    def scan(v: Column, first: Column) -> Column:
        step = lambda a, x: F.struct(join(a["at"], x).alias("at"), F.array_append(a["out"], a["at"]).alias("out"))
        return F.aggregate(v, F.struct(first.alias("at"), none.alias("out")), step, lambda a: a["out"])

    def all_of(blocks: Column) -> Column:
        heads = scan(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), join)), F.lit(0))
        return _let(heads, lambda h: F.flatten(F.transform(blocks, lambda b, i: scan(b, F.get(h, i)))))

    return _let(values, lambda v: F.when(F.size(v) > 0, _let(_blocks(v), all_of)).otherwise(none))


FOUND = "array<struct<start:int,end:int,s:string,around:string>>"


def _found(text: Column, pattern: str, when: Column) -> Column:
    """FOUND: the leftmost non-overlapping matches, their text s, and up to REACH characters on either side."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def spans(h: Column, g: Column) -> Column:
        sizes = F.transform(h, lambda x, i: F.length(x) + F.length(F.get(g, i)))
        at = lambda b, i: F.get(b, i) + F.length(F.get(g, i))
        placed = _let(_before(sizes, lambda a, x: a + x), lambda b: F.transform(h, lambda x, i: F.struct(at(b, i).alias("start"), (at(b, i) + F.length(x)).alias("end"), x.alias("s"))))
        return _let(placed, lambda p: F.flatten(F.transform(_blocks(p), block)))

    def block(p: Column) -> Column:
        low = F.greatest(F.get(p, F.lit(0))["start"] - REACH, F.lit(0))
        part = F.substring(text, low + 1, F.element_at(p, -1)["end"] + REACH - low)
        near = lambda t, s: F.concat(F.substring(t, F.greatest(s["start"] - REACH, F.lit(0)) - low + 1, F.least(s["start"], F.lit(REACH))), F.lit(" "), F.substring(t, s["end"] - low + 1, F.lit(REACH)))
        return _let(part, lambda t: F.transform(p, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["s"].alias("s"), F.lower(near(t, s)).alias("around"))))

    return F.when(when & text.rlike(pattern), _let(hits, lambda h: _let(gaps, lambda g: spans(h, g)))).otherwise(F.array().cast(FOUND))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    value = lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)
    return F.aggregate(F.transform(each, lambda c, i: value(F.ascii(c) - 48, i)), F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number leaves 1 modulo 97, with its first four characters moved to the end."""
    moved = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    each = F.transform(F.filter(F.split(moved, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.aggregate(each, F.lit(0), lambda a, c: F.when(c < 58, (a * 10 + c - 48) % 97).otherwise((a * 100 + c - 55) % 97)) == 1


def _confirmed_by(kind: str):
    """Predicate over a span: the checksum or shape of its kind."""
    digits = lambda s: F.length(_digits(s["s"]))
    plain = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return {
        "ip": lambda s: F.forall(F.split(s["s"], r"\."), lambda p: (F.length(plain(p)) <= 3) & (F.substring(plain(p), 1, 3).cast("int") <= 255)),
        "card": lambda s: digits(s).between(12, 19) & luhn(_digits(s["s"])),
        "phone": lambda s: digits(s).between(9, 15),
        "iban": lambda s: mod97(s["s"]),
    }.get(kind, lambda s: F.lit(True))


def _confirmed(rank: int, kind: str) -> Column:
    """The spans of a kind that are confirmed and score enough, as SPAN."""
    near = lambda s: s["around"].rlike(r"(?<![a-z])(?:" + "|".join(CONTEXT[kind]) + r")(?![a-z])")
    score = lambda s: F.when(near(s), min(1.0, BARE[kind] + RAISE)).otherwise(BARE[kind])
    scored = F.transform(F.filter(f"_f_{kind}", _confirmed_by(kind)), lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), score(s).alias("score")))
    return F.filter(scored, lambda s: s["score"] >= LIMIT)


SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def find_pii(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Adds the column pii: accepted spans as array<struct<start,rank,end,kind,score>> by start, then kind as listed.

    Offsets count code points, end exclusive. Null and empty texts have none. A column pii that docs has is replaced;
    other columns may have any names.
    """
    plain, (own,) = numbered(docs, text_col)
    names = dict(zip(plain.columns, docs.columns, strict=True))
    kept = [c for c, name in names.items() if name.lower() != "pii"]
    return _with_spans(plain, own).select(*kept, "pii").toDF(*(names[c] for c in kept), "pii")


def in_context(spans: Column) -> Column:
    """How many spans have a context word nearby."""
    bare = F.create_map(*(F.lit(x) for pair in BARE.items() for x in pair))
    return F.size(F.filter(spans, lambda s: s["score"] > bare[s["kind"]]))


def _with_spans(docs: DataFrame, text_col: str) -> DataFrame:
    """find_pii() over numbered columns."""
    digit = F.col("_t").rlike("[0-9]")
    gate = {"email": F.instr("_t", "@") > 0, "ip": digit & (F.instr("_t", ".") > 0), "card": digit, "phone": F.instr("_t", "+") > 0, "iban": digit, "ssn": digit & (F.instr("_t", "-") > 0)}
    src = docs.withColumn("_t", text_of(text_col))
    src = src.withColumns({f"_f_{k}": _found(F.col("_t"), PATTERNS[k], gate[k]) for k in KINDS})
    return src.withColumn("pii", F.sort_array(F.concat(*(_confirmed(rank, kind) for rank, kind in enumerate(KINDS))))).drop("_t", *(f"_f_{k}" for k in KINDS))


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with each accepted span replaced by its kind in brackets; spans that overlap become one, of the first one's kind.

    Null stays null, texts without spans stay as they are, an empty table gives none and repeated rows repeat. Columns
    keep their names, which may be any.
    """
    plain, (own,) = numbered(docs, text_col)
    text = F.col(own)

    def pieces(p: Column, before: Column) -> Column:
        cuts = F.filter(F.transform(p, lambda s, i: F.struct(F.get(before, i).alias("a"), s["start"].alias("b"), s["kind"].alias("kind"))), lambda c: c["b"] >= c["a"])

        def block(cut: Column) -> Column:
            first = F.get(cut, F.lit(0))["a"]
            part = F.substring(text, first + 1, F.element_at(cut, -1)["b"] - first)
            shown = lambda t: F.transform(cut, lambda c: F.concat(F.substring(t, c["a"] - first + 1, c["b"] - c["a"]), F.lit("["), F.upper(c["kind"]), F.lit("]")))
            return _let(part, lambda t: F.array_join(shown(t), ""))

        joined = _let(cuts, lambda c: F.array_join(F.transform(_blocks(c), block), ""))
        return F.concat(joined, F.substring(text, F.array_max(F.transform(p, lambda s: s["end"])) + 1, F.length(text)))

    ends = lambda p: _before(F.transform(p, lambda s: s["end"]), lambda a, x: F.greatest(a, x))
    shown = _let(F.col("pii"), lambda p: _let(ends(p), lambda b: pieces(p, b)))
    return _with_spans(plain, own).withColumn(own, F.when(F.size("pii") > 0, shown).otherwise(text)).drop("pii").toDF(*docs.columns)
