"""Column functions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space of any script. Blanks and ASCII are tried first, which is several times faster than the whole set.
_SPACES = r"\s\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
WORD = rf"(?:[!-~]++(?:(?=[ \n])|[^{_SPACES}]*+)|(?![ \n])[^{_SPACES}]++)"
#: What strip() and blank() take as white space.
BLANKS = " \t\n\x0b\f\r"
#: Ends of lines other than \n, in ASCII and beyond.
_RARE_ENDS, _WIDE_ENDS = r"[\r\x0B\x0C\x1C\x1D\x1E]", r"[\x85\u2028\u2029]"


def bound(value: Column, f) -> Column:
    """f(value), with value evaluated once however often f reads it; functions over arrays evaluate each mention anew."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def words(text: Column) -> Column:
    """Runs without white space."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def has_words(text: Column, n: int) -> Column:
    """Whether there are n words or more, without counting the rest."""
    return text.rlike(rf"^[{_SPACES}]*+(?:{WORD}[{_SPACES}]++){{{n - 1}}}[^{_SPACES}]")


def blank(text: Column) -> Column:
    return strip(text) == ""


def lines(text: Column) -> Column:
    """Lines of a text without their ends; a last line that is empty is none."""
    # most texts have no end but \n, at which Java splits without a pattern
    rare = text.rlike(_RARE_ENDS) | ((F.octet_length(text) > F.length(text)) & text.rlike(_WIDE_ENDS))
    parts = F.when(rare, F.split(text, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]")).otherwise(F.split(text, "\n"))
    return bound(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(BLANKS))


def has(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    return text.rlike(("(?i)" if ignore_case else "") + pattern)


def one_of(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def tokens(text: Column) -> Column:
    """Lower-case technical tokens, without punctuation at their end."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9][a-z0-9+#./\-]*"), F.lit(0)), lambda t: F.rtrim(t, F.lit(".,;:!?")))


def phrases(found: Column) -> Column:
    """Distinct tokens and adjacent pairs; found must be a plain column, as it is read per element."""
    pairs = F.when(F.size(found) >= 2, F.transform(F.sequence(F.lit(0), F.size(found) - 2), lambda i: F.concat_ws(" ", F.get(found, i), F.get(found, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.array_union(found, pairs)


def clamp(x: Column, low: float = 0.0, high: float = 10.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(F.lit(1), whole)
