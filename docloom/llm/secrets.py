"""Secret scans: known shapes, and the guess cost of values in a credential context.

A value that follows a credential word is cut into words, dates, repeats, keyboard walks and brute-force spans by
dynamic programming for the least number of guesses. Every such value is costed; those that cost enough guesses are
reported, also where a known shape has found only their beginning.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import batched, text_of

#: Kinds as listed; spans at one start are in this order.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "guess")

ASSIGN = re.compile(r"(?ai:(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: A wider credential context: a name, an optional quote, a separator or 'is', and a value up to a blank or quote.
CONTEXT = re.compile(r"(?ai:(?<![a-z])(?:password|passwd|passphrase|pass|pwd|secret|token|api_?key|access_?key|private_?key|client_?secret|credentials?|auth|bearer)[\"']?(?:\x20*[:=]>?\x20*|\x20is\x20|\x20)([\"']?)([^\s\"'`,;<>]{8,}))")

#: Keyboard rows, for walks.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")
_LEET = str.maketrans("430157@$!", "aeoistasi")
#: log2 of the guesses for a date, and what each further segment costs.
DATE_BITS, SEGMENT_BITS = math.log2(366 * 130 * 4), 1.0


class Ranks(dict):
    """Words by rank, and the characters of the longest."""

    longest = 0

    def setdefault(self, word: str, rank: int) -> int:
        self.longest = max(self.longest, len(word))
        return super().setdefault(word, rank)


@lru_cache(maxsize=4)
def word_ranks(path: str | None) -> Ranks:
    """Words of a vocabulary file by rank, whole words only; without a file, the credential words alone."""
    words = ["password", "passwd", "secret", "token", "admin", "letmein", "welcome", "login", "master", "access", "changeme", "default", "example", "test", "user", "root"]
    if path:
        from tokenizers import Tokenizer

        vocabulary = sorted(Tokenizer.from_file(path).get_vocab().items(), key=lambda x: x[1])
        words += [w[: -len("</w>")] for w, _ in vocabulary if w.endswith("</w>") and len(w) >= 7 and w[:-4].isalpha()]
    ranks = Ranks()
    for w in words:
        ranks.setdefault(w.lower(), len(ranks) + 1)
    return ranks


@lru_cache(maxsize=1)
def _neighbours() -> set[tuple[str, str]]:
    pairs = {(a, b) for row in ROWS for a, b in zip(row, row[1:], strict=False)}
    columns = {(a, b) for up, down in zip(ROWS, ROWS[1:], strict=False) for a, b in zip(up[1:], down, strict=False)}
    return {p for a, b in pairs | columns for p in ((a, b), (b, a))}


def _symbol_bits(c: str) -> float:
    if c.isdigit():
        return math.log2(10)
    if c.isascii() and c.isalpha():
        return math.log2(26)
    return math.log2(33)


#: Values that cost fewer bits are guessed in seconds.
WEAK_BITS = 30.0
#: Characters of the longest unit that counts as repeated for a caller of guess_bits() that says nothing; scans take any.
UNIT = 8


def repeats(value: str, longest: float = math.inf) -> list[tuple[int, int, int]]:
    """Every (start, end, width) of a longest stretch that repeats its first width characters, at most longest, twice or more, the least width.

    Equal characters width apart are looked for at multiples of width only, one of which every such stretch has, so the
    work is n log n but where stretches are found. Stretches that a part of the unit repeats in are told once.
    """
    n, out, known = len(value), [], []
    for width in range(1, int(min(n // 2, longest)) + 1):
        known, at = [r for r in known if r[1] - r[0] > width], 0
        while at + width < n:
            if value[at] != value[at + width]:
                at += width
                continue
            end = next((e for s, e, w in known if width % w == 0 and s <= at and at + width < e), 0)
            if end:
                end -= width
            else:
                start, end = at, at + 1
                while start and value[start - 1] == value[start - 1 + width]:
                    start -= 1
                while end + width < n and value[end] == value[end + width]:
                    end += 1
                if end - start >= width:
                    out.append((start, end + width, width))
                    known.append(out[-1])
            at = max(at + width, -(-end // width) * width)
    return out


class Stretch:
    """The starts of segments that may end at any of a stretch's places, each at the logarithm of its length.

    A later start gains on an earlier one less and less the further the end. So one that isn't cheaper at its first end
    never is, and is left out; the others are all kept.
    """

    def __init__(self, least: int):
        self.least, self.starts = least, []

    def cheapest(self, j: int) -> float:
        return min((cost + math.log2(j - i) for i, cost in self.starts if j - i >= self.least), default=math.inf)

    def add(self, i: int, cost: float) -> None:
        j = i + self.least
        if all(cost + math.log2(self.least) < c + math.log2(j - k) for k, c in self.starts):
            self.starts.append((i, cost))


def guess_bits(value: str, ranks: Ranks, unit: float = UNIT) -> float:
    """log2 of the guesses that the cheapest segmentation of a whole value needs, with repeated units of at most unit characters."""
    n, low, longest = len(value), value.lower(), ranks.longest
    plain, near = low.translate(_LEET), _neighbours()
    best = [0.0] + [math.inf] * n

    def reach(i: int, j: int, bits: float) -> None:
        best[j] = min(best[j], best[i] + bits + (SEGMENT_BITS if i else 0.0))

    brute = [0.0]
    for c in value:
        brute.append(brute[-1] + _symbol_bits(c))
    mixed = 1.0 if any(c.isupper() for c in value) and any(c.islower() for c in value) else 0.0
    rows = [0] * n
    for k in range(1, n):
        rows[k] = rows[k - 1] + (ROWS_AT.get(low[k]) != ROWS_AT.get(low[k - 1]))
    begun: dict[int, list[tuple]] = {}  # by start: stretches as (end, width, starts by their place in the unit)
    for a, b, width in repeats(value, unit):
        least = 3 if width == 1 else 2 * width
        begun.setdefault(a, []).append((b, width, [Stretch(least) for _ in range(width)], a))
    a = 0
    for k in range(1, n + 1):
        if k == n or (low[k - 1], low[k]) not in near:
            if k - a >= 3:
                begun.setdefault(a, []).append((k, 0, [Stretch(3)], a))
            a = k
    inside: list[tuple] = []

    def stretched(i: int) -> None:
        """Ends segments of stretches at i, and begins others there."""
        for b, width, starts, a in inside:
            at = starts[(i - a) % width if width else 0]
            best[i] = min(best[i], at.cheapest(i) + (2.0 * rows[i - 1] if not width else -math.log2(width)))
        inside[:] = [x for x in inside if x[0] > i] + begun.get(i, [])
        own = best[i] + (SEGMENT_BITS if i else 0.0)
        for b, width, starts, a in inside:
            at = starts[(i - a) % width if width else 0]
            if i + at.least <= b:
                at.add(i, own + (brute[i + width] - brute[i] if width else math.log2(47) + 2.0 * (1 - rows[i + 1])))

    run = math.inf  # the cheapest segmentation that ends in a brute-force span, which a character at a time extends
    for i in range(n):
        stretched(i)
        run = min(run, best[i] + (SEGMENT_BITS if i else 0.0)) + brute[i + 1] - brute[i] + mixed * value[i].isalpha() * 0.8
        best[i + 1] = min(best[i + 1], run)
        for j in range(i + 3, min(n, i + longest) + 1):
            for form, more in ((low, 0.0), (plain, 2.0)):
                rank = ranks.get(form[i:j])
                if rank:
                    reach(i, j, math.log2(rank) + more + (0.0 if value[i:j].islower() else 1.0 if value[i : i + 1].isupper() and value[i + 1 : j].islower() else 3.0))
        m = _DATE.match(value, i)
        if m:
            reach(i, m.end(), DATE_BITS if len(m[0]) > 4 else math.log2(130))
    stretched(n)
    return best[n]


ROWS_AT = {c: r for r, row in enumerate(ROWS) for c in row}


Span = tuple[int, int, int, str, float | None]
Value = tuple[int, int, float]


def find_secrets(text: str, ranks: Ranks, **limits) -> list[Span]:
    """The spans of costed()."""
    return costed(text, ranks, **limits)[0]


def costed(text: str, ranks: Ranks, *, least_bits: float = 45.0, plain_bits: float = 70.0, shortest: int = 12) -> tuple[list[Span], list[Value]]:
    """Spans (start, rank of kind, end, kind, bits) by start, then kind as listed, and the costed values (start, end, bits).

    Offsets count code points. A guess is a context value of at least least_bits, or plain_bits if letters are all it has,
    that no known shape covers. Values are costed once each, at their own places.
    """
    out: list[Span] = []
    costs: dict[tuple[int, int], float] = {}
    if "=" in text or ":" in text:
        for m in ASSIGN.finditer(text):
            if len(m[1]) >= shortest:
                costs[m.span(1)] = guess_bits(m[1], ranks, math.inf)
                out.append((m.start(), 0, m.end(), "assign", costs[m.span(1)]))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), "access", None) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), "hex", None) for m in HEX.finditer(text)]
    out.sort(key=lambda s: s[:3])
    starts, reach = [s[0] for s in out], list(accumulate((s[2] for s in out), max))
    for m in CONTEXT.finditer(text):
        value = m[2].rstrip(".)")
        a, b = m.start(2), m.start(2) + len(value)
        before = bisect_right(starts, a)
        if before and reach[before - 1] >= b:
            continue
        bits = costs[a, b] = guess_bits(value, ranks, math.inf)
        if bits >= (plain_bits if value.isalpha() else least_bits):
            out.append((a, 3, b, "guess", bits))
    return sorted(out, key=lambda s: s[:3]), sorted((a, b, bits) for (a, b), bits in costs.items())


SPAN = "array<struct<kind:string,start:long,end:long,bits:double>>"
VALUE = "array<struct<start:long,end:long,bits:double>>"


def scan_secrets(docs: DataFrame, *, words_path: str | None = None, least_bits: float = 45.0, plain_bits: float = 70.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, spans (kind, start, end, bits) and values (start, end, bits).

    Kinds assign, access and hex are known shapes; guess is a value in a wider credential context that costs at least
    2**least_bits guesses, 2**plain_bits if it is all letters, and that no known shape covers. values has every value that
    was costed, weak ones too. Null and empty texts have neither; very long texts and values are read whole;
    repeated rows give repeated results, an empty table none; other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = word_ranks(words_path)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())]))
        cost = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())]))
        for batch in batches:
            found = [costed(t, ranks, least_bits=least_bits, plain_bits=plain_bits) for t in batch.column(1).to_pylist()]
            spans = [[{"kind": k, "start": a, "end": b, "bits": bits} for a, _, b, k, bits in s] for s, _ in found]
            values = [[{"start": a, "end": b, "bits": bits} for a, b, bits in v] for _, v in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind), pa.array(values, cost)], names=["doc_id", "spans", "values"])

    return batched(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), run, f"doc_id long, spans {SPAN}, values {VALUE}")
