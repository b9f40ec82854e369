"""Chat formatting by incremental black-box rendering.

The template is a function from turns to text and is never looked into. Successive prefixes are rendered and
compared: if one output extends the one before, the difference is the new turn's span; if not, the template has
rewritten history and the conversation says so. Where the text lies inside a span is found by rendering the last
turn with two other texts: what those outputs share at the start and end is the turn's frame.

Every prefix is rendered, however long a conversation is, as only that shows whether a template rewrites history:
the work grows with the square of a conversation's turns, its memory with their text. The template here remembers what
turns look like, so that a prefix costs it little more than the copying.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import batched, text_of

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

_CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_ROLE_CONTROL = re.compile(r"[\\:\n]|#(?=##)|<(?=/turn>)")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    """Put a backslash before backslashes and before whatever could begin a control string."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _tagged_turn(turn: Turn) -> str:
    role, text = turn
    return f"### {_ROLE_CONTROL.sub(lambda m: chr(92) + m[0], role)}: {escape(text)}</turn>\n"


class _Shown(dict):
    """Turns as tagged() shows them, emptied when they hold this many characters."""

    most, chars = 32_000_000, 0

    def __missing__(self, turn: Turn) -> str:
        shown = _tagged_turn(turn)
        if self.chars + len(shown) > self.most:
            self.clear()
            self.chars = 0
        self.chars += len(shown)
        self[turn] = shown
        return shown


_shown = _Shown()


def tagged(turns: list[Turn]) -> str:
    """The template of this module: '### Role: text</turn>' per turn, control strings inside texts escaped."""
    return "".join(map(_shown.__getitem__, turns))


def read_back(formatted: str) -> list[Turn]:
    """The turns of a tagged() output; raises ValueError if anything is left over."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _frame(template: Template, before: list[Turn], role: str) -> tuple[int, int]:
    """Characters around a last turn's text, counted from the end of the rendering before it and from the end."""
    one, other = (template([*before, (role, probe)]) for probe in ("A", "B"))
    head = len(os.path.commonprefix([one, other]))
    tail = len(os.path.commonprefix([one[::-1], other[::-1]]))
    return head - len(template(before)), tail


def render(template: Template, turns: list[Turn], escaped: Callable[[str], str] = escape) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """(formatted text, spans, rewrites history). A span: turn from, to, its text from, to; code points, end exclusive.

    Spans are empty lists where a template rewrites history at any turn, as no span would then be that turn's alone.
    """
    pieces, full = [], template([])
    for k in range(len(turns)):
        now = template(turns[: k + 1])
        if not now.startswith(full):
            return template(turns), [], True
        pieces.append(now[len(full) :])
        full = now
    spans, at, frames = [], len(full) - sum(map(len, pieces)), {}
    for k, ((role, text), piece) in enumerate(zip(turns, pieces, strict=True)):
        key = (role, k == 0)
        inner = escaped(text)
        for fresh in (False, True):
            if fresh or key not in frames:
                frames[key] = _frame(template, turns[:k], role)
            head, tail = frames[key]
            if piece[head : len(piece) - tail] == inner:
                break
        spans.append((at, at + len(piece), at + head, at + len(piece) - tail))
        at += len(piece)
    return full, spans, False


SPAN = "array<struct<role:string,start:long,end:long,text_start:long,text_end:long>>"


def format_conversations(rows: DataFrame, template: Template = tagged, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, spans, rewrites_history.

    Turns go by turn_col, then role and text where that ties; repeated rows are turns of their own. Null roles and
    texts count as empty; rows of a null conversation form one conversation. Rows reach a worker sorted, so that it
    holds one conversation at a time. Extra columns are ignored; an empty table gives no rows.
    """
    kind = pa.list_(pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64())]))

    def emit(done: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*done, strict=True)) or [[]] * 5
        types = [pa.int64(), pa.int64(), pa.string(), kind, pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["conv_id", "n_turns", "formatted", "spans", "rewrites_history"])

    def finish(conv: int | None, turns: list[Turn]) -> tuple:
        text, spans, rewrites = render(template, turns)
        named = [{"role": turns[k][0], "start": s[0], "end": s[1], "text_start": s[2], "text_end": s[3]} for k, s in enumerate(spans)]
        return conv, len(turns), text, named, rewrites

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turns, begun = None, [], False
        for batch in batches:
            done = []
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if begun and c != conv:
                    done.append(finish(conv, turns))
                    turns = []
                conv, begun = c, True
                turns.append((role, text))
            yield emit(done)
        if begun:
            yield emit([finish(conv, turns)])

    ordered = rows.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("t"), text_of(role_col).alias("r"), text_of(text_col).alias("x")).repartition("c").sortWithinPartitions("c", "t", "r", "x").select("c", "r", "x")
    return batched(ordered, run, f"conv_id long, n_turns long, formatted string, spans {SPAN}, rewrites_history boolean")


def digests(formatted: DataFrame) -> DataFrame:
    """Digest columns read back from the output of format_conversations() with the tagged() template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, n, text, spans, rewrites in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
                turns = read_back(text)
                for role, said in turns:
                    whole.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in spans:
                    if span["role"] == "assistant":
                        said = unescape(text[span["text_start"] : span["text_end"]])
                        loss.update(said.encode("utf-8", "surrogatepass"))
                        chars += len(said)
                out.append((conv, len(turns), whole.hexdigest(), chars, loss.hexdigest(), len(text), rewrites))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return batched(formatted, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean")
