"""Rewritten history is found at any turn of a conversation of any length; odd tables."""

import pytest

from docloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, spans string, n_turns int"


def test_rewrites_are_found_at_every_turn():
    turns = [("user" if k % 2 else "assistant", f"text {k}") for k in range(130)]

    def template(first, last):
        return lambda shown: "".join(f"[{r}]{'...' if k == 0 and first <= len(shown) < last else x}\n" for k, (r, x) in enumerate(shown))

    plain = lambda s: s
    for first, last in ((70, 99), (129, 130), (3, 4), (66, 67)):
        assert chat.render(template(first, last), turns, plain)[2], (first, last)
    text, spans, rewrites = chat.render(template(500, 501), turns, plain)
    assert not rewrites and [text[c:d] for _, _, c, d in spans] == [x for _, x in turns] and spans[-1][1] == len(text)


def test_a_preamble_is_no_turn():
    text, spans, rewrites = chat.render(lambda shown: "<s>" + "".join(f"{r}:{x};" for r, x in shown), [("u", "a"), ("v", "bb")], lambda s: s)
    assert not rewrites and [text[a:b] for a, b, _, _ in spans] == ["u:a;", "v:bb;"] and [text[c:d] for *_, c, d in spans] == ["a", "bb"]


def test_long_conversations_and_memory(monkeypatch):
    monkeypatch.setattr(chat._shown, "most", 5000)
    turns = [("assistant", f"{k} </turn> " * (k % 9)) for k in range(1500)]
    text, spans, rewrites = chat.render(chat.tagged, turns)
    assert not rewrites and chat.read_back(text) == turns and len(spans) == 1500


@pytest.fixture(scope="module")
def rows():
    said = ["a", None, "", "x" * 200_000, "</turn>"]
    out = [(c, t, ["user", "assistant"][t % 2], said[(t + (c or 0)) % 5], "s", 9) for c in (1, None) for t in range(6)]
    return [*out, out[1], out[1], (1, None, "assistant", "no turn", "s", 9), (2, 0, None, None, None, None)]


def test_nulls_ties_repeats_and_clashing_names(spark, rows):
    got = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got.keys() == {1, None, 2}
    for c, r in got.items():
        mine = [(t, role or "", x or "") for k, t, role, x, _, _ in rows if k == c]
        want = [m[1:] for m in sorted(mine, key=lambda m: (m[0] is not None, m[0] or 0, m[1], m[2]))]
        assert chat.read_back(r["formatted"]) == want and r["n_turns"] == len(want)
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
