import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from arborlake.llm import chat

PIECES = st.lists(st.sampled_from(["<", "[", "\\", "/", "s>", "INST]", "SYS]", "ROLE=", "ROLE]", " ", "a", "\n", "</s>", "[INST] ", " [/INST]", "é"]), max_size=8).map("".join)
TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a]b"]), PIECES), max_size=6)


@settings(max_examples=500, deadline=None)
@given(TURNS)
def test_round_trip(turns):
    whole, found, rewritten = chat.spans(turns, chat.inst_template)
    assert rewritten is None
    assert chat.read_back(whole) == turns
    assert [chat.unescape(whole[a:b]) for _, _, a, b in found] == [t for _, t in turns]
    assert "".join(whole[a:b] for a, b, _, _ in found) == whole


def test_escape_of_escaped():
    for t in ("[INST]", "[\\INST]", "[\\\\INST]", "</s>", "<\\/s>", "<s>"):
        assert chat.unescape(chat.escape(t)) == t and not chat.BARE.search(chat.escape(t))


def rewriting(turns):
    """Drops all but the last answer, as templates do that cut earlier reasoning."""
    last = max((k for k, (r, _) in enumerate(turns) if r == "assistant"), default=-1)
    return "".join(f"<{r}>{t if r != 'assistant' or k == last else ''}</{r}>" for k, (r, t) in enumerate(turns))


def test_templates_that_rewrite():
    turns = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    assert chat.spans(turns, rewriting)[2] == 3
    assert chat.spans(turns[:3], rewriting)[2] is None
    assert chat.spans(turns, lambda ts: f"{len(ts)}:" + str(ts))[2] == 1
    suffix = chat.spans(turns, lambda ts: "".join(f"[{r}]{t}" for r, t in ts))
    assert suffix[2] is None and [suffix[0][a:b] for _, _, a, b in suffix[1]] == ["a", "b", "c", "d"]


def want(rows):
    out = {}
    for c, t, r, x in sorted(rows, key=lambda z: tuple((v is not None, v) for v in z)):
        out.setdefault(c, []).append((r or "", x or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, ts in out.items():
        loss = "".join(x for r, x in ts if r == "assistant")
        yield c, len(ts), sha("".join(f"{r}\n{x}\n" for r, x in ts)), len(loss), sha(loss), len(chat.inst_template(ts))


def test_rows(spark):
    rows = [
        (1, 1, "assistant", "two"), (1, 0, "user", "one </s>"), (2, 0, "user", None), (2, 0, "user", None), (3, 0, None, "x"), (None, 0, "user", "n"), (None, 1, "assistant", ""),
        (4, None, "system", "s"), (4, 0, "assistant", "é" * 30000), (5, 0, "tool", "[ROLE=x]"), *[(6, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(150)],
    ]
    df = spark.createDataFrame([(c, t, r, x, "e", 1) for c, t, r, x in rows], "conv_id bigint, turn bigint, role string, text string, n_turns string, c int")
    got = sorted(map(tuple, chat.conversation_digests(df).collect()), key=str)
    assert got == sorted(want(rows), key=str)
    assert chat.conversation_digests(df.limit(0)).count() == 0
    full = chat.format_conversations(df).collect()
    assert all(r.rewritten_at is None for r in full)
    r = next(r for r in full if r.conv_id == 1)
    assert [r.formatted[t.text_start : t.text_end] for t in r.turns if t.loss] == ["two"]
    six = sorted((r for r in full if r.conv_id == 6), key=lambda r: r.part)
    assert "".join(r.formatted for r in six) == chat.inst_template([(a, b) for c, _, a, b in rows if c == 6])


def test_templates_with_history(spark):
    """Any template but a context-free one is given the whole history, however long."""

    def late(turns):
        """Rewrites turn 1 as soon as there are over 100 turns."""
        return "".join(f"<{r}>{'gone' if k == 1 and len(turns) > 100 else t}</{r}>" for k, (r, t) in enumerate(turns))

    def numbered(turns):
        """Numbers its turns and opens with a start mark."""
        return "<start>" + "".join(f"{k}:{r}={t};" for k, (r, t) in enumerate(turns))

    turns = [("assistant" if k % 2 else "user", f"turn {k}") for k in range(150)]
    df = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)] + [(2, k, r, t) for k, (r, t) in enumerate(turns[:100])], "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.format_conversations(df, late).collect()}
    assert got[1].rewritten_at == 100 and got[1].formatted == late(turns) and got[2].rewritten_at is None
    got = {r.conv_id: r for r in chat.format_conversations(df, numbered).collect()}
    assert got[1].rewritten_at is None and got[1].formatted == numbered(turns)
    assert [got[1].formatted[t.text_start : t.text_end] for t in got[1].turns] == [t for _, t in turns]
    assert chat.format_conversations(df, chat.inst_template).count() == 5
