"""Chat formatting by incremental black-box rendering.

A template is any function from turns to a string; nothing is known of its inside. The prefixes of a conversation are
rendered one turn after another. Where each output starts with the one before, what was added is the turn's span; a
template whose output does not is one that rewrites history, and the turn at which it did so is reported. Where the
text stands inside a span is found by rendering the turn once more with two texts that differ in their first
character. The loss mask covers the assistant's texts alone.
"""

from __future__ import annotations

import hashlib
import os.path
import re
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from arborlake.llm.common import read, small_batches

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
#: Turns that are rendered together where a template is declared to be context-free. A longer conversation is rendered
#: in windows, each headed by the last turn before it, so that time and memory stay in proportion to its length; its
#: windows are rows of their own. Any other template gets the whole history, at the cost of a square in its turns.
WINDOW = 64

#: The control strings of the template.
MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("", "</s>")}
CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\]|/?SYS\]|/?ROLE[=\]])")
ESCAPED = re.compile(r"([<\[])(\\*)\\(/?s>|/?INST\]|/?SYS\]|/?ROLE[=\]])")
BARE = re.compile(r"</s>|\[/?INST\]|\[/?SYS\]|\[/?ROLE[=\]]")


def escape(text: str) -> str:
    """One backslash more inside each control string, those already escaped included, so that none is left."""
    return CONTROL.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def context_free(template: Template) -> Template:
    """Declares that the template writes each turn without looking at others."""
    template.context_free = True
    return template


@context_free
def inst_template(turns: list[Turn]) -> str:
    """[SYS] .. [/SYS], [INST] .. [/INST] and the answer closed by </s>; any other role is named in its mark."""
    out = []
    for role, text in turns:
        a, b = MARKS.get(role) or (f"[ROLE={quote(role, safe='')}] ", " [/ROLE]")
        out.append(a + escape(text) + b)
    return "".join(out)


def read_back(formatted: str) -> list[Turn]:
    """The turns of inst_template()'s output."""
    out, at = [], 0
    while at < len(formatted):
        m = BARE.match(formatted, at)
        if m is None or m.group() == "</s>":  # no mark opens an answer
            role, start = "assistant", at
        elif m.group() == "[ROLE=":
            end = formatted.index("]", m.end())
            role, start = unquote(formatted[m.end() : end]), end + 2
        else:
            role, start = ("system" if "SYS" in m.group() else "user"), m.end() + 1
        close = BARE.search(formatted, start)
        if close is None:
            raise ValueError("a turn is not closed")
        out.append((role, unescape(formatted[start : close.start() - (role != "assistant")])))
        at = close.end()
    return out


def spans(turns: list[Turn], template: Template) -> tuple[str, list[tuple[int, int, int, int]], int | None]:
    """The whole output; for each turn its span and its text's span; the first turn that changed what came before, or None.

    Spans are of the whole output. They stand for turns up to a rewriting one; from there on they are empty.
    """
    before, found, rewritten = "", [], None
    for k in range(len(turns)):
        role, text = turns[k]
        now = template(turns[: k + 1])
        if not now.startswith(before):
            rewritten = k
            break
        one, other = (template([*turns[:k], (role, t)]) for t in ("\ue000", "\ue001"))
        start = len(os.path.commonprefix([one, other]))
        tail = len(one) - start - 1
        end = len(now) - tail
        found.append((len(before), len(now), start, end))
        before = now
    whole = template(turns)
    if rewritten is None and not whole == before:
        rewritten = len(turns)
    if rewritten is not None:
        found += [(0, 0, 0, 0)] * (len(turns) - len(found))
    return whole, found, rewritten


def _grouped(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[tuple[object, int, bool, Turn | None, list[Turn]]]:
    """(conversation, part, whether it ends there, the turn before, turns) from rows sorted by conversation and turn."""
    none = object()
    windowed = getattr(template, "context_free", False)
    conv, part, head, turns = none, 0, None, []
    for batch in batches:
        for c, role, text in zip(*[x.to_pylist() for x in batch.columns[:3]], strict=True):
            if c != conv or conv is none:
                if conv is not none:
                    yield conv, part, True, head, turns
                conv, part, head, turns = c, 0, None, []
            elif windowed and len(turns) == WINDOW:
                yield conv, part, False, head, turns
                part, head, turns = part + 1, turns[-1], []
            turns.append((role or "", text or ""))
    if conv is not none:
        yield conv, part, True, head, turns


def _window(head: Turn | None, turns: list[Turn], template: Template) -> tuple[str, list[tuple[int, int, int, int]], int | None]:
    """spans() of the turns, without the head that they were rendered behind."""
    if head is None:
        return spans(turns, template)
    whole, found, rewritten = spans([head, *turns], template)
    skip = found[0][1]
    return whole[skip:], [tuple(max(0, x - skip) for x in f) for f in found[1:]], None if rewritten is None else max(0, rewritten - 1)


def _sorted(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Conversations side by side; ties of the turn in order of role and text. Rows stream through, so that a long conversation needs no memory."""
    d = df.select(F.col(conv_col).alias("c"), F.col(role_col).alias("r"), F.col(text_col).alias("x"), F.col(turn_col).alias("t"))
    return d.repartition("c").sortWithinPartitions("c", "t", "r", "x")


def _mapped(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    kind = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def batches(it):
        rows = []
        size = 0
        for row in run(it):
            rows.append(row)
            size += sum(len(x) for x in row if isinstance(x, str))
            if len(rows) >= 256 or size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(v, x.type) for v, x in zip(zip(*rows), arrow)], schema=arrow)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, x.type) for v, x in zip(zip(*rows), arrow)], schema=arrow)

    return small_batches(df).mapInArrow(batches, kind)


def format_conversations(df: DataFrame, template: Template = inst_template, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, part, formatted, turns, rewritten_at): one row for a conversation; with a context-free template one for each 64 turns.

    turns: role, span, span of the text, and whether it counts for the loss. rewritten_at: the turn at which the
    template changed what it had written before, else null; any template but a context-free one is given all turns up
    to each, so that a conversation is held in memory whole. Null texts and roles count as empty. Turns with equal
    numbers go by role, then text; repeated rows stay. Rows without a conversation id are one conversation of null id.
    An empty table gives no rows.
    """

    def run(it):
        for conv, part, _, head, turns in _grouped(it, template):
            whole, found, rewritten = _window(head, turns, template)
            marks = [{"role": r, "start": f[0], "end": f[1], "text_start": f[2], "text_end": f[3], "loss": r == "assistant"} for (r, _), f in zip(turns, found)]
            yield conv, part, whole, marks, rewritten

    kind = df.schema[conv_col].dataType.simpleString()
    turn = "struct<role:string,start:int,end:int,text_start:int,text_end:int,loss:boolean>"
    return _mapped(_sorted(df, conv_col, turn_col, role_col, text_col), run, f"`{conv_col}` {kind}, part int, formatted string, turns array<{turn}>, rewritten_at int")


def conversation_digests(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """What the formatted conversations hold, read back from them, as digests: one row for each conversation."""

    def run(it):
        sha = hashlib.sha256
        n, n_chars, loss_chars, all_turns, loss = 0, 0, 0, sha(), sha()
        for conv, _, ends, head, turns in _grouped(it, inst_template):
            whole, found, rewritten = _window(head, turns, inst_template)
            if rewritten is not None:
                raise ValueError("the template rewrites history")
            for (role, text), (start, end, a, b) in zip(read_back(whole), found, strict=True):
                all_turns.update(f"{role}\n{text}\n".encode())
                n += 1
                if role == "assistant":
                    under = unescape(whole[a:b])
                    loss.update(under.encode())
                    loss_chars += len(under)
            n_chars += len(whole)
            if ends:
                yield conv, n, all_turns.hexdigest(), loss_chars, loss.hexdigest(), n_chars
                n, n_chars, loss_chars, all_turns, loss = 0, 0, 0, sha(), sha()

    kind = df.schema[conv_col].dataType.simpleString()
    return _mapped(_sorted(df, conv_col, turn_col, role_col, text_col), run, f"`{conv_col}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    say = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", say), (-7, 1, "assistant", say)], "conv_id bigint, turn bigint, role string, text string")
    return conversation_digests(rows.unionAll(more))


#: The contract's values from the rows themselves; formatted_chars is the template's and is summed from its marks.
ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS\]|/?ROLE[=\]])', '\1\2\\\3', 'g')) AS n FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + CASE role WHEN 'assistant' THEN 4 WHEN 'user' THEN 15 WHEN 'system' THEN 13 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
