"""SQL of any dialect to statements and tokens. Dialects differ in quotes, comments and blocks, which are options."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from arborlake.syntax.nodes import Node, settle


@dataclass(frozen=True)
class Options:
    dollar_quotes: bool = True
    block_comments: bool = True
    slash_comments: bool = False
    hash_comments: bool = False
    dash_comments: bool = True
    backticks: bool = True
    brackets: bool = False
    backslash_escapes: bool = False
    begin_end_blocks: bool = False
    anonymous_blocks: bool = False
    batches: bool = False


DIALECTS = {
    "standard": Options(dollar_quotes=False, backticks=False),
    "postgres": Options(backticks=False),
    "duckdb": Options(backticks=False),
    "mysql": Options(dollar_quotes=False, hash_comments=True, backslash_escapes=True, begin_end_blocks=True),
    "sqlite": Options(dollar_quotes=False, brackets=True, begin_end_blocks=True),
    "sqlserver": Options(dollar_quotes=False, backticks=False, brackets=True, begin_end_blocks=True, batches=True),
    "oracle": Options(dollar_quotes=False, backticks=False, begin_end_blocks=True, anonymous_blocks=True),
    "clickhouse": Options(dollar_quotes=True, hash_comments=True, backslash_escapes=True),
    "trino": Options(dollar_quotes=True, backticks=True),
    "cql": Options(slash_comments=True, batches=False),
    "spark": Options(dollar_quotes=False, backslash_escapes=True),
}

#: Reserved words that most dialects share.
KEYWORDS = frozenset(
    "all alter and any as asc asof begin between by case cast commit create cross current date declare default delete desc distinct drop else end escape except exists explain false fetch filter first following for from full function grant group grouping having if ilike in index inner insert intersect interval into is join lateral left like limit match materialized merge natural not null nulls offset on or order outer over partition pivot positional preceding primary procedure qualify range recursive references rename replace returning right rollback rollup row rows select semi set sets show table then ties time timestamp to top trigger true truncate unbounded union unique unpivot update using values view when where window with within".split()
)


@lru_cache(maxsize=64)
def _token(o: Options) -> re.Pattern:
    parts = [("space", rb"\s+")]
    if o.dash_comments:
        parts.append(("comment", rb"--[^\n]*"))
    if o.slash_comments:
        parts.append(("comment2", rb"//[^\n]*"))
    if o.hash_comments:
        parts.append(("comment3", rb"#[^\n]*"))
    if o.block_comments:
        parts.append(("comment4", rb"/\*.*?(?:\*/|\Z)"))
    esc = rb"(?:[^'\\]|''|\\.)*" if o.backslash_escapes else rb"(?:[^']|'')*"
    parts.append(("string", rb"(?:[eEbBxXnN]|[uU]&)?'" + esc + rb"(?:'|\Z)"))
    if o.dollar_quotes:
        parts.append(("string2", rb"\$(?P<tag>[A-Za-z_]\w*)?\$.*?(?:\$(?(tag)(?P=tag))\$|\Z)"))
    parts.append(("quoted", rb'"(?:[^"]|"")*(?:"|\Z)'))
    if o.backticks:
        parts.append(("quoted2", rb"`(?:[^`]|``)*(?:`|\Z)"))
    if o.brackets:
        parts.append(("quoted3", rb"\[(?:[^\]]|\]\])*(?:\]|\Z)"))
    parts += [
        ("number", rb"0[xX][0-9a-fA-F]+|(?:\d+(?:_\d+)*\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"),
        ("parameter", rb"\$\d+|\?\d*|[:@]\w+|@@\w+"),
        ("word", rb"[A-Za-z_\x80-\xff][\w$\x80-\xff]*"),
        ("open", rb"[(\[{]"),
        ("close", rb"[)\]}]"),
        ("end", rb";"),
        ("operator", rb"::|\|>|\|\||<=>|<=|>=|<>|!=|->>|->|=>|:=|<<|>>|\*\*|//|[-+*/%=<>!~^&|#@:]+?"),
        ("point", rb"[.,]"),
        ("other", rb"."),
    ]
    return re.compile(b"|".join(b"(?P<%s>%s)" % (n.encode(), p) for n, p in parts), re.S)


KIND = {"comment2": "comment", "comment3": "comment", "comment4": "comment", "string2": "string", "quoted": "quoted_identifier", "quoted2": "quoted_identifier", "quoted3": "quoted_identifier"}
CLOSING = {"(": ")", "[": "]", "{": "}"}


def parse_sql(source: bytes, options: Options | str = "standard") -> Node:
    """(source_file (statement token*)*): brackets nest, `;` ends a statement, in a BEGIN .. END block it does not."""
    o = DIALECTS[options] if isinstance(options, str) else options
    root = Node("source_file", 0, len(source))
    stack: list[tuple[Node, str | None]] = [(root, None)]
    depth = 0
    words: list[str] = []
    batch = re.compile(rb"[gG][oO][ \t]*(?=\r?\n|\Z)")

    def unwind(end: int):
        while len(stack) > 1:
            n, close = stack.pop()
            if close:
                n.add(Node(close, end, end, named=False, missing=True))
                n.end = end

    at = 0
    pattern = _token(o)
    while at < len(source):
        m = pattern.match(source, at)
        kind, s, e = m.lastgroup, at, m.end()
        if kind == "tag":
            kind = "string2"
        at = e
        if kind == "space":
            continue
        text = m[0]
        if o.batches and kind == "word" and (s == 0 or source[:s].rstrip(b" \t").endswith(b"\n")) and batch.match(source, s):
            unwind(root.children[-1].children[-1].end if root.children and root.children[-1].children else s)
            root.add(Node("batch_separator", s, e))
            depth = 0
            continue
        if len(stack) == 1:
            if kind.startswith("comment"):
                root.add(Node("comment", s, e, extra=True))
                continue
            if kind == "end":
                root.add(Node(";", s, e, named=False))
                continue
            stack.append((root.add(Node("statement", s, e)), None))
            words = []
        top = stack[-1][0]
        if kind == "word":
            low = text.decode("utf-8", "replace").lower()
            key = low in KEYWORDS
            top.add(Node("keyword" if key else "identifier", s, e))
            if len(stack) == 2:
                words.append(low)
            starts = low == "begin" and (o.anonymous_blocks and len(words) == 1 or o.begin_end_blocks and len(words) > 1) or low == "declare" and o.anonymous_blocks and len(words) == 1
            if starts and not (depth and words[0] == "declare" and low == "begin" and words.count("begin") == 1):
                depth += 1
            elif depth and low in ("case", "if", "loop", "while", "repeat") and (len(words) < 2 or words[-2] != "end") and low == "case":
                depth += 1
            elif depth and low == "end" and not re.compile(rb"\s+(?:if|loop|while|repeat)\b", re.I).match(source, e):
                depth -= 1
        elif kind == "open":
            n = top.add(Node("parenthesis", s, e))
            n.add(Node(text.decode(), s, e, named=False))
            stack.append((n, CLOSING[text.decode()]))
        elif kind == "close":
            if any(c == text.decode() for _, c in stack):
                while stack[-1][1] != text.decode():
                    n, c = stack.pop()
                    n.end = s
                    n.add(Node(c, s, s, named=False, missing=True))
                n, _ = stack.pop()
                n.add(Node(text.decode(), s, e, named=False))
                n.end = e
            else:
                top.add(Node("ERROR", s, e))
        elif kind == "end":
            if depth == 0:
                unwind(s)
                root.add(Node(";", s, e, named=False))
                continue
            top.add(Node(";", s, e, named=False))
        elif kind in ("operator", "point", "other"):
            top.add(Node(text.decode("utf-8", "replace"), s, e, named=False) if kind != "other" else Node("ERROR", s, e))
        else:
            k = KIND.get(kind, kind)
            top.add(Node(k, s, e, extra=k == "comment"))
        stack[1][0].end = e
    unwind(len(source.rstrip()) if len(stack) == 2 else len(source))
    return settle(root)


def statements(source: str, options: Options | str = "standard") -> list[str]:
    """The statements of a script, without their semicolons and outer comments."""
    data = source.encode("utf-8")
    return [data[n.start : n.end].decode("utf-8") for n in parse_sql(data, options).children if n.kind == "statement"]
