"""Program text of curly-bracket languages, loosely: nested brackets over words, numbers, strings, comments and operators."""

from __future__ import annotations

import re

from arborlake.syntax.nodes import Node, settle

TOKEN = re.compile(rb"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\.)*`?|\d[\w.]*|[A-Za-z_$\x80-\xff][\w$\x80-\xff-]*|[{}()\[\]]|[;,.]|[^\s\w{}()\[\];,.\"'`]+", re.S)
PAIRS = {b"{": ("block", b"}"), b"(": ("arguments", b")"), b"[": ("brackets", b"]")}
KEYWORDS = frozenset(b"var let const function return if else for while do new class this null true false import export from of in typeof async await".split())
DECLARES = frozenset(b"var let const function class".split())


def parse_code(source: bytes) -> Node:
    root = Node("program", 0, len(source))
    stack: list[tuple[Node, bytes | None]] = [(root, None)]
    declares = False
    for m in TOKEN.finditer(source):
        t, s, e = m[0], m.start(), m.end()
        top = stack[-1][0]
        if t in PAIRS:
            kind, close = PAIRS[t]
            n = top.add(Node(kind, s, e))
            n.add(Node(t.decode(), s, e, named=False))
            stack.append((n, close))
        elif t in (b"}", b")", b"]"):
            if any(c == t for _, c in stack):
                while stack[-1][1] != t:
                    n, c = stack.pop()
                    n.end = s
                    n.add(Node(c.decode(), s, s, named=False, missing=True))
                n, _ = stack.pop()
                n.add(Node(t.decode(), s, e, named=False))
                n.end = e
            else:
                top.add(Node("ERROR", s, e))
        elif t[:2] in (b"//", b"/*"):
            top.add(Node("comment", s, e, extra=True))
        elif t[:1] in b"\"'`":
            top.add(Node("string", s, e, supertypes=("literal",)))
        elif t[:1].isdigit():
            top.add(Node("number", s, e, supertypes=("literal",)))
        elif t in KEYWORDS:
            top.add(Node(t.decode(), s, e, named=False))
            declares = t in DECLARES
            continue
        elif t[:1].isalpha() or t[:1] in b"_$" or t[0] > 127:
            top.add(Node("identifier", s, e, field="name" if declares else None))
        else:
            top.add(Node(t.decode("utf-8", "replace"), s, e, named=False))
        declares = False
    while len(stack) > 1:
        n, c = stack.pop()
        n.end = len(source)
        n.add(Node(c.decode(), len(source), len(source), named=False, missing=True))
    return settle(root)
