"""JSON to a tree. What can't be read becomes an ERROR node; a bracket that isn't closed becomes a MISSING one."""

from __future__ import annotations

import re

from arborlake.syntax.nodes import Node, settle

SPACE = re.compile(rb"[ \t\r\n\f\xc2\xa0]*")
TOKEN = re.compile(rb'("(?:[^"\\\n]|\\.)*"|-?(?:0x[0-9a-fA-F]+|\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)|true|false|null|//[^\n]*|/\*.*?\*/|[{}\[\],:])[ \t\r\n\f\xc2\xa0]*', re.S)
ESCAPE = re.compile(rb"\\(?:u[0-9a-fA-F]{4}|.)", re.S)
VALUE = ("_value",)


def _string(s: int, e: int, source: bytes) -> Node:
    own = [Node('"', s, s + 1, [], False)]
    if e - s > 2:
        body = Node("string_content", s + 1, e - 1)
        if source.find(b"\\", s, e) >= 0:
            body.children = [Node("escape_sequence", m.start(), m.end()) for m in ESCAPE.finditer(source, s + 1, e - 1)]
        own.append(body)
    own.append(Node('"', e - 1, e, [], False))
    return Node("string", s, e, own, True, None, False, False, VALUE)


def parse_json(source: bytes) -> Node:
    """(document value*), where object holds pairs of key and value."""
    root = Node("document", 0, len(source))
    stack = [root]
    broken = False  # whether spans have to be settled
    at = SPACE.match(source, 3 if source.startswith(b"\xef\xbb\xbf") else 0).end()

    def put(node: Node):
        nonlocal broken
        top = stack[-1]
        if top.kind == "pair":
            top.add(node, "value")
            top.end = node.end
            if node.kind not in ("object", "array"):
                stack.pop()
            return
        if top.kind == "object" and node.kind in ("string", "number"):
            node.field = "key"
            pair = top.add(Node("pair", node.start, node.end, [node]))
            stack.append(pair)
            return
        if top.kind != "object":
            top.add(node)
        else:
            broken = True
            top.add(Node("ERROR", node.start, node.end, [node]))

    def close_pair():
        nonlocal broken
        if stack[-1].kind == "pair":
            pair = stack.pop()
            if not any(c.field == "value" for c in pair.children):
                at = max(pair.end, pair.children[-1].end)
                broken = True
                pair.children.append(Node("null", at, at, missing=True, field="value", supertypes=VALUE))

    while at < len(source):
        m = TOKEN.match(source, at)
        if m is None:
            bad = re.compile(rb"[^ \t\r\n{}\[\],:\"]+|\"[^\n]*").match(source, at)
            end = bad.end() if bad else at + 1
            stack[-1].add(Node("ERROR", at, end))
            at = SPACE.match(source, end).end()
            broken = True
            continue
        t, (s, e), at = m[1], m.span(1), m.end()
        if t in (b"{", b"["):
            n = Node("object" if t == b"{" else "array", s, e, supertypes=VALUE)
            n.add(Node(t.decode(), s, e, named=False))
            put(n)
            stack.append(n)
        elif t in (b"}", b"]"):
            close_pair()
            want = "object" if t == b"}" else "array"
            if any(n.kind == want for n in stack):
                while stack[-1].kind != want:
                    broken = True
                    n = stack.pop()
                    close = "}" if n.kind == "object" else "]"
                    n.end = s
                    n.add(Node(close, s, s, named=False, missing=True))
                    close_pair()
                n = stack.pop()
                n.add(Node(t.decode(), s, e, named=False))
                n.end = e
                if stack[-1].kind == "pair":
                    stack.pop().end = e
            else:
                broken = True
                stack[-1].add(Node("ERROR", s, e))
        elif t == b",":
            close_pair()
            broken = broken or stack[-1] is root
            stack[-1].add(Node(",", s, e, named=False) if stack[-1] is not root else Node("ERROR", s, e))
        elif t == b":":
            top = stack[-1]
            if top.kind == "pair" and len(top.children) == 1:
                top.add(Node(":", s, e, named=False))
                top.end = e
            else:
                broken = True
                top.add(Node("ERROR", s, e))
        elif t[:1] == b"/":
            broken = True
            stack[-1].add(Node("comment", s, e, extra=True))
        elif t[:1] == b'"':
            put(_string(s, e, source))
        else:
            kind = t.decode() if t in (b"true", b"false", b"null") else "number"
            put(Node(kind, s, e, [], True, None, False, False, VALUE))
    close_pair()
    broken = broken or len(stack) > 1
    while len(stack) > 1:
        n = stack.pop()
        if n.kind in ("object", "array"):
            n.add(Node("}" if n.kind == "object" else "]", len(source), len(source), named=False, missing=True))
        n.end = len(source)
        close_pair()
    return settle(root) if broken else root
