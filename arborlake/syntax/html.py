"""HTML to a tree of elements. Tags that never close end with what holds them; stray end tags are kept as such."""

from __future__ import annotations

import re

from arborlake.syntax.nodes import Node, settle

TOKEN = re.compile(rb"<!--.*?(?:-->|\Z)|<![^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>?)", re.S)
ATTRIBUTE = re.compile(rb"([^\s=/>\"']+)(?:(\s*=\s*)(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
ENTITY = re.compile(rb"&(?:#\d+|#x[0-9a-fA-F]+|\w+);?")
RAW = {b"script": "script_element", b"style": "style_element"}
# Names of HTML.
VOID = frozenset(b"area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {b"li": {b"li"}, b"dt": {b"dt", b"dd"}, b"dd": {b"dt", b"dd"}, b"tr": {b"tr", b"td", b"th"}, b"td": {b"td", b"th"}, b"th": {b"td", b"th"}, b"option": {b"option"}}
CLOSE_P = frozenset(b"address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


def _attributes(tag: Node, source: bytes, start: int, end: int) -> None:
    for m in ATTRIBUTE.finditer(source, start, end):
        a = tag.add(Node("attribute", m.start(), m.end()))
        a.add(Node("attribute_name", m.start(1), m.end(1)))
        if m[3] is not None:
            s, e = m.span(3)
            a.add(Node("=", m.start(2) + m[2].index(b"="), m.start(2) + m[2].index(b"=") + 1, named=False))
            if m[3][:1] in b"\"'":
                q = a.add(Node("quoted_attribute_value", s, e))
                mark = chr(m[3][0])
                q.add(Node(mark, s, s + 1, named=False))
                if e - s > 2:
                    q.add(Node("attribute_value", s + 1, e - 1))
                q.add(Node(mark, e - 1, e, named=False))
            else:
                a.add(Node("attribute_value", s, e))


def _text(parent: Node, source: bytes, start: int, end: int) -> None:
    def plain(a: int, b: int):
        piece = source[a:b]
        s, e = a + len(piece) - len(piece.lstrip()), b - (len(piece) - len(piece.rstrip()))
        if s < e:
            parent.add(Node("text", s, e))

    at = start
    for m in ENTITY.finditer(source, start, end):
        plain(at, m.start())
        parent.add(Node("entity", m.start(), m.end()))
        at = m.end()
    plain(at, end)


def parse_html(source: bytes) -> Node:
    root = Node("document", 0, len(source))
    stack: list[tuple[Node, bytes]] = [(root, b"")]
    at = 0

    def leave(end: int):
        node, _ = stack.pop()
        node.end = max([end if not node.children else node.children[-1].end, node.end if node.children else end])

    while at < len(source):
        m = TOKEN.search(source, at)
        if m is None:
            _text(stack[-1][0], source, at, len(source))
            break
        _text(stack[-1][0], source, at, m.start())
        at = m.end()
        if m[2] is None:
            if m[0].startswith(b"<!--"):
                stack[-1][0].add(Node("comment", m.start(), at, extra=True))
            elif m[0][:9].lower() == b"<!doctype":
                d = stack[-1][0].add(Node("doctype", m.start(), at))
                d.add(Node("<!", m.start(), m.start() + 2, named=False))
                d.add(Node("doctype", m.start() + 2, m.start() + 9, named=False))
                if m[0].endswith(b">"):
                    d.add(Node(">", at - 1, at, named=False))
            else:
                stack[-1][0].add(Node("ERROR", m.start(), at))
            continue
        name = m[2].lower()
        if m[1]:
            tag = Node("end_tag", m.start(), at)
            tag.add(Node("</", m.start(), m.start() + 2, named=False))
            tag.add(Node("tag_name", *m.span(2)))
            if m[4]:
                tag.add(Node(">", at - 1, at, named=False))
            if any(n == name for _, n in stack):
                while stack[-1][1] != name:
                    leave(m.start())
                stack[-1][0].add(tag)
                stack[-1][0].end = at
                stack.pop()
            else:
                tag.kind = "erroneous_end_tag"
                tag.children[1].kind = "erroneous_end_tag_name"
                stack[-1][0].add(tag)
            continue
        closes = CLOSES.get(name, set()) | ({b"p"} if name in CLOSE_P else set())
        while stack[-1][1] in closes:
            leave(m.start())
        own_end = m[3].rstrip().endswith(b"/")
        tag = Node("self_closing_tag" if own_end else "start_tag", m.start(), at)
        tag.add(Node("<", m.start(), m.start() + 1, named=False))
        tag.add(Node("tag_name", *m.span(2)))
        _attributes(tag, source, m.start(3), m.end(3) - (1 if own_end else 0))
        if m[4]:
            tag.add(Node("/>" if own_end else ">", at - (2 if own_end else 1), at, named=False))
        element = stack[-1][0].add(Node(RAW.get(name, "element"), m.start(), at, [tag]))
        if own_end or name in VOID:
            continue
        if name in RAW:
            close = re.compile(rb"</" + re.escape(name) + rb"\s*>", re.I).search(source, at)
            end = close.start() if close else len(source)
            if end > at:
                element.add(Node("raw_text", at, end))
            if close:
                t = element.add(Node("end_tag", close.start(), close.end()))
                t.children = [Node("</", close.start(), close.start() + 2, named=False), Node("tag_name", close.start() + 2, close.start() + 2 + len(name)), Node(">", close.end() - 1, close.end(), named=False)]
            at = element.end = close.end() if close else len(source)
            continue
        stack.append((element, name))
    while len(stack) > 1:
        leave(len(source))
    return settle(root)
