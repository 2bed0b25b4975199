"""The tree query language: S-expression patterns with fields, captures, anchors, quantifiers, alternations and predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MOST_DEPTH, MOST_CAPTURES, MOST_NEGATED = 100, 3, 8


class QueryError(ValueError):
    """kind: syntax, node type, field, capture, structure or predicate; offset in bytes, row and column from 0."""

    def __init__(self, kind: str, text: str, offset: int, message: str):
        before = text.encode("utf-8")[:offset].decode("utf-8", "replace")
        self.kind, self.offset, self.message = kind, offset, message
        self.row, self.column = before.count("\n"), len(before.encode("utf-8")) - (before.encode("utf-8").rfind(b"\n") + 1)
        line = text.split("\n")[self.row] if text else ""
        super().__init__(f"{kind} error at {self.row + 1}:{self.column + 1}: {message}\n{line}\n{' ' * self.column}^")


@dataclass
class Item:
    """A node, group or alternation; parts are the children's patterns, the group's or the options."""

    form: str  # node, group, choice
    kind: str | None = None  # None: any
    named: bool | None = True  # None: either
    missing: bool = False
    supertype: str | None = None
    parts: list[Item] = field(default_factory=list)
    negated: list[str] = field(default_factory=list)
    fields: list[str] = field(default_factory=list)
    captures: list[str] = field(default_factory=list)
    quantifier: str = ""
    anchored: bool = False
    last_anchor: bool = False

    @property
    def exact(self) -> bool:
        return self.form == "node" and self.kind is None and self.named is None


@dataclass
class Predicate:
    name: str
    args: list[tuple[str, str]]  # ("capture" or "string", value)
    offset: int


@dataclass
class Pattern:
    item: Item
    predicates: list[Predicate]
    start: int
    end: int

    @property
    def rooted(self) -> bool:
        return self.item.form != "group" or len(self.item.parts) == 1 and self.item.parts[0].form == "node"

    def settings(self) -> dict[str, str | None]:
        """#set! keys of the pattern as a whole."""
        return {p.args[0][1]: (p.args[1][1] if len(p.args) > 1 else None) for p in self.predicates if p.name == "set!" and all(k == "string" for k, _ in p.args)}

    def assertions(self) -> list[tuple[bool, str]]:
        """#is? and #is-not?: (positive, property)"""
        return [(p.name == "is?", p.args[-1][1]) for p in self.predicates if p.name in ("is?", "is-not?")]

    def general(self) -> list[Predicate]:
        return [p for p in self.predicates if p.name not in TEXT and p.name not in ("set!", "is?", "is-not?")]


#: predicate: (compares with, negative, any)
TEXT = {f"{a}{n}{o}?": (o, bool(n), bool(a)) for a in ("", "any-") for n in ("", "not-") for o in ("eq", "match")} | {"any-of?": ("of", False, False), "not-any-of?": ("of", True, False)}

TOKEN = re.compile(r'\s+|;[^\n]*|"(?:[^"\\\n]|\\.)*"|@[\w.?!-]+|#[\w.?!-]+|![\w.-]+|[A-Za-z_][\w.-]*\s*:(?!:)|[\w][\w.?!-]*(?:/[\w.-]+)?|[()\[\].?*+_]')
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "0": "\0"}


def _string(token: str) -> str:
    return re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), token[1:-1])


class Query:
    """Compiled patterns. kinds, anonymous and fields are a language's names, checked where they are given."""

    def __init__(self, text: str, kinds: set[str] | None = None, anonymous: set[str] | None = None, fields: set[str] | None = None):
        self.text, self.kinds, self.anonymous, self.fields = text, kinds, anonymous, fields
        self.capture_names: list[str] = []
        self.patterns: list[Pattern] = []
        self._tokens = self._lex()
        self._at = 0
        while self._at < len(self._tokens):
            start = self._tokens[self._at][1]
            predicates: list[Predicate] = []
            item = self._item(0, predicates)
            while self._at < len(self._tokens) and self._peek() == "(" and self._peek(1).startswith("#"):
                predicates.append(self._predicate())
            self._check(predicates)
            while item.form == "group" and len(item.parts) == 1 and not (item.captures or item.quantifier or item.fields):
                item = item.parts[0]  # the brackets hold predicates alone
            end = self._tokens[self._at][1] if self._at < len(self._tokens) else len(text.encode("utf-8"))
            self.patterns.append(Pattern(item, predicates, start, end))

    def _fail(self, kind: str, message: str, offset: int | None = None):
        at = offset if offset is not None else self._tokens[self._at][1] if self._at < len(self._tokens) else len(self.text.encode("utf-8"))
        raise QueryError(kind, self.text, at, message)

    def _lex(self) -> list[tuple[str, int]]:
        out, at, byte = [], 0, 0
        while at < len(self.text):
            m = TOKEN.match(self.text, at)
            if m is None:
                raise QueryError("syntax", self.text, byte, f"unexpected {self.text[at]!r}")
            if not m[0].isspace() and m[0][0] != ";":
                out.append((m[0], byte))
            at = m.end()
            byte += len(m[0].encode("utf-8"))
        return out

    def _peek(self, ahead: int = 0) -> str:
        k = self._at + ahead
        return self._tokens[k][0] if k < len(self._tokens) else ""

    def _next(self) -> str:
        if self._at >= len(self._tokens):
            self._fail("syntax", "unexpected end")
        self._at += 1
        return self._tokens[self._at - 1][0]

    def _kind(self, name: str, named: bool, offset: int) -> str:
        known = self.kinds if named else self.anonymous
        if known is not None and name not in known and name != "ERROR":
            self._fail("node type", f"no node {name}", offset)
        return name

    def _field(self, name: str, offset: int) -> str:
        if self.fields is not None and name not in self.fields:
            self._fail("field", f"no field {name}", offset)
        return name

    def _item(self, depth: int, predicates: list[Predicate]) -> Item:
        if depth > MOST_DEPTH:
            self._fail("structure", "nested too deep")
        offset = self._tokens[self._at][1] if self._at < len(self._tokens) else None
        t = self._next()
        if t == "[":
            item = Item("choice")
            while self._peek() != "]":
                item.parts.append(self._item(depth + 1, predicates))
            self._next()
            if not item.parts:
                self._fail("syntax", "an empty alternation", offset)
        elif t == "(":
            item = self._list(depth, predicates)
        elif t[0] == '"':
            item = Item("node", self._kind(_string(t), False, offset), False)
        elif t == "_":
            item = Item("node", None, None)
        elif t.endswith(":"):
            name = self._field(t[:-1].strip(), offset)
            item = self._item(depth + 1, predicates)
            item.fields.append(name)
            return item
        else:
            self._fail("syntax", f"unexpected {t!r}", offset)
        while True:
            t = self._peek()
            if t in ("?", "*", "+") and t:
                self._next()
                item.quantifier = t if not item.quantifier or item.quantifier == t else "*"
            elif t.startswith("@"):
                self._next()
                if len(item.captures) == MOST_CAPTURES:
                    self._fail("capture", "too many captures", self._tokens[self._at - 1][1])
                item.captures.append(t[1:])
                if t[1:] not in self.capture_names:
                    self.capture_names.append(t[1:])
            else:
                return item

    def _list(self, depth: int, predicates: list[Predicate]) -> Item:
        offset = self._tokens[self._at][1] if self._at < len(self._tokens) else None
        t = self._peek()
        if t in ("(", "[", ".") or t[:1] == '"' or t.endswith(":"):
            item = Item("group")
        elif t == "MISSING":
            self._next()
            item = Item("node", None, None, missing=True)
            if self._peek() != ")":
                own = self._next()
                item.kind, item.named = (_string(own), False) if own[0] == '"' else (own, True)
                self._kind(item.kind, item.named, offset)
        elif t == "_":
            self._next()
            item = Item("node", None, True)
        elif re.fullmatch(r"[\w][\w.?!-]*(?:/[\w.-]+)?", t):
            self._next()
            parent, _, own = t.rpartition("/")
            item = Item("node", self._kind(own, True, offset), True, supertype=parent or None)
        else:
            self._fail("syntax", f"unexpected {t!r}", offset)
        anchored = False
        while self._peek() != ")":
            t = self._peek()
            if t == ".":
                self._next()
                anchored = True
            elif t.startswith("!"):
                self._next()
                item.negated.append(self._field(t[1:], self._tokens[self._at - 1][1]))
                if len(item.negated) > MOST_NEGATED:
                    self._fail("structure", "too many negated fields")
            elif t == "(" and self._peek(1).startswith("#"):
                predicates.append(self._predicate())
            elif not t:
                self._fail("syntax", "unexpected end")
            else:
                part = self._item(depth + 1, predicates)
                part.anchored, anchored = anchored, False
                item.parts.append(part)
        if anchored:
            if item.form == "group" or not item.parts:
                self._fail("syntax", "an anchor at the end of a group")
            item.last_anchor = True
        self._next()
        if item.form == "group" and not item.parts:
            self._fail("syntax", "an empty group", offset)
        return item

    def _predicate(self) -> Predicate:
        self._next()
        offset = self._tokens[self._at][1]
        name, args = self._next()[1:], []
        while self._peek() != ")":
            t = self._next()
            args.append(("capture", t[1:]) if t[0] == "@" else ("string", _string(t) if t[0] == '"' else t))
        self._next()
        return Predicate(name, args, offset)

    def _check(self, predicates: list[Predicate]) -> None:
        for p in predicates:
            for kind, v in p.args:
                if kind == "capture" and v not in self.capture_names:
                    self._fail("capture", f"no capture @{v}", p.offset)
            if p.name in TEXT:
                op = TEXT[p.name][0]
                if op != "of" and len(p.args) != 2 or op == "of" and len(p.args) < 1:
                    self._fail("predicate", f"#{p.name} takes {'two arguments' if op != 'of' else 'a capture and strings'}, not {len(p.args)}", p.offset)
                if p.args[0][0] != "capture":
                    self._fail("predicate", f"the first argument of #{p.name} is a capture", p.offset)
                if op == "match":
                    if p.args[1][0] != "string":
                        self._fail("predicate", f"the second argument of #{p.name} is a string", p.offset)
                    try:
                        re.compile(p.args[1][1])
                    except re.error as e:
                        self._fail("predicate", f"bad expression: {e}", p.offset)
                if op == "of" and any(k != "string" for k, _ in p.args[1:]):
                    self._fail("predicate", f"#{p.name} takes strings after its capture", p.offset)
            elif p.name == "set!" and not 1 <= len(p.args) <= 3:
                self._fail("predicate", "#set! takes a key and a value", p.offset)

    def capture_quantifiers(self, index: int) -> dict[str, str]:
        """How often each capture of a pattern occurs in a match: one, ?, + or * (least and most are combined along the tree)."""

        def bounds(item: Item) -> dict[str, tuple[int, int]]:
            out: dict[str, tuple[int, int]] = {}
            if item.form == "choice":
                own = [bounds(p) for p in item.parts]
                for c in {c for o in own for c in o}:
                    out[c] = (min(o.get(c, (0, 0))[0] for o in own), max(o.get(c, (0, 0))[1] for o in own))
            else:
                for p in item.parts:
                    for c, (a, b) in bounds(p).items():
                        x, y = out.get(c, (0, 0))
                        out[c] = (min(1, x + a), min(2, y + b))
            for c in item.captures:
                x, y = out.get(c, (0, 0))
                out[c] = (1, min(2, y + 1))
            if item.quantifier:
                out = {c: (0 if item.quantifier in "?*" else a, b if item.quantifier == "?" else 2) for c, (a, b) in out.items()}
            return out

        names = {(1, 1): "one", (0, 1): "?", (1, 2): "+", (0, 2): "*"}
        return {c: names[v] for c, v in bounds(self.patterns[index].item).items()}
