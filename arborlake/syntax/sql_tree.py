"""SQL as trees: the tokens of a statement grouped to clauses, relations, joins, calls and expressions.

Works on the token tree of syntax.sql and keeps every token, so that any text still gives a tree: what does not read as
a query stays a list of tokens. Dialects share the clauses; words that only some of them know are clauses in all.
"""

from __future__ import annotations

from arborlake.syntax.nodes import Node, settle
from arborlake.syntax.sql import parse_sql

#: Brackets within brackets that are grouped at most; deeper ones keep their tokens.
MOST_DEPTH = 150

# Words that begin clauses, tie queries, and make joins and operators.
CLAUSES = {
    "with": "with_clause", "select": "select_clause", "from": "from_clause", "where": "where_clause", "prewhere": "where_clause", "group": "group_by_clause", "having": "having_clause", "window": "window_clause",
    "qualify": "qualify_clause", "order": "order_by_clause", "limit": "limit_clause", "offset": "offset_clause", "fetch": "fetch_clause", "values": "values_clause", "insert": "insert_clause", "update": "update_clause",
    "delete": "delete_clause", "set": "set_clause", "returning": "returning_clause", "create": "create_clause",
}
OPENERS = frozenset("with select from values insert update delete create".split())
SETS = frozenset("union intersect except minus".split())
JOINS = frozenset("natural asof positional inner left right full outer cross semi anti any global lateral".split())
ORDERS = frozenset("asc desc nulls first last".split())
BINARY = {
    "or": 1, "and": 2, "=": 4, "==": 4, "<>": 4, "!=": 4, "<": 4, ">": 4, "<=": 4, ">=": 4, "<=>": 4, "is": 4, "like": 4, "ilike": 4, "rlike": 4, "in": 4, "between": 4, "similar": 4, "glob": 4,
    "||": 6, "|": 6, "&": 6, "->": 9, "->>": 9, "<<": 6, ">>": 6, "#": 6, "~": 6, "+": 7, "-": 7, "*": 8, "/": 8, "//": 8, "%": 8, "**": 9, "^": 9, "::": 11,
}
NOT, SIGN = 3, 10

#: Named kinds that the groups add.
GROUPS = frozenset([*CLAUSES.values(), *"select_item order_item group_item with_item relation join join_condition alias column_reference function_call window_definition binary_expression unary_expression case_expression set_operator query expression".split()])


class _Grouper:
    def __init__(self, source: bytes):
        self.source = source

    def word(self, n: Node) -> str:
        if n.kind in ("keyword", "identifier") or not n.named:
            return self.source[n.start : n.end].decode("utf-8", "replace").lower()
        return ""

    def wrap(self, kind: str, nodes: list[Node], field: str | None = None) -> Node:
        return Node(kind, nodes[0].start, nodes[-1].end, nodes, field=field)

    # -- queries

    def body(self, nodes: list[Node], depth: int) -> list[Node]:
        """The tokens of a statement, or between brackets, grouped."""
        if depth > MOST_DEPTH or not nodes:
            return nodes
        first = next((n for n in nodes if not n.extra), None)
        if first is None or first.kind not in ("keyword", "identifier") or self.word(first) not in OPENERS:
            return self.listed(nodes, "expression", depth) if depth else nodes
        out: list[Node] = []
        at = 0
        while at < len(nodes):
            word = self.word(nodes[at]) if nodes[at].kind in ("keyword", "identifier") else ""
            if word in SETS:
                end = at + 1
                while end < len(nodes) and self.word(nodes[end]) in ("all", "distinct", "by", "name", "corresponding"):
                    end += 1
                out.append(self.wrap("set_operator", nodes[at:end]))
                at = end
                continue
            if word not in CLAUSES:
                out.append(nodes[at])
                at += 1
                continue
            end = at + 1
            while end < len(nodes) and not self.starts(nodes, end, word):
                end += 1
            out.append(self.clause(CLAUSES[word], nodes[at:end], depth))
            at = end
        return out

    def starts(self, nodes: list[Node], at: int, inside: str) -> bool:
        """Whether a clause or set operator starts there."""
        n = nodes[at]
        if n.kind not in ("keyword", "identifier"):
            return False
        word = self.word(n)
        if word in SETS:
            return True
        if word not in CLAUSES:
            return False
        after = self.word(nodes[at + 1]) if at + 1 < len(nodes) else ""
        before = self.word(nodes[at - 1])
        if before == "." or after == ".":
            return False
        if word in ("group", "order"):
            return after == "by"
        if word == "from":
            return before != "distinct"  # IS DISTINCT FROM
        if word == "with":
            return False
        if word == "set":
            return inside in ("update", "insert")
        if word == "values":
            return inside in ("insert", "with")
        if word in ("update", "delete", "insert", "create", "returning"):
            return inside == "with" or word == "returning"
        if word == "offset" or word == "window":
            return inside != "select" or word == "window" and after != ""
        return True

    def clause(self, kind: str, nodes: list[Node], depth: int) -> Node:
        head = 1
        while head < len(nodes) and self.word(nodes[head]) in {"select_clause": ("distinct", "all"), "group_by_clause": ("by",), "order_by_clause": ("by",), "with_clause": ("recursive",), "insert_clause": ("into", "overwrite")}.get(kind, ()):
            head += 1
        rest = nodes[head:]
        item = {"select_clause": "select_item", "returning_clause": "select_item", "group_by_clause": "group_item", "order_by_clause": "order_item", "with_clause": "with_item"}.get(kind)
        if item:
            rest = self.listed(rest, item, depth)
        elif kind in ("where_clause", "having_clause", "qualify_clause"):
            rest = [self.expression(rest, depth)] if rest else []
        elif kind == "from_clause":
            rest = self.relations(rest, depth)
        else:
            rest = [self.inside(n, depth) for n in rest]
        return self.wrap(kind, nodes[:head] + rest)

    def listed(self, nodes: list[Node], kind: str, depth: int) -> list[Node]:
        """The parts between commas as nodes of a kind; a part of one token that needs none stays alone in an expression list."""
        out: list[Node] = []
        part: list[Node] = []
        for n in [*nodes, None]:
            if n is None or not n.named and n.kind == ",":
                if part:
                    out.append(self.expression(part, depth) if kind == "expression" else self.item(kind, part, depth))
                part = []
                if n is not None:
                    out.append(n)
            else:
                part.append(n)
        return out

    def item(self, kind: str, nodes: list[Node], depth: int) -> Node:
        if kind == "with_item":
            done = [self.inside(n, depth) for n in nodes]
            if done[0].kind in ("identifier", "quoted_identifier"):
                done[0].field = "name"
            return self.wrap(kind, done)
        tail: list[Node] = []
        if kind == "order_item":
            while len(nodes) > 1 and self.word(nodes[-1]) in ORDERS:
                tail.insert(0, nodes[-1])
                nodes = nodes[:-1]
        elif kind == "select_item":
            nodes, tail = self.aliased(nodes)
        value = self.expression(nodes, depth)
        value.field = "value"
        return self.wrap(kind, [value, *tail])

    def aliased(self, nodes: list[Node]) -> tuple[list[Node], list[Node]]:
        """The nodes without their alias, and the alias."""
        last = nodes[-1]
        if last.kind in ("identifier", "quoted_identifier", "string") and len(nodes) > 1:
            if self.word(nodes[-2]) == "as" and len(nodes) > 2:
                last.field = "name"
                return nodes[:-2], [self.wrap("alias", nodes[-2:], "alias")]
            before = nodes[-2]
            plain = last.kind != "string" and (before.kind in ("identifier", "quoted_identifier", "parenthesis", "number", "string") or self.word(before) in ("end", "null", "true", "false"))
            if plain and self.word(before) not in BINARY and self.word(before) != "not":
                last.field = "name"
                return nodes[:-1], [self.wrap("alias", nodes[-1:], "alias")]
        return nodes, []

    def relations(self, nodes: list[Node], depth: int) -> list[Node]:
        out: list[Node] = []
        part: list[Node] = []
        at = 0

        def done(into: list[Node]):
            if part:
                into.append(self.relation(part[:], depth))
                part.clear()

        while at < len(nodes):
            word = self.word(nodes[at])
            end = at
            while end < len(nodes) and self.word(nodes[end]) in JOINS:
                end += 1
            if end < len(nodes) and self.word(nodes[end]) == "join" and (nodes[end].kind == "keyword"):
                done(out)
                own = nodes[at : end + 1]
                at = end + 1
                right: list[Node] = []
                while at < len(nodes) and self.word(nodes[at]) not in ("on", "using", "match_condition") and not self.joins(nodes, at) and not (not nodes[at].named and nodes[at].kind == ","):
                    right.append(nodes[at])
                    at += 1
                if right:
                    r = self.relation(right, depth)
                    r.field = "right"
                    own.append(r)
                while at < len(nodes) and self.word(nodes[at]) in ("on", "using", "match_condition"):
                    start = at
                    at += 1
                    while at < len(nodes) and self.word(nodes[at]) not in ("on", "using", "match_condition") and not self.joins(nodes, at) and not (not nodes[at].named and nodes[at].kind == ","):
                        at += 1
                    rest = nodes[start + 1 : at]
                    own.append(self.wrap("join_condition", [nodes[start], *([self.expression(rest, depth)] if rest else [])], "condition"))
                out.append(self.wrap("join", own))
                continue
            if not nodes[at].named and nodes[at].kind == ",":
                done(out)
                out.append(nodes[at])
            else:
                part.append(nodes[at])
            at += 1
            del word
        done(out)
        return out

    def joins(self, nodes: list[Node], at: int) -> bool:
        while at < len(nodes) and self.word(nodes[at]) in JOINS:
            at += 1
        return at < len(nodes) and self.word(nodes[at]) == "join"

    def relation(self, nodes: list[Node], depth: int) -> Node:
        nodes, tail = self.aliased(nodes)
        value = self.expression(nodes, depth)
        value.field = "value"
        return self.wrap("relation", [value, *tail])

    def inside(self, n: Node, depth: int) -> Node:
        """A bracket with what it holds grouped; other nodes as they are."""
        if n.kind == "parenthesis" and len(n.children) > 2 and depth < MOST_DEPTH:
            first, last = n.children[0], n.children[-1]
            closed = not last.named
            inner = n.children[1:-1] if closed else n.children[1:]
            own = self.body(inner, depth + 1)
            if own and own[0].kind in CLAUSES.values():
                own = [self.wrap("query", own)]
            n.children = [first, *own, *([last] if closed else [])]
        return n

    # -- expressions

    def expression(self, nodes: list[Node], depth: int) -> Node:
        """One node for the tokens: the operand or operation that they are, else an expression of tokens."""
        operands = self.operands(nodes, depth)
        if len(operands) == 1:
            return operands[0]
        if any(n.extra or n.error for n in operands):
            return self.wrap("expression", operands)
        return self.operations(operands) or self.wrap("expression", operands)

    def operands(self, nodes: list[Node], depth: int) -> list[Node]:
        """Names with their dots, calls with their arguments and windows, and cases each as one node."""
        out: list[Node] = []
        at = 0
        name = ("identifier", "quoted_identifier")
        while at < len(nodes):
            n = nodes[at]
            if self.word(n) == "case" and n.kind == "keyword":
                level, end = 0, at
                while end < len(nodes):
                    w = self.word(nodes[end])
                    level += (w == "case") - (w == "end")
                    end += 1
                    if not level:
                        break
                out.append(self.wrap("case_expression", [self.inside(x, depth) for x in nodes[at:end]]))
                at = end
                continue
            if n.kind in name or n.kind == "keyword" and at + 1 < len(nodes) and nodes[at + 1].kind == "parenthesis" and self.word(n) not in BINARY and self.word(n) not in ("not", "exists", "as", "from", "on", "using", "when", "then", "else", "over", "interval", "all", "any", "some"):
                end = at + 1
                while end + 1 < len(nodes) and not nodes[end].named and nodes[end].kind == "." and (nodes[end + 1].kind in (*name, "keyword") or nodes[end + 1].kind == "*"):
                    end += 2
                own = nodes[at:end]
                called = end < len(nodes) and nodes[end].kind == "parenthesis" and self.source[nodes[end].start : nodes[end].start + 1] == b"("
                if len(own) > 1:
                    own = [self.wrap("column_reference", own)]
                if called:
                    own[0].field = "name"
                    arguments = self.inside(nodes[end], depth)
                    arguments.field = "arguments"
                    call = [own[0], arguments]
                    end += 1
                    if end + 1 < len(nodes) and self.word(nodes[end]) in ("over", "filter") and nodes[end + 1].kind in ("parenthesis", *name):
                        call.append(self.wrap("window_definition", [nodes[end], self.inside(nodes[end + 1], depth)], "window"))
                        end += 2
                    out.append(self.wrap("function_call", call))
                else:
                    out += own
                at = end
                continue
            out.append(self.inside(n, depth))
            at += 1
        return out

    def operations(self, nodes: list[Node]) -> Node | None:
        """Operands and operators as a tree by precedence, left to right; None if they do not alternate."""
        values: list[Node] = []
        waiting: list[tuple[int, list[Node], bool]] = []  # precedence, the operator's tokens, whether it has a left side
        between = 0

        def apply() -> None:
            _, tokens, binary = waiting.pop()
            right = values.pop()
            right.field = "right" if binary else "operand"
            for t in tokens:
                t.field = "operator"
            if binary:
                left = values.pop()
                left.field = "left"
                values.append(self.wrap("binary_expression", [left, *tokens, right]))
            else:
                values.append(self.wrap("unary_expression", [*tokens, right]))

        wants = True
        k = 0
        while k < len(nodes):
            n = nodes[k]
            word = self.word(n) if not n.children else ""
            if wants:
                if word == "not" or not n.named and word in ("-", "+", "~"):
                    waiting.append((NOT if word == "not" else SIGN, [n], False))
                elif not n.named and not n.children and word not in ("*",):
                    return None
                else:
                    values.append(n)
                    wants = False
                k += 1
                continue
            tokens = [n]
            if word == "not" and k + 1 < len(nodes) and self.word(nodes[k + 1]) in ("in", "like", "ilike", "between", "similar", "rlike", "glob"):
                tokens.append(nodes[k + 1])
                word = self.word(nodes[k + 1])
            elif word == "is":
                while k + len(tokens) < len(nodes) - 1 and self.word(nodes[k + len(tokens)]) in ("not", "distinct", "from"):
                    tokens.append(nodes[k + len(tokens)])
            if word not in BINARY:
                return None
            level = BINARY[word]
            if word == "and" and between:
                between -= 1
                level = 5  # the second part of BETWEEN
            elif word == "between":
                between += 1
            while waiting and waiting[-1][0] >= level:
                apply()
            waiting.append((level, tokens, True))
            wants = True
            k += len(tokens)
        if wants or not values:
            return None
        while waiting:
            apply()
        return values[0] if len(values) == 1 else None


def parse_sql_tree(source: bytes, options="standard") -> Node:
    """parse_sql() with the tokens of each statement grouped."""
    root = parse_sql(source, options)
    g = _Grouper(source)
    for n in root.children:
        if n.kind == "statement":
            n.children = g.body(n.children, 0)
    return settle(root)
