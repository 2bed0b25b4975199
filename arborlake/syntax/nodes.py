"""Syntax nodes: the tree that a parser builds, and its rows."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field

NODES_SCHEMA = (
    "layer_id int, language string, node_id int, parent_id int, last_desc int, ancestors array<int>, depth int, child_index int, named_child_index int, n_children int, n_named int, "
    "field string, kind string, supertypes array<string>, is_named boolean, is_extra boolean, is_missing boolean, is_error boolean, has_error boolean, "
    "start_byte int, end_byte int, start_row int, start_col int, end_row int, end_col int, text string"
)


@dataclass(slots=True)
class Node:
    """start and end are byte offsets. Children are in order and do not overlap."""

    kind: str
    start: int
    end: int
    children: list[Node] = field(default_factory=list)
    named: bool = True
    field: str | None = None
    extra: bool = False
    missing: bool = False
    supertypes: tuple[str, ...] = ()

    @property
    def error(self) -> bool:
        return self.kind == "ERROR"

    def add(self, node: Node, field: str | None = None) -> Node:
        if field is not None:
            node.field = field
        self.children.append(node)
        return node


COLUMNS = [f.strip().split(" ")[0] for f in NODES_SCHEMA.split(", ")]


def line_starts(source: bytes) -> list[int]:
    """The offsets at which lines begin."""
    lines, at = [0], source.find(b"\n")
    while at >= 0:
        lines.append(at + 1)
        at = source.find(b"\n", at + 1)
    return lines


def placed(shift: list[tuple[int, int]] | None, offset: int, end: bool = False) -> int:
    """The document's offset of one in a text that was put together from ranges; an end belongs to the range before it."""
    if shift is None:
        return offset
    k = max(0, bisect_right(shift, (offset - (1 if end and offset else 0), 1 << 62)) - 1)
    return offset - shift[k][0] + shift[k][1]


def columns(root: Node, source: bytes, layer: int, language: str, names: list[str] = COLUMNS, shift: list[tuple[int, int]] | None = None, wanted: frozenset[str] | None = None, document: bytes | None = None) -> list[list]:
    """The named columns of NODES_SCHEMA for the nodes in pre-order, or for those of the wanted kinds.

    shift: (offset in source, offset in the document) of each range that source was put together from; offsets, rows
    and columns are then the document's. Only what is named is built.
    """
    nodes: list[Node] = []
    parent: list[int | None] = []
    index: list[int] = []
    depth: list[int] = []
    todo: list[tuple[Node, int | None, int, int]] = [(root, None, 0, 0)]
    pop, push = todo.pop, todo.append
    while todo:
        node, above, at, level = pop()
        me = len(nodes)
        nodes.append(node)
        parent.append(above)
        index.append(at)
        depth.append(level)
        below = node.children
        for k in range(len(below) - 1, -1, -1):
            push((below[k], me, k, level + 1))
    keep = None if wanted is None else [k for k, n in enumerate(nodes) if n.kind in wanted]
    own = nodes if keep is None else [nodes[k] for k in keep]
    pick = lambda values: values if keep is None else [values[k] for k in keep]
    made: dict[str, list] = {}

    def last() -> list[int]:
        out = list(range(len(nodes)))
        for k in range(len(nodes) - 1, 0, -1):
            p = parent[k]
            if out[k] > out[p]:
                out[p] = out[k]
        return out

    def errors() -> list[bool]:
        out = [n.missing or n.kind == "ERROR" for n in nodes]
        for k in range(len(nodes) - 1, 0, -1):
            if out[k]:
                out[parent[k]] = True
        return out

    def ancestors() -> list[list[int]]:
        out: list[list[int]] = []
        for p in parent:
            out.append([] if p is None else [*out[p], p])
        return out

    def named_index() -> list[int | None]:
        out: list[int | None] = [None] * len(nodes)
        seen = [0] * len(nodes)
        for k in range(1, len(nodes)):
            if nodes[k].named:
                p = parent[k]
                out[k] = seen[p]
                seen[p] += 1
        return out

    def points(ends: bool) -> None:
        lines = line_starts(source if shift is None or document is None else document)
        rows, cols, prefix = [], [], "end" if ends else "start"
        for at in made[f"{prefix}_byte"]:
            row = bisect_right(lines, at) - 1
            rows.append(row)
            cols.append(at - lines[row])
        made[f"{prefix}_row"], made[f"{prefix}_col"] = rows, cols

    asked = set(names)
    n = len(own)
    for ends, prefix in ((False, "start"), (True, "end")):
        if asked & {f"{prefix}_byte", f"{prefix}_row", f"{prefix}_col"}:
            at = [x.end for x in own] if ends else [x.start for x in own]
            made[f"{prefix}_byte"] = at if shift is None else [placed(shift, o, ends) for o in at]
            if asked & {f"{prefix}_row", f"{prefix}_col"}:
                points(ends)
    build = {
        "layer_id": lambda: [layer] * n,
        "language": lambda: [language] * n,
        "node_id": lambda: list(range(n)) if keep is None else keep,
        "parent_id": lambda: pick(parent),
        "last_desc": lambda: pick(last()),
        "ancestors": lambda: pick(ancestors()),
        "depth": lambda: pick(depth),
        "child_index": lambda: pick(index),
        "named_child_index": lambda: pick(named_index()),
        "n_children": lambda: [len(x.children) for x in own],
        "n_named": lambda: [sum(c.named for c in x.children) for x in own],
        "field": lambda: [x.field for x in own],
        "kind": lambda: [x.kind for x in own],
        "supertypes": lambda: [x.supertypes for x in own],
        "is_named": lambda: [x.named for x in own],
        "is_extra": lambda: [x.extra for x in own],
        "is_missing": lambda: [x.missing for x in own],
        "is_error": lambda: [x.kind == "ERROR" for x in own],
        "has_error": lambda: pick(errors()),
        "text": lambda: [None if x.children else source[x.start : x.end].decode("utf-8", "replace") for x in own],
    }
    return [made[c] if c in made else build[c]() for c in names]


def rows(root: Node, source: bytes, layer: int, language: str, shift: list[tuple[int, int]] | None = None, wanted: frozenset[str] | None = None, document: bytes | None = None) -> list[tuple]:
    """columns() as rows of NODES_SCHEMA."""
    got = columns(root, source, layer, language, COLUMNS, shift, wanted, document)
    ancestors, supertypes = COLUMNS.index("ancestors"), COLUMNS.index("supertypes")
    got[ancestors], got[supertypes] = list(map(list, got[ancestors])), list(map(list, got[supertypes]))
    return list(zip(*got))


def settle(root: Node) -> Node:
    """Makes each node span its children."""
    order = list(walk(root))
    for n in reversed(order):
        if n.children:
            n.start = min(n.start, n.children[0].start)
            n.end = max(n.end, max(c.end for c in n.children))
    return root


def sexp(root: Node, fields: bool = True) -> str:
    """The S-expression of the named nodes."""
    if not root.named and not root.missing:
        return ""
    if root.missing:
        own = f"(MISSING {root.kind if root.named else repr(root.kind)})"
    else:
        inner = [sexp(c, fields) for c in root.children if c.named or c.missing]
        own = "(" + " ".join([root.kind, *inner]) + ")"
    return f"{root.field}: {own}" if fields and root.field else own


def walk(root: Node):
    todo = [root]
    while todo:
        n = todo.pop()
        yield n
        todo += reversed(n.children)
