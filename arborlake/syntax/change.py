"""What an edit changed in the tree of a text."""

from __future__ import annotations

from collections.abc import Callable

from arborlake.syntax.nodes import Node


def edit_between(old: bytes, new: bytes) -> tuple[int, int, int]:
    """(start, old end, new end) of the smallest replacement that turns old into new, as far to the right as it can be."""
    most = min(len(old), len(new))
    a = 0
    while a < most and old[a : a + 256] == new[a : a + 256] and old[a : a + 256]:
        a += len(old[a : a + 256])
    a = min(a, most)
    while a and old[:a][-256:] != new[:a][-256:]:
        a -= 1
    while a < most and old[a] == new[a]:
        a += 1
    b = 0
    while b < most - a and old[-1 - b] == new[-1 - b]:
        b += 1
    return a, len(old) - b, len(new) - b


def moved(offset: int, edit: tuple[int, int, int], end: bool = False) -> int:
    """Where an offset of the old text is in the new one; what was replaced goes to the start of the replacement, its end to its end."""
    start, old_end, new_end = edit
    if offset < start or end and offset == start:
        return offset
    if offset >= old_end:
        return offset + new_end - old_end
    return new_end if end else start


def _steps(root: Node, move: Callable[[int, bool], int]) -> list[tuple[int, int, tuple, int]]:
    """(start, end, path, number) of each node in pre-order; path: the node's kind, name, field and start, and the path above it.

    Nodes of no width have their place among the nodes at that offset as well.
    """
    out = []
    todo = [(root, None)]
    while todo:
        node, above = todo.pop()
        a, b = move(node.start, False), move(node.end, True)
        path = (node.kind, node.named, node.field, a, above)
        out.append((a, max(a, b), path, len(out)))
        todo += [(c, path) for c in reversed(node.children)]
    return out


def _cover(steps: list[tuple[int, int, tuple, int]], size: int) -> list[tuple[int, tuple | None]]:
    """(start, path): from each start on, up to the next, the innermost node over the bytes."""
    ends = [(size, None)]
    out: list[tuple[int, tuple | None]] = [(0, None)]

    def put(at: int, path):
        if out[-1][0] == at:
            out[-1] = (at, path)
        else:
            out.append((at, path))

    for a, b, path, _ in steps:
        if a == b:
            continue
        while len(ends) > 1 and ends[-1][0] <= a:
            at, _ = ends.pop()
            put(at, ends[-1][1])
        put(a, path)
        ends.append((b, path))
    while len(ends) > 1:
        at, _ = ends.pop()
        put(at, ends[-1][1])
    return out


def changed(parser: Callable[[bytes], Node], old: bytes, new: bytes, edit: tuple[int, int, int] | None = None) -> list[tuple[int, int]]:
    """Ranges of new, in order and apart, over which the old tree after the edit and the new one have other nodes.

    A byte's nodes are those over it, each by its kind, field and start. Nodes without width count for the byte behind
    them, the last byte at the end of the text.
    """
    if old == new and edit is None:
        return []
    edit = edit or edit_between(old, new)
    before = _steps(parser(old), lambda x, end: min(len(new), moved(x, edit, end)))
    after = _steps(parser(new), lambda x, end: x)
    size = len(new)
    a, b = _cover(before, size), _cover(after, size)
    out: list[tuple[int, int]] = []

    def add(s: int, e: int):
        if s >= e:
            return
        if out and out[-1][1] >= s:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))

    found = []
    i = j = at = 0
    while at < size:
        while i + 1 < len(a) and a[i + 1][0] <= at:
            i += 1
        while j + 1 < len(b) and b[j + 1][0] <= at:
            j += 1
        to = min(a[i + 1][0] if i + 1 < len(a) else size, b[j + 1][0] if j + 1 < len(b) else size, size)
        if a[i][1] != b[j][1]:
            found.append((at, to))
        at = to
    empty = [{(s, path) for s, e, path, _ in steps if s == e} for steps in (before, after)]
    for s, _ in empty[0] ^ empty[1]:
        s = min(s, size - 1)
        if s >= 0:
            found.append((s, s + 1))
    for s, e in sorted(found):
        add(s, e)
    return out
