import json as js

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arborlake.syntax import LANGUAGES
from arborlake.syntax.html import parse_html
from arborlake.syntax.json import parse_json
from arborlake.syntax.nodes import rows, sexp, walk
from arborlake.syntax.sql import DIALECTS, parse_sql, statements


def check(root, source):
    for n in walk(root):
        assert 0 <= n.start <= n.end <= len(source), n
        at = n.start
        for c in n.children:
            assert at <= c.start and c.end <= n.end, (n, c)
            at = c.end
    out = rows(root, source, 0, "x")
    assert [r[12] for r in out] == [n.kind for n in walk(root)]
    for r in out:
        if r[3] is not None:
            assert out[r[3]][2] < r[2] <= out[r[3]][4] and out[r[3]][6] == r[6] - 1
            assert r[5] == [*out[r[3]][5], r[3]]


@pytest.mark.parametrize("language", sorted(LANGUAGES))
@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(list("{}[]()<>/!-=\"'`$;:,.&# \n\\") + ["a", "é", "1", "<p>", "</p>", "<li>", "<script>", "BEGIN", "END", "select", "/*", "*/", "--", "true"]), max_size=25).map("".join))
def test_total(language, text):
    source = text.encode()
    check(LANGUAGES[language](source), source)


VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda v: st.lists(v, max_size=4) | st.dictionaries(st.text(max_size=3), v, max_size=3), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(VALUES, st.sampled_from([None, 2]), st.booleans())
def test_json_values(value, indent, ascii):
    source = js.dumps(value, indent=indent, ensure_ascii=ascii).encode()
    root = parse_json(source)
    check(root, source)
    assert not any(n.error or n.missing for n in walk(root))

    def back(n):
        if n.kind == "object":
            return {back(p.children[0]): back(p.children[-1]) for p in n.children if p.kind == "pair"}
        if n.kind == "array":
            return [back(c) for c in n.children if c.named]
        return js.loads(source[n.start : n.end])

    assert back(root.children[0]) == value


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(['{', '}', '[', ']', ',', ':', '"a"', '"', "1", "true", " ", "\n", "x", "/*c*/", "//c\n", "\\"]), max_size=20).map("".join))
def test_json_is_settled(text):
    """Spans are those that settling gives, also where it is left out."""
    from arborlake.syntax.nodes import settle

    spans = lambda root: [(n.kind, n.start, n.end) for n in walk(root)]
    assert spans(parse_json(text.encode())) == spans(settle(parse_json(text.encode())))


def test_shapes():
    assert sexp(parse_json(b'{"a": [1, "x"], "b": null}')) == "(document (object (pair key: (string (string_content)) value: (array (number) (string (string_content)))) (pair key: (string (string_content)) value: (null))))"
    assert sexp(parse_json(b'{"a": }')) == "(document (object (pair key: (string (string_content)) value: (MISSING null))))"
    assert sexp(parse_json(b"[1, @@ 2")) == "(document (array (number) (ERROR) (number) (MISSING ']')))"
    html = parse_html(b"<!DOCTYPE html><ul><li a=1>x<li>y &amp; z</ul><br/><script>if (a<b) {}</script></i>")
    assert sexp(html) == (
        "(document (doctype) (element (start_tag (tag_name)) (element (start_tag (tag_name) (attribute (attribute_name) (attribute_value))) (text)) (element (start_tag (tag_name)) (text) (entity) (text)) (end_tag (tag_name)))"
        " (element (self_closing_tag (tag_name))) (script_element (start_tag (tag_name)) (raw_text) (end_tag (tag_name))) (erroneous_end_tag (erroneous_end_tag_name)))"
    )


def test_statements():
    assert statements("select 1; select ';' -- x;\n, 2; /* ; */ ;") == ["select 1", "select ';' -- x;\n, 2"]
    assert statements("select $$a;b$$; select $t$ $$ ; $t$", "postgres") == ["select $$a;b$$", "select $t$ $$ ; $t$"]
    assert statements("select 'a\\';b'; select 1", "mysql") == ["select 'a\\';b'", "select 1"]
    assert statements("select [a;b] from t\nGO\nselect 2", "sqlserver") == ["select [a;b] from t", "select 2"]
    assert statements("create trigger x begin update t set a = 1; end; select 3", "sqlite") == ["create trigger x begin update t set a = 1; end", "select 3"]
    assert statements("begin; select 1; commit", "standard") == ["begin", "select 1", "commit"]
    assert statements("declare x int; begin x := case when 1 then 2 end; end; select 1", "oracle") == ["declare x int; begin x := case when 1 then 2 end; end", "select 1"]
    for d in DIALECTS:
        check(parse_sql("select é, (1 + [2] from".encode(), d), "select é, (1 + [2] from".encode())
