import random

import pytest

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arborlake.operators import trees as T
from arborlake.syntax import FIELDS, KINDS, LANGUAGES
from arborlake.syntax.change import changed, edit_between, moved
from arborlake.syntax.match import Matcher
from arborlake.syntax.nodes import walk
from arborlake.syntax.query import Query, QueryError


def found(query, text, language="json", **where):
    source = text.encode()
    root = LANGUAGES[language](source)
    return [(m.pattern, [(c, source[n.start : n.end].decode()) for c, n in m.captures]) for m in Matcher(Query(query)).matches(root, source, **where)]


def test_patterns():
    assert found("(array (number) @a (number) @b)", "[1, 2, 3]") == [(0, [("a", "1"), ("b", "2")]), (0, [("a", "1"), ("b", "3")]), (0, [("a", "2"), ("b", "3")])]
    assert found("(array (number) @a . (number) @b)", "[1, 2, 3]") == [(0, [("a", "1"), ("b", "2")]), (0, [("a", "2"), ("b", "3")])]
    assert found("(array . (_) @a)", "[1, 2, 3]") == [(0, [("a", "1")])]
    assert found("(array (_) @a .)", "[1, 2, 3]") == [(0, [("a", "3")])]
    assert found("(array (number)+ @a)", "[1, 2, 3]") == [(0, [("a", "1"), ("a", "2"), ("a", "3")])]
    assert found("(array (string)* @s (number) @n)", '["x", "y", 1]') == [(0, [("s", '"x"'), ("s", '"y"'), ("n", "1")])]
    assert found("(array (string)? @s . (number) @n)", '[1, "x", 2]') == [(0, [("n", "1")]), (0, [("s", '"x"'), ("n", "2")])]
    assert found("[(true) (false)] @b", "[true, null, false]") == [(0, [("b", "true")]), (0, [("b", "false")])]
    assert found('(pair key: (_) @k value: [(number) (null)] @v)', '{"a": 1, "b": "x", "c": null}') == [(0, [("k", '"a"'), ("v", "1")]), (0, [("k", '"c"'), ("v", "null")])]
    assert found('(array "," @c)', "[1, 2]") == [(0, [("c", ",")])]
    assert found("(_value/number) @n (string) @s", '[1, "a"]') == [(0, [("n", "1")]), (1, [("s", '"a"')])]
    assert found("(ERROR) @e", "[1 @@ 2]") == [(0, [("e", "@@")])]
    assert found("(MISSING) @m", "[1") == [(0, [("m", "")])]
    assert found('(MISSING "]") @m', "[1") == [(0, [("m", "")])]
    assert found("((number) @a (number) @b)", "[1, 2]") == [(0, [("a", "1"), ("b", "2")])]
    assert found("(array ((number) (string))+ @x)", '[1, "a", 2, "b"]')[0][1][0] == ("x", "1")
    assert found("(pair value: (array (number) @n))", '{"a": [1, {"b": [2]}]}') == [(0, [("n", "1")]), (0, [("n", "2")])]


def test_predicates():
    text = '{"a": "a", "b": "c"}'
    q = "((pair key: (string (string_content) @k) value: (string (string_content) @v)) {})"
    assert len(found(q.format("(#eq? @k @v)"), text)) == 1
    assert len(found(q.format("(#not-eq? @k @v)"), text)) == 1
    assert len(found(q.format('(#match? @v "^[cd]$")'), text)) == 1
    assert len(found(q.format('(#not-any-of? @k "a" "z")'), text)) == 1
    assert len(found(q.format('(#any-eq? @k "zzz")'), text)) == 2
    assert len(found('((array (string)* @s) (#eq? @s "x"))', "[1]")) == 1  # no node: holds
    p = Query('((string) @s (#set! lang "x") (#is? local) (#is-not? @s local) (#strip! @s "a"))').patterns[0]
    assert p.settings() == {"lang": "x"} and p.assertions() == [(True, "local"), (False, "local")] and [g.name for g in p.general()] == ["strip!"]


@pytest.mark.parametrize(
    "text,kind,offset",
    [("(pair", "syntax", 5), ("(pair ]", "syntax", 6), ("()", "syntax", 1), ("(nope)", "node type", 1), ('("é" "zz")', "node type", 1), ("(pair nope: (_))", "field", 6), ("((pair) @a (#eq? @b \"x\"))", "capture", 12), ("((pair) @a (#eq? @a))", "predicate", 12), ("((pair) @a (#match? @a \"(\"))", "predicate", 12), ("(" * 103 + "pair" + ")" * 103, "structure", None), ("((pair) .)", "syntax", None)],
)
def test_errors(text, kind, offset):
    with pytest.raises(QueryError) as e:
        Query(text, kinds={"pair", "é"}, anonymous={"é"} if "zz" not in text else set(), fields={"key"})
    assert e.value.kind == kind and (offset is None or e.value.offset == offset)


def test_capture_quantifiers():
    q = Query("(a (b)* @x (c)? @y [(d) @z (e)] (f (g)+ @w) @x)")
    assert q.capture_quantifiers(0) == {"x": "+", "y": "?", "z": "?", "w": "+"}


def random_pattern(rnd, node):
    """A pattern cut from a real tree."""
    own = [c for c in node.children if rnd.random() < 0.5]
    parts = [random_pattern(rnd, c) for c in own]
    kind = f'"{node.kind}"' if not node.named else f"({node.kind} {' '.join(parts)})"
    if '"""' in kind or node.kind == '"':
        kind = "_"
    field = f"{node.field}: " if node.field and rnd.random() < 0.5 else ""
    return f"{field}{kind} @c{rnd.randrange(1000000)}"


def test_joins_against_the_matcher(spark):
    rnd = random.Random(4)
    texts = ['{"a": [1, 2, {"b": null, "c": "x"}], "d": "é"}', "[[1, 2], [3, [4, 5]], true]", '{"x": {"y": {"z": [1, "a", 2]}}}', '[1, "a", "b", 3]']
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    nodes = T.parse(df, "json").persist()
    patterns = ["(array . (number) @a (number) @b)", "(pair key: (_) @k !nothing) @p", "(array (_) @x .)", '((number) @n (#match? @n "[24]"))', '(array (number) @a . (string) @b (#eq? @a "1"))']
    for _ in range(12):
        root = LANGUAGES["json"](rnd.choice(texts).encode())
        patterns.append(random_pattern(rnd, rnd.choice([n for n in walk(root) if n.named])))
    for p in patterns:
        got = sorted(tuple(sorted((k, v) for k, v in r.asDict().items() if k != "layer_id")) for r in T.join_query(nodes, p).collect())
        want = []
        for i, t in enumerate(texts):
            root = LANGUAGES["json"](t.encode())
            number = {id(n): k for k, n in enumerate(walk(root))}
            for m in Matcher(Query(p)).matches(root, t.encode()):
                want.append(tuple(sorted([("doc_id", i), *((c, number[id(n)]) for c, n in m.captures)])))
        assert got == sorted(want), p


def test_change_and_layers(spark):
    df = spark.createDataFrame([(1, "<p>é</p><script>var a = track(1);</script><style>b{c:1}</style>"), (2, None)], "doc_id int, text string")
    n = T.layered_nodes(df, "html").where("layer_id > 0 and text = 'track'").first()
    assert df.first().text.encode()[n.start_byte : n.end_byte] == b"track"
    h = T.highlight(df, "html", names=["string", "function", "tag"]).collect()
    assert [r.capture for r in h if r.layer_id > 0] == ["function"]
    with pytest.raises(ValueError):
        T.replaced(b"abc", [(0, 1, b"xx")])
    assert T.replaced(b"abc", [(0, 1, b"x")]) == b"xbc"
    assert T.parse(df.limit(0), "html").count() == 0


def test_names_of_a_language(spark):
    df = spark.createDataFrame([(1, "[1]")], "doc_id int, text string")
    for query, kind in (("(no_such_kind) @x", "node type"), ("(pair nothing: (_) @x)", "field"), ("(pair !nothing) @x", "field"), ("(array (strings) @x)", "node type")):
        with pytest.raises(QueryError) as e:
            T.query_texts(df, "json", query)
        assert e.value.kind == kind
    assert T.query_texts(df, "json", "(_value/number) @x").count() == 1
    for language in LANGUAGES:
        for text in ('{"a": [1, null], "b": "x\\n"} // c', "<p class='a'>x &amp; <br/><script>f(1)</script></q>", "select a.b, f(x) over (order by 1) from (select 1) t join u using (k) where not a in (1) -- c", "function f(a) { return `x` + [1]; }"):
            nodes = list(walk(LANGUAGES[language](text.encode())))
            assert {n.kind for n in nodes if n.named and not n.error} <= KINDS[language]
            assert {n.field for n in nodes if n.field} <= FIELDS[language]
            assert {x for n in nodes for x in n.supertypes} <= KINDS[language]


def brute_changed(parser, old, new, edit):
    """Byte by byte: the nodes over it, each by its kind, name, field and start."""

    def paths(source, move):
        out = [()] * len(new)
        empty = set()

        def go(node, above):
            a, b = move(node.start, False), move(node.end, True)
            path = (*above, (node.kind, node.named, node.field, a))
            if a >= b:
                empty.add((a, path))
            for k in range(a, min(b, len(new))):
                out[k] = path
            for c in node.children:
                go(c, path)

        go(parser(source), ())
        return out, empty

    (x, e), (y, f) = paths(old, lambda o, end: min(len(new), moved(o, edit, end))), paths(new, lambda o, end: o)
    bad = {k for k in range(len(new)) if x[k] != y[k]} | {min(k, len(new) - 1) for k, _ in e ^ f if new}
    out = []
    for k in sorted(bad):
        if out and out[-1][1] == k:
            out[-1] = (out[-1][0], k + 1)
        else:
            out.append((k, k + 1))
    return out


PIECES = st.lists(st.sampled_from(['{', '}', '[', ']', ',', ':', '"a"', '"', "1", "23", "true", " ", "x", "-", "é"]), max_size=14).map("".join)


@pytest.mark.parametrize("language", ["json", "code", "sql"])
@settings(max_examples=300, deadline=None)
@given(PIECES, PIECES, PIECES, PIECES)
def test_changed_against_brute_force(language, a, b, c, d):
    """Random edits: b between a and d becomes c."""
    old, new = (a + b + d).encode(), (a + c + d).encode()
    parser = LANGUAGES[language]
    given_edit = (len(a.encode()), len((a + b).encode()), len((a + c).encode()))
    assert changed(parser, old, new, given_edit) == brute_changed(parser, old, new, given_edit)
    if old != new:
        s, o, n = edit_between(old, new)
        assert old[:s] == new[:s] and old[o:] == new[n:] and new[s:n] != old[s:o]
        assert changed(parser, old, new) == brute_changed(parser, old, new, (s, o, n))
    else:
        assert changed(parser, old, new) == []


def test_changed_ranges(spark):
    json = LANGUAGES["json"]
    assert changed(json, b'{"a": 1, "b": 2, "c": 3}', b'{"a": 1000, "b": 2, "c": 3}') == [(7, 10)]  # the number's new bytes, and nothing behind it
    assert changed(json, b'{"a": 1, "b": 2}', b'{"a": [1], "b": 2}') == [(6, 9)]
    assert changed(json, b"[1, 2]", b"[7, 2]") == []
    old = spark.createDataFrame([(1, "[1]"), (2, None), (3, "[1]"), (4, "x"), (None, "[1]")], "doc_id int, text string")
    new = spark.createDataFrame([(1, "[true]", 1, 2, 5), (2, "[1]", 0, 0, 0), (3, None, 0, 0, 0), (5, "x", 0, 0, 0)], "doc_id int, text string, s int, o int, n int")
    for edit in (None, ("s", "o", "n")):
        assert [tuple(r) for r in T.changed_ranges(old, new, "json", edit_cols=edit).collect()] == [(1, 1, 5)]


def test_layers_of_layers(spark):
    """Points are the document's, ranges are cut by their parent's, and a layer that holds itself ends."""
    text = "\n\n<p>é</p>\n<script>\n  track(1)</script>"
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    n = T.layered_nodes(df, "html").where("text = 'track'").first()
    assert (n.start_row, n.start_col, text.encode()[n.start_byte : n.end_byte]) == (4, 2, b"track")
    pieces = spark.createDataFrame([(1, "ab[1,\n2]cd\n [3", [(2, 9), (12, 15)])], "doc_id int, text string, r array<struct<start:int,end:int>>")
    got = {(r.text, r.start_row, r.start_col, r.end_row, r.end_col) for r in T.parse(pieces, "json", ranges_col="r", kinds=["number"]).collect()}
    assert got == {("1", 0, 3, 0, 4), ("2", 1, 0, 1, 1), ("3", 2, 2, 2, 3)}
    own = {"json": '((string (string_content) @injection.content) (#set! injection.language "json"))'}
    deep = '"' + "a" * 3 + '"'
    for _ in range(12):
        deep = '["' + deep.replace('"', "'") + '"]'
    assert T.layers(spark.createDataFrame([(1, "x")], "doc_id int, text string"), "json", injections={"json": '((document) @injection.content (#set! injection.language "json") (#set! injection.include-children))'}).count() == 1
    assert T.layers(spark.createDataFrame([(1, '["[1]"]')], "doc_id int, text string"), "json", injections=own).count() == 2
    assert T._document_spans([(1, 5)], [(0, 10), (3, 20)], 6) == [(11, 13), (20, 22)]


def test_budgets(spark):
    many = "[" + ",".join(map(str, range(200))) + "]"
    df = spark.createDataFrame([(1, many), (2, "[1, 2]")], "doc_id int, text string")
    q = "(array (number) @a (number) @b)"
    whole = {r.doc_id: (r.n, r.x) for r in T.query_texts(df, "json", q).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("exceeded").alias("x")).collect()}
    assert whole == {1: (199 * 100, False), 2: (1, False)}
    cut = {r.doc_id: (r.n, r.x) for r in T.query_texts(df, "json", q, match_limit=50).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("exceeded").alias("x")).collect()}
    assert cut == {1: (50, True), 2: (1, False)}
    assert T.query_texts(df, "json", q, seconds=0.0).count() < 199 * 100


def test_sql_trees():
    from arborlake.syntax.nodes import sexp

    tree = lambda q: sexp(LANGUAGES["sql"](q.encode()))
    assert "(join (keyword) (keyword) right: (relation value: (identifier)) condition: (join_condition (keyword) (binary_expression" in tree("select 1 from t left join u on t.a = u.b")
    assert tree("select 1 + 2 * 3") == "(source_file (statement (select_clause (keyword) (select_item value: (binary_expression left: (number) right: (binary_expression left: (number) right: (number)))))))"
    assert tree("select x between 1 and 2 and y").count("binary_expression") == 3
    assert "function_call name: (identifier) arguments: (parenthesis (identifier)) window: (window_definition" in tree("select sum(x) over (order by y) from t")
    assert "(query (select_clause" in tree("select * from (select a from b) c")
    assert tree("vacuum full t") == "(source_file (statement (identifier) (keyword) (identifier)))" and "select_item" in tree("with q as (select 1) select q.x as y from q")
    deep = "select " + "(" * 400 + "1" + ")" * 400
    assert LANGUAGES["sql"](deep.encode()).end == len(deep)


def _broadcasts(df):
    return "Broadcast" in df._jdf.queryExecution().executedPlan().toString()


def test_equal_nodes_and_joins_of_nodes_broadcast_none(spark):
    """Spark takes parsed rows for as small as their texts; a broadcast of them is what the driver failed by."""
    a = spark.createDataFrame([(1, "[1, 2]"), (2, "[1]"), (3, None), (4, "7")], "doc_id int, text string")
    b = spark.createDataFrame([(1, "[1, 2]"), (2, "[x]"), (3, "1"), (5, "7")], "doc_id int, text string")
    key = ["doc_id", "layer_id", "node_id", "kind", "start_byte", "end_byte"]
    plain = T.parse(a, "json").join(T.parse(b, "json"), key).groupBy("doc_id").count()
    got = T.equal_nodes(a, b, "json")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    n = T.parse(a, "json")
    targets = n.where("kind = 'number'").select("doc_id", "layer_id", F.lit(0).alias("ancestor_id"), F.col("node_id").alias("target_id"))
    towards = T.child_with_descendant(n, targets)
    assert sorted((r.doc_id, r.kind) for r in towards.collect()) == [(1, "array"), (1, "array"), (2, "array"), (4, "number")]
    q = T.join_query(n, "(array (number) @a)", texts=True)
    assert sorted((r.doc_id, r.a_text) for r in q.collect()) == [(1, "1"), (1, "2"), (2, "1")]
    assert not any(map(_broadcasts, [got, towards, q, T.parents(n), T.node_types(n)]))


def test_pattern_kinds():
    assert T.pattern_kinds("(pair key: (string (string_content) @k) value: (number) @v)") == ["number", "pair", "string", "string_content"]
    assert T.pattern_kinds("(pair (_) @x)") is None and T.pattern_kinds("(pair !value) @p") is None


def test_node_types_of_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, '{"a": [1, {"b": null}]}'), (2, "[1 @"), (3, None), (4, '{"x": "y"}')], "doc_id int, text string").repartition(3)
    want = {(r.kind, r.is_named): (r.n, r.fields, r.child_kinds) for r in T.node_types(T.parse(docs, "json")).collect()}
    monkeypatch.setattr(T, "TYPES_HELD", 2)
    got = T.node_types_of(docs, "json")
    assert {(r.kind, r.is_named): (r.n, r.fields, r.child_kinds) for r in got.collect()} == want and got.count() == len(want)


def test_resolved_in_the_pass_that_parses(spark):
    """The same as by joins, with scopes that hide what is outside and names that are defined twice."""
    q = '(block) @scope\n((arguments) @scope (#set! inherits "false"))\n(program) @scope\n("var" . (identifier) @definition)\n((identifier) @reference)'
    rnd = random.Random(5)
    word = lambda: rnd.choice(["a", "b", "var a", "var b", "{", "}", "(", ")", ";"])
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(30))) for i in range(60)], "doc_id int, text string")
    want = T.resolve(*T.scoped_names(docs, "javascript", q)).select("doc_id", "name", "offset", "def_offset")
    got = T.resolved(docs, "javascript", q)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString().replace("Exchange RoundRobin", "")


def test_groups_are_tried_where_they_can_begin():
    """A wide node takes time in proportion to its children, not to their square."""
    source = ("f(x); " * 300).encode()
    m = Matcher(Query('((identifier) @a . (arguments) @b (#eq? @a "f"))\n("var" . (identifier) @c)'))
    tried = [0]
    plain = m._node_or_choice

    def counted(*args):
        tried[0] += 1
        return plain(*args)

    m._node_or_choice = counted
    assert len(m.matches(LANGUAGES["javascript"](source), source)) == 300
    assert tried[0] < 300 * 20


def test_highlight_texts(spark):
    docs = spark.createDataFrame([(1, '{"é": 10}')], "doc_id int, text string")
    assert [(r.capture, r.text) for r in T.highlight(docs, "json", texts=True).orderBy("seq").collect()] == [("property", '"é"'), ("constant", "10")]
