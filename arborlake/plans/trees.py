"""Queries over syntax trees of events.props (JSON), pages.html (HTML) and SQL texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.operators import trees as T
from arborlake.operators.storage import cut, written
from arborlake.plans.registry import register
from arborlake.session import table
from arborlake.sources import readers

SQL_TEXTS = [
    (1, "SELECT a, b FROM t WHERE x = 'é' -- note\n; DELETE FROM t WHERE y IN (1, 2)"),
    (2, "insert into t values (1, 'x;y'); /* c */ select count(*) from t"),
    (3, "WITH q AS (SELECT 1) SELECT * FROM q"),
]


def _json(spark, sf_dir, once=False, columns=None, kinds=None):
    """once: parsed and written, for queries that join nodes with nodes; columns and kinds: what the query reads."""
    n = T.parse(table(spark, sf_dir, "events"), "json", "event_id", "props", kinds=kinds, columns=columns)
    return cut(n) if once else n


def _html(spark, sf_dir, once=False, columns=None, kinds=None):
    n = T.parse(table(spark, sf_dir, "pages"), "html", "page_id", "html", kinds=kinds, columns=columns)
    return cut(n) if once else n


#: What join_query() reads.
JOINED = ["layer_id", "node_id", "parent_id", "child_index", "named_child_index", "n_children", "n_named", "start_byte", "text", "kind", "is_named", "supertypes", "field", "is_error", "is_missing"]


def _sql(spark, sf_dir):
    return T.parse(spark.createDataFrame(SQL_TEXTS, "doc_id bigint, text string"), "sql")


def query(name: str, sql: str | None = None):
    return register(name, sql)


@query("a1_parse_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.parse(table(spark, sf_dir, "events"), "json", "event_id", "props", kinds=["number"], columns=["field", "text"])
    return n.where("field = 'value'").select("event_id", F.col("text").cast("int").alias("k"))


@query("a1_parse_html", "SELECT page_id, CAST(len(regexp_extract_all(html, '<[a-zA-Z][^>]*>')) AS BIGINT) AS n_tags FROM pages")
def _(spark, sf_dir):
    n = T.parse(table(spark, sf_dir, "pages"), "html", "page_id", "html", kinds=["start_tag", "self_closing_tag"], columns=["node_id"])
    return n.groupBy("page_id").agg(F.count("*").alias("n_tags"))


@query("a1_parse_sql", "SELECT CAST(d AS BIGINT) AS doc_id, CAST(n AS BIGINT) AS n FROM (VALUES (1, 2), (2, 2), (3, 1)) AS t(d, n)")
def _(spark, sf_dir):
    return _sql(spark, sf_dir).where("kind = 'statement'").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("a1_included_ranges", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("html", F.concat(F.lit("<b>é</b>"), "props")).withColumn("r", F.array(F.struct(F.lit(9).alias("start"), (F.octet_length("props") + 9).alias("end"))))
    n = T.parse(e, "json", "event_id", "html", "r")
    v = n.where("field = 'value'").join(e.select("event_id", F.encode("html", "UTF-8").alias("b")), "event_id")
    return v.select("event_id", F.substring("b", F.col("start_byte") + 1, F.col("end_byte") - F.col("start_byte")).cast("string").cast("int").alias("k"))


@query("a1_decode_utf16", "SELECT event_id, props AS t FROM events")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.encode("props", "UTF-16LE").alias("b"))
    return e.select("event_id", readers.decode_text(F.col("b"), "UTF-16LE").alias("t"))


@query("a1_decode_custom", "SELECT event_id, upper(event_type) AS t FROM events")
def _(spark, sf_dir):
    decode = readers.decode_custom(lambda b: b.decode("ascii").upper())
    return table(spark, sf_dir, "events").select("event_id", decode(F.col("event_type").cast("binary")).alias("t"))


@query("a2_tokens", "SELECT kind, CAST(n AS BIGINT) AS n FROM (VALUES ('keyword', 17), ('identifier', 11), ('number', 4), ('string', 2), ('comment', 2)) AS t(kind, n)")
def _(spark, sf_dir):
    n = _sql(spark, sf_dir)
    return n.where("kind in ('keyword', 'identifier', 'number', 'string', 'comment')").groupBy("kind").agg(F.count("*").alias("n"))


@query("a2_tokenise_regexp", "SELECT page_id, CAST(len(regexp_extract_all(url, '[a-z]+')) AS BIGINT) AS n FROM pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.expr("regexp_extract_all(url, '[a-z]+', 0)")).cast("bigint").alias("n"))


@query("a3_error_summary", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS errors FROM events")
def _(spark, sf_dir):
    n = _json(spark, sf_dir).where("node_id = 0")
    return n.agg(F.count("*").alias("n"), F.sum(F.col("has_error").cast("bigint")).alias("errors"))


@query("a3_recovery", "SELECT * FROM (VALUES (1, '(document (object (pair key: (string (string_content)) value: (MISSING null))))'), (2, '(document (array (number) (ERROR) (MISSING '']'')))')) AS t(doc_id, sexp)")
def _(spark, sf_dir):
    return T.sexps(spark.createDataFrame([(1, '{"a": }'), (2, "[1 @")], "doc_id int, text string"), "json")


@query("a4_edit", "SELECT event_id, CAST(7 AS BIGINT) AS moved FROM events")
def _(spark, sf_dir):
    n = _json(spark, sf_dir, True, ["start_byte", "end_byte", "field"])
    e = n.select("event_id").distinct().select("event_id", F.lit(0).alias("start"), F.lit(0).alias("old_end"), F.lit(7).alias("new_end"))
    both = T.edited(n, e, "event_id").where("field = 'value'").select("event_id", F.col("start_byte").alias("b")).join(n.where("field = 'value'").select("event_id", "start_byte"), "event_id")
    return both.select("event_id", (F.col("b") - F.col("start_byte")).cast("bigint").alias("moved"))


@query(
    "a4_changed_ranges",
    """SELECT event_id, CAST(s AS INT) AS start_, CAST(e AS INT) AS end_ FROM (
         SELECT event_id, 6 AS s, CASE event_id % 4 WHEN 0 THEN 10 ELSE 9 + length(k) END AS e, event_id % 4 AS m FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events) WHERE event_id % 4 IN (0, 1)
         UNION ALL SELECT event_id, 6 + length(k), 8 + length(k), 2 FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events) WHERE event_id % 4 = 2)""",
)
def _(spark, sf_dir):
    """A number becomes true, is put in quotes, or grows by two digits; a fourth of the texts stay."""
    e = table(spark, sf_dir, "events").select("event_id", "props")
    to = F.when(F.col("event_id") % 4 == 0, F.regexp_replace("props", "[0-9]+", "true")).when(F.col("event_id") % 4 == 1, F.regexp_replace("props", "([0-9]+)", '"$1x"')).when(F.col("event_id") % 4 == 2, F.regexp_replace("props", "([0-9]+)", "$1.5")).otherwise(F.col("props"))
    c = T.changed_ranges(e, e.withColumn("props", to), "json", "event_id", "props")
    return c.withColumnsRenamed({"start": "start_", "end": "end_"})


@query("a4_parse_again", "SELECT event_id FROM events WHERE event_id % 10 = 3")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    after = e.withColumn("props", F.when(F.col("event_id") % 10 == 3, F.lit("{}")).otherwise(F.col("props")))
    return T.to_parse_again(e, after, "event_id", "props").select("event_id")


@query("a5_parent", "SELECT event_id, 'pair' AS parent_kind FROM events")
def _(spark, sf_dir):
    return T.parents(_json(spark, sf_dir), "event_id").where("kind = 'number'").select("event_id", "parent_kind")


@query("a5_child", "SELECT event_id, 'k' AS t FROM events")
def _(spark, sf_dir):
    n = _json(spark, sf_dir)
    return T.child(n, 1).where("kind = 'string_content'").select("event_id", F.col("text").alias("t"))


@query("a5_child_by_field", "SELECT event_id, json_extract_string(props, '$.k') AS v FROM events")
def _(spark, sf_dir):
    return T.child_by_field(_json(spark, sf_dir), "value", "event_id").select("event_id", F.col("text").alias("v"))


@query("a5_siblings", "SELECT event_id, ':' AS next_kind, 'number' AS next_named_kind, CAST(2 AS BIGINT) AS n_later FROM events")
def _(spark, sf_dir):
    n = _json(spark, sf_dir, True, ["layer_id", "node_id", "parent_id", "child_index", "is_named", "field", "kind"])
    s = T.siblings(n, "event_id").where("field = 'key'")
    k = n.select("event_id", "node_id", "kind")
    a = k.select("event_id", F.col("node_id").alias("next_sibling"), F.col("kind").alias("next_kind"))
    b = k.select("event_id", F.col("node_id").alias("next_named"), F.col("kind").alias("next_named_kind"))
    return s.join(a, ["event_id", "next_sibling"]).join(b, ["event_id", "next_named"]).select("event_id", "next_kind", "next_named_kind", "n_later")


@query("a5_counts", "SELECT event_id, CAST(3 AS BIGINT) AS children, CAST(1 AS BIGINT) AS named, CAST(length(props) AS BIGINT) AS bytes FROM events")
def _(spark, sf_dir):
    o = _json(spark, sf_dir).where("kind = 'object'")
    return o.select("event_id", F.col("n_children").cast("bigint").alias("children"), F.col("n_named").cast("bigint").alias("named"), (F.col("end_byte") - F.col("start_byte")).cast("bigint").alias("bytes"))


@query("a5_node_text", "SELECT event_id, props AS t FROM events")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return T.text_of(_json(spark, sf_dir).where("kind = 'object'"), e, "event_id", "props").select("event_id", F.col("node_text").alias("t"))


@query("a5_descendant_for_range", "SELECT event_id, 'string_content' AS kind FROM events")
def _(spark, sf_dir):
    n = _json(spark, sf_dir, True, ["node_id", "depth", "kind", "start_byte", "end_byte"])
    r = n.select("event_id").distinct().select("event_id", F.lit(2).alias("range_start"), F.lit(3).alias("range_end"))
    return T.descendant_for_range(n, r, "event_id").select("event_id", "kind")


@query("a5_first_child_for_byte", "SELECT event_id, ':' AS kind FROM events")
def _(spark, sf_dir):
    n = _json(spark, sf_dir)
    o = n.where("kind = 'pair'").select("event_id", F.col("node_id").alias("parent_id"), F.lit(4).alias("offset"))
    return T.first_child_for_byte(n, o, "event_id").select("event_id", "kind")


@query("a5_descendants", "SELECT page_id, CAST(len(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*)</nav>', 1), '<a ')) AS BIGINT) AS links FROM pages")
def _(spark, sf_dir):
    n = _html(spark, sf_dir, True, ["layer_id", "node_id", "parent_id", "ancestors", "kind", "text"])
    name = n.where("kind = 'tag_name' and text = 'nav'")
    tag = n.join(name.select("page_id", "layer_id", F.col("parent_id").alias("node_id")), ["page_id", "layer_id", "node_id"], "left_semi")
    element = n.join(tag.where("kind = 'start_tag'").select("page_id", "layer_id", F.col("parent_id").alias("node_id")), ["page_id", "layer_id", "node_id"], "left_semi")
    below = T.descendants(n, element, "page_id").where("kind = 'tag_name' and text = 'a'")
    starts = n.where("kind = 'start_tag'").select("page_id", F.col("node_id").alias("parent_id"))
    return below.join(starts, ["page_id", "parent_id"]).groupBy("page_id").agg(F.count("*").alias("links"))


@query("a5_siblings_of_field", "SELECT event_id, CAST(0 AS BIGINT) AS later FROM events")
def _(spark, sf_dir):
    n = _json(spark, sf_dir, False, ["layer_id", "node_id", "parent_id", "child_index", "is_named", "field", "kind"])
    return T.siblings(n, "event_id").where("field = 'value'").select("event_id", F.col("n_later_of_field").cast("bigint").alias("later"))


@query("a5_children_by_field", "SELECT event_id, json_extract_string(props, '$.k') AS v FROM events")
def _(spark, sf_dir):
    return T.children_by_field(_json(spark, sf_dir, columns=["parent_id", "field", "text"]), "value").select("event_id", F.col("text").alias("v"))


#: Texts of several lines, for points: a line break before each value.
_LINED = "concat('[', chr(10), ' ', json_extract_string(props, '$.k'), ',', chr(10), '  ', event_id, ']')"


def _lined(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("[\n "), F.get_json_object("props", "$.k"), F.lit(",\n  "), F.col("event_id").cast("string"), F.lit("]")).alias("t"))


@query("a5_descendant_for_points", "SELECT event_id, CAST(event_id AS VARCHAR) AS v FROM events")
def _(spark, sf_dir):
    n = T.parse(_lined(spark, sf_dir), "json", "event_id", "t", columns=["node_id", "depth", "text", "start_row", "start_col", "end_row", "end_col"])
    r = table(spark, sf_dir, "events").select("event_id", F.lit(2).alias("from_row"), F.lit(2).alias("from_col"), F.lit(2).alias("to_row"), F.lit(3).alias("to_col"))
    return T.descendant_for_points(n, r, "event_id").select("event_id", F.col("text").alias("v"))


@query("a6_first_child_for_point", "SELECT event_id, CAST(event_id AS VARCHAR) AS v FROM events")
def _(spark, sf_dir):
    n = T.parse(_lined(spark, sf_dir), "json", "event_id", "t", columns=["node_id", "parent_id", "named_child_index", "text", "end_row", "end_col"])
    at = table(spark, sf_dir, "events").select("event_id", F.lit(1).alias("parent_id"), F.lit(2).alias("row"), F.lit(0).alias("col"))
    return T.first_child_for_point(n, at, "event_id", named=True).select("event_id", F.col("text").alias("v"))


@query("a5_root_with_offset", f"SELECT event_id, CAST(100 + length({_LINED}) AS INT) AS e, 7 AS r, CAST(3 + length(CAST(event_id AS VARCHAR)) AS INT) AS c FROM events")
def _(spark, sf_dir):
    n = T.with_offset(T.parse(_lined(spark, sf_dir), "json", "event_id", "t", kinds=["array"], columns=["start_byte", "start_row", "start_col", "end_byte", "end_row", "end_col"]), 100, 5, 9)
    return n.select("event_id", F.col("end_byte").alias("e"), F.col("end_row").alias("r"), F.col("end_col").alias("c"))


@query("a10_point_range", "SELECT event_id, CAST(event_id AS VARCHAR) AS v FROM events")
def _(spark, sf_dir):
    m = T.query_texts(_lined(spark, sf_dir), "json", "(number) @n", "event_id", "t", point_range=((2, 0), (9, 0)))
    return m.select("event_id", F.col("captures")[0]["text"].alias("v"))


@query("a10_containing_points", "SELECT event_id, json_extract_string(props, '$.k') AS v FROM events")
def _(spark, sf_dir):
    m = T.query_texts(_lined(spark, sf_dir), "json", "(number) @n", "event_id", "t", containing_points=((1, 0), (1, 99)))
    return m.select("event_id", F.col("captures")[0]["text"].alias("v"))


@query("a10_disabled", "SELECT event_id, '' AS names FROM events WHERE json_extract_string(props, '$.k') LIKE '%7'")
def _(spark, sf_dir):
    q = '((number) @a (#match? @a "7$"))\n(string) @b'
    m = T.query_texts(table(spark, sf_dir, "events"), "json", q, "event_id", "props", disabled_patterns={1}, disabled_captures={"a"})
    return m.select("event_id", F.array_join(F.transform("captures", lambda c: c["name"]), ",").alias("names"))


@query("a10_remove_match", "SELECT event_id, 'v' AS name FROM events")
def _(spark, sf_dir):
    m = T.query_texts(table(spark, sf_dir, "events"), "json", "(string) @k\n(number) @v", "event_id", "props")
    return T.captures(T.without(m, m.where("pattern_index = 0"), "event_id"), "event_id").select("event_id", "name")


@query("a10_introspection", "SELECT * FROM (VALUES (0, 0, true, 'k', 'one'), (0, 0, true, 'v', '?'), (1, 52, true, 'n', '+')) AS t(pattern_index, start_byte, rooted, capture, quantifier)")
def _(spark, sf_dir):
    return T.query_info(spark, "(pair key: (string) @k value: [(number) @v (null)])\n(array (number)+ @n)", "json").drop("end_byte")


@query("a7_symbols", "SELECT 'json' AS language, CAST(13 AS BIGINT) AS n, CAST(2 AS BIGINT) AS fields")
def _(spark, sf_dir):
    s = T.symbols(spark).groupBy("language").agg(F.count("*").alias("n"))
    return s.join(T.field_names(spark).groupBy("language").agg(F.count("*").alias("fields")), "language").where("language = 'json'")


@query("a11_combined", "SELECT page_id, CAST(1 AS BIGINT) AS n, CAST(len(regexp_extract_all(html, '<a [^>]*>')) AS BIGINT) AS pieces FROM pages WHERE html LIKE '%<a %'")
def _(spark, sf_dir):
    """The values of href, put together to one layer of another language."""
    q = '((attribute (attribute_name) @_n (quoted_attribute_value (attribute_value) @injection.content)) (#eq? @_n "href") (#set! injection.language "code") (#set! injection.combined))'
    p = table(spark, sf_dir, "pages")
    found = T.layers(p.where("html like '%<a %'"), "html", "page_id", "html", injections={"html": q}).where("language = 'code'")
    return found.groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.size("ranges")).alias("pieces"))


@query("a11_unknown_language", "SELECT page_id, CAST(1 AS BIGINT) AS layers FROM pages")
def _(spark, sf_dir):
    q = '((script_element (raw_text) @injection.content) (#set! injection.language "no such"))'
    return T.layers(table(spark, sf_dir, "pages"), "html", "page_id", "html", injections={"html": q}).groupBy("page_id").agg(F.count("*").alias("layers"))


@query("a11_overlaid", "SELECT page_id, regexp_replace(html, '(?s)(<script>).*?(</script>)', '\\1' || repeat('~', length(regexp_extract(html, '(?s)<script>(.*?)</script>', 1))) || '\\2') AS t FROM pages")
def _(spark, sf_dir):
    return T.overlaid(table(spark, sf_dir, "pages"), "html", "javascript", "~", "page_id", "html").select("page_id", F.col("text").alias("t"))


@query("a1_layer_points", "SELECT page_id, CAST(len(string_split(split_part(html, 'track(', 1), chr(10))) - 1 AS INT) AS row_ FROM pages WHERE html LIKE '%track(%'")
def _(spark, sf_dir):
    """Rows of nested nodes are those of the document: each page has another number of lines before its script."""
    p = table(spark, sf_dir, "pages").withColumn("html", F.concat(F.repeat(F.lit("\n"), (F.col("page_id") % 5).cast("int")), "html"))
    n = T.layered_nodes(p, "html", "page_id", "html", columns=["language", "kind", "text", "start_row"])
    found = n.where("language = 'javascript' and kind = 'identifier' and text = 'track'")
    return found.select("page_id", (F.col("start_row") - (F.col("page_id") % 5).cast("int")).alias("row_"))


@query("a8_sql_select_items", "SELECT CAST(d AS BIGINT) AS doc_id, CAST(n AS BIGINT) AS n FROM (VALUES (1, 2), (2, 1), (3, 2)) AS t(d, n)")
def _(spark, sf_dir):
    m = T.query_texts(spark.createDataFrame(SQL_TEXTS, "doc_id bigint, text string"), "sql", "(select_item) @i")
    return m.groupBy("doc_id").agg(F.count("*").alias("n"))


@query("a8_sql_relations_and_calls", "SELECT CAST(d AS BIGINT) AS doc_id, c, t FROM (VALUES (1, 'relation', 't'), (1, 'relation', 't'), (2, 'relation', 't'), (2, 'call', 'count'), (3, 'relation', 'q')) AS x(d, c, t)")
def _(spark, sf_dir):
    m = T.query_texts(spark.createDataFrame(SQL_TEXTS, "doc_id bigint, text string"), "sql", "(relation value: (identifier) @relation)\n(function_call name: (identifier) @call)")
    return m.select("doc_id", F.col("captures")[0]["name"].alias("c"), F.col("captures")[0]["text"].alias("t"))


#: An array of an event's number and its id, with something between that JSON does not have.
def _odd(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("["), F.get_json_object("props", "$.k"), F.lit(", @@ "), F.col("event_id").cast("string"), F.lit("]")).alias("t"))


@query("a8_error_node", "SELECT event_id, '@@' AS t, CAST(3 + length(json_extract_string(props, '$.k')) AS INT) AS at_ FROM events")
def _(spark, sf_dir):
    m = T.query_texts(_odd(spark, sf_dir), "json", "(ERROR) @e", "event_id", "t")
    return m.select("event_id", F.col("captures")[0]["text"].alias("t"), F.col("captures")[0]["start_byte"].alias("at_"))


@query("a8_group", "SELECT event_id, json_extract_string(props, '$.k') AS a, CAST(event_id AS VARCHAR) AS b FROM events")
def _(spark, sf_dir):
    m = T.query_texts(_odd(spark, sf_dir), "json", "((number) @a (number) @b)", "event_id", "t")
    return m.select("event_id", F.col("captures")[0]["text"].alias("a"), F.col("captures")[1]["text"].alias("b"))


@query("a8_comments_and_escapes", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') LIKE '%7'")
def _(spark, sf_dir):
    q = '; numbers that end in 7\n((number) @n ; here\n  (#match? @n "^\\\\d*7$"))'
    return T.query_texts(table(spark, sf_dir, "events"), "json", q, "event_id", "props").select("event_id")


@query("a9_not_eq", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') NOT IN ('7', '8')")
def _(spark, sf_dir):
    q = '((number) @n (#not-eq? @n "7") (#not-any-of? @n "8" "no such"))'
    return T.query_texts(table(spark, sf_dir, "events"), "json", q, "event_id", "props").select("event_id")


@query("a1_decode_utf16be", "SELECT event_id, props AS t FROM events")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.encode("props", "UTF-16BE").alias("b"))
    return e.select("event_id", readers.decode_text(F.col("b"), "UTF-16BE").alias("t"))


@query("a1_decode_broken_utf8", "SELECT event_id, event_type || chr(65533) || event_id AS t FROM events")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.col("event_type").cast("binary"), F.unhex(F.lit("FF")), F.col("event_id").cast("string").cast("binary")).alias("b"))
    return e.select("event_id", readers.decode_text(F.col("b")).alias("t"))


@query("a5_equal_nodes", "SELECT event_id, CAST(11 AS BIGINT) AS same FROM events")
def _(spark, sf_dir):
    """Nodes of two parses are equal by their keys."""
    e = table(spark, sf_dir, "events")
    return T.equal_nodes(e, e, "json", "event_id", "props")


@query("a5_sexp", "SELECT event_id, '(document (object (pair key: (string (string_content)) value: (number))))' AS sexp FROM events")
def _(spark, sf_dir):
    return T.sexps(table(spark, sf_dir, "events"), "json", "event_id", "props")


@query("a6_preorder", "SELECT event_id, 'document/object/{/pair/string/\"/string_content/\"/:/number/}' AS walk FROM events")
def _(spark, sf_dir):
    n = _json(spark, sf_dir)
    return n.groupBy("event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "kind"))), lambda x: x["kind"]), "/").alias("walk"))


@query("a7_node_types", "SELECT 'pair' AS kind, 'key,value' AS fields, count(*) AS n FROM events")
def _(spark, sf_dir):
    t = T.node_types_of(table(spark, sf_dir, "events"), "json", "event_id", "props").where("kind = 'pair'")
    return t.select("kind", F.array_join("fields", ",").alias("fields"), "n")


@query("a7_expected_next", "SELECT ':' AS kind, 'number' AS next_kind, count(*) AS n FROM events")
def _(spark, sf_dir):
    return T.expected_next(_json(spark, sf_dir), "event_id").where("kind = ':'").select("kind", "next_kind", "n")


@query("a8_fields_and_captures", "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events")
def _(spark, sf_dir):
    m = T.query_texts(table(spark, sf_dir, "events"), "json", "(pair key: (string (string_content) @k) value: (number) @v)", "event_id", "props")
    return m.select("event_id", F.col("captures")[0]["text"].alias("key"), F.col("captures")[1]["text"].alias("value"))


@query("a8_join_plan", "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events")
def _(spark, sf_dir):
    q = "(pair key: (string (string_content) @k) value: (number) @v)"
    n = written(_json(spark, sf_dir, columns=JOINED, kinds=T.pattern_kinds(q)), "nodes")
    m = T.join_query(n, q, 0, "event_id", texts=True)
    return m.select("event_id", F.col("k_text").alias("key"), F.col("v_text").alias("value"))


@query("a8_quantifier", "SELECT page_id, CAST(len(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*)</nav>', 1), '<li>')) AS BIGINT) AS items FROM pages")
def _(spark, sf_dir):
    m = T.query_texts(table(spark, sf_dir, "pages"), "html", '(element (start_tag (tag_name) @t) (element)+ @li (#eq? @t "ul"))', "page_id", "html")
    return m.groupBy("page_id").agg(F.max(F.size("captures") - 1).cast("bigint").alias("items"))


@query("a8_alternation_anchor_wildcard", "SELECT event_id, CAST(3 AS BIGINT) AS n FROM events")
def _(spark, sf_dir):
    m = T.query_texts(table(spark, sf_dir, "events"), "json", '[(string) (number)] @s\n(pair . (_) @first)\n(pair "x" @none)', "event_id", "props")
    return m.groupBy("event_id").agg(F.count("*").alias("n"))


@query("a8_negated_field", "SELECT event_id, CAST(0 AS BIGINT) AS n FROM events")
def _(spark, sf_dir):
    m = T.query_texts(table(spark, sf_dir, "events"), "json", "(pair !value) @p\n(document) @d", "event_id", "props")
    return m.groupBy("event_id").agg(F.count_if(F.col("pattern_index") == 0).alias("n"))


@query("a9_match", "SELECT event_id FROM events WHERE regexp_matches(json_extract_string(props, '$.k'), '^[1-4]')")
def _(spark, sf_dir):
    return T.query_texts(table(spark, sf_dir, "events"), "json", '((number) @n (#match? @n "^[1-4]"))', "event_id", "props").select("event_id")


@query("a9_any_of", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') IN ('1', '2', '30')")
def _(spark, sf_dir):
    return T.query_texts(table(spark, sf_dir, "events"), "json", '((number) @n (#any-of? @n "1" "2" "30"))', "event_id", "props").select("event_id")


@query("a9_any_compat", "SELECT event_id FROM events")
def _(spark, sf_dir):
    return T.query_texts(table(spark, sf_dir, "events"), "json", '((number) @n (#any-eq? @n "no such"))', "event_id", "props").select("event_id")


@query("a9_any_strict", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def _(spark, sf_dir):
    return T.query_texts(table(spark, sf_dir, "events"), "json", '((number) @n (#any-eq? @n "7"))', "event_id", "props", strict=True).select("event_id")


@query("a10_captures", "SELECT event_id, i AS seq, name FROM events, (VALUES (1, 'p'), (2, 'k'), (3, 'v')) AS t(i, name)")
def _(spark, sf_dir):
    m = T.query_texts(table(spark, sf_dir, "events"), "json", "(number) @v\n(pair key: (string) @k) @p", "event_id", "props")
    return T.captures(m, "event_id").select("event_id", "seq", "name")


@query("a10_ranges_and_depth", "SELECT event_id, CAST(1 AS BIGINT) AS n FROM events")
def _(spark, sf_dir):
    m = T.query_texts(table(spark, sf_dir, "events"), "json", "(_) @n", "event_id", "props", byte_range=(0, 1), max_start_depth=1)
    return m.where(F.col("captures")[0]["kind"] == "object").groupBy("event_id").agg(F.count("*").alias("n"))


@query("a11_layers", "SELECT page_id, language, depth FROM pages, (VALUES ('html', 0), ('css', 1), ('javascript', 1)) AS t(language, depth)")
def _(spark, sf_dir):
    return T.layers(table(spark, sf_dir, "pages"), "html", "page_id", "html").select("page_id", "language", "depth")


@query("a11_layered_nodes", "SELECT page_id, 'track' AS f FROM pages")
def _(spark, sf_dir):
    n = T.layered_nodes(table(spark, sf_dir, "pages"), "html", "page_id", "html")
    return n.where("language = 'javascript' and kind = 'identifier' and text = 'track'").select("page_id", F.col("text").alias("f"))


@query("a12_highlight", "SELECT event_id, 'property' AS a, 'constant' AS b FROM events")
def _(spark, sf_dir):
    h = T.highlight(table(spark, sf_dir, "events"), "json", "event_id", "props")
    return h.groupBy("event_id").agg(F.max(F.when(F.col("seq") == 0, F.col("capture"))).alias("a"), F.max(F.when(F.col("seq") == 1, F.col("capture"))).alias("b"))


@query("a12_events", "SELECT event_id, 'start,end,start,end' AS kinds FROM events")
def _(spark, sf_dir):
    h = T.highlight_events(T.highlight(table(spark, sf_dir, "events"), "json", "event_id", "props"), "event_id")
    return h.groupBy("event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "kind"))), lambda x: x["kind"]), ",").alias("kinds"))


@query("a12_styles", "SELECT event_id, 'green' AS a, 'plain' AS b FROM events")
def _(spark, sf_dir):
    styles = spark.createDataFrame([("property", "green"), ("comment", "grey")], "name string, style string")
    h = T.styled(T.highlight(table(spark, sf_dir, "events"), "json", "event_id", "props"), styles, "plain")
    return h.groupBy("event_id").agg(F.max(F.when(F.col("seq") == 0, F.col("style"))).alias("a"), F.max(F.when(F.col("seq") == 1, F.col("style"))).alias("b"))


@query("a12_locals", "SELECT * FROM (VALUES (1, 'x', 10, 5), (1, 'x', 30, 25), (1, 'y', 31, NULL), (1, 'x', 60, 5)) AS t(doc_id, name, offset_, def_offset)")
def _(spark, sf_dir):
    refs = spark.createDataFrame([(1, "x", 10), (1, "x", 30), (1, "y", 31), (1, "x", 60)], "doc_id int, name string, offset int")
    defs = spark.createDataFrame([(1, "x", 5), (1, "x", 25), (1, "y", 55)], "doc_id int, name string, offset int")
    scopes = spark.createDataFrame([(1, 0, 100, True), (1, 20, 40, True)], "doc_id int, scope_start int, scope_end int, inherits boolean")
    return T.resolve(refs, defs, scopes).withColumnRenamed("offset", "offset_")


@query("a12_tags", "SELECT page_id, 'track' AS name, 'reference' AS role, 'call' AS tag FROM pages WHERE html LIKE '%track(%'")
def _(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"(?s)<script>(.*?)</script>", 1).alias("code")).where("code like '%track(%'")
    return T.tags(p, "javascript", "page_id", "code").select("page_id", "name", "role", "tag")


#: A function of its own for each event, called with a name that it defines and one that it does not.
_CODE = "concat('function f', event_id, '(a) { use(a); use(b); }')"


def _functions(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("function f"), F.col("event_id").cast("string"), F.lit("(a) { use(a); use(b); }")).alias("code"))


@query("a12_locals_query", "SELECT event_id, name, def_offset FROM (SELECT event_id, 'a' AS name, CAST(11 + length(CAST(event_id AS VARCHAR)) AS INT) AS def_offset FROM events UNION ALL SELECT event_id, 'b', NULL FROM events)")
def _(spark, sf_dir):
    q = '(program) @scope\n("function" . (identifier) . (arguments (identifier) @definition))\n((identifier) @_f . (arguments (identifier) @reference) (#eq? @_f "use"))'
    return T.resolved(_functions(spark, sf_dir), "javascript", q, "event_id", "code").select("event_id", "name", "def_offset")


@query("a12_not_local", "SELECT event_id, 'a' AS t, 'parameter' AS capture FROM events UNION ALL SELECT event_id, 'b', 'variable' FROM events")
def _(spark, sf_dir):
    """Names that a scope defines take another colour than those that it does not."""
    scopes = {"javascript": '(program) @scope\n("function" . (identifier) . (arguments (identifier) @definition))\n((identifier) @_f . (arguments (identifier) @reference) (#eq? @_f "use"))'}
    colours = {"javascript": '((identifier) @_f . (arguments (identifier) @variable) (#eq? @_f "use") (#is-not? local))\n((identifier) @_f . (arguments (identifier) @parameter) (#eq? @_f "use") (#is? local))'}
    h = T.highlight(_functions(spark, sf_dir), "javascript", "event_id", "code", names=["variable", "parameter"], highlights=colours, scopes=scopes, texts=True)
    return h.select("event_id", F.col("text").alias("t"), "capture")


@query("a12_colours", "SELECT * FROM (VALUES (255, 0, 0, 196), (8, 8, 8, 232), (0, 0, 255, 21), (128, 128, 128, 244)) AS t(r, g, b, index)")
def _(spark, sf_dir):
    c = spark.createDataFrame([(255, 0, 0), (8, 8, 8), (0, 0, 255), (128, 128, 128)], "r int, g int, b int")
    return T.nearest_colours(c, T.xterm_palette(spark))


@query("a12_colours_16", "SELECT * FROM (VALUES (250, 10, 10, 9), (120, 0, 10, 1), (0, 0, 0, 0), (200, 200, 200, 7)) AS t(r, g, b, index)")
def _(spark, sf_dir):
    c = spark.createDataFrame([(250, 10, 10), (120, 0, 10), (0, 0, 0), (200, 200, 200)], "r int, g int, b int")
    return T.nearest_colours(c, T.ansi_palette(spark))
