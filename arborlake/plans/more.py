"""Further forms of the inventory: hints, files, views, other query languages, cursors and the rest of tree navigation."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import functions as F

from arborlake.operators import patterns, recursion
from arborlake.operators import trees as T
from arborlake.operators.storage import scratch, written
from arborlake.plans.relational import query
from arborlake.plans.relational_sql import sql
from arborlake.plans.trees import SQL_TEXTS
from arborlake.sources import readers
from arborlake.syntax.sql import statements

# ---- sources and sinks

sql("b1_join_hint", "SELECT /*+ BROADCAST(nation) */ count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey", "SELECT count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey")
sql("b1_tvf_explode", "SELECT * FROM explode(array(1, 2, 3)) AS t(x)", "SELECT unnest([1, 2, 3]) AS x")
sql("b9_unary", "SELECT n_nationkey, -n_nationkey AS a, +n_nationkey AS b, ~n_nationkey AS c, NOT n_nationkey > 3 AS d FROM nation")
sql("b9_named_arguments", "SELECT n_nationkey, mask(n_name, upperChar => 'Q', lowerChar => NULL, digitChar => NULL) AS m FROM nation", "SELECT n_nationkey, regexp_replace(n_name, '[A-Z]', 'Q', 'g') AS m FROM nation")
sql("b9_tuple", "SELECT n_nationkey, struct(n_name, n_regionkey).n_regionkey AS r FROM nation", "SELECT n_nationkey, n_regionkey AS r FROM nation")
sql("b10_intervals", "SELECT CAST(INTERVAL '1-2' YEAR TO MONTH AS STRING) AS ym, CAST(INTERVAL '1 02:03:04' DAY TO SECOND AS STRING) AS ds", "SELECT 'INTERVAL ''1-2'' YEAR TO MONTH' AS ym, 'INTERVAL ''1 02:03:04'' DAY TO SECOND' AS ds")
sql("b10_nested_types", "SELECT element_at(m, 'k')[1].a AS v FROM (SELECT CAST(map('k', array(named_struct('a', 1), named_struct('a', 2))) AS MAP<STRING, ARRAY<STRUCT<a: BIGINT>>>) AS m)", "SELECT CAST(2 AS BIGINT) AS v")


@query("b1_with_function", "SELECT n_nationkey, n_nationkey + 7 AS v FROM nation", "nation")
def _(spark, nation):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION arborlake_plus(x INT) RETURNS INT RETURN x + 7")
    return nation.selectExpr("n_nationkey", "arborlake_plus(n_nationkey) AS v")


@query("b1_object_name", "SELECT count(*) AS n FROM region", "region")
def _(spark, region):
    region.createOrReplaceGlobalTempView("arborlake_region")
    return spark.sql("SELECT count(*) AS n FROM global_temp.arborlake_region")


@query("b2_truncate", "SELECT count(*) AS n FROM region WHERE FALSE", "region")
def _(spark, region):
    return region.limit(0).agg(F.count("*").alias("n"))


@query("b2_copy_csv", "SELECT n_nationkey, n_name FROM nation", "nation")
def _(spark, nation):
    path = scratch(nation, "copy") + "/nation.csv"
    nation.write.option("header", True).csv(path)
    return readers.file_table(spark, path, "n_nationkey int, n_name string, n_regionkey int").select("n_nationkey", "n_name")


@query("b2_outfile_json", "SELECT r_regionkey, r_name FROM region", "region")
def _(spark, region):
    path = scratch(region, "out") + "/region.json"
    region.write.json(path)
    return readers.file_table(spark, path, "r_regionkey int, r_name string")


@query("b2_export_import", "SELECT count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey", "nation", "region")
def _(spark, nation, region):
    path = scratch(nation, "db")
    readers.export_database({"nation": nation, "region": region}, path)
    t = readers.import_database(spark, ["nation", "region"], path)
    return t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).agg(F.count("*").alias("n"))


@query("b2_insert_overwrite_partition", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1", "orders")
def _(spark, orders):
    path = scratch(orders, "parts")
    orders.where("o_orderstatus <> 'P'").write.partitionBy("o_orderstatus").parquet(path)
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("b2_materialized_view", "SELECT o_orderstatus, max(o_totalprice) AS m FROM orders GROUP BY 1", "orders")
def _(spark, orders):
    path = scratch(orders, "view")
    view = orders.groupBy("o_orderstatus").agg(F.max("o_totalprice").alias("m"))
    view.where("FALSE").write.parquet(path)  # created without data
    view.write.mode("overwrite").parquet(path)  # refreshed
    return spark.read.parquet(path)


@query("b2_inline_data", "SELECT * FROM (VALUES (1, 'a'), (2, 'é')) AS t(i, s)")
def _(spark):
    lines = spark.createDataFrame([("1,a",), ("2,é",)], "value string")
    return lines.select(F.from_csv("value", "i int, s string").alias("r")).select("r.*")


# ---- windows, sets, blocks


@query("b6_row_pattern", "WITH o AS (SELECT event_id, value > lag(value) OVER w AS up FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id FROM o WHERE up", "events")
def _(spark, events):
    d = {"UP": F.col("value") > F.col("prev_value")}
    return patterns.match_recognize(events.select("user_id", "event_id", "ts", "value"), ["user_id"], ["ts", "event_id"], d, "UP").select("event_id")


@query("b8_parallel_with", "SELECT 'n' AS t, count(*) AS n FROM nation UNION ALL SELECT 'r', count(*) FROM region", "nation", "region")
def _(spark, nation, region):
    with ThreadPoolExecutor(2) as pool:
        counts = list(pool.map(lambda x: (x[0], x[1].count()), [("n", nation), ("r", region)]))
    return spark.createDataFrame(counts, "t string, n bigint")


@query("b12_cursor", "SELECT CAST(sum(n_nationkey) AS BIGINT) AS s FROM nation", "nation")
def _(spark, nation):
    total = sum(r.n_nationkey for r in nation.select("n_nationkey").toLocalIterator())  # one partition at a time
    return spark.createDataFrame([(total,)], "s bigint")


@query("b12_pandas_udf", "SELECT n_nationkey, length(n_name) AS n FROM nation", "nation")
def _(spark, nation):
    @F.pandas_udf("bigint")
    def size(s):
        return s.str.len()

    return nation.select("n_nationkey", size("n_name").alias("n"))


@query("b12_pandas_aggregate", "SELECT o_orderstatus, round(mad(o_totalprice), 4) AS m FROM orders GROUP BY 1", "orders")
def _(spark, orders):
    """An aggregate that no built-in is: the median distance from the median, in one Arrow batch a group."""

    @F.pandas_udf("double")
    def mad(x: pd.Series) -> float:
        return float((x - x.median()).abs().median())

    return orders.groupBy("o_orderstatus").agg(F.round(mad("o_totalprice"), 4).alias("m"))


@query("b13_session_settings", "SELECT 'UTC' AS v")
def _(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.sql("SET TIME ZONE 'UTC'")
    out = spark.sql("SELECT current_timezone() AS v").first().v
    spark.conf.set("spark.sql.session.timeZone", before)
    return spark.createDataFrame([(out,)], "v string")


@query("b13_show_columns", "SELECT * FROM (VALUES ('r_regionkey'), ('r_name')) AS t(col_name)", "region")
def _(spark, region):
    region.createOrReplaceTempView("arborlake_region")
    return spark.sql("SHOW COLUMNS IN arborlake_region")


# ---- other query languages


@query("b14_named_expressions", "SELECT event_type, count(*) AS n FROM events WHERE value > 10 GROUP BY event_type", "events")
def _(spark, events):
    events.createOrReplaceTempView("arborlake_events")
    spark.sql("SELECT * FROM arborlake_events WHERE value > 10").createOrReplaceTempView("arborlake_big")  # $big = (SELECT ..)
    return spark.sql("SELECT event_type, count(*) AS n FROM arborlake_big GROUP BY event_type")


@query("b14_split_script", "SELECT * FROM (VALUES (1, 0, 'select 1'), (1, 1, 'select '';'''), (2, 0, 'drop table t')) AS t(doc_id, i, statement)")
def _(spark):
    df = spark.createDataFrame([(1, "select 1; select ';' ; -- end"), (2, "/* a; */ drop table t")], "doc_id int, text string")

    @F.pandas_udf("array<string>")
    def split(s):
        return s.map(statements)

    return df.select("doc_id", F.posexplode(split("text")).alias("i", "statement"))


@query("b14_last_write_ttl", "SELECT user_id, arg_max(value, event_id) AS value FROM events WHERE event_id % 3 <> 0 GROUP BY user_id", "events")
def _(spark, events):
    from arborlake.operators import changes as C

    e = events.withColumn("expires", F.when(F.col("event_id") % 3 == 0, F.lit(5)))
    return C.last_write(e, ["user_id"], ["value"], "event_id", "expires", F.lit(5))


# ---- the rest of tree navigation and queries


def _json(events):
    return T.parse(events, "json", "event_id", "props")


@query("a5_child_with_descendant", "SELECT event_id, 'pair' AS kind FROM events", "events")
def _(spark, events):
    n = written(T.parse(events, "json", "event_id", "props", columns=["layer_id", "node_id", "ancestors", "kind"]), "nodes")
    t = n.where("kind = 'string_content'").select("event_id", "layer_id", F.lit(1).alias("ancestor_id"), F.col("node_id").alias("target_id"))
    return T.child_with_descendant(n, t, "event_id").select("event_id", "kind")


@query("a5_points_and_flags", "SELECT event_id, 0 AS start_row, CAST(length(props) AS INT) AS end_col, FALSE AS has_error FROM events", "events")
def _(spark, events):
    return _json(events).where("kind = 'object'").select("event_id", "start_row", "end_col", "has_error")


@query("a6_first_last_child", "SELECT event_id, '{' AS a, '}' AS b FROM events", "events")
def _(spark, events):
    n = _json(events).where("parent_id = 1")
    return n.groupBy("event_id").agg(F.min_by("kind", "child_index").alias("a"), F.max_by("kind", "child_index").alias("b"))


@query("a6_goto_descendant", "SELECT event_id, 'pair' AS kind, 2 AS depth FROM events", "events")
def _(spark, events):
    return _json(events).where("node_id = 3").select("event_id", "kind", "depth")


@query("a7_subtypes", "SELECT * FROM (VALUES ('_value', 'number'), ('_value', 'object'), ('_value', 'string')) AS t(supertype, kind)", "events")
def _(spark, events):
    return _json(events).select(F.explode("supertypes").alias("supertype"), "kind").distinct()


@query("a8_supertype_and_missing", "SELECT * FROM (VALUES (1, 0, '1'), (1, 0, '\"a\"'), (1, 1, '')) AS t(doc_id, pattern_index, text)")
def _(spark):
    df = spark.createDataFrame([(1, '[1, "a"')], "doc_id int, text string")
    m = T.query_texts(df, "json", '[(_value/number) (_value/string)] @v\n(MISSING "]") @m')
    return m.select("doc_id", "pattern_index", F.col("captures")[0]["text"].alias("text"))


@query("a8_sibling_order", "SELECT * FROM (VALUES (1, '1', '2'), (1, '1', '3'), (1, '2', '3')) AS t(doc_id, a, b)")
def _(spark):
    df = spark.createDataFrame([(1, "[1, 2, 3]")], "doc_id int, text string")
    m = T.query_texts(df, "json", "(array (number) @a (number) @b)")
    return m.select("doc_id", F.col("captures")[0]["text"].alias("a"), F.col("captures")[1]["text"].alias("b"))


@query("a9_equal_captures", "SELECT * FROM (VALUES (1, '\"a\"')) AS t(doc_id, v)")
def _(spark):
    df = spark.createDataFrame([(1, '{"a": "a", "b": "c"}')], "doc_id int, text string")
    m = T.query_texts(df, "json", "(pair key: (string) @k value: (string) @v (#eq? @k @v))")
    return m.select("doc_id", F.col("captures")[1]["text"].alias("v"))


@query("a10_containing_range", "SELECT event_id, 'string_content' AS kind FROM events", "events")
def _(spark, events):
    m = T.query_texts(events, "json", "(_) @n", "event_id", "props", containing=(2, 3))
    return m.select("event_id", F.col("captures")[0]["kind"].alias("kind"))


@query("a10_match_limit", "SELECT * FROM (VALUES (1, CAST(2 AS BIGINT), TRUE)) AS t(doc_id, n, exceeded)")
def _(spark):
    df = spark.createDataFrame([(1, "[1, 2, 3, 4]")], "doc_id int, text string")
    m = T.query_texts(df, "json", "(array (number) @a (number) @b)", match_limit=2)
    return m.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("exceeded").alias("exceeded"))


@query("a12_recognised_names", "SELECT * FROM (VALUES (1, 'function.builtin'), (2, 'string')) AS t(i, name)")
def _(spark):
    names = ["string", "function", "function.builtin", "keyword"]
    rows = [(1, T.recognised("function.builtin.static", names)), (2, T.recognised("string.special.key", names))]
    return spark.createDataFrame(rows, "i int, name string")


@query("a2_dialect_lexing", "SELECT * FROM (VALUES ('mysql', CAST(1 AS BIGINT)), ('sqlserver', CAST(2 AS BIGINT)), ('standard', CAST(2 AS BIGINT))) AS t(dialect, n)")
def _(spark):
    text = "select [a;b] from t # c; d"
    found = [("mysql", len(statements("select 'a\\';b' # c; d", "mysql"))), ("sqlserver", len(statements("select [a;b] from t\nGO\nselect 2", "sqlserver"))), ("standard", len(statements(text, "standard")) - 1)]
    return spark.createDataFrame(found, "dialect string, n bigint")


@query("a2_keywords", "SELECT * FROM (VALUES ('select', CAST(4 AS BIGINT)), ('from', CAST(4 AS BIGINT)), ('values', CAST(1 AS BIGINT))) AS t(word, n)")
def _(spark):
    n = T.parse(spark.createDataFrame(SQL_TEXTS, "doc_id bigint, text string"), "sql", kinds=["keyword"], columns=["text"])
    return n.groupBy(F.lower("text").alias("word")).agg(F.count("*").alias("n")).where("word in ('select', 'from', 'values')")
