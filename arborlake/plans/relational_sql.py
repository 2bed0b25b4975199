"""Relational queries that Spark SQL runs as written: one for each form; DuckDB's text where it differs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborlake.plans.registry import register
from arborlake.session import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def sql(name: str, text: str, duck: str | None = None) -> None:
    used = [t for t in TABLES if t in text]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in used:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(text)

    register(name, duck or text)(run)


# B1 scans and sources
sql("b1_table_scan", "SELECT o_orderkey, o_orderstatus FROM orders")
sql("b1_derived_table", "SELECT d.k, d.n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) d WHERE d.n > 12")
sql("b1_lateral_subquery", "SELECT c_custkey, t.n FROM customer, LATERAL (SELECT count(*) AS n FROM orders WHERE o_custkey = c_custkey) t")
sql("b1_values", "SELECT x, y FROM (VALUES (1, 'a'), (2, 'b'), (NULL, 'c')) AS v(x, y)")
sql("b1_table_statement", "TABLE region")
sql("b1_column_aliases", "SELECT a, b FROM (SELECT r_regionkey, r_name FROM region) AS t(a, b)")
sql("b1_cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE s > 1000) SELECT o_custkey, round(s, 2) AS s FROM top")
sql("b1_recursive_cte", "WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f + n FROM t WHERE n < 20) SELECT n, f FROM t")
sql("b1_table_function", "SELECT id FROM range(10)", "SELECT range AS id FROM range(10)")
sql("b1_sample_all", "SELECT count(*) AS n FROM orders TABLESAMPLE (100 PERCENT)", "SELECT count(*) AS n FROM orders")
sql("b1_no_from", "SELECT 1 AS a, 'x' AS b, 2 + 3 AS c")

# B3 projections and predicates
sql("b3_select_alias", "SELECT l_orderkey AS k, l_linenumber AS ln, CAST(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2))) AS DOUBLE) AS net FROM lineitem")
sql("b3_star", "SELECT * FROM nation")
sql("b3_star_except", "SELECT * EXCEPT (n_regionkey) FROM nation", "SELECT * EXCLUDE (n_regionkey) FROM nation")
sql("b3_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
sql("b3_where", "SELECT o_orderkey FROM orders WHERE (o_totalprice > 100000 AND o_orderstatus = 'F') OR NOT o_orderpriority LIKE '1%'")
sql("b3_having", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 500")
sql("b3_boolean_logic", "SELECT p_partkey, (p_size > 10 AND p_size < 20) AS a, (p_size > 40 OR p_brand = 'Brand#11') AS b, NOT (p_size = 1) AS c FROM part")
sql("b3_is_tests", "SELECT event_id, (CASE WHEN value > 50 THEN value END) IS NULL AS a, (value > 50) IS TRUE AS b, (value > 50) IS NOT FALSE AS c FROM events")
sql("b3_is_distinct_from", "SELECT c_custkey, nullif(c_nationkey, 3) IS DISTINCT FROM 4 AS a, nullif(c_nationkey, 3) IS NOT DISTINCT FROM NULL AS b FROM customer")
sql("b3_between", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 50000 AND 60000")
sql("b3_in_list", "SELECT n_name FROM nation WHERE n_regionkey IN (1, 3)")
sql("b3_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
sql("b3_not_in_subquery", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
sql("b3_like_ilike", "SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_type ILIKE '%S%' AND p_brand NOT LIKE 'Brand#1_'")
sql("b3_like_escape", "SELECT p_partkey, ('a%' || p_brand) LIKE 'a!%%' ESCAPE '!' AS m FROM part")
sql("b3_regexp", "SELECT p_partkey FROM part WHERE regexp_like(p_brand, '^Brand#[12][1-3]$')", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '^Brand#[12][1-3]$')")
sql("b3_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O')")
sql("b3_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
sql("b3_scalar_subquery", "SELECT o_orderkey, round(o_totalprice - (SELECT avg(o_totalprice) FROM orders), 1) AS d FROM orders")
sql("b3_correlated_scalar", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS m FROM customer")
sql("b3_case", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS s, CASE WHEN o_totalprice > 100000 THEN 2 WHEN o_totalprice > 50000 THEN 1 ELSE 0 END AS c FROM orders")

# B4 joins
sql("b4_inner_on", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 150000")
sql("b4_theta_join", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql("b4_using", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x JOIN (SELECT s_nationkey AS k, s_name AS b FROM supplier) y USING (k)")
sql("b4_natural", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT s_nationkey AS k, s_name AS b FROM supplier) y")
sql("b4_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("b4_left_outer", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
sql("b4_right_outer", "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'P'")
sql("b4_full_outer", "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey AND c_nationkey > 12")
sql("b4_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'")
sql("b4_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
sql("b4_array_join", "SELECT s_suppkey, x FROM supplier LATERAL VIEW explode(array(s_nationkey, s_nationkey + 1)) t AS x", "SELECT s_suppkey, unnest([s_nationkey, s_nationkey + 1]) AS x FROM supplier")
sql("b4_ordinality", "SELECT s_suppkey, pos + 1 AS i, x FROM supplier LATERAL VIEW posexplode(split(s_name, '#')) t AS pos, x", "SELECT s_suppkey, unnest(range(1, len(string_split(s_name, '#')) + 1))::INT AS i, unnest(string_split(s_name, '#')) AS x FROM supplier")
sql("b4_comma_list", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
sql("b4_star_join", "SELECT r_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")

# B5 aggregation
sql("b5_group_by", "SELECT o_orderpriority, count(*) AS n, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM orders GROUP BY o_orderpriority")
sql("b5_group_by_all", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
sql("b5_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_linestatus) AS BIGINT) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql("b5_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
sql("b5_grouping_sets", "SELECT l_returnflag, l_linestatus, l_suppkey % 3 AS m, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_suppkey % 3), ())")
sql("b5_empty_group", "SELECT count(*) AS n, max(o_totalprice) AS m FROM orders GROUP BY GROUPING SETS (())")
sql("b5_with_rollup", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus WITH ROLLUP", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)")
sql("b5_distinct_aggregate", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey) AS p, count(*) AS n FROM lineitem GROUP BY l_returnflag")
sql("b5_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS m FROM orders GROUP BY o_orderpriority")
sql("b5_within_group", "SELECT l_returnflag, percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity) AS med, percentile_disc(0.9) WITHIN GROUP (ORDER BY l_quantity) AS p90 FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS med, quantile_disc(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag")
sql("b5_listagg", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql("b5_statistics", "SELECT p_brand, round(stddev_samp(p_retailprice), 4) AS sd, round(var_pop(p_size), 4) AS v, round(corr(p_size, p_retailprice), 6) AS r, round(skewness(p_size), 4) AS sk FROM part GROUP BY p_brand", "SELECT p_brand, round(stddev_samp(p_retailprice), 4) AS sd, round(var_pop(p_size), 4) AS v, round(corr(p_size, p_retailprice), 6) AS r, round((avg(p_size ** 3) - 3 * avg(p_size) * var_pop(p_size) - avg(p_size) ** 3) / var_pop(p_size) ** 1.5, 4) AS sk FROM part GROUP BY p_brand")
sql("b5_bool_bit_aggregates", "SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS a, bool_or(o_totalprice > 400000) AS o, CAST(bit_xor(o_custkey) AS BIGINT) AS x FROM orders GROUP BY o_orderstatus")
sql("b5_arg_max", "SELECT o_orderpriority, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS k FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS k FROM orders GROUP BY o_orderpriority")
sql("b5_pivot", "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_totalprice FROM orders) PIVOT (count(o_totalprice) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT o_orderpriority, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY o_orderpriority")
sql("b5_unpivot", "SELECT n_nationkey, name, val FROM (SELECT n_nationkey, n_regionkey AS a, n_nationkey * 2 AS b FROM nation) UNPIVOT (val FOR name IN (a, b))")
sql("b5_ordered_array", "SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), ';') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql("b5_histogram_counts", "SELECT floor(p_retailprice / 100) * 100 AS bucket, count(*) AS n FROM part GROUP BY 1", "SELECT CAST(floor(p_retailprice / 100) * 100 AS BIGINT) AS bucket, count(*) AS n FROM part GROUP BY 1")

# B6 window functions
sql("b6_over", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS s FROM orders")
sql("b6_named_window", "SELECT o_orderkey, CAST(rank() OVER w AS BIGINT) AS r, CAST(dense_rank() OVER w AS BIGINT) AS d, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
sql("b6_rows_frame", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS a FROM orders")
sql("b6_range_frame", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) AS n FROM lineitem")
sql("b6_interval_range", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS n FROM events")
sql("b6_lead_lag", "SELECT event_id, lag(value, 1, 0.0D) OVER w AS a, lead(value) OVER w AS b, first_value(value) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", "SELECT event_id, lag(value, 1, 0.0) OVER w AS a, lead(value) OVER w AS b, first_value(value) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
sql("b6_ignore_nulls", "SELECT event_id, last_value(nullif(event_type, 'view')) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t FROM events", "SELECT event_id, last_value(nullif(event_type, 'view') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t FROM events")
sql("b6_ntile_distribution", "SELECT p_partkey, CAST(ntile(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS BIGINT) AS q, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice), 6) AS pr, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_retailprice), 6) AS cd FROM part")
sql("b6_nth_value", "SELECT p_partkey, nth_value(p_partkey, 2) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS x FROM part")

# B7 order and limit
sql("b7_order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20")
sql("b7_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")
sql("b7_order_by_all", "SELECT o_orderstatus, o_orderpriority FROM orders ORDER BY ALL LIMIT 40")
sql("b7_collate", "SELECT count(DISTINCT lower(r_name)) AS n, bool_and(r_name COLLATE UTF8_LCASE = lower(r_name) COLLATE UTF8_LCASE) AS same FROM region", "SELECT count(DISTINCT lower(r_name)) AS n, bool_and(r_name COLLATE NOCASE = lower(r_name)) AS same FROM region")
sql("b7_distribute_sort", "SELECT o_orderstatus, count(*) AS n FROM (SELECT * FROM orders DISTRIBUTE BY o_orderstatus SORT BY o_orderkey) GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")

# B8 set operations
sql("b8_union_all", "SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer")
sql("b8_union", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
sql("b8_intersect", "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer")
sql("b8_intersect_all", "SELECT s_nationkey AS k FROM supplier INTERSECT ALL SELECT c_nationkey FROM customer")
sql("b8_except", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier")
sql("b8_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
sql("b8_minus", "SELECT n_nationkey AS k FROM nation MINUS SELECT s_nationkey FROM supplier", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier")
sql("b8_precedence", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 3 UNION SELECT s_nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_nationkey > 20")
sql("b8_from_first", "FROM nation SELECT n_name, n_regionkey WHERE n_regionkey > 2", "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey > 2")
sql("b8_pipe", "FROM orders |> WHERE o_totalprice > 100000 |> AGGREGATE count(*) AS n GROUP BY o_orderstatus |> WHERE n > 1", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus HAVING count(*) > 1")

# B9 scalar expressions
sql("b9_operators", "SELECT p_partkey, p_size + 2 * 3 AS a, p_size % 7 AS m, p_size & 5 AS b, p_size | 8 AS o, p_size ^ 3 AS x, p_brand || '-' || p_type AS t, -p_size AS neg FROM part", "SELECT p_partkey, p_size + 2 * 3 AS a, p_size % 7 AS m, p_size & 5 AS b, p_size | 8 AS o, xor(p_size, 3) AS x, p_brand || '-' || p_type AS t, -p_size AS neg FROM part")
sql("b9_special_forms", "SELECT n_nationkey, substring(n_name FROM 2 FOR 3) AS s, trim(BOTH 'N' FROM n_name) AS t, overlay(n_name PLACING 'zz' FROM 2 FOR 1) AS o, position('A' IN n_name) AS p FROM nation", "SELECT n_nationkey, substring(n_name, 2, 3) AS s, trim(n_name, 'N') AS t, substring(n_name, 1, 1) || 'zz' || substring(n_name, 3) AS o, CAST(position('A' IN n_name) AS INT) AS p FROM nation")
sql("b9_extract", "SELECT o_orderkey, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(extract(MONTH FROM o_orderdate) AS BIGINT) AS m, CAST(extract(DAY FROM o_orderdate) AS BIGINT) AS d FROM orders")
sql("b9_cast", "SELECT p_partkey, CAST(p_size AS STRING) AS s, CAST(p_retailprice AS INT) AS i, try_cast(p_brand AS INT) AS n, '12'::INT AS c FROM part WHERE p_retailprice = floor(p_retailprice)", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS s, CAST(p_retailprice AS INT) AS i, try_cast(p_brand AS INT) AS n, '12'::INT AS c FROM part WHERE p_retailprice = floor(p_retailprice)")
sql("b9_struct_field", "SELECT p_partkey, s.a + 1 AS a, s.b AS b FROM (SELECT p_partkey, named_struct('a', p_size, 'b', p_brand) AS s FROM part)", "SELECT p_partkey, s.a + 1 AS a, s.b AS b FROM (SELECT p_partkey, {'a': p_size, 'b': p_brand} AS s FROM part)")
sql("b9_array_literal", "SELECT p_partkey, element_at(array(p_size, 7, 9), 2) AS e, CAST(size(array(1, 2, 3)) AS BIGINT) AS n FROM part", "SELECT p_partkey, [p_size, 7, 9][2] AS e, len([1, 2, 3]) AS n FROM part")
sql("b9_map_literal", "SELECT p_partkey, map('a', p_size, 'b', 2)['a'] AS v FROM part", "SELECT p_partkey, MAP {'a': p_size, 'b': 2}['a'] AS v FROM part")
sql("b9_lambda", "SELECT p_partkey, array_join(transform(array(1, 2, p_size), x -> x * 2), ',') AS t, aggregate(array(1, 2, p_size), 0, (a, x) -> a + x) AS s FROM part", "SELECT p_partkey, array_to_string(list_transform([1, 2, p_size], lambda x: x * 2), ',') AS t, CAST(list_sum([1, 2, p_size]) AS INT) AS s FROM part")
sql("b9_interval", "SELECT o_orderkey, o_orderdate + INTERVAL '3' DAY AS d, o_orderdate - INTERVAL '2' MONTH AS m FROM orders")
sql("b9_typed_literal", "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < TIMESTAMP_NTZ '1997-03-01 00:00:00'", "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < TIMESTAMP '1997-03-01 00:00:00'")
sql("b9_json_path", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
sql("b9_variant", "SELECT event_id, variant_get(parse_json(props), '$.k', 'int') AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
sql("b9_strings", "SELECT n_nationkey, upper(lower(n_name)) AS u, CAST(length(n_name) AS BIGINT) AS l, reverse(n_name) AS r, lpad(n_name, 12, '*') AS p, replace(n_name, 'A', 'a') AS x, left(n_name, 3) AS h, repeat('ab', 2) AS q FROM nation")
sql("b9_math", "SELECT p_partkey, round(sqrt(p_size), 6) AS s, abs(p_size - 25) AS a, round(ln(p_size + 1), 6) AS l, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(sign(p_size - 25) AS INT) AS g, round(power(p_size, 1.5), 4) AS w FROM part")
sql("b9_dates", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS m, CAST(datediff(o_orderdate, DATE '1992-01-01') AS BIGINT) AS d, date_format(o_orderdate, 'yyyy-MM') AS f FROM orders", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, date_diff('day', DATE '1992-01-01', o_orderdate) AS d, strftime(o_orderdate, '%Y-%m') AS f FROM orders")
sql("b9_conditionals", "SELECT p_partkey, coalesce(nullif(p_size, 7), 0) AS c, greatest(p_size, 10) AS g, least(p_size, 10) AS l, if(p_size > 5, 'y', 'n') AS i FROM part")

# B10 types
sql("b10_literals", "SELECT 1e3 AS a, 31 AS h, 'it''s' AS s, CAST('12.34' AS DECIMAL(10, 2)) AS d, hex(X'1F2E') AS b FROM region WHERE r_regionkey = 0", "SELECT 1000.0::DOUBLE AS a, 31 AS h, 'it''s' AS s, CAST('12.34' AS DECIMAL(10, 2)) AS d, '1F2E' AS b FROM region WHERE r_regionkey = 0")
