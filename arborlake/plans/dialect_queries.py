"""Dialect texts that run on Spark after rewriting; DuckDB runs the same text, or one of the same meaning."""

from __future__ import annotations

from arborlake.plans.dialects import run
from arborlake.plans.registry import register
from arborlake.plans.relational_sql import TABLES
from arborlake.session import table


def dialect(name: str, text: str, kind: str = "duckdb", duck: str | None = None) -> None:
    used = [t for t in TABLES if t in text]

    def go(spark, sf_dir):
        return run(spark, text, kind, **{t: table(spark, sf_dir, t) for t in used})

    register(name, duck or text)(go)


dialect("sql_qualify", "SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 1000 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
dialect("sql_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderkey")
dialect("sql_fetch_first", "SELECT p_partkey FROM part ORDER BY p_partkey FETCH FIRST 5 ROWS ONLY", "oracle", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 5")
dialect("sql_fetch_with_ties", "SELECT p_partkey, p_size FROM part ORDER BY p_size FETCH FIRST 10 ROWS WITH TIES", "postgres", "SELECT p_partkey, p_size FROM part QUALIFY rank() OVER (ORDER BY p_size) <= 10")
dialect("sql_top", "SELECT TOP 4 [p_partkey] FROM [part] ORDER BY [p_partkey] DESC", "sqlserver", "SELECT p_partkey FROM part ORDER BY p_partkey DESC LIMIT 4")
dialect("sql_limit_offset_comma", "SELECT `p_partkey` FROM part ORDER BY p_partkey LIMIT 5, 3 # page", "mysql", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 3 OFFSET 5")
dialect("sql_limit_by", "SELECT o_custkey, o_orderkey FROM orders ORDER BY o_orderkey LIMIT 2 BY o_custkey", "clickhouse", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 2")
dialect("sql_exclude_quoted", 'SELECT * EXCLUDE (n_regionkey) FROM "nation" AS "n"')
dialect("sql_semi_anti", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey ANTI JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 1")
dialect("sql_comprehension", "SELECT n_nationkey, len([x + 1 FOR x IN [1, 2, n_nationkey] IF x > 1])::BIGINT AS a FROM nation")
dialect("sql_map_literal", "SELECT n_nationkey, MAP {'a': n_nationkey, 'b': 2}['a'] AS m FROM nation")
dialect("sql_function_names", "SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS k, bool_or(o_orderstatus = 'F') AS b FROM orders GROUP BY o_custkey")
dialect("sql_cast_types", "SELECT p_partkey, CAST(p_size AS HUGEINT)::BIGINT AS h, CAST(p_retailprice AS DECIMAL(10, 1)) AS d, TRY_CAST(p_brand AS INT8) AS t FROM part WHERE p_retailprice = round(p_retailprice, 1)", "duckdb", "SELECT p_partkey, CAST(p_size AS BIGINT) AS h, CAST(p_retailprice AS DECIMAL(10, 1)) AS d, TRY_CAST(p_brand AS BIGINT) AS t FROM part WHERE p_retailprice = round(p_retailprice, 1)")
dialect("sql_from_first", "FROM nation WHERE n_regionkey = 1")
dialect("sql_cte_materialized", "WITH q AS MATERIALIZED (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey) SELECT * FROM q WHERE n > 2 UNION ALL SELECT -1, 0")
dialect("sql_nested_qualify", "SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) <= 2) t")
dialect("sql_odbc_escapes", "SELECT o_orderkey, {fn upper({fn left(o_orderpriority, 3)})} AS p, '{d x}' AS s FROM {oj orders LEFT OUTER JOIN customer ON o_custkey = c_custkey} WHERE o_orderdate >= {d '1997-01-01'} AND o_orderdate < {ts '1997-03-01 00:00:00'}", "standard", "SELECT o_orderkey, upper(left(o_orderpriority, 3)) AS p, '{d x}' AS s FROM orders LEFT OUTER JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < TIMESTAMP '1997-03-01 00:00:00'")
dialect("sql_outer_mark", "SELECT n.n_name, s.s_suppkey FROM nation n, supplier s WHERE n.n_nationkey = s.s_nationkey(+) AND s.s_acctbal(+) > 0 AND n.n_regionkey < 3 ORDER BY n.n_name", "oracle", "SELECT n_name, s_suppkey FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 0 WHERE n_regionkey < 3")
