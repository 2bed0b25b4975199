"""Texts of other query languages over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlake.plans import languages as L
from arborlake.plans.relational import query

# ---- SPARQL over the triples of nations, regions and suppliers


def _triples(nation, region, supplier):
    t = L.triples_of(supplier.select("s_suppkey", F.concat(F.lit("n"), "s_nationkey").alias("in"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")), "s_suppkey", "s")
    t = t.unionAll(L.triples_of(nation.select("n_nationkey", F.concat(F.lit("r"), "n_regionkey").alias("part"), F.col("n_name").alias("name")), "n_nationkey", "n"))
    return t.unionAll(L.triples_of(region.select("r_regionkey", F.col("r_name").alias("name")), "r_regionkey", "r"))


def sparql(name: str, sql: str, text: str, casts: list[str] | None = None):
    @query(name, sql, "nation", "region", "supplier")
    def _(spark, nation, region, supplier):
        out = L.sparql(_triples(nation, region, supplier), text)
        return out.selectExpr(*casts) if casts else out


sparql(
    "b14_graph_pattern",
    "SELECT DISTINCT n_name AS x, r_name AS y FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "SELECT DISTINCT ?x ?y WHERE { ?s <in> ?n . ?n <name> ?x ; <part> ?r . ?r <name> ?y }",
)
sparql(
    "b14_property_path",
    "SELECT s_name AS x, r_name AS y FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "SELECT ?x ?y WHERE { ?s <name> ?x . ?s <in>/<part>/<name> ?y }",
)
sparql(
    "b14_path_closure",
    "SELECT DISTINCT r_name AS y, n_name AS x FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT DISTINCT r_name, s_name FROM nation JOIN region ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey UNION SELECT DISTINCT n_name, s_name FROM nation JOIN supplier ON s_nationkey = n_nationkey",
    "SELECT DISTINCT ?y ?x WHERE { ?r <name> ?y . ?r ^(<in>|<part>)+ ?n . ?n <name> ?x }",
)
sparql("b14_construct", "SELECT r_name AS s, 'has' AS p, n_name AS o FROM nation JOIN region ON n_regionkey = r_regionkey", "CONSTRUCT { ?y <has> ?x } WHERE { ?n <part> ?r ; <name> ?x . ?r <name> ?y }")
sparql("b14_ask", "SELECT count(*) > 0 AS yes FROM nation WHERE n_name = 'no such'", 'ASK { ?n <name> "no such" }')
sparql(
    "b14_optional_union_filter",
    "SELECT n_name AS x, CASE WHEN n_regionkey > 2 THEN r_name END AS y FROM nation JOIN region ON n_regionkey = r_regionkey WHERE regexp_matches(n_name, 'A') UNION ALL SELECT r_name, NULL FROM region",
    """SELECT ?x ?y WHERE {
         { ?n <part> ?any ; <name> ?x . FILTER regex(?x, "A") OPTIONAL { ?n <part> ?r . ?r <name> ?y FILTER (?r > "r2") } }
         UNION { ?q ^<part> ?some . ?q <name> ?x . FILTER NOT EXISTS { ?some <part> ?q . ?other <part> ?q . FILTER (?other < ?some) } }
       }""",
)
sparql(
    "b14_sparql_aggregate",
    "SELECT r_name AS y, count(*) AS n, CAST(round(sum(s_acctbal), 2) AS DOUBLE) AS total FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, y LIMIT 3",
    "SELECT ?y (count(?s) AS ?n) (sum(?b) AS ?total) WHERE { ?s <in>/<part> ?r ; <balance> ?b . ?r <name> ?y } GROUP BY ?y HAVING (count(?s) > 1) ORDER BY DESC(?n) ?y LIMIT 3",
    ["y", "n", "round(total, 2) AS total"],
)
sparql(
    "b14_sparql_values_bind_minus",
    "SELECT n_name AS x, 'r' || n_regionkey AS r, lower(n_name) || '!' AS z FROM nation WHERE n_regionkey IN (1, 2) AND NOT starts_with(n_name, 'I')",
    'SELECT ?x ?r ?z WHERE { VALUES ?r { "r1" "r2" } ?n <part> ?r ; <name> ?x . BIND(concat(lcase(?x), "!") AS ?z) MINUS { ?n <name> ?x FILTER strstarts(?x, "I") } }',
)
sparql(
    "b14_sparql_subselect",
    "SELECT n_name AS x, k FROM nation JOIN (SELECT s_nationkey, count(*) AS k FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey",
    "SELECT ?x ?k WHERE { { SELECT ?n (count(*) AS ?k) WHERE { ?s <in> ?n } GROUP BY ?n } ?n <name> ?x }",
)


# ---- Cypher


def _graph(nation, region, customer, part):
    tables = {"Nation": (nation, "n_nationkey"), "Region": (region, "r_regionkey"), "Customer": (customer, "c_custkey"), "Part": (part, "p_partkey")}
    twice = part.select("p_partkey", (F.col("p_partkey") * 2).alias("double"))
    return L.Graph(tables, {"PART_OF": (nation, "n_nationkey", "n_regionkey"), "LIVES_IN": (customer, "c_custkey", "c_nationkey"), "DOUBLE": (twice, "p_partkey", "double")})


def cypher(name: str, sql: str, text: str, casts: list[str] | None = None):
    @query(name, sql, "nation", "region", "customer", "part")
    def _(spark, nation, region, customer, part):
        out = L.cypher(_graph(nation, region, customer, part), text)
        return out.selectExpr(*casts) if casts else out


cypher(
    "b14_cypher_match",
    "SELECT c_custkey AS c, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 5000 AND r_name <> 'ASIA'",
    "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation)-[:PART_OF]->(r:Region) WHERE c.c_acctbal > 5000 AND r.r_name <> 'ASIA' RETURN c AS c, n.n_name AS nation, r.r_name AS region",
)
cypher(
    "b14_cypher_aggregate",
    "SELECT r_name AS region, count(*) AS n, max(c_acctbal) AS most FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1 ORDER BY n DESC, region LIMIT 3",
    "MATCH (r:Region)<-[:PART_OF]-(n:Nation)<-[:LIVES_IN]-(c:Customer {c_mktsegment: 'BUILDING'}) RETURN r.r_name AS region, count(c) AS n, max(c.c_acctbal) AS most ORDER BY n DESC, region LIMIT 3",
)
cypher(
    "b14_variable_length_path",
    "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_partkey <> 0 AND b.p_partkey IN (a.p_partkey * 4, a.p_partkey * 8)",
    "MATCH (a:Part)-[:DOUBLE*2..3]->(b:Part) RETURN a AS a, b AS b",
)


# ---- CQL


def cql(name: str, sql: str, text: str):
    @query(name, sql, "events", "nation")
    def _(spark, events, nation):
        return L.cql({"events": events, "nation": nation}, text, {"events": ["user_id"]}, {"events": ["ts", "event_id"]})


cql("b14_cql_select", "SELECT DISTINCT event_type FROM events WHERE user_id IN (1, 2, 3) ORDER BY event_type LIMIT 3", "SELECT DISTINCT event_type FROM events WHERE user_id IN (1, 2, 3) ORDER BY event_type LIMIT 3;")
cql("b14_cql_partition_limit", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 2", "SELECT user_id, event_id FROM shop.events PER PARTITION LIMIT 2 ALLOW FILTERING")
cql("b14_cql_group", "SELECT user_id, count(*) AS n, max(value) AS top FROM events WHERE event_type = 'click' GROUP BY user_id", "SELECT user_id, count(*) AS n, max(value) AS top FROM events WHERE event_type = 'click' GROUP BY user_id ALLOW FILTERING")
cql("b14_cql_json", """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS "[json]" FROM nation""", "SELECT JSON n_nationkey, n_name FROM nation")


# ---- GraphQL


@query("b14_nested_selection", "SELECT r_name AS name, (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation WHERE n_regionkey = r_regionkey AND n_name <> 'CHINA') AS nations FROM region WHERE r_regionkey IN (1, 2)", "nation", "region")
def _(spark, nation, region):
    types = {"region": L.Type(region, {"nations": ("nation", "r_regionkey", "n_regionkey", True)}), "nation": L.Type(nation.where("n_name <> 'CHINA'"))}
    text = """query ($keys: [Int]) { region(r_regionkey: $keys) { name: r_name nations { ...short n_nationkey @skip(if: true) } } }
              fragment short on nation { n_name }"""
    out = L.graphql(types, text, {"keys": [1, 2]})
    return out.select("name", F.array_join(F.transform("nations", lambda x: x["n_name"]), ",").alias("nations"))


@query("b14_nested_object", "SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY n_nationkey LIMIT 5 OFFSET 2", "nation", "region")
def _(spark, nation, region):
    types = {"nation": L.Type(nation, {"region": ("region", "n_regionkey", "r_regionkey", False)}), "region": L.Type(region)}
    out = L.graphql(types, "{ nation(first: 5, offset: 2) { n_nationkey region { r_name } } }")
    return out.select("n_nationkey", F.col("region.r_name").alias("r_name"))
