import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.operators import functions, joins, patterns, ranges, recursion, storage, windows
from arborlake.sources import readers


def test_nearest_vectors(spark):
    rnd = np.random.default_rng(1)
    v = rnd.normal(size=(200, 6)).round(1)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "i bigint, v array<double>").repartition(3)
    q = df.where("i % 20 = 0").select(F.col("i").alias("q"), "v")
    got = joins.nearest_vectors(q, df, "q", "v", "i", "v", 4, block_bytes=3 * 6 * 8)
    own = {}
    for r in got.collect():
        own.setdefault(r.q, []).append((r["rank"], r.i, round(r.distance, 9)))
    for k in range(0, 200, 20):
        d = sorted((round(float(np.sqrt(((v[k] - v[j]) ** 2).sum())), 9), j) for j in range(200))[:4]
        assert sorted(own[k]) == [(n + 1, j, x) for n, (x, j) in enumerate(d)]
    assert joins.nearest_vectors(q.limit(0), df, "q", "v", "i", "v", 4).count() == 0


def test_asof_with_and_without_buckets(spark):
    rnd = random.Random(3)
    left = [(i, rnd.choice("ab"), rnd.randrange(60)) for i in range(80)]
    right = [(rnd.choice("abc"), rnd.randrange(60), i) for i in range(40)]
    a = spark.createDataFrame(left, "i int, k string, t int")
    b = spark.createDataFrame(right, "k string, t int, v int")
    for strict in (False, True):
        for bucket in (None, F.floor(F.col("_t") / 7)):
            got = {r.i: r.v for r in joins.asof_join(a, b, "t", "t", ["k"], ["v"], "left", strict, bucket).collect()}
            for i, k, t in left:
                fit = [(u, v) for kk, u, v in right if kk == k and (u < t if strict else u <= t)]
                assert got[i] == (max(fit)[1] if fit else None), (strict, bucket)


def test_row_index(spark):
    df = spark.range(20011).select((F.col("id") * 37 % 20011).alias("x")).repartition(5)
    got = joins.with_row_index(df, ["x"], "n").collect()
    assert all(r.x == r.n for r in got) and len(got) == 20011
    assert joins.with_row_index(df.limit(0), ["x"], "n").count() == 0


def test_pattern_language(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate("abbcabc")], "i int, c string").withColumn("k", F.lit(1))
    d = {n.upper(): F.col("c") == n for n in "abc"}
    span = lambda p, **kw: sorted((r.match_no, r.i) for r in patterns.match_recognize(df, ["k"], ["i"], d, p, **kw).collect())
    assert span("A B+ C") == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 4), (2, 5), (2, 6)]
    assert span("(A | C) B{1,1}") == [(1, 0), (1, 1), (2, 4), (2, 5)]
    assert span("^ A B") == [(1, 0), (1, 1)]
    assert span("X C $") == [(1, 5), (1, 6)]
    assert span("B B?", after="to next row") == [(1, 1), (1, 2), (2, 2), (3, 5)]


#: Patterns as trees: a name; ("then", ..), ("or", ..), ("many", least, most or None, part), ("out", part)
TREES = [
    ("A B+", ("then", "A", ("many", 1, None, "B"))), ("A {- B* -} C", ("then", "A", ("out", ("many", 0, None, "B")), "C")), ("(A | B){2}", ("many", 2, 2, ("or", "A", "B"))),
    ("X Y", ("then", "X", "Y")), ("A? X B", ("then", ("many", 0, 1, "A"), "X", "B")), ("PERMUTE(A, B)", ("or", ("then", "A", "B"), ("then", "B", "A"))), ("(A B | C)+", ("many", 1, None, ("or", ("then", "A", "B"), "C"))),
]


def plain(part, rows, at, fits):
    """Each way in which a pattern matches from a place on, the preferred first: (end, [(row, variable, left out)])."""
    if isinstance(part, str):
        if at < len(rows) and fits(part, rows[at]):
            yield at + 1, [(at, part, False)]
    elif part[0] == "then":
        if len(part) == 1:
            yield at, []
            return
        for e, own in plain(part[1], rows, at, fits):
            for end, more in plain(("then", *part[2:]), rows, e, fits):
                yield end, own + more
    elif part[0] == "or":
        for p in part[1:]:
            yield from plain(p, rows, at, fits)
    elif part[0] == "out":
        for e, own in plain(part[1], rows, at, fits):
            yield e, [(r, n, True) for r, n, _ in own]
    else:
        _, least, most, p = part
        if most is None or most > 0:
            for e, own in plain(p, rows, at, fits):
                if e > at:
                    for end, more in plain(("many", max(0, least - 1), None if most is None else most - 1, p), rows, e, fits):
                        yield end, own + more
        if least == 0:
            yield at, []


def expected(tree, rows, fits, after):
    out, at = [], 0
    while at <= len(rows):
        e, own = next(plain(tree, rows, at, fits), (at, []))
        if e == at:
            at += 1
            continue
        out.append([(r, n) for r, n, gone in own if not gone])
        at = e if after == "past last row" else at + 1
    return out


@pytest.mark.parametrize("after", ["past last row", "to next row"])
@pytest.mark.parametrize("pattern,tree", TREES)
def test_patterns_against_a_plain_matcher(spark, pattern, tree, after):
    rnd = random.Random(len(pattern))
    fits = lambda name, row: name in ("X", "Y") or name.lower() in row
    parts = {k: ["".join(sorted(rnd.sample("abc", rnd.choice([1, 1, 2])))) for _ in range(rnd.randrange(14))] for k in [1, 2, 3, None]}
    df = spark.createDataFrame([(k, i, c) for k, rows in parts.items() for i, c in enumerate(rows)], "k int, i int, c string")
    d = {n: F.col("c").contains(n.lower()) for n in "ABC"}
    got = {}
    for r in patterns.match_recognize(df, ["k"], ["i"], d, pattern, after).collect():
        got.setdefault(r.k, {}).setdefault(r.match_no, []).append((r.i, r.classifier))
        assert r.row_no == r.i + 1
    for k, rows in parts.items():
        assert [sorted(got.get(k, {}).get(m + 1, [])) for m in range(len(expected(tree, rows, fits, after)))] == expected(tree, rows, fits, after)
        assert len(got.get(k, {})) == len([x for x in expected(tree, rows, fits, after) if x])


def test_measures_and_skips(spark):
    df = spark.createDataFrame([(i, c, 10 * i) for i, c in enumerate("abbcabc")], "i int, c string, v int").withColumn("k", F.lit(1))
    d = {n.upper(): F.col("c") == n for n in "abc"}
    m = patterns.match_recognize(df, ["k"], ["i"], d, "A B+ C", subsets={"S": ["A", "B"]})
    of, first, last = patterns.of, patterns.first, patterns.last
    got = patterns.one_row(m, ["k"], {"a": first("v", "A"), "lb": last("v", "B"), "ls": last("v", "S"), "n": F.count(of("v", "S")), "s": F.sum(of("v", "B"))}).orderBy("match_no").collect()
    assert [tuple(r) for r in got] == [(1, 1, 0, 20, 20, 3, 30), (1, 2, 40, 50, 50, 2, 50)]
    rows = lambda **kw: sorted((r.match_no, r.i) for r in patterns.match_recognize(df, ["k"], ["i"], d, "X B", **kw).collect())
    assert rows(after="to last B") == [(1, 0), (1, 1), (2, 1), (2, 2), (3, 4), (3, 5)] == rows(after="to first B")
    assert patterns.match_recognize(df, ["k"], ["i"], d, "A B", unmatched=True).where("match_no is null").count() == 3
    for bad in ({"after": "to first Z"}, {"after": "nowhere"}, {"subsets": {"S": ["Z"]}}):
        with pytest.raises(ValueError):
            rows(**bad)
    with pytest.raises(Exception, match="where the match begins"):
        rows(after="to first X")


def test_nearest_value(spark):
    rnd = random.Random(5)
    left = [(i, rnd.choice(["a", "a", "a", "b", "z", None]), rnd.choice([None, rnd.randrange(80)])) for i in range(150)]
    right = [(rnd.choice(["a", "a", "b", None]), rnd.choice([None, rnd.randrange(80)]), j) for j in range(60)]
    a, b = spark.createDataFrame(left, "i int, k string, x int"), spark.createDataFrame(right, "k string, y int, id int")
    for by, n in ((["k"], 7), ([], 256), (["k"], 1)):
        got = {r.i: (r.id, r.distance) for r in joins.nearest_value(a, b, "x", "y", "id", by, n).collect()}
        for i, k, x in left:
            fit = [] if x is None else [(abs(y - x), y, j) for kk, y, j in right if y is not None and (not by or kk == k)]
            assert got[i] == ((min(fit)[2], min(fit)[0]) if fit else (None, None)), (i, by, n)
    assert joins.nearest_value(a, b.limit(0), "x", "y", "id", ["k"]).where("id is not null").count() == 0


def test_table_function(spark):
    rows = [(k, t, k * 10 + t) for k in (1, 2, None, 3) if k is not None for t in range(2500 if k == 3 else 4)] + [(None, 1, 5), (None, 0, 6)]
    df = spark.createDataFrame(rows, "k int, t int, v int").repartition(3)

    def head(key, rows):
        yield next(rows)[0], key[0] is None

    assert sorted(map(tuple, functions.table_function(df, ["k"], ["t"], ["v"], head, "first int, none boolean").collect()), key=str) == sorted([(1, 10, False), (2, 20, False), (3, 30, False), (None, 6, True)], key=str)
    n = functions.table_function(df, [], ["t"], ["v"], lambda key, rows: iter([(sum(1 for _ in rows),)]), "n int")
    assert [tuple(r) for r in n.collect()] == [(len(rows),)]
    assert functions.table_function(df.limit(0), ["k"], ["t"], ["v"], head, "first int, none boolean").count() == 0


def test_model(spark):
    cells = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 5), ("b", None, 7)], "k string, d int, m bigint")
    rules = [(3, lambda c: c(1) + F.coalesce(c(2), F.lit(0))), (1, lambda c: c(3) * 2)]
    assert sorted(map(tuple, functions.model(cells, ["k"], "d", "m", rules).collect())) == [("a", 1, 60), ("a", 2, 20), ("a", 3, 30), ("b", 1, 10), ("b", 3, 5)]


def test_small(spark):
    wide = spark.range(200).select(F.repeat(F.lit("x"), 1000).alias("s"), F.array(F.lit(1)).alias("a"))
    plan = lambda df: spark.range(3).join(df, F.col("id") == F.length("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(storage.small(wide)) and "strategy=broadcast" not in plan(storage.small(wide, 100_000))


def test_recursion(spark):
    e = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (3, 4)], "c int, p int")
    got = recursion.connect_by(e, "c", "p", F.col("p").isNull()).collect()
    assert sorted((r.c, r.level, r.path, r.is_cycle) for r in got) == [(1, 1, [1], False), (2, 2, [1, 2], False), (3, 3, [1, 2, 3], False), (4, 4, [1, 2, 3, 4], True)]
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (None, 1)], "a int, b int")
    assert {(r.a, r.b) for r in recursion.closure(edges, "a", "b").collect()} == {(i, j) for i in (1, 2, 3) for j in (1, 2, 3)} | {(4, 5)}
    steps = recursion.fixpoint(spark.createDataFrame([(1,)], "n int"), lambda d: d.where("n < 6").select((F.col("n") + 2).alias("n")))
    assert sorted(r.n for r in steps.collect()) == [1, 3, 5, 7]


def test_ranges(spark):
    rnd = random.Random(2)
    make = lambda: [(1, a, a + rnd.randrange(6)) for a in (rnd.randrange(40) for _ in range(15))]
    a, b = make(), make()
    da, db = (spark.createDataFrame(x, "k int, start int, end int") for x in (a, b))
    points = lambda x: {p for _, s, e in x for p in range(s, e)}
    for f, want in ((ranges.intersect, points(a) & points(b)), (ranges.difference, points(a) - points(b)), (ranges.symmetric_difference, points(a) ^ points(b))):
        got = [(r.k, r.start, r.end) for r in f(da, db, ["k"]).collect()]
        assert points(got) == want and len(points(got)) == sum(e - s for _, s, e in got)
    assert ranges.normalise(da.limit(0), ["k"]).count() == 0


def test_ties_and_fill(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, 9), (5, None)], "i int, v int")
    assert sorted(r.i for r in windows.limit_with_ties(df.where("v is not null"), 2, ["v"]).collect()) == [1, 2, 3]
    assert windows.limit_with_ties(df.limit(0), 2, ["v"]).count() == 0
    f = spark.createDataFrame([(1, 10), (4, 40)], "k bigint, v int")
    assert [tuple(r) for r in windows.fill(f, "k", 1, interpolate=["v"]).orderBy("k").collect()] == [(1, 10), (2, 10), (3, 10), (4, 40)]
    long = spark.createDataFrame([(0, 1, None), (9000, None, "b"), (20000, 3, None)], "k bigint, v int, w string")
    got = windows.fill(long, "k", 1, interpolate=["v", "w"]).collect()
    assert len(got) == 20001 and all((r.v, r.w) == (3 if r.k == 20000 else 1, None if r.k < 9000 else "b") for r in got)
    days = spark.sql("SELECT DATE '2024-01-30' AS k, 1 AS v UNION ALL SELECT DATE '2024-02-02', 2")
    assert [r.v for r in windows.fill(days, "k", F.expr("INTERVAL 1 DAY"), interpolate=["v"]).orderBy("k").collect()] == [1, 1, 1, 2]


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,é\n")
    (tmp_path / "b.json").write_text('{"x": 1}\n')
    assert readers.file_table(spark, str(tmp_path / "a.csv")).first().y == "é"
    assert readers.file_table(spark, str(tmp_path / "b.json"), "x int").first().x == 1
    (tmp_path / "t.bin").write_bytes(b"\xef\xbb\xbfa\xffb")
    d = readers.documents(spark, str(tmp_path / "t.bin"))
    assert d.select(readers.decode_text(F.col("content"))).first()[0] == "a�b"
    readers.export_database({"t": spark.range(3)}, str(tmp_path / "db"))
    assert readers.import_database(spark, ["t"], str(tmp_path / "db"))["t"].count() == 3


def test_lateral_top_numbers_rows_in_order(spark):
    """The rank's own window holds the order: what a sort before the shuffle leaves is lost where rows come from several executors."""
    from arborlake.plans import registry

    plan = registry.queries()["b4_lateral_top"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(o_custkey" in plan
    assert all("o_totalprice" in x.split("specifiedwindowframe")[0] for x in plan.split("windowspecdefinition(")[1:])


def test_quantiles_disc(spark):
    """A group of nulls, one with a null, and one of very many values."""
    n = 3_000_000
    few = spark.createDataFrame([("null", None), ("some", None), ("some", 3.0), ("some", 1.0), ("some", 2.0)], "k string, v double")
    many = spark.range(n).select(F.lit("many").alias("k"), (F.col("id") * 7 % n).cast("double").alias("v"))
    got = {r.k: tuple(r)[1:] for r in windows.quantiles_disc(few.unionAll(many), ["k"], "v", {"a": "0.1", "b": "0.5", "c": "0.9", "z": "0", "o": "1"}).collect()}
    assert got["null"] == (None,) * 5
    assert got["some"] == (1.0, 2.0, 3.0, 1.0, 3.0)
    assert got["many"] == (n / 10 - 1, n / 2 - 1, n * 9 / 10 - 1, 0.0, n - 1.0)


def test_quantile_query_is_exact(spark, tmp_path):
    """Over three million values, none twice: more than an accuracy of a millionth can tell apart."""
    from arborlake.plans import registry

    n = 3_000_000
    spark.range(n).select(F.lit("A").alias("l_returnflag"), (F.col("id") * 7 % n).cast("double").alias("l_quantity")).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert [tuple(r) for r in registry.queries()["b5_quantile_approx"](spark, str(tmp_path)).collect()] == [("A", n / 10 - 1, n / 2 - 1, n * 9 / 10 - 1)]
