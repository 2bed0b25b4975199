import hashlib
import re

import duckdb
import pytest

from arborlake.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items):
    split = lambda t: WORD.findall((t or "").translate(LOWER))
    wins = {}
    for i, t in items:
        w = split(t)
        n = min(len(w), 13)
        for k in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for i, t in docs:
        w = split(t)
        hit, found = set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (got := wins.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= got
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


long = [f"w{i}" for i in range(40)]
DOCS = [
    (1, "x " * 30 + " ".join(long[3:16]) + " y" * 10), (2, "x " * 900 + " ".join(long[3:16])), (3, None), (4, ""), (5, "!!! ..."), (6, " ".join(long[3:15])),
    (7, "ÉCOLE Stop, the É-thing"), (7, "ÉCOLE Stop, the É-thing"), (None, " ".join(long)), (8, ("short item " * 3000)), (9, "SHORT\x00item"), (10, "only"), (11, "école short ITEM"),
]
ITEMS = [(10, " ".join(long[:30]).upper()), (2, " ".join(long[3:16])), (3, "Short, item"), (4, None), (5, ""), (6, "only"), (None, "école"), (10, "dup " * 20), (7, "ÉCOLE")]


@pytest.mark.parametrize("most", [400_000, 20, 7])
def test_against_brute_force(spark, most):
    d = spark.createDataFrame([(i, t, "z", 1) for i, t in DOCS], "doc_id bigint, text string, row string, n_hit int").repartition(3)
    b = spark.createDataFrame([(i, t, "q") for i, t in ITEMS], "item_id bigint, text string, window string")
    got = dc.report(d, b, most_broadcast=most).drop("row")
    assert sorted(map(tuple, got.collect()), key=str) == brute(DOCS, ITEMS)
    none = dc.report(d, b.limit(0)).drop("row").collect()
    assert sorted(map(tuple, none), key=str) == brute(DOCS, [])
    assert dc.report(d.limit(0), b).count() == 0


def test_oracle(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    keep = [(i, t) for i, t in DOCS if "\x00" not in (t or "")]
    con.executemany("INSERT INTO documents VALUES (?, ?)", keep)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", ITEMS)
    assert sorted(con.sql(dc.ORACLE).fetchall(), key=str) == brute(keep, ITEMS)


def test_a_long_text_and_many_scans(spark):
    """20,000 words and windows in several tables: rows of one word are not shuffled, and each is a hit once."""
    text = " ".join(f"w{i}" for i in range(20_000))
    items = [(k, " ".join(f"w{i}" for i in range(100 * k, 100 * k + 40))) for k in range(100)]
    d = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = dc.report(d, b, most_broadcast=1000)
    assert [tuple(r)[1:4] for r in got.collect()] == [(1, 20_000, 4000)]
    plan = got._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_a_window_of_many_items_is_one_hit(spark):
    """Items that share all of their windows are named, and not multiplied with the places."""
    d = spark.createDataFrame([(1, "same words " * 400)], "doc_id bigint, text string")
    b = spark.createDataFrame([(k, "same words " * 20) for k in range(300)], "item_id bigint, text string")
    rows = dc.scan(d, b).collect()
    assert len(rows) == 1 and len(rows[0].spans) == 788 and len(rows[0].items) == 300


def test_removal_with_clashing_names(spark):
    rows = [(1, " ".join(long[:30]), 1, "a"), (1, "clean words", 2, "b"), (None, None, 3, "c"), (2, "", 4, "d"), (3, " ".join(long[:30]), None, None), (3, "clean words", 6, "f"), (3, "clean words", 6, "f")]
    b = spark.createDataFrame(ITEMS[:3], "item_id bigint, text string")
    for names in ("gone", "_gone", "GONE", "row", "key", "items", "words"):
        df = spark.createDataFrame(rows, f"doc_id bigint, text string, {names} int, h string")
        got = dc.remove_contaminated(df, b, most_broadcast=10)
        assert got.columns == df.columns
        assert sorted(map(str, got.collect())) == sorted(str(r) for r in df.collect() if r.text not in (" ".join(long[:30]),))
    assert dc.remove_contaminated(df.limit(0), b).count() == 0 and dc.remove_contaminated(df, b.limit(0)).count() == len(rows)
