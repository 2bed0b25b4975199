import random
import re

import pytest
import xxhash

from arborlake.llm import simhash
from arborlake.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    """prints: a list; the least index reachable."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one two", "one  TWO three", "É à b c\x1cd \x0be", "a b c " * 3000, "Ünd DIE der ÄÖ x"])
def test_print(text):
    assert simhash.fingerprint(text) == brute_print(text)


@pytest.mark.parametrize("crowd", [200, 3])
def test_links_and_components(spark, crowd):
    rnd = random.Random(5)
    prints = [rnd.getrandbits(64) for _ in range(40)]
    for _ in range(160):  # walks that share a segment, so that crowds arise
        p = rnd.choice(prints)
        for _ in range(rnd.randint(1, 4)):
            p ^= 1 << rnd.choice([rnd.randrange(64), rnd.randrange(40, 48)])
        prints.append(p)
    prints = list(dict.fromkeys(prints))
    signed = [p - (p >> 63 << 64) for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    found = simhash.links(df, crowd).collect()
    for r in found:
        assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 3 and r.a != r.b
    if crowd == 200:
        want = {frozenset((signed[i], signed[j])) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3}
        assert {frozenset((r.a, r.b)) for r in found} == want
    got = {r.node: r.root for r in components(spark.createDataFrame([(r.a, r.b) for r in found], "a bigint, b bigint"), "a", "b").collect()}
    least = {}
    for s, c in zip(signed, brute_components(prints)):
        least[c] = min(least.get(c, s), s)
    assert {s: got.get(s, s) for s in signed} == {s: least[c] for s, c in zip(signed, brute_components(prints))}


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(9, base), (4, base), (7, base + " extra"), (5, None), (3, ""), (6, "Short one"), (6, "Short one"), (None, "short ONE"), (8, "x y"), (None, "alone null")]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id bigint, text string, fp string, component_id int")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    prints = [brute_print(t) for _, t in rows]
    comp = brute_components(prints)
    least = {}
    for (i, _), c in zip(rows, comp):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    assert got == sorted(((i, f"{p:016x}", least.get(c)) for (i, _), p, c in zip(rows, prints, comp)), key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (None, 3), (200, 201), (201, 200)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(df, "a", "b").collect()}
    assert got == {i: 0 for i in range(61)} | {200: 200, 201: 200}
    assert components(df.limit(0), "a", "b").count() == 0


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_remove_copies(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows, group = [], {}
    for g in range(60):
        base = [word() for _ in range(rnd.choice([60, 200, 400]))]
        for k in range(rnd.choice([1, 1, 2, 5])):
            own = list(base)
            for _ in range(0 if k == 0 else len(base) // 60):
                own[rnd.randrange(len(own))] = word()
            rows.append((len(rows) * 3 + 1, " ".join(own)))
            group[rows[-1][0]] = g
            if k and len(shingles(" ".join(own)) & shingles(" ".join(base))) / len(shingles(" ".join(own)) | shingles(" ".join(base))) < 0.8:
                rows.pop()
    rows += [(5000, rows[0][1]), (6000, ""), (6001, None), (None, "null id"), (None, "null id"), (None, rows[0][1]), (7000, "twice a"), (7000, "twice b"), (7000, "twice b"), (7001, "twice b")]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id bigint, text string, fp string, component_id int").repartition(4)
    assert {(r.doc_id, r.component_id) for r in simhash.copies(df.where("doc_id < 5000"), meeting=2).collect()} == {(r.doc_id, r.component_id) for r in simhash.copies(df.where("doc_id < 5000")).collect()}
    out = simhash.remove_copies(df)
    assert out.columns == df.columns
    got = sorted((r.doc_id, r.text) for r in out.collect() if r.doc_id is not None)
    want = {}
    for i, t in rows:
        if i is not None and i < 5000:
            want[group[i]] = min(want.get(group[i], i), i)
    left = {i for i, _ in got if i < 5000}
    assert left == set(want.values())
    assert [x for x in got if x[0] >= 5000] == [(6000, ""), (7000, "twice a"), (7000, "twice b")]
    assert [r.text for r in out.where("doc_id is null").collect()] == ["null id"]
    assert simhash.remove_copies(df.limit(0)).count() == 0


def test_sketch_estimates():
    rnd = random.Random(9)
    base = [f"w{k}" for k in range(600)]
    own = list(base)
    for _ in range(12):
        own[rnd.randrange(600)] = "new"
    a, b = shingles(" ".join(base)), shingles(" ".join(own))
    got = (simhash.sketch(" ".join(base)) == simhash.sketch(" ".join(own))).mean()
    assert abs(got - len(a & b) / len(a | b)) < 0.1
    assert simhash.similarity(" ".join(base), " ".join(own).upper().replace(" ", ", ")) == len(a & b) / len(a | b)
    assert simhash.similarity(None, "!!") == 1 and simhash.similarity("", "a") == 0
    assert simhash.sketch(None) is None and len(set(simhash.sketch("one").tolist())) == 1


def test_pairs_inside_a_template_family(spark):
    rnd = random.Random(11)
    words = lambda n: [f"w{rnd.getrandbits(40):x}" for _ in range(n)]
    template, rows, pairs = words(425), [], []
    for k in range(2000):
        own = words(26)
        rows.append((2 * k, " ".join(template + own + words(49))))
        if k < 80:
            rows.append((2 * k + 1, " ".join(template + own + words(49))))
            pairs.append((2 * k, 2 * k + 1))
    text = dict(rows)
    assert all(simhash.similarity(text[a], text[b]) >= simhash.SIMILARITY for a, b in pairs)
    assert all(simhash.similarity(text[0], text[b]) < simhash.SIMILARITY for b in range(2, 4000, 2))
    rnd.shuffle(rows)
    got = {r.doc_id: r.component_id for r in simhash.copies(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    partner = {b: a for a, b in pairs}
    assert got == {i: partner.get(i, i) for i in text}


def test_joins_of_unbounded_tables_are_not_broadcast(spark, tmp_path):
    """Left to Spark, these tables are small enough to be broadcast here, and at 0.5 GB the driver failed by several at once."""
    from arborlake.llm import components as C

    def plain(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return "SortMergeJoin" in plan and "Broadcast" not in plan

    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 9)], "u bigint, v bigint")
    tied = spark.createDataFrame([(2, 1), (3, 1)], "node bigint, root bigint")
    least = spark.createDataFrame([(1, 10), (2, 11), (7, 12)], "fp bigint, least bigint")
    each = spark.createDataFrame([(1, [5, 6]), (2, [5, 7]), (3, [5])], "th bigint, bands array<bigint>")
    assert all(map(plain, [C._large(edges), C._small(edges), simhash.links(least.select("fp")), simhash._labels(least, tied), *simhash._met(each, 2)[:1]]))
