import itertools
import random

from arborlake.llm import url_rules as ur


def test_host_and_path():
    for url, want in {
        None: ("", ""), "": ("", ""), "x/y": ("", ""), "http://A.Example.ORG/Es/1?q#z": ("a.example.org", "/Es/1"), "https://h": ("h", ""), "https://h?x=/y": ("h", ""),
        "https://h#a/b": ("h", ""), "a://b://c/d": ("b:", "//c/d"), "://": ("", ""), "http://ÄB.de/x": ("Äb.de", "/x"), "http://h/a\nb?c": ("h", "/a\nb"),
    }.items():
        assert ur.host_and_path(url) == want, url


def test_fixed_rules():
    r = ur.Rules(ur.FIXED_RULES)
    for host, path, want in [
        ("a.example.org", "/es/2", ("block", "example.org/es/")), ("example.org", "/en/17", ("block", "example.org/en/1")), ("example.org", "/en/2", ("allow", "org/")),
        ("notexample.org", "/es/2", ("allow", "org/")), ("x.com", "/de/", ("block", "com/de/")), ("x.com", "/fr/1", ("allow", "com/fr/")), ("x.com", "/en/", None), ("x.net", "/", None), ("org", "/", ("allow", "org/")), ("x.org", "", None), ("", "", None),
    ]:
        assert r.fixed_rule(host, path) == want, (host, path)


def planted(n=900, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        host, lang = rnd.choice(["casino-win", "blog", "news", "ads"]), rnd.choice(["en", "de"])
        bad = host == "casino-win" or (host == "ads" and lang == "de")
        rows.append((i, f"http://{rnd.choice(['m', 'www'])}.{host}.example.net/{lang}/{rnd.randrange(999)}", int(bad if rnd.random() < 0.95 else not bad)))
    return rows


def test_mined_rules_against_counting(spark):
    rows = planted()
    urls = spark.createDataFrame([(i, u, "x") for i, u, _ in rows] + [(None, None, "x"), (5000, "no url", "x")], "page_id bigint, url string, host string")
    labelled = spark.createDataFrame([(u, b, "x") for _, u, b in rows] + [(None, 1, "x"), ("http://casino-win.example.net/en/1", None, "x"), ("no url", 1, "x")], "url string, block int, items string")
    rules = ur.compiled([ur.mine(labelled, min_support=0.01, min_confidence=0.6)])
    got = {r[0]: (round(r[1], 9), r[2]) for rs in rules.index.values() for r in rs}
    count, bad = {}, {}
    for _, u, b in rows:
        own = ur.tokens(u)
        for k in range(1, len(own) + 1):
            for c in itertools.combinations(own, k):
                c = frozenset(c)
                count[c] = count.get(c, 0) + 1
                bad[c] = bad.get(c, 0) + b
    base = sum(b for *_, b in rows) / len(rows)
    least = max(0.01 * len(rows), ur.MIN_COUNT)
    brute = {c: (round(bad[c] / n, 9), bad[c]) for c, n in count.items() if bad[c] >= least and bad[c] / n >= 0.6 and bad[c] / n > base + ur.ERRORS * (base * (1 - base) / n) ** 0.5}
    minimal = {c: v for c, v in brute.items() if not any(d < c and w[0] >= v[0] for d, w in brute.items())}
    assert got == minimal
    judged = {r.page_id: r for r in ur.judge(urls, rules).collect()}
    for i, u, _ in rows:
        have = set(ur.tokens(u))
        assert judged[i].verdict == ("block" if any(c <= have for c in brute) else "allow")
    assert judged[None].verdict == judged[5000].verdict == "allow" and judged[5000].host == "" and judged[None].rule is None
    right = sum((judged[i].verdict == "block") == bool(b) for i, _, b in rows)
    assert right > 0.9 * len(rows)


def test_chance_is_no_rule(spark):
    rnd = random.Random(6)
    rows = [(f"http://h{rnd.randrange(40)}.org/{rnd.choice(['a', 'b', 'c'])}/{i}", int(rnd.random() < 0.15)) for i in range(3000)]
    assert ur.mine(spark.createDataFrame(rows, "url string, block int"), min_confidence=0.0) == ([], {})


def test_made_labels_held_out(spark):
    rows = ur.labelled_urls(8000)
    held = [r for i, r in enumerate(rows) if i % 4 == 0]
    rules = ur.compiled([ur.mine(spark.createDataFrame([r for i, r in enumerate(rows) if i % 4], "url string, block int"))])
    judged = {r.page_id: r.verdict == "block" for r in ur.judge(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(held)], "page_id bigint, url string"), rules).collect()}
    hits = sum(judged[i] and b for i, (_, b) in enumerate(held))
    assert hits >= 0.97 * sum(judged.values()) and hits >= 0.95 * sum(b for _, b in held)
    assert any(len(r[0]) > 1 for rs in rules.index.values() for r in rs)


def test_labelled_pages(spark):
    urls = ["http://h.org/en/12?x=3", "http://h.org/13.html", "http://h.org/14/#a", "http://h.org/15/x", "http://16.org/", None, "http://h.org/17?a=/18", "http://h.org/" + "9" * 40]
    pages = spark.createDataFrame([(u, 1) for u in urls], "url string, block int")
    labels = spark.createDataFrame([(12, 0), (12, 1), (13, 1), (14, None), (15, 0), (16, 0), (17, 1), (18, 0), (None, 0)], "doc_id bigint, quality int")
    assert sorted(ur.labelled_pages(pages, labels).collect()) == [("http://h.org/13.html", 0), ("http://h.org/17?a=/18", 0), ("http://h.org/en/12?x=3", 1)]


def test_empty(spark):
    urls = spark.createDataFrame([(1, "http://x.org/")], "page_id bigint, url string")
    assert ur.mine(spark.createDataFrame([], "url string, block int")) == ([], {})
    assert ur.mine(spark.createDataFrame([("http://x.org/", 1)] * 50, "url string, block int")) == ([], {})
    rules = ur.compiled([], ur.FIXED_RULES)
    assert [(r.rule, r.verdict) for r in ur.judge(urls, rules).collect()] == [("org/", "allow")]
    assert ur.judge(urls.limit(0), rules).count() == 0
    twice = ur.judge(urls.unionAll(urls), rules)
    assert twice.count() == 2


def test_a_host_of_many_tokens_displaces_no_other(spark):
    long = "http://a.b.c.d.e.f/g/h/i/j/k/l/m"
    rows = [(i, long, 0) for i in range(60)] + [(100 + i, "http://weak.net/" + chr(97 + i), int(i >= 38)) for i in range(40)] + [(200 + i, f"http://ok{i}.org/", 1) for i in range(400)]
    urls = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id bigint, url string")
    rules = ur.compiled([ur.mine(spark.createDataFrame([(u, 1 - q) for _, u, q in rows], "url string, block int"))])
    assert len(ur.tokens(long)) == 13
    judged = {r.page_id: r.verdict for r in ur.judge(urls, rules).collect()}
    assert all(judged[i] == ("allow" if i >= 200 else "block") for i, _, _ in rows)
