import random
import re
from html import unescape

import pytest

from arborlake.llm import pages


def texts(html, zone=None):
    return [t for t, z, _ in pages.lines(html) if zone is None or z == zone]


PAGE = """<!DOCTYPE html><html lang="fr"><head><meta charset="utf-8"><title>T&amp;</title><style>p{margin:0}</style><script>var t="</p>";track(0);</script></head>
<body><nav><ul><li><a href="/a">Menu a</a></li></ul></nav><!-- ad 0 <p>no</p> --><div class="ad">Buy <p>this</p></div><div id="cookie-notice">We use</div>
<article><h1>Head &lt;one&gt;</h1><p><b>Bold   text&nbsp;x
y.<br><p>Second<br>line &eacute;&#233;</p><aside>Side</aside><form><input>Name</form><p>in<b>li</b>ne</p></article><section class="comments"><article><p>First!</p></article></section><footer>&copy; host</footer>"""


def test_lines():
    assert texts(PAGE, pages.LANDMARK) == ["Head <one>", "Bold text x y.", "Second line éé", "inline"]
    assert texts(PAGE, pages.NONE) == []
    assert texts(PAGE, pages.BOILERPLATE) == ["Menu a", "Buy", "this", "We use", "Side", "Name", "First!", "© host"]


@pytest.mark.parametrize(
    "html,want",
    [
        (None, []), ("", []), ("plain", ["plain"]), ("<p>a<p>b", ["a", "b"]), ("a < b & c", ["a < b & c"]), ("<script>x", []), ("<p title='>'>q</p>", ["q"]), ("<nav>m<article><p>body</article>", ["m", "body"]),
        ("<ARTICLE><P>Up</P></ARTICLE>", ["Up"]), ("<div>one<div>two</div>three</div>", ["one", "two", "three"]), ("<article><header><h1>T</h1></header>x<footer>f</footer>y</article>", ["T", "x", "f", "y"]),
        ("<table><tr><td>a</td><td>b</td></tr></table>", ["a", "b"]), ("<p>" + "x " * 50000, ["x " * 49999 + "x"]), ("<", ["<"]), ("<!-- open", []), ("<p hidden>h</p>v", ["h", "v"]),
    ],
)
def test_odd_html(html, want):
    assert texts(html) == want


def test_zones():
    zones = lambda html: {t: z for t, z, _ in pages.lines(html)}
    assert zones("<nav>m<article><p>body</article>") == {"m": pages.BOILERPLATE, "body": pages.LANDMARK}
    z = zones("<article><header><h1>T</h1></header>x<footer>f</footer>y</article>z<p hidden>h</p><aside><article>teaser</article></aside>")
    assert z == {"T": 1, "x": 1, "f": 2, "y": 1, "z": 0, "h": 2, "teaser": 2}


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


@pytest.mark.parametrize(
    "html",
    [
        '<body class="has-sidebar"><article><p>t</article>', '<div class="no-ads layout"><main><p>t</main></div>', "<form><article><p>t</article></form>", '<article class="post no-comments"><p>t</article>',
        '<form><div class="layout"><main>t</main></div></form>', "<article><math>t</math></article>", "<article><noscript>t</noscript></article>", "<article><object>t</object></article>", "<noscript><article>t</article></noscript>",
    ],
)
def test_wrappers(html):
    assert texts(html, pages.LANDMARK) == ["t"]


@pytest.mark.parametrize("html", ['<aside><form><article>t</article></form></aside>', '<div class="comments"><article>t</article></div>', "<form><label>t</label></form>", "<nav><main>t</main></nav>"])
def test_no_wrappers(html):
    assert texts(html, pages.BOILERPLATE) == ["t"]


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


@pytest.mark.parametrize("bits", [1 << 29, 20])
def test_lcs(bits, monkeypatch):
    monkeypatch.setattr(pages, "TABLE_BITS", bits)
    rnd = random.Random(1)
    for k in range(600):
        a, b = ([rnd.choice("abcdefgh"[: 2 + k % 7]) for _ in range(rnd.randrange(30))] for _ in range(2))
        for found in (pages.aligned(a, b), pages._dense(a, b)):
            assert len(found) == lcs(a, b)
            assert all(a[i] == b[j] for i, j in found) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))


def test_lines_that_repeat_without_end():
    a, b = ["0", *"xy" * 15_000, "1"], ["2", *"yx" * 15_000, "3"]
    assert len(pages.aligned(a, b)) == 29_999


def plain(html):
    """The blocks of the article of a test page, by its tags alone."""
    body = re.search(r"<article>(.*?)</article>", html or "", re.S)
    found = re.split(r"</?(?:h1|p)>", re.sub(r"</?b>", "", body[1].replace("<br>", " "))) if body else []
    return [t for b in found if (t := " ".join(unescape(b).split()))]


def brute(rows):
    """{(id, url): text} by comparing each page with the pages around it in one sorted list, with a plain alignment."""

    def shares(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
        out, i, j = [False] * len(a), len(a), len(b)
        while i and j:
            if a[i - 1] == b[j - 1]:
                out[i - 1] = True
                i, j = i - 1, j - 1
            elif d[i - 1][j] >= d[i][j - 1]:
                i -= 1
            else:
                j -= 1
        return out

    order = sorted(((*pages.host_and_path(u), i, u, pages.lines(h)) for i, u, h in rows), key=lambda r: r[:4])
    out = {}
    for k, (host, path, i, u, own) in enumerate(order):
        around = [p for p in range(max(0, k - 3), min(len(order), k + 4)) if p != k and order[p][0] == host]
        near = lambda p: next((n for n, (x, y) in enumerate(zip(path, order[p][1])) if x != y), min(len(path), len(order[p][1])))
        around.sort(key=lambda p: (-near(p), abs(p - k), p))
        stays, _ = pages.judged(own, [shares([x[0] for x in own], [x[0] for x in order[p][4]]) for p in around[:4]])
        out[i, u] = "\n\n".join(x[0] for x, s in zip(own, stays) if s)
    return out


def site(n, seed=3):
    """Pages of a few hosts whose templates are plain elements: a bar, a list of links, a repeated call in the article, an imprint."""
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        host = rnd.choice(["hot", "hot", "hot", "b", "c"])
        own = "".join(f"<p>text {k} {j}</p>" for j in range(rnd.randint(1, 4)))
        quote = "<p>a quotation</p>" if rnd.random() < 0.1 else ""
        links = "".join(f"<li>{w}</li>" for w in ["Home", "News", "Shop", f"here {k}"])
        inner = f"<h1>head {k}</h1>{own}{quote}<p>Tell your friends</p>"
        rows.append((k, f"http://{host}.org/{rnd.choice('ab')}/{rnd.randrange(400)}", f"<div>bar of {host}</div><ul>{links}</ul>{inner if k % 3 else '<article>' + inner + '</article>'}<div>imprint</div>"))
    return rows


def test_bounds_and_fences():
    rnd = random.Random(4)
    for n, size in ((1, 40), (7, 300), (30, 300), (211, 900), (211, 3)):
        keys = sorted({(rnd.choice("ab"), f"/{rnd.randrange(size):03}", True, k, "") for k in range(size)})
        bounds = pages.range_bounds(keys[:: rnd.randint(1, 3)], n)
        if size == 300:
            bounds = sorted(rnd.sample(keys, min(n, len(keys))) + keys[5:9])  # ranges of a few keys and of none
        cells = {}
        for k in keys:
            cells.setdefault(pages.bisect_right(bounds, k), []).append(k)
        edges = {r: sorted(set(own[:3] + own[-3:])) for r, own in cells.items()}
        fences = pages.Fences(bounds, edges)
        sent = {}
        for k in keys:
            for r in fences.ranges(k):
                sent.setdefault(r, []).append(k)
        for at, k in enumerate(keys):
            got = sent[pages.bisect_right(bounds, k)]
            j = got.index(k)
            assert got[max(0, j - 3) : j] == keys[max(0, at - 3) : at] and got[j + 1 : j + 4] == keys[at + 1 : at + 4]
        assert sum(map(len, sent.values())) <= len(keys) + 6 * len(cells)


def test_differencing(spark):
    soup = lambda body: f"<div>Top bar</div><div>Home</div>{body}<div>Imprint</div>"
    rows = [
        (1, "http://h.org/a/1", soup("<p>one</p><p>first</p>")), (2, "http://h.org/a/2", soup("<p>two</p>")), (3, "http://h.org/b", soup("<p>two</p>")), (4, "http://solo.org/", soup("<p>only</p>")),
        (5, "http://copy.org/1", "<article><p>same</p></article>"), (6, "http://copy.org/2", "<article><p>same</p></article>"), (7, "http://n.org/1", None), (8, None, ""), (None, None, "<p>x</p>"), (9, "http://twin.org/x", "<p>t</p>"), (9, "http://twin.org/x", "<p>t</p>"),
    ]
    df = spark.createDataFrame([(i, u, h, "c", 2) for i, u, h in rows], "page_id bigint, url string, html string, text string, id int")
    got = {(r.page_id, r.url): r for r in pages.extract(df).collect()}
    assert pages.extract(df).count() == len(rows)
    text = {k[0]: r.text for k, r in got.items()}
    assert text[1] == "one\n\nfirst" and text[2] == "two" and got[(1, "http://h.org/a/1")].nearest == 2 and got[(2, "http://h.org/a/2")].nearest == 1
    assert text[3] == "two"  # its neighbour's copy has no say
    assert text[4] == "Top bar\n\nHome\n\nonly\n\nImprint" and got[(4, "http://solo.org/")].nearest is None
    assert text[5] == text[6] == "same" and text[7] == "" and text[8] == "" and text[None] == "x" and text[9] == "t"
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert pages.extract(df.limit(0)).count() == 0


def test_differencing_decides(spark):
    rows = site(400)
    want = brute(rows)
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    try:
        for n in ("2", "211"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append({(r.page_id, r.url): r for r in pages.extract(df).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] and {k: r.text for k, r in got[0].items()} == want
    assert sum(r.n_decided > 0 for r in got[0].values()) > 390
    for k, u, html in rows:
        kept = got[0][k, u].text.split("\n\n")
        assert [t for t in kept if t.startswith(("head", "text"))] == re.findall(r"(?:head|text)[ \d]+", html)
        assert not {"Home", "News", "Shop", f"here {k}", "imprint", "Tell your friends", "bar of hot"} & set(kept)


def test_contract(spark):
    """Every page of the table against an extractor of its own tags."""
    path = "/root/testdata/sf0.01"
    rows = {(r.page_id, r.url): r.html for r in spark.read.parquet(f"{path}/pages.parquet").collect()}
    got = pages.op2_pages(spark, path).collect()
    assert len(got) == len(rows)
    assert all(r.text == "\n\n".join(plain(rows[r.page_id, r.url])) and r.n_chars == len(r.text) for r in got)
