"""HTML extraction by nearest-URL page differencing.

Every page becomes its lines of text, each with the zone it stands in: a landmark (article or main), boilerplate by its
element, or neither. Pages stand in order of host and path; of the pages of its host around it, a page is compared with
those of the longest common path. The lines of both are aligned by longest common subsequence, and shared lines are
what the pages have in common and not of their own:

- outside a landmark a line goes that the nearest page shares, or most of the near pages;
- inside a landmark a line goes that all near pages share, three at least: pages quote one another, and a quotation is
  no template;
- a list goes whole if most of its text goes so;
- a page that shares most of a landmark's text, or nearly all of the plain text, is a copy and has no say there.

Markup breaks the ties that differencing leaves: what no page nearby shares goes if it stands in an element of
boilerplate, or outside a landmark that holds most of what is left.

Text moves between tasks once, compressed. The layout is by ranges of host and path whose bounds come from a sample of
keys, so a host of any size is spread over many tasks. The pages next to a bound are sent to the ranges on both sides,
so that every page meets the same neighbours wherever bounds fall, and results do not depend on the number of ranges.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import deque
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from arborlake.llm.common import map_slices, parts, read, small_batches
from arborlake.llm.url_rules import host_and_path

NONE, LANDMARK, BOILERPLATE = 0, 1, 2
#: Keys that are sampled for each range, and in all; sampled keys of a range at least.
SAMPLED, MOST_SAMPLED, LEAST_SAMPLED = 64, 100_000, 16
#: Pages on either side that are looked at, and those of them that are compared.
AROUND, COMPARED = 3, 4
#: Near pages that must share a line of a landmark.
AGREED = 3
#: Shares of the text from which a near page is a copy: of the landmarks', of the plain lines'.
COPY_OF_LANDMARK, COPY_OF_PLAIN = 0.7, 0.9
#: Bits of a table of alignments that is held at once.
TABLE_BITS = 1 << 29

# Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea template iframe select".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
LISTS = frozenset("dl menu nav ol table ul".split())
LANDMARKS = frozenset("article main".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form header menu button dialog head noscript".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice popup promo related share sharing sidebar social sponsor sponsored subscribe subscription widget".split()
)
#: Boilerplate that may hold whole pages: a landmark in it is one.
WRAPPERS = frozenset("form noscript".split())
#: Names that inside a landmark mean its own heading, or its own text where scripts don't run.
OWN = frozenset("header noscript".split())
#: Names that say how the page is laid out, not what the element is.
UNSAID = re.compile(r"(?:no|not|has|have|with|without|hide|hides|show|shows|is)[-_]", re.I)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME_PARTS = re.compile(r"[A-Za-z0-9]+")


def _boilerplate(tag: str, attributes: str, in_landmark: bool) -> bool:
    if tag in BOILERPLATE_TAGS and not (in_landmark and tag in OWN):
        return True
    if tag not in ("html", "body") and attributes and not attributes.isspace():
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or name == "role" and value in BOILERPLATE_ROLES or name == "style" and "display:none" in value.replace(" ", ""):
                return True
            if name in ("class", "id"):
                for whole in value.split():
                    if not UNSAID.match(whole) and any(w in BOILERPLATE_WORDS and not (in_landmark and w in OWN) for w in NAME_PARTS.findall(whole)):
                        return True
    return False


def lines(html: str | None) -> list[tuple[str, int, int]]:
    """(text, zone, list) of each block in page order: references decoded, white space one space, trimmed, empty ones left out.

    list: the number of the innermost list that holds the block, 0 for none. Scripts, styles, titles, comments and
    markup give no text. <br> is white space. Elements that are never closed end with what holds them; unclosed
    boilerplate ends where a landmark begins, and forms around a landmark do not count.
    """
    html = html or ""
    out: list[tuple[str, int, int]] = []
    text: list[str] = []
    stack: list[tuple[str, int, int, bool]] = []  # open elements that set a zone or are lists, and all others of their names
    zone, listed, at, n_lists = NONE, 0, 0, 0
    lowered = None

    def flush():
        if text:
            words = unescape("".join(text)).split()
            text.clear()
            if words:
                out.append((" ".join(words), zone, listed))

    while True:
        m = TOKEN.search(html, at)
        if m is None:
            text.append(html[at:])
            break
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            if tag == "br":
                text.append(" ")
                continue
            flush()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    flush()
                    del stack[k:]
                    zone, listed = stack[-1][1:3] if stack else (NONE, 0)
                    break
            continue
        if tag in RAW:
            if lowered is None:
                lowered = html.lower() if html.isascii() else re.sub("[A-Z]", lambda x: x[0].lower(), html)
            end = lowered.find("</" + tag, at)
            close = html.find(">", end) if end >= 0 else -1
            at = close + 1 if close >= 0 else len(html)
            text.append(" ")
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in LANDMARKS and zone != LANDMARK:
            around = zone
            if zone == BOILERPLATE:
                if lowered is None:
                    lowered = html.lower() if html.isascii() else re.sub("[A-Z]", lambda x: x[0].lower(), html)
                while stack and stack[-1][1] == BOILERPLATE and lowered.find("</" + stack[-1][0], at) < 0:
                    stack.pop()
                around, listed = stack[-1][1:3] if stack else (NONE, 0)
                if around == BOILERPLATE and all(s[1] != BOILERPLATE or s[3] for s in stack):
                    around = NONE
            inside = BOILERPLATE if around == BOILERPLATE or _boilerplate(tag, m[3], False) else LANDMARK
        elif zone != BOILERPLATE and _boilerplate(tag, m[3], zone == LANDMARK):
            inside = BOILERPLATE
        else:
            inside = zone
        if inside != zone or tag in LISTS or any(s[0] == tag for s in stack):
            flush()
            if tag in LISTS:
                n_lists += 1
                listed = n_lists
            wrapper = inside == BOILERPLATE and (zone == BOILERPLATE and all(s[1] != BOILERPLATE or s[3] for s in stack) or zone != BOILERPLATE and tag in WRAPPERS)
            stack.append((tag, inside, listed, wrapper))
            zone = inside
    flush()
    return out


def _sparse(a: list, b: list, places: dict) -> list[tuple[int, int]]:
    """The pairs of a longest common subsequence, by the places in b of each line of a: fast if lines seldom repeat."""
    ends: list[int] = []
    links: list[tuple] = []
    for i, x in enumerate(a):
        for j in places.get(x, ()):
            k = bisect_left(ends, j)
            link = (i, j, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    out, link = [], links[-1] if links else None
    while link is not None:
        out.append(link[:2])
        link = link[2]
    return out[::-1]


def _dense(a: list, b: list) -> list[tuple[int, int]]:
    """The same by rows of bits, for lines that repeat without end; large tables are halved."""
    if not a or not b:
        return []

    def masks(b):
        out: dict = {}
        for j, y in enumerate(b):
            out[y] = out.get(y, 0) | 1 << j
        return out

    def rows(a, b):
        m, full = masks(b), (1 << len(b)) - 1
        v = full
        for x in a:
            u = v & m.get(x, 0)
            v = ((v + u) | (v - u)) & full
            yield v

    if len(a) * len(b) > TABLE_BITS and len(a) > 1:
        half = len(a) // 2

        def lengths(a, b):
            *_, last = rows(a, b)
            n, out = 0, [0]
            for c in reversed(f"{last:0{len(b)}b}"):
                n += c == "0"
                out.append(n)
            return out

        ahead, behind = lengths(a[:half], b), lengths(a[half:][::-1], b[::-1])[::-1]
        at = max(range(len(b) + 1), key=lambda j: ahead[j] + behind[j])
        return _dense(a[:half], b[:at]) + [(i + half, j + at) for i, j in _dense(a[half:], b[at:])]
    table = list(rows(a, b))
    out, i, j = [], len(a), len(b)
    while i and j:
        if table[i - 1] >> j - 1 & 1:
            j -= 1
        else:
            i -= 1
            if not (i and not table[i - 1] >> j - 1 & 1):
                j -= 1
                out.append((i, j))
    return out[::-1]


def aligned(a: list, b: list) -> list[tuple[int, int]]:
    """The pairs (i, j) of a longest common subsequence of a and b."""
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    m = 0
    while m < len(a) - n and m < len(b) - n and a[-1 - m] == b[-1 - m]:
        m += 1
    own, other = a[n : len(a) - m], b[n : len(b) - m]
    places: dict = {}
    for j in range(len(other) - 1, -1, -1):
        places.setdefault(other[j], []).append(j)
    matches = sum(len(places.get(x, ())) for x in own)
    inner = _sparse(own, other, places) if matches <= 64 * (len(own) + len(other)) else _dense(own, other)
    return [(k, k) for k in range(n)] + [(i + n, j + n) for i, j in inner] + [(len(a) - k, len(b) - k) for k in range(m, 0, -1)]


def judged(own: list[tuple[str, int, int]], near: list[list[bool]]) -> tuple[list[bool], list[bool]]:
    """For each line whether it stays, and whether near pages share it so that it goes.

    near: for each near page, the nearest first, which lines of own it shares.
    """
    size = [len(t) for t, _, _ in own]
    of_zone = [sum(s for s, (_, z, _) in zip(size, own) if z == want) for want in (NONE, LANDMARK)]
    gone = [False] * len(own)
    for want in (NONE, LANDMARK, BOILERPLATE):
        here = [k for k, (_, z, _) in enumerate(own) if z == want]
        voters = near
        if want == LANDMARK or want == NONE and not of_zone[LANDMARK]:
            most = (COPY_OF_PLAIN, COPY_OF_LANDMARK)[want]
            voters = [v for v in near if sum(size[k] for k in here if v[k]) < most * of_zone[want]]
        for k in here:
            votes = sum(v[k] for v in voters)
            if want == LANDMARK:
                gone[k] = votes == len(voters) >= AGREED
            else:
                gone[k] = bool(votes) and (voters[0][k] or 2 * votes > len(voters))
    lists: dict[int, list[int]] = {}
    for k, (_, _, n) in enumerate(own):
        if n:
            lists.setdefault(n, []).append(k)
    for held in lists.values():
        if 2 * sum(size[k] for k in held if gone[k]) > sum(size[k] for k in held):
            for k in held:
                gone[k] = True
    left = [k for k in range(len(own)) if not gone[k] and own[k][1] != BOILERPLATE]
    marked = [k for k in left if own[k][1] == LANDMARK]
    if marked and 2 * sum(size[k] for k in marked) >= sum(size[k] for k in left):
        left = marked
    if not left:  # all is shared
        left = [k for k, (_, z, _) in enumerate(own) if z == LANDMARK] or [k for k, (_, z, _) in enumerate(own) if z == NONE]
    stays = [False] * len(own)
    for k in left:
        stays[k] = True
    return stays, [g and not s for g, s in zip(gone, stays)]


def _key(host: str, path: str, page, url: str | None) -> tuple:
    return host, path, page is not None, page, url or ""


def range_bounds(keys: list[tuple], n: int) -> list[tuple]:
    """Lower bounds of the second and later of up to n ranges over sorted sampled keys."""
    step = max(LEAST_SAMPLED, -(-len(keys) // max(1, n)))
    return sorted(set(keys[step::step]))


class Fences:
    """Which ranges a key is sent to: its own, and those whose first or last keys have it among their neighbours.

    edges: for each range its distinct keys in order, of many only the first and the last AROUND.
    """

    def __init__(self, bounds: list[tuple], edges: dict[int, list[tuple]], around: int = AROUND):
        self.bounds = bounds
        self.until: dict[int, tuple] = {}  # a range: the last key behind it that it needs
        self.since: dict[int, tuple] = {}
        order = sorted(edges)
        for way, out in ((order[::-1], self.until), (order, self.since)):
            met: list[tuple] = []  # the keys next to the range, the nearest last
            for r in way:
                if met:
                    out[r] = met[-min(around, len(met))]
                own = edges[r][::-1] if out is self.until else edges[r]
                met = (met + own)[-around:]
        self.order = order
        self.at = {r: k for k, r in enumerate(order)}

    def ranges(self, key: tuple) -> list[int]:
        """The key's own range first."""
        own = bisect_right(self.bounds, key)
        out = [own]
        for k in range(self.at[own] - 1, -1, -1):
            if key > self.until[self.order[k]]:
                break
            out.append(self.order[k])
        for k in range(self.at[own] + 1, len(self.order)):
            if key < self.since[self.order[k]]:
                break
            out.append(self.order[k])
        return out


def _common(path: str, other: str) -> int:
    n = 0
    for x, y in zip(path, other):
        if x != y:
            break
        n += 1
    return n


def _edges(df: DataFrame, id_col: str, url_col: str, bounds: list[tuple], n: int) -> dict[int, list[tuple]]:
    """For each range the distinct keys at its ends, in order: two times AROUND rows a range."""

    def place():
        def f(ids, urls):
            where = [host_and_path(u) for u in urls]
            return [[bisect_right(bounds, _key(h, p, i, u)) for (h, p), i, u in zip(where, ids, urls)], [h for h, _ in where], [p for _, p in where], ids, urls]

        return f

    kind = df.schema[id_col].dataType.simpleString()
    laid = map_slices(df, [id_col, url_col], place, f"pid int, host string, path string, id {kind}, url string", rows=1024)
    laid = laid.repartitionById(n, F.col("pid"))
    schema = _parse_datatype_string(f"pid int, host string, path string, id {kind}, url string")
    arrow = to_arrow_schema(schema)

    def ends(batches):
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for pid, h, p, i, u in zip(*[c.to_pylist() for c in batch.columns]):
                k = _key(h, p, i, u)
                first, last = held.setdefault(pid, ([], []))
                if len(first) < AROUND or k < first[-1]:
                    if k not in first:
                        first.append(k)
                        first.sort()
                        del first[AROUND:]
                if len(last) < AROUND or k > last[0]:
                    if k not in last:
                        last.append(k)
                        last.sort()
                        del last[:-AROUND]
        rows = [(pid, h, p, i, u) for pid, both in held.items() for h, p, _, i, u in sorted(set(both[0] + both[1]))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, x.type) for v, x in zip(zip(*rows), arrow)], schema=arrow)

    out: dict[int, list[tuple]] = {}
    for r in small_batches(laid).mapInArrow(ends, schema).collect():
        out.setdefault(r["pid"], []).append(_key(r["host"], r["path"], r["id"], r["url"]))
    return {r: sorted(keys) for r, keys in out.items()}


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars, nearest, n_shared, n_decided) for every page.

    nearest: the id of the nearest page that it was compared with. n_shared: lines that went as near pages share them;
    n_decided: those of them that markup alone would have kept. Null html is empty and gives the empty text. Pages
    without a host are one host. Of neighbours as near the closer one in order of path and id counts, and of those the
    former; pages with equal URLs are neighbours. Repeated rows stay; null ids come first. A page without neighbours is
    judged by its markup. An empty table gives no rows. Neither partitions nor their number change the rows.
    """
    spark = df.sparkSession
    n = parts(spark)
    total = df.count()
    bounds: list[tuple] = []
    if total:
        thin = max(1, total // min(SAMPLED * n, MOST_SAMPLED))
        # sets bounds only; every row is laid out
        sample = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).where(F.pmod(F.xxhash64("id", "url"), F.lit(thin)) == 0).limit(8 * MOST_SAMPLED).collect()
        bounds = range_bounds(sorted(_key(*host_and_path(r["url"]), r["id"], r["url"]) for r in sample), n)
    n = len(bounds) + 1
    sent = spark.sparkContext.broadcast(Fences(bounds, _edges(df, id_col, url_col, bounds, n)))  # 2 * AROUND keys a range
    kind = df.schema[id_col].dataType.simpleString()

    def parse():
        fences = sent.value

        def f(ids, urls, htmls):
            out = []
            for i, u, html in zip(ids, urls, htmls):
                host, path = host_and_path(u)
                packed = zlib.compress(json.dumps(lines(html), ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass"), 1)
                for k, pid in enumerate(fences.ranges(_key(host, path, i, u))):
                    out.append((pid, k == 0, host, path, i, u, packed))
            return [list(c) for c in zip(*out)]

        return f

    laid = map_slices(df, [id_col, url_col, html_col], parse, f"pid int, own boolean, host string, path string, id {kind}, url string, packed binary")
    laid = laid.repartitionById(n, F.col("pid")).sortWithinPartitions("pid", "host", "path", "id", "url", "packed")
    result = _parse_datatype_string(f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars bigint, nearest {kind}, n_shared bigint, n_decided bigint")
    arrow = to_arrow_schema(result)

    def pages(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                cols = [c.to_pylist() for c in batch.slice(at, 128).columns]
                for pid, own, host, path, page, url, packed in zip(*cols):
                    yield own, (pid, host), path, page, url, json.loads(zlib.decompress(packed).decode("utf-8", "surrogatepass"))

    def compare(batches):
        rows: list[tuple] = []
        held: deque = deque()  # pages of one range and host in order: those around the one that is judged
        pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}
        first = 0  # the number of held[0]

        def shares(k: int, other: int) -> list[bool]:
            """Which lines of page k page other shares."""
            a, b = min(k, other), max(k, other)
            if (a, b) not in pairs:
                x, y = ([t for t, _, _ in held[p - first][5]] for p in (a, b))
                pairs[a, b] = aligned(x, y)
            out = [False] * len(held[k - first][5])
            for pair in pairs[a, b]:
                out[pair[k != a]] = True
            return out

        def judge(k: int):
            own, _, path, page, url, lines_of = held[k - first]
            if not own:
                return
            around = [p for p in range(max(first, k - AROUND), min(first + len(held), k + AROUND + 1)) if p != k]
            around.sort(key=lambda p: (-_common(path, held[p - first][2]), abs(p - k), p))
            stays, shared = judged(lines_of, [shares(k, p) for p in around[:COMPARED]])
            text = "\n\n".join(line[0] for line, s in zip(lines_of, stays) if s)
            alone, _ = judged(lines_of, [])
            rows.append((page, url, text, len(text), held[around[0] - first][3] if around else None, sum(shared), sum(s and not t for s, t in zip(alone, stays))))

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(v, x.type) for v, x in zip(zip(*rows), arrow)], schema=arrow)
            rows.clear()
            return made

        todo = 0  # the page to be judged next
        for page in pages(batches):
            if held and held[-1][1] != page[1]:
                while todo < first + len(held):
                    judge(todo)
                    todo += 1
                first += len(held)
                held.clear()
                pairs.clear()
            held.append(page)
            while todo + AROUND < first + len(held):
                judge(todo)
                todo += 1
            while first < todo - AROUND:
                held.popleft()
                first += 1
                for p in [p for p in pairs if p[0] < first]:
                    del pairs[p]
            if len(rows) >= 128:
                yield out()
        while todo < first + len(held):
            judge(todo)
            todo += 1
        if rows:
            yield out()

    return small_batches(laid).mapInArrow(compare, result)


def op2_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
