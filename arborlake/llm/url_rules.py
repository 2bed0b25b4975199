"""URL filtering by association rules.

Labelled URLs become baskets of tokens; Spark's FP-growth mines the combinations that occur with the label `block`.
Rules below a support or a confidence go, those whose confidence may be the labels' base rate by chance, and those that
a rule with fewer tokens covers as well. Each kept rule stands in an inverted index under its rarest token, so a URL
meets only rules whose rarest token it has. Fixed rules of host and path come before the mined ones.

Labels come from tables of (url, block). The query mines two: the pages whose document has a label, and labelled_urls(),
a table made by rule, as the labels of documents tell of their text and hardly of their URL.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass, field

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm.common import map_slices, parts, read

#: Labelled rows that are mined at most, chosen by a hash of the id: a bound of the mining's time.
MOST_LABELLED = 20_000
#: Rules left after pruning that the driver and the workers can hold; more are an error.
MOST_RULES = 1_000_000
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE = 0.002, 8, 0.8
#: Standard errors by which a rule's confidence is to lie above the base rate, as very many combinations are tried.
ERRORS = 4.0
BLOCK = "label=block"
#: The fixed rules of the query: (verdict, host and path).
FIXED_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

# Words of hosts that are blocked in these pairs, of hosts that are not, and of both alike.
BLOCKED_WORDS = {
    "gambling": ("casino poker slots roulette blackjack jackpot betting bets bingo lottery".split(), "win free online best royal lucky bonus club king vegas".split()),
    "pharmacy": ("pills viagra cialis tramadol xanax meds".split(), "cheap discount online buy order generic".split()),
    "adult": ("adult xxx porn sex nude cams".split(), "x hot live free video tube".split()),
    "spam": ("spam seo backlinks clickbait linkfarm doorway".split(), "farm links traffic cheap boost network".split()),
    "tracking": ("ads adserver banner popunder doubleclick tracker".split(), "track click pixel serve media network".split()),
}
OTHER_WORDS = "news city museum school garden travel science music kitchen history sport weather library health forum river market art film photo software nature bridge family village".split()
MIXED_HOSTS = "windows-win free-software free-recipes cheap-flights cheap-hotels adult-education adult-learning spam-filter spam-report classified-ads track-order race-track video-lessons dairy-farm wind-farm online-school best-books live-news hot-springs x-ray bonus-track media-library network-news order-books club-history royal-museum buy-local discount-travel click-here boost-health".split()
SECTIONS = "en de fr es news blog article archive tag topics about products".split()

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_PARTS = re.compile(r"[^\W_]+")


def host_and_path(url: str | None) -> tuple[str, str]:
    """After the first :// up to /, ? or #, with A-Z lower-cased; then up to ? or #. Both empty without a ://."""
    m = _URL.search(url or "")
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def tokens(url: str | None) -> list[str]:
    """A URL's distinct tokens: labels of the host and their parts, path segments and query keys; numbers are one token."""
    host, path = host_and_path(url)
    if not host and not path:
        return []
    out = set()
    labels = host.split(".")
    for label in labels:
        out.add("host:" + label)
        bits = _PARTS.findall(label)
        if len(bits) > 1:
            out.update("host:" + b for b in bits)
    for s in path.split("/"):
        if s:
            out.add("path:" + ("#" if s.isdigit() else s))
            if "." in s:
                out.add("type:" + s.rsplit(".", 1)[1])
    query = (url or "").split("?", 1)
    if len(query) == 2:
        for pair in query[1].split("#", 1)[0].split("&"):
            out.add("query:" + pair.split("=", 1)[0])
    return sorted(out)


@dataclass
class Rules:
    """Mined rules (tokens, confidence, count) under their rarest token, and fixed rules of host and path."""

    fixed: list[tuple[str, str]] = field(default_factory=list)
    index: dict[str, list[tuple[frozenset, float, int]]] = field(default_factory=dict)

    def fixed_rule(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest fixed rule that fits: its host or a subdomain, and a path that starts with its path."""
        best = None
        for verdict, rule in self.fixed:
            h, _, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
                best = (verdict, rule)
        return best

    def mined_rule(self, own: list[str]) -> tuple[frozenset, float, int] | None:
        """The mined rule of the highest confidence, then support, all of whose tokens the URL has."""
        have = set(own)
        met = [r for t in own for r in self.index.get(t, ()) if r[0] <= have]
        return min(met, key=_rank, default=None)


def _rank(rule: tuple[frozenset, float, int]):
    return -rule[1], -rule[2], len(rule[0]), sorted(rule[0])


def prune(found: DataFrame, most: int = MOST_RULES) -> list[tuple[frozenset, float, int]]:
    """The rules (antecedent, confidence, count) but those that one with a part of their tokens and at least their confidence covers.

    Smaller antecedents come first; those of one size are held against the kept ones where they are, so that only rules
    that stay reach the driver.
    """
    spark = found.sparkSession
    kept: dict[str, list[tuple[frozenset, float]]] = {}
    out: list[tuple[frozenset, float, int]] = []
    for (size,) in found.select(F.size("antecedent").alias("s")).distinct().orderBy("s").collect():
        sent = spark.sparkContext.broadcast(kept)

        def make(sent=sent):
            below = sent.value

            def f(*columns):
                rows = [r for r in zip(*columns) if not any(c >= r[1] and b < set(r[0]) for t in r[0] for b, c in below.get(t, ()))]
                return [[r[k] for r in rows] for k in range(3)]

            return f

        left = map_slices(found.where(F.size("antecedent") == size), ["antecedent", "confidence", "count"], make, "antecedent array<string>, confidence double, count bigint")
        rows = left.limit(most + 1 - len(out)).collect()
        if len(out) + len(rows) > most:
            raise ValueError(f"over {most} rules are left after pruning: raise min_support or min_confidence")
        for r in rows:
            own = frozenset(r["antecedent"])
            kept.setdefault(min(own), []).append((own, r["confidence"]))
            out.append((own, r["confidence"], r["count"]))
    return sorted(out, key=_rank)


def index_of(rules: list[tuple[frozenset, float, int]], frequency: dict[str, int]) -> dict[str, list]:
    out: dict[str, list] = {}
    for r in rules:
        out.setdefault(min(r[0], key=lambda t: (frequency.get(t, 0), t)), []).append(r)
    return out


def mine(labelled: DataFrame, url_col: str = "url", block_col: str = "block", min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, errors: float = ERRORS, most: int = MOST_LABELLED) -> tuple[list[tuple[frozenset, float, int]], dict[str, int]]:
    """`block` rules from labelled URLs, and how often each of their tokens occurs.

    labelled: a URL and whether it is to be blocked; rows with a null in either are left out, and of many rows `most`
    are taken by a hash of the URL. Without both labels there are no rules.
    """
    spark = labelled.sparkSession
    known = labelled.select(F.col(url_col).alias("url"), F.col(block_col).cast("int").alias("b")).where("url is not null and b is not null")
    rows = known.orderBy(F.xxhash64("url"), "url", "b").limit(most)
    baskets = map_slices(rows, ["url", "b"], lambda: lambda us, bs: [[[*tokens(u), BLOCK] if b else tokens(u) for u, b in zip(us, bs)], bs], "items array<string>, b int", rows=1024)
    baskets = baskets.where(F.size("items") > F.col("b")).coalesce(min(8, parts(spark))).persist()
    try:
        n, blocked = baskets.agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
        support = max(min_support, min_count / n) if n else 2
        if support > 1 or not 0 < blocked < n:
            return [], {}
        base = blocked / n
        model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence, numPartitions=min(8, parts(spark))).fit(baskets.select("items"))
        found = model.associationRules.where(F.col("consequent") == F.array(F.lit(BLOCK))).select("antecedent", "confidence", F.round(F.col("support") * n).cast("long").alias("count"))
        error = F.sqrt(F.lit(base * (1 - base)) * F.col("confidence") / F.col("count"))  # count / confidence URLs have the tokens
        found = found.where(F.col("confidence") > base + errors * error).persist()
        try:
            rules = prune(found)
        finally:
            found.unpersist()
        if not rules:
            return [], {}
        own = spark.createDataFrame([(t,) for t in sorted({t for r in rules for t in r[0]})], "t string")  # of MOST_RULES rules
        single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("t"), "freq").join(own, "t").collect()
    finally:
        baskets.unpersist()
    return rules, {r["t"]: r["freq"] for r in single}


def compiled(mined: list[tuple[list[tuple[frozenset, float, int]], dict[str, int]]], fixed=()) -> Rules:
    """The rules of one mining or more under their rarest tokens."""
    frequency: dict[str, int] = {}
    for _, own in mined:
        for t, n in own.items():
            frequency[t] = frequency.get(t, 0) + n
    return Rules(list(fixed), index_of([r for rules, _ in mined for r in rules], frequency))


def labelled_urls(n: int = 6000, seed: int = 3) -> list[tuple[str, int]]:
    """(url, block): labelled URLs made by rule. 1: a host of gambling, pharmacies, adult content, spam or tracking.

    Words that stand in such hosts stand in others as well, so that combinations tell more than words.
    """
    rnd = random.Random(seed)
    kinds = sorted(BLOCKED_WORDS)
    out = []
    for _ in range(n):
        block = rnd.random() < 0.35
        if block:
            own, beside = BLOCKED_WORDS[rnd.choice(kinds)]
            pair = [rnd.choice(own), rnd.choice(beside)]
            rnd.shuffle(pair)
            name = "-".join(pair)
        elif rnd.random() < 0.5:
            name = rnd.choice(MIXED_HOSTS)
        else:
            name = "-".join(rnd.sample(OTHER_WORDS, rnd.randint(1, 2)))
        host = rnd.choice(["", "", "www.", "m.", "blog."]) + name + rnd.choice([".example.com", ".example.org", ".example.net", ".test"])
        path = "/".join([rnd.choice(SECTIONS), *([rnd.choice(OTHER_WORDS)] if rnd.random() < 0.3 else []), str(rnd.randrange(10_000))])
        end = rnd.choice(["", "/", ".html", "?page=2&ref=x", "?utm_source=feed", "#top"])
        out.append((f"{rnd.choice(['http', 'https'])}://{host}/{path}{end}", int(block)))
    return out


def judge(urls: DataFrame, rules: Rules, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, matched, confidence) for every row.

    rule: the fixed rule that decides, else null; then the mined rules do: block if one matches, whose tokens and
    confidence follow. Null URLs, and those without ://, have an empty host and path and are allowed. Repeated rows
    and null ids give one row each; URLs of any length are read whole.
    """
    sent = urls.sparkSession.sparkContext.broadcast(rules)  # MOST_RULES rules at most

    def make():
        r = sent.value

        def f(ids, us):
            out = []
            for u in us:
                host, path = host_and_path(u)
                fixed = r.fixed_rule(host, path)
                mined = None if fixed else r.mined_rule(tokens(u))
                out.append((host, path, fixed and fixed[1], fixed[0] if fixed else "block" if mined else "allow", mined and sorted(mined[0]), mined and mined[1]))
            return [ids, *map(list, zip(*out))]

        return f

    kind = urls.schema[id_col].dataType.simpleString()
    return map_slices(urls, [id_col, url_col], make, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, matched array<string>, confidence double", rows=1024)


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, block) of the pages whose URL ends in the number of a labelled document: block if its quality is 0."""
    number = F.regexp_extract("url", r"^[^?#]*?://[^/?#]*/(?:[^?#]*/)?(\d{1,18})(?:\.\w+)?/?(?:[?#]|$)", 1)
    numbered = pages.where("url is not null").select("url", F.when(number != "", number.cast("bigint")).alias("doc_id"))
    bad = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 0).cast("int")).alias("block"))
    return numbered.join(bad, "doc_id").select("url", "block")


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    made = spark.createDataFrame(labelled_urls(), "url string, block int")
    mined = [mine(labelled_pages(pages, read(spark, sf_dir, "labels"))), mine(made)]
    return judge(pages, compiled(mined, FIXED_RULES))
