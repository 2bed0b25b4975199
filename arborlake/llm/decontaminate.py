"""Benchmark decontamination with DataFrame functions only.

A text becomes its array of words, and each window of words one 64-bit hash. Window hashes are built by doubling: the
hashes of neighbouring windows of 1, 2, 4 and 8 words are combined, so a window of 13 costs five passes over the array
and no string is joined. The items' windows are hashed likewise and broadcast as a hash set of a bounded size; more
windows than that are dealt to several such sets, and the texts are scanned once for each. Rows of one word each are
therefore never shuffled. Hits are verified word by word. Each document's array ends with one mark that always matches,
so that documents without a hit keep a row without a second scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm.common import ascii_lower_col, broadcast_if_small, cut, read, unused

WORD_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Item windows that are broadcast at once: with their words about 200 bytes each, so under 100 MB.
BROADCAST_WINDOWS = 400_000
_MARK = 0


def words(text: Column) -> Column:
    """Runs of digits, letters a-z (A-Z lower-cased) and any character beyond ASCII. Null has none."""
    return F.filter(F.split(ascii_lower_col(F.coalesce(text, F.lit(""))), WORD_BREAKS), lambda w: w != "")


def _with_windows(df: DataFrame, source: str, widths: list[int]) -> tuple[DataFrame, dict[int, str]]:
    """Adds a column of the hashes of all windows for each width, and those that they are built from."""
    needed, todo = set(), set(widths)
    while todo:
        w = todo.pop()
        if w not in needed:
            needed.add(w)
            if w > 1:
                p = 1 << (w - 1).bit_length() - 1
                todo |= {p, w - p}
    names = {w: f"_h{w}" for w in needed}
    for w in sorted(needed):
        if w == 1:
            df = df.withColumn(names[1], F.transform(source, lambda x: F.xxhash64(x)))
            continue
        p = 1 << (w - 1).bit_length() - 1
        n = F.size(source) - w + 1
        a, b = F.slice(names[p], F.lit(1), F.greatest(n, F.lit(0))), F.slice(names[w - p], F.lit(p + 1), F.greatest(n, F.lit(0)))
        df = df.withColumn(names[w], F.zip_with(a, b, lambda x, y: F.xxhash64(x, y)))
    return df, names


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = 13) -> DataFrame:
    """(item, window, size): each item's windows of `width` words; an item of fewer, but not none, is one window."""
    w = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(width))
    each = w.select("item", "words", F.explode(F.sequence(F.lit(1), F.size("words") - size + 1)).alias("at"))
    return each.select("item", F.slice("words", F.col("at"), size).alias("window"), size.alias("size")).distinct()


def _tables(benchmark: DataFrame, id_col: str, text_col: str, width: int, most: int) -> tuple[list[DataFrame], list[int]]:
    """Tables (h, s, window, items) of at most about `most` windows and items each, the first with the mark; the sizes of windows."""
    windows = cut(item_windows(benchmark, id_col, text_col, width))
    of_size = {r["size"]: r["n"] for r in windows.groupBy("size").agg(F.count("*").alias("n")).collect()}  # one row a size
    sizes, total = sorted(of_size), sum(of_size.values())
    hashed = None
    for s in sizes:
        part, names = _with_windows(windows.where(F.col("size") == s), "window", [s])
        part = part.select(F.col(names[s])[0].alias("h"), F.col("size").alias("s"), "window", "item")
        hashed = part if hashed is None else hashed.unionAll(part)
    spark = benchmark.sparkSession
    mark = spark.range(1).select(F.lit(0).cast("bigint").alias("h"), F.lit(_MARK).alias("s"), F.array().cast("array<string>").alias("window"), F.array().cast("array<string>").alias("items"))
    if hashed is None:
        return [mark], []
    # a window that many items share is one row of the table, and one hit wherever it occurs
    hashed = hashed.groupBy("h", "s", "window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    n = max(1, -(-total // most)) if most else total
    if n > 1:
        hashed = cut(hashed)
    dealt = [hashed.where(F.pmod(F.xxhash64("h"), F.lit(n)) == k) if n > 1 else hashed for k in range(n)]
    return [mark.unionAll(dealt[0]), *dealt[1:]], sizes


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, most_broadcast: int = BROADCAST_WINDOWS, carried: str | None = None, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(row, id, n_words, spans, items) for each document, and the column `carried` if one is named.

    spans: array of (at, end), word positions from 0, one for each place of a window; items: those that occur. `row`
    tells repeated rows apart. Null texts and items have no words. Items without an id are scanned but not named. Rows
    with a null id are kept. An empty benchmark hits nothing. Other columns may have any name.
    """
    tables, sizes = _tables(benchmark, item_col, item_text_col, width, most_broadcast)
    more = [F.col(carried).alias("carried")] if carried else []
    w = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), *more)
    if len(tables) > 1:
        w = cut(w, as_dealt=True)  # all scans number the same rows alike
    kept = ["row", "id", *["carried"][: len(more)]]
    w = w.select(*kept, words(F.col("text")).alias("words"))
    w, names = _with_windows(w, "words", sizes)
    entry = lambda s: F.transform(F.col(names[s]), lambda h, i: F.struct(h.alias("h"), i.alias("at"), F.lit(s).alias("s")))
    last = F.array(F.struct(F.lit(0).cast("bigint").alias("h"), F.lit(0).alias("at"), F.lit(_MARK).alias("s")))
    met = None
    for k, table in enumerate(tables):
        entries = [*[entry(s) for s in sizes], *([last] if k == 0 else [])]
        each = w.select(*kept, "words", F.explode(F.concat(*entries)).alias("e")).select(*kept, "words", F.col("e.h").alias("h"), F.col("e.at").alias("at"), F.col("e.s").alias("s"))
        t = F.broadcast(table.select(F.col("h").alias("t_h"), F.col("s").alias("t_s"), "window", "items"))
        found = each.join(t, (F.col("h") == F.col("t_h")) & (F.col("s") == F.col("t_s")) & ((F.col("s") == _MARK) | (F.slice("words", F.col("at") + 1, F.greatest(F.col("s"), F.lit(1))) == F.col("window"))))
        found = found.select(*kept, F.size("words").alias("n_words"), F.when(F.col("s") != _MARK, F.struct("at", (F.col("at") + F.col("s")).alias("end"))).alias("span"), "items")
        met = found if met is None else met.unionAll(found)
    # a document's places by the items of their window first: a window that many items share names them once
    by_items = met.groupBy("row", "items").agg(*[F.first(c).alias(c) for c in [*kept[1:], "n_words"]], F.collect_list("span").alias("spans"))
    out = by_items.groupBy("row").agg(
        *[F.first(c).alias(c) for c in [*kept[1:], "n_words"]],
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )
    return out.withColumnRenamed("carried", carried) if carried else out


def covered(spans: Column) -> Column:
    """The number of words in the union of the spans (at, end)."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        F.array_sort(F.array_distinct(spans)),
        start,
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(s["end"] - F.greatest(s["at"], acc["end"]), F.lit(0))).alias("n"),
            F.greatest(acc["end"], s["end"]).alias("end"),
        ),
        lambda acc: acc["n"],
    )


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, most_broadcast: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row a document: words, words hit, items that occur and whether it is contaminated (a twentieth hit, at least one).

    Nulls, empty texts, repeated rows and empty tables are as in scan().
    """
    found = scan(docs, benchmark, id_col, text_col, width, most_broadcast)
    items = F.array_sort("items")
    out = found.select(F.col("row"), F.col("id").alias(id_col), F.col("n_words").cast("bigint").alias("n_words"), covered(F.col("spans")).alias("n_hit"), items.alias("items"))
    return out.select(
        "row",
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", width: int = 13, most_broadcast: int = BROADCAST_WINDOWS) -> DataFrame:
    """docs with all columns and without the rows that are contaminated, as report() has it. Equal texts are judged once.

    Rows with a null or empty text have no words and stay. Repeated rows stay or go together. Ids are not looked at,
    and other columns may have any name. Empty tables take nothing away.
    """
    texts = docs.select(F.col(text_col).alias("text")).where(F.col(text_col).isNotNull())
    hit = scan(texts.select(F.lit(0).alias("doc_id"), "text", F.sha2(F.col("text").cast("binary"), 256).alias("key")), benchmark, width=width, most_broadcast=most_broadcast, carried="key")
    n = covered(F.col("spans"))
    key = unused(docs, "gone")
    gone = broadcast_if_small(hit.where((n > 0) & (20 * n >= F.col("n_words"))).select(F.col("key").alias(key)).distinct(), 200_000)  # 64 characters each
    return docs.join(gone, F.sha2(docs[text_col].cast("binary"), 256) == F.col(key), "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("row")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS n, list_slice(w, p0, p0 + least(len(w), 13) - 1) AS win
       FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p0 FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, p0, n, list_slice(w, p0, p0 + n - 1) AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p0 FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT dw.r, dw.p0, dw.n, bw.item FROM dw JOIN bw ON dw.win = bw.win),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(p0, p0 + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
