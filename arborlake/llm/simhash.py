"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into two segments of 32 bits. Two that differ in at most 3 bits differ in at most one bit in one
segment, so each probes, in each segment's table, its own value and the values with one more bit set (of two values
one bit apart, one is the other with that bit set). Matches are verified by their whole distance. Equal fingerprints
are one row throughout.

A segment value that very many fingerprints share would make many pairs. In such a crowd the balls go on over the
other segment: members meet at the values within two bits of theirs, and one link to a middle member stands for all,
so that rows grow with the members and no component is lost.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborlake.llm.common import broadcast_if_small, by_sorting, cut, give_back_heaps, map_slices, read, unused
from arborlake.llm.components import components

#: A segment value with more distinct fingerprints than this is a crowd. Results do not depend on it.
CROWD = 200


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64 majority bits over the hashes of all word shingles, repeats included; without words zero."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z alone change, and the six white-space bytes part words
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(whole, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(whole[a:b], seed) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist())], np.uint64)
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        total += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): the fingerprint as a signed long. Null texts count as empty, and those have fingerprint zero."""

    def make():
        return lambda ids, texts: [ids, [(v := fingerprint(t, width)) - (v >> 63 << 64) for t in texts]]

    return map_slices(df, [id_col, text_col], make, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, fp bigint")


def _segments(prints: DataFrame) -> DataFrame:
    """(fp, k): k is one of a fingerprint's two segment values, the upper segment's with bit 32 set."""
    return prints.select("fp", F.explode(F.expr("array(fp & 4294967295L, shiftrightunsigned(fp, 32) | 4294967296L)")).alias("k"))


def _ball(k: str, bits: int = 32) -> str:
    """k, and k with one more bit set."""
    return f"concat(array({k}), filter(transform(sequence(0, {bits - 1}), b -> {k} | shiftleft(1L, b)), x -> x <> {k}))"


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between fingerprints that differ in 3 bits or fewer; those of a crowd are as many as keep it joined.

    prints: distinct `fp`.
    """
    own = _segments(prints)
    probes = own.select("fp", F.col("k").alias("own_k"), F.explode(F.expr(_ball("k"))).alias("k"))
    crowds = own.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("k")
    near = F.expr("bit_count(a ^ b) <= 3 and a <> b and (own_k <> k or a < b)")
    found = own.select(F.col("fp").alias("a"), "k").join(by_sorting(probes.select(F.col("fp").alias("b"), "own_k", "k")), "k")
    if crowds.isEmpty():
        return found.where(near).select("a", "b")
    plain = own.join(by_sorting(crowds), "k", "left_anti").select(F.col("fp").alias("a"), "k").join(by_sorting(probes.select(F.col("fp").alias("b"), "own_k", "k")), "k").where(near).select("a", "b")
    # level 0: at most one bit from a member of the crowd; 1: two bits; 2: at most one bit from one that probes it
    met = probes.join(by_sorting(crowds), "k").withColumn("rest", F.expr("if(k >= 4294967296L, fp & 4294967295L, shiftrightunsigned(fp, 32))"))
    one = "transform(sequence(0, 31), b -> rest ^ shiftleft(1L, b))"
    two = "flatten(transform(sequence(0, 30), b -> transform(sequence(b + 1, 31), c -> rest ^ shiftleft(1L, b) ^ shiftleft(1L, c))))"
    close = met.select("k", "fp", F.expr("if(own_k = k, 0, 2)").alias("level"), F.explode(F.expr(f"concat(array(rest), {one})")).alias("z"))
    wide = met.where("own_k = k").select("k", "fp", F.lit(1).alias("level"), F.explode(F.expr(two)).alias("z"))
    spread = close.unionAll(wide)
    middle = spread.where("level = 0").groupBy("k", "z").agg(F.min("fp").alias("a"))
    starred = spread.join(by_sorting(middle), ["k", "z"]).where("fp <> a").select("a", F.col("fp").alias("b"))
    return plain.unionAll(starred)


def _labels(least: DataFrame, tied: DataFrame) -> DataFrame:
    """(fp, component_id) for each fp with its least id; tied: (node, root) of those that have a link.

    The least id of each root is written before it is joined, so that a component of any size can be split over tasks.
    """
    linked = least.join(by_sorting(tied), least.fp == tied.node).select("fp", "least", "root")
    of_root = cut(linked.groupBy("root").agg(F.min("least").alias("component_id")))
    alone = least.join(by_sorting(tied), least.fp == tied.node, "left_anti").select("fp", F.col("least").alias("component_id"))
    return linked.join(by_sorting(of_root), "root").select("fp", "component_id").unionAll(alone)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, crowd: int = CROWD) -> DataFrame:
    """(id, fingerprint, component_id) for each row.

    fingerprint: 16 hex digits. component_id: the smallest id among all documents that links reach, itself included.
    Null and empty texts have fingerprint zero and link as any other. Repeated rows give one row each. A row with a
    null id is no component's smallest unless the component has no other id; then it is null. Long texts are hashed
    whole. An empty table gives no rows.
    """
    prints = cut(fingerprints(df, id_col, text_col, width), as_dealt=True)
    least = cut(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
    tied = components(links(least.select("fp"), crowd), "a", "b")
    return prints.join(by_sorting(_labels(least, tied)), "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


BINS, BANDS, BAND_ROWS = 256, 20, 5
#: Texts are near copies if their sets of five-word shingles have this similarity.
SIMILARITY = 0.8
#: By 256 bins, whose error at 0.8 is 0.025: below the first a pair is none, from the second on it is one; between them texts decide.
UNLIKELY, LIKELY = 0.66, 0.95
#: Meetings of more texts than this compare each with three hubs, then those that share a rare shingle; smaller ones all pairs.
MEETING = 32
_DONORS = np.argsort(np.random.default_rng(17).random((BINS, BINS)), axis=1)
_BREAKS = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _shingle_hashes(text: str | None, width: int = 5, seed: int = 43) -> np.ndarray:
    """Sorted hashes of the shingles of words without their punctuation; texts of fewer words are one shingle, without words none."""
    words = [w for w in _BREAKS.split((text or "").encode("utf-8").lower()) if w]
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(whole, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.sort(np.array([digest(whole[a:b], seed) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist())], np.uint64))


def sketch(text: str | None, width: int = 5) -> np.ndarray | None:
    """The least shingle hash in each of 256 bins of the hash range, 48 bits of it; empty bins take another's. None without words."""
    h = _shingle_hashes(text, width)
    if not len(h):
        return None
    at = np.searchsorted(h, np.arange(BINS, dtype=np.uint64) << np.uint64(56))
    least = h[np.minimum(at, len(h) - 1)]
    full = (at < len(h)) & (least >> np.uint64(56) == np.arange(BINS))
    if not full.all():
        donor = _DONORS[np.arange(BINS), full[_DONORS].argmax(axis=1)]
        least = np.where(full, least, least[donor])
    return least & np.uint64((1 << 48) - 1)


def similarity(a: str | None, b: str | None) -> float:
    """Of the sets of five-word shingles; 1 for two texts without words."""
    x, y = np.unique(_shingle_hashes(a)), np.unique(_shingle_hashes(b))
    if not len(x) and not len(y):
        return 1.0
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common)


def _copies_prints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, fp, sketch, bands); th: a hash of the text; sketch: 256 numbers of 15 bits; bands: 20 numbers. Both empty for texts without words."""

    def make():
        signed = lambda v: v - (v >> 63 << 64)

        def f(ids, texts):
            hashes, prints, sketches, bands = [], [], [], []
            for t in texts:
                hashes.append(signed(xxhash.xxh64_intdigest((t or "").encode("utf-8"), 42)))
                prints.append(signed(fingerprint(t)))
                k = sketch(t)
                sketches.append([] if k is None else (k & np.uint64(0x7FFF)).astype(np.int16))
                bands.append([] if k is None else [xxhash.xxh64_intdigest(k[b * BAND_ROWS : (b + 1) * BAND_ROWS].tobytes(), b) >> 1 for b in range(BANDS)])
            return [ids, hashes, prints, sketches, bands]

        return f

    return map_slices(df, [id_col, text_col], make, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, th bigint, fp bigint, sketch array<smallint>, bands array<bigint>")


def _met(each: DataFrame, meeting: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of texts that share a band, and the members (k, th) of large meetings.

    Pairs are all of a small meeting, else each with the one that met most others and with those of the least and
    greatest hash; what that leaves open is for _rare_pairs().
    """
    keys = each.select("th", F.explode("bands").alias("k"))
    met = cut(keys.join(by_sorting(keys.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")), "k"))
    few = met.where(F.col("n") <= meeting)
    small = few.select("k", F.col("th").alias("a")).join(by_sorting(few.select("k", F.col("th").alias("b"))), "k").where("a < b").select("a", "b")
    large = met.where(F.col("n") > meeting)
    weight = large.groupBy("th").agg(F.sum("n").alias("w"))
    hubs = large.join(by_sorting(weight), "th").groupBy("k").agg(F.max(F.struct("w", "th"))["th"].alias("x"), F.min("th").alias("y"), F.max("th").alias("z"))
    hubs = hubs.select("k", F.explode(F.array_distinct(F.array("x", "y", "z"))).alias("hub"))
    crowded = large.join(by_sorting(hubs), "k").where("th <> hub").select(F.least("th", "hub").alias("a"), F.greatest("th", "hub").alias("b"))
    return small.unionAll(crowded).distinct(), large.select("k", "th")


def _rare_pairs(texts: DataFrame, large: DataFrame, tied: DataFrame) -> DataFrame | None:
    """Pairs (a, b) of members of large meetings that may be similar and are in different components; None if there are none.

    By prefixes: the shingles of each set stand in one order, rarest first. Of two sets as similar as asked, the first
    shared one stands early in both, so sets meet at their first shingles alone, and what a whole family shares is not
    among them unless a member is as good as the family's template. Only members outside the largest component of a
    meeting look for others. texts: (th, text), may repeat.
    """
    roots = tied.select(F.col("node").alias("th"), "root")
    own = cut(large.join(by_sorting(roots), "th", "left").select("k", "th", F.coalesce("root", "th").alias("c")))
    main = own.groupBy("k", "c").agg(F.count("*").alias("n")).groupBy("k").agg(F.max(F.struct("n", "c"))["c"].alias("main"), F.count("*").alias("parts")).where("parts > 1")
    members = cut(own.join(by_sorting(main), "k").groupBy("th", "c").agg(F.max(F.col("c") != F.col("main")).alias("open")))
    if members.isEmpty():
        return None
    asked = broadcast_if_small(members.select("th"), 1_000_000)  # 8 bytes each

    def make():
        def f(ths, ts):
            sets = [np.unique(_shingle_hashes(t)).view(np.int64) for t in ts]
            return [ths, [len(x) for x in sets], sets]

        return f

    sets = cut(map_slices(texts.join(asked, "th").dropDuplicates(["th"]), ["th", "text"], make, "th bigint, n bigint, hs array<bigint>", rows=32), as_dealt=True)
    each = sets.select("th", "n", F.explode("hs").alias("h"))
    repeated = each.join(by_sorting(each.groupBy("h").agg(F.count("*").alias("d")).where("d > 1")), "h")
    of_text = Window.partitionBy("th")  # shingles of one text alone come first and meet none
    ranked = repeated.withColumn("at", F.row_number().over(of_text.orderBy("d", "h")) + F.col("n") - F.count("*").over(of_text))
    first = cut(ranked.where(f"at <= n - ceil({SIMILARITY}D * n - 1e-6D) + 1").join(by_sorting(members), "th").select("th", "n", "h", "at", "c", "open"))
    x = first.where(f"at <= n - ceil({2 * SIMILARITY / (1 + SIMILARITY)}D * n - 1e-6D) + 1").select("h", *[F.col(c).alias(f"x_{c}") for c in ("th", "n", "at", "c", "open")])  # of the smaller set
    y = first.select("h", *[F.col(c).alias(f"y_{c}") for c in ("th", "n", "at", "c", "open")])
    fits = F.expr(
        f"x_c <> y_c and (x_n < y_n or x_n = y_n and x_th < y_th) and x_n >= {SIMILARITY}D * y_n - 1e-6D"
        f" and {1 + SIMILARITY}D * (1 + least(x_n - x_at, y_n - y_at)) >= {SIMILARITY}D * (x_n + y_n) - 1e-6D"
    )
    found = x.where("x_open").join(by_sorting(y), "h").where(fits).unionAll(x.where("not x_open").join(by_sorting(y.where("y_open")), "h").where(fits))
    return found.select(F.least("x_th", "y_th").alias("a"), F.greatest("x_th", "y_th").alias("b")).distinct()


def _groups(df: DataFrame, id_col: str, text_col: str, meeting: int) -> tuple[DataFrame, DataFrame]:
    """(id, th) of each row, and (th, component_id) of each text hash; component_id: (no_id, id, th) of the row that comes first in its component."""
    prints = cut(_copies_prints(df, id_col, text_col), as_dealt=True)
    each = cut(prints.groupBy("th").agg(F.min(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("th").alias("th"))).alias("least"), F.min("fp").alias("fp"), F.max("sketch").alias("sketch"), F.max("bands").alias("bands")))
    reps = each.groupBy("fp").agg(F.min("th").alias("rep"))
    equal = each.select("th", "fp").join(by_sorting(reps), "fp").where("th <> rep").select(F.col("rep").alias("a"), F.col("th").alias("b"))
    near = links(reps.select("fp")).join(by_sorting(reps.select(F.col("fp").alias("a"), F.col("rep").alias("ra"))), "a").join(by_sorting(reps.select(F.col("fp").alias("b"), F.col("rep").alias("rb"))), "b")
    met, large = _met(each, meeting)
    pairs = equal.unionAll(near.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionAll(met).distinct()
    own, other = each.select(F.col("th").alias("a"), F.col("sketch").alias("x")), each.select(F.col("th").alias("b"), F.col("sketch").alias("y"))
    share = F.expr(f"if(size(x) = 0 or size(y) = 0, if(size(x) = size(y), 1D, 0D), size(filter(zip_with(x, y, (p, q) -> p = q), z -> z)) / {BINS}D)")
    hashed = df.select(F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("th"), F.col(text_col).alias("text"))  # the hash of _copies_prints()

    def similar(pairs):
        judged = cut(pairs.join(by_sorting(own), "a").join(by_sorting(other), "b").select("a", "b", share.alias("s")).where(F.col("s") >= UNLIKELY))
        open_pairs = judged.where(F.col("s") < LIKELY).select("a", "b")
        asked = broadcast_if_small(open_pairs.select(F.explode(F.array("a", "b")).alias("th")).distinct(), 1_000_000)  # 8 bytes each
        texts = cut(hashed.join(asked, "th").dropDuplicates(["th"]))
        both = open_pairs.join(by_sorting(texts.select(F.col("th").alias("a"), F.col("text").alias("ta"))), "a").join(by_sorting(texts.select(F.col("th").alias("b"), F.col("text").alias("tb"))), "b")
        exact = map_slices(both, ["a", "b", "ta", "tb"], lambda: lambda a, b, ta, tb: [a, b, [similarity(x, y) for x, y in zip(ta, tb)]], "a bigint, b bigint, s double")
        return judged.where(F.col("s") >= LIKELY).unionAll(exact.where(F.col("s") >= SIMILARITY)).select("a", "b")

    tied = components(similar(pairs), "a", "b")
    give_back_heaps(df.sparkSession)
    rare = _rare_pairs(hashed, large, tied)
    if rare is not None:
        tied = components(tied.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(similar(rare)), "a", "b")
    labels = _labels(each.select(F.col("th").alias("fp"), "least"), tied).withColumnRenamed("fp", "th")
    return prints.select(F.col(id_col).alias("id"), "th"), labels


def copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", meeting: int = MEETING) -> DataFrame:
    """(id, component_id) of each row: components of texts with a similarity of 0.8 or more; of the ids in a component the smallest.

    Candidates are SimHash links, texts of one fingerprint and texts that share a band of their sketches; where very many
    share one, also those of them that share a rare shingle. Sketches rule most pairs in or out; texts decide the rest
    exactly. Null texts count as empty; texts without words are copies if their fingerprints are equal. Repeated rows give
    one row each; null ids are kept, and the component of rows without any id has none. An empty table gives no rows.
    """
    rows, labels = _groups(df, id_col, text_col, meeting)
    return rows.join(by_sorting(labels), "th").select(F.col("id").alias(id_col), F.col("component_id.id").alias("component_id"))


def remove_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all columns and one document of each group of copies: the one of the smallest id, null ids last.

    Null texts count as empty. Rows that share an id but no text are different documents; of rows that share both one
    stays, whatever their other columns hold. Other columns may have any name. An empty table stays empty.
    """
    rows, labels = _groups(docs, id_col, text_col, MEETING)
    own = rows.groupBy("id", "th").agg(F.count("*").alias("n"))
    judged = cut(own.join(by_sorting(labels), "th").select("id", "th", "n", (F.col("id").eqNullSafe(F.col("component_id.id")) & (F.col("th") == F.col("component_id.th"))).alias("stays")).where("n > 1 or not stays"))
    gone_id, gone_th = unused(docs, "gone_id"), unused(docs, "gone_th")
    named = judged.select(F.col("id").alias(gone_id), F.col("th").alias(gone_th), "stays")
    gone = broadcast_if_small(named.where("not stays").drop("stays"), 1_000_000)  # 16 bytes each
    hashed = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    match = lambda t: (hashed == t[gone_th]) & docs[id_col].eqNullSafe(t[gone_id])
    left = docs.join(gone, match(gone), "left_anti")
    many = named.where("stays").drop("stays")  # rows that share id and text
    if many.isEmpty():
        return left
    many = broadcast_if_small(many, 1_000_000)
    own_th = unused(docs, "own_th")
    one = docs.join(many, match(many), "left_semi").withColumn(own_th, hashed).dropDuplicates([id_col, own_th]).drop(own_th)
    return left.join(many, match(many), "left_anti").unionAll(one)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
