"""Toxicity: a convolutional text classifier trained in numpy, with thresholds calibrated by language.

A word's embedding is the sum of the hashed embeddings of its character 4-grams and of itself; what never occurs in
training embeds to nothing. Filters one, two and three words wide run over the whole text, each keeps its greatest
value, and a linear layer sums these up. As only the greatest positions carry gradient, training is cheap. All labelled
documents are learnt from: shards of them in tasks of their own, whose models are averaged after each epoch.

The language that picks a threshold is told from the text by its function words; a table's columns are no input.
Thresholds move the logits, so that 0.7 means the calibrated threshold in every language.
"""

from __future__ import annotations

import copy
import itertools
import math
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from arborlake.llm.common import broadcast_if_small, cut, give_back, let_go, map_slices, read, small_batches, trim

WORD = re.compile(r"[^\W\d_]+")
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 18, 8, 8, (1, 2, 3)
EPOCHS, BATCH, RATE = 5, 48, 0.05
#: Labelled documents of a shard, about; a shard learns in one task.
SHARD_ROWS = 16_000
#: Texts that are kept together as numbers of words.
CHUNK = 10 * BATCH
#: Buckets whose embeddings are put together in one row, and the columns of such rows.
PIECE, PIECES = 1024, "piece int, shard int, n bigint, met binary, moved binary, value binary, sums binary"
#: Logits are counted by steps of this size.
GRID = 1 / 1024
THRESHOLD = 0.7
#: Words that a task keeps with their embedding; beyond it the cache starts anew.
CACHED_WORDS = 150_000
#: Frequent function words.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on are with this be by from",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch",
    "fr": "le la les de des du et un une en que qui dans pour est pas au par sur avec",
    "es": "el la los las de del y en que un una por con para se no es como más",
}
LANGUAGES = (*FUNCTION_WORDS, "other")


def _language_marks() -> dict[str, int]:
    """{word: bit mask of the languages that have it}"""
    out: dict[str, int] = {}
    for k, words in enumerate(FUNCTION_WORDS.values()):
        for w in words.split():
            out[w] = out.get(w, 0) | 1 << k
    return out


MARKS = _language_marks()


def features(word: str) -> list[int]:
    """Buckets of a word and of its character 4-grams, with a mark at either end."""
    w = f"<{word}>"
    grams = [w, *{w[k : k + 4] for k in range(len(w) - 3)}] if len(w) > 4 else [w]
    return [zlib.crc32(g.encode("utf-8")) & (BUCKETS - 1) for g in sorted(grams)]


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Vocabulary:
    """Words by number, their buckets end to end."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.flat, self.start, self.marks = array("i"), array("q", [0]), array("b")

    def ids(self, words: list[str]) -> np.ndarray:
        number = self.number
        out = np.empty(len(words), np.int32)
        for k, w in enumerate(words):
            i = number.get(w)
            if i is None:
                i = number[w] = len(number)
                self.flat.extend(features(w))
                self.start.append(len(self.flat))
                self.marks.append(MARKS.get(w, 0))
            out[k] = i
        return out


@dataclass
class Chunk:
    """Texts as numbers of words, with the buckets and marks of these words: what training needs of them."""

    ids: list[np.ndarray]
    y: np.ndarray
    flat: np.ndarray
    start: np.ndarray
    marks: np.ndarray

    @classmethod
    def of(cls, texts: Iterable[str | None], y: Iterable[int]) -> Chunk:
        vocab = Vocabulary()
        ids = [vocab.ids(words_of(t)) for t in texts]
        return cls(ids, np.array(y, np.float64), np.array(vocab.flat, np.int32), np.array(vocab.start, np.int64), np.array(vocab.marks, np.int64))

    def packed(self) -> dict[str, bytes]:
        n = np.array([len(i) for i in self.ids], np.int32)
        kind = np.uint16 if len(self.marks) < 1 << 16 else np.int32
        return {"y": self.y.astype(np.int8).tobytes(), "sizes": n.tobytes(), "ids": np.concatenate(self.ids).astype(kind).tobytes(), "flat": self.flat.tobytes(), "grams": np.diff(self.start).astype(np.int32).tobytes(), "marks": self.marks.astype(np.int8).tobytes()}

    @classmethod
    def unpacked(cls, r: dict) -> Chunk:
        marks = np.frombuffer(r["marks"], np.int8).astype(np.int64)
        ids = np.frombuffer(r["ids"], np.uint16 if len(marks) < 1 << 16 else np.int32).astype(np.int32)
        ends = np.cumsum(np.frombuffer(r["sizes"], np.int32))
        start = np.concatenate(([0], np.cumsum(np.frombuffer(r["grams"], np.int32), dtype=np.int64)))
        return cls(np.split(ids, ends[:-1]), np.frombuffer(r["y"], np.int8).astype(np.float64), np.frombuffer(r["flat"], np.int32), start, marks)

    def logits(self, model: Model, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The logit of some of the texts and their languages."""
        table = np.zeros((len(self.marks) + 1, DIM), np.float32)
        if len(self.marks):
            table[1:] = np.add.reduceat(model.embed[self.flat], self.start[:-1], axis=0)
        z, lang = [], []
        for at in range(0, len(some), BATCH):
            ids = [self.ids[i] for i in some[at : at + BATCH]]
            laid, starts, sizes = _laid(ids)
            z.append(model.logits(table[laid], starts, sizes))
            docs = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
            lang.append(languages(self.marks[np.concatenate(ids)], docs, len(ids)))
        return np.concatenate(z), np.concatenate(lang)


def languages(marks: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """The language of each document: the one whose function words it has most of; the last index if it has none."""
    counts = np.stack([np.bincount(docs[(marks >> k & 1) > 0], minlength=n) for k in range(len(FUNCTION_WORDS))])
    return np.where(counts.max(axis=0) > 0, counts.argmax(axis=0), len(FUNCTION_WORDS))


@dataclass
class Model:
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    base: float
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))

    def pooled(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The pooled filters of documents whose embedded words follow one another, and the raw filter values.

        A document's rows end with zeros, one more than the widest filter less one.
        """
        parts, raw = [], []
        for f, b, w in zip(self.filters, self.bias, WIDTHS):
            n = len(x) - w + 1
            v = x[:n] @ f[:DIM]
            for k in range(1, w):
                v += x[k : k + n] @ f[k * DIM : (k + 1) * DIM]
            v += b
            raw.append(v)
            between = np.stack([starts, starts + sizes - w + 1], axis=1).ravel()  # no window reaches into the next document
            parts.append(np.maximum(np.maximum.reduceat(v, between, axis=0)[::2], 0))
        return np.concatenate(parts, axis=1), raw

    def logits(self, x, starts, sizes) -> np.ndarray:
        if not len(starts):
            return np.zeros(0)
        return self.pooled(x, starts, sizes)[0] @ self.out + self.base

    def scores(self, logits: np.ndarray, lang: np.ndarray) -> np.ndarray:
        z = np.clip(logits - self.threshold[lang] + math.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)
        return 1 / (1 + np.exp(-z))


GAP = max(WIDTHS) - 1


def _laid(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all documents plus one, 0 behind each document; where each starts and its size with these zeros."""
    sizes = np.array([len(i) + GAP + 1 for i in ids])
    starts = np.cumsum(sizes) - sizes
    flat = np.zeros(int(sizes.sum()) + GAP, np.int64)
    for s, i in zip(starts, ids):
        flat[s : s + len(i)] = i + 1
    return flat, starts, sizes


class Learner:
    """A model while it learns: sums of squared gradients by which rates fall, the buckets that words have had, and those that steps have moved."""

    def __init__(self, seed: int = 7):
        rnd = np.random.default_rng(seed)
        self.model = Model(
            rnd.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32),
            [rnd.normal(0, 0.4, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
            [np.full(FILTERS, -0.05, np.float32) for _ in WIDTHS],
            rnd.uniform(0.2, 0.6, len(WIDTHS) * FILTERS).astype(np.float32),
            -3.0,
        )
        self.sums = np.full((BUCKETS, 1), 1e-3, np.float32)
        self.dense_sums = np.full(len(self.dense()), 1e-3)
        self.met, self.moved, self.rows = np.zeros(BUCKETS, bool), np.zeros(BUCKETS, bool), 0

    def dense(self) -> np.ndarray:
        """All that is not an embedding, as one vector."""
        m = self.model
        return np.concatenate([*(f.ravel() for f in m.filters), *m.bias, m.out, [m.base]]).astype(np.float64)

    def set_dense(self, v: np.ndarray) -> None:
        m = self.model
        ends = np.cumsum([x.size for x in (*m.filters, *m.bias, m.out)])
        *parts, base = np.split(v, ends)
        parts = [x.astype(np.float32) for x in parts]
        m.filters = [x.reshape(f.shape) for x, f in zip(parts, m.filters)]
        m.bias, m.out, m.base = parts[len(WIDTHS) : -1], parts[-1], float(base[0])

    def learn(self, chunk: Chunk, some: np.ndarray, toxic_weight: float, rate: float) -> None:
        """One step by the gradient of some of the texts."""
        model, ids, y, flat, start = self.model, [chunk.ids[i] for i in some], chunk.y[some], chunk.flat, chunk.start

        def buckets(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The buckets of words, end to end; where each word's begin, and how many it has."""
            length = start[words + 1] - start[words]
            first = np.cumsum(length) - length
            return flat[np.repeat(start[words] - first, length) + np.arange(int(length.sum()))], first, length

        laid, starts, sizes = _laid(ids)
        distinct, inverse = np.unique(laid, return_inverse=True)
        table = np.zeros((len(distinct), DIM), np.float32)
        real = distinct > 0
        if real.any():
            own, first, _ = buckets(distinct[real] - 1)
            self.met[own] = True
            table[real] = np.add.reduceat(model.embed[own], first, axis=0)
        x = table[inverse]
        h, raw = model.pooled(x, starts, sizes)
        z = np.clip(h @ model.out + model.base, -30, 30)
        d = (1 / (1 + np.exp(-z)) - y) * np.where(y == 1, toxic_weight, 1.0) / len(some)
        g_h = d[:, None] * model.out[None, :] * (h > 0)
        g_filters, g_bias = [np.zeros_like(f) for f in model.filters], [np.zeros_like(b) for b in model.bias]
        word_grads, word_ids = [], []
        for k, (f, w, v) in enumerate(zip(model.filters, WIDTHS, raw)):
            g = g_h[:, k * FILTERS : (k + 1) * FILTERS]
            doc, col = np.nonzero(g)
            if not len(doc):
                continue
            ends = starts + sizes - w + 1
            best = np.array([starts[i] + int(v[starts[i] : ends[i], j].argmax()) for i, j in zip(doc, col)])
            value = g[doc, col].astype(np.float32)
            window = np.concatenate([x[best + m] for m in range(w)], axis=1)
            np.add.at(g_filters[k].T, col, window * value[:, None])
            g_bias[k] += np.bincount(col, value, FILTERS).astype(np.float32)
            for m in range(w):
                word_ids.append(laid[best + m])
                word_grads.append(f[m * DIM : (m + 1) * DIM, col].T * value[:, None])
        g = np.concatenate([*(f.ravel() for f in g_filters), *g_bias, h.T @ d, [d.sum()]])
        self.dense_sums += g**2
        self.set_dense(self.dense() - rate * g / np.sqrt(self.dense_sums))
        self.rows += len(some)
        if word_ids:
            wi, wg = np.concatenate(word_ids), np.concatenate(word_grads)
            wi, wg = wi[wi > 0] - 1, wg[wi > 0]
            bucket, _, length = buckets(wi)
            touched, inverse = np.unique(bucket, return_inverse=True)
            g = np.zeros((len(touched), DIM), np.float32)
            np.add.at(g, inverse, np.repeat(wg, length, axis=0))
            self.sums[touched] += (g**2).mean(axis=1, keepdims=True)
            model.embed[touched] -= rate * g / np.sqrt(self.sums[touched])
            self.moved[touched] = True

    def learnt(self) -> Model:
        """The model, in which words that training never met embed to nothing."""
        self.model.embed[~self.met] = 0
        return self.model


def nothing_learnt() -> Model:
    """A constant that calls nothing toxic."""
    model = Learner().learnt()
    model.threshold[:] = 1e9
    return model


def toxic_weight(clean: int, toxic: int) -> float:
    return max(1.0, clean / max(1, toxic)) ** 0.5


def train(rows: Iterable[tuple[str | None, int]], seed: int = 7, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE) -> Model:
    """Fits the classifier on four fifths of the texts, given with their labels, and calibrates thresholds by language on the rest.

    For as many texts as one process holds; fit() does it over a table of any size. Without both classes the model is a
    constant that calls nothing toxic.
    """
    texts, y = zip(*rows) if (rows := list(rows)) else ((), ())
    y = np.array([1 if label else 0 for label in y], np.float64)
    if not 0 < y.sum() < len(y):
        return nothing_learnt()
    order = np.random.default_rng(seed).permutation(len(y))
    apart = np.zeros(len(y), bool)
    for c in (0, 1):  # a fifth of each class
        own = order[y[order] == c]
        apart[own[: len(own) // 5]] = True
    own, held = order[~apart[order]], np.flatnonzero(apart)
    chunk, learner, weight = Chunk.of(texts, y), Learner(seed), toxic_weight((y[own] == 0).sum(), (y[own] == 1).sum())
    for epoch in range(epochs):
        for at in range(0, len(own), batch):
            learner.learn(chunk, own[at : at + batch], weight, rate / (1 + epoch))
    if not len(set(y[held])) == 2:
        held = own
    model = learner.learnt()
    z, lang = chunk.logits(model, held)
    model.threshold = calibrate(z, y[held], lang)
    return model


def best_cut(z: np.ndarray, y: np.ndarray, n: np.ndarray | None = None, grid: float = 0.0) -> float:
    """The cut with the best F1; of cuts as good, two thirds up the widest gap, as many more clean documents are to come than toxic ones.

    n: how many documents a row stands for. grid: a value z stands for z up to z + grid, which no cut parts.
    """
    n = np.ones(len(z), np.int64) if n is None else n
    values, positive = np.unique(z), int((n * y).sum())
    cuts = np.concatenate(([values[0] - 1], np.maximum((2 * values[1:] + values[:-1]) / 3, values[:-1] + grid)))
    order = np.argsort(z)
    at = np.searchsorted(z[order], cuts)
    hits = positive - np.concatenate(([0], np.cumsum((n * y)[order])))[at]
    called = n.sum() - np.concatenate(([0], np.cumsum(n[order])))[at]
    f1 = 2 * hits / np.maximum(called + positive, 1)
    gaps = np.concatenate(([2.0], values[1:] - values[:-1]))
    best = f1 >= f1.max() - 1e-12
    return float(cuts[best][np.argmax(gaps[best])])


def calibrate(z: np.ndarray, y: np.ndarray, lang: np.ndarray, n: np.ndarray | None = None, grid: float = 0.0, least: int = 15) -> np.ndarray:
    """A cut for each language that has so many of each class, the common one for the others. n and grid as in best_cut()."""
    n = np.ones(len(z), np.int64) if n is None else n
    out = np.full(len(LANGUAGES), best_cut(z, y, n, grid))
    for k in range(len(LANGUAGES)):
        own = lang == k
        if min((n * y)[own].sum(), (n * (1 - y))[own].sum()) >= least:
            out[k] = best_cut(z[own], y[own], n[own], grid)
    return out


class Scorer:
    """Scores slices of texts, keeping the embeddings of words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self._new()

    def _new(self):
        self.vocab, self.done = Vocabulary(), 0
        self.table = np.zeros((1024, DIM), np.float32)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if len(self.vocab.number) > CACHED_WORDS:
            self._new()
        vocab = self.vocab
        ids = [vocab.ids(words_of(t)) for t in texts]
        n = len(vocab.number)
        if n > self.done:
            flat = np.array(vocab.flat, np.int64)
            start = np.array(vocab.start, np.int64)
            fresh = np.add.reduceat(self.model.embed[flat], start[:-1], axis=0)
            while len(self.table) < n + 1:
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[self.done + 1 : n + 1] = fresh
            self.done = n
            vocab.flat, vocab.start = array("i"), array("q", [0])  # numbers stay; buckets are needed once
        laid, starts, sizes = _laid(ids)
        z = self.model.logits(self.table[laid], starts, sizes)
        marks = np.array(vocab.marks, np.int64)
        docs = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
        lang = languages(marks[np.concatenate(ids)] if len(docs) else np.zeros(0, np.int64), docs, len(ids))
        return self.model.scores(z, lang)


def fold(id_col) -> F.col:
    """crc32 of the id as text, modulo 3; null ids count as the text of nothing."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, text, y, apart): every document with a label, of the folds that are not held out; a fifth of the ids is apart."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").where(fold("id") != 1)
    own = broadcast_if_small(own.groupBy("id").agg(F.max("y").alias("y")).where("y in (0, 1)"), 1_000_000)  # 12 bytes each
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(fold("id") != 1)
    return texts.join(own, "id").withColumn("apart", F.expr("pmod(xxhash64('apart', id), 5) = 0"))


def _chunks(rows: DataFrame) -> DataFrame:
    """Texts that come by shard, as rows of CHUNK texts, so that words are told apart once and not in each epoch. rows: shard, apart, y, text."""
    kind = "shard int, apart boolean, y binary, sizes binary, ids binary, flat binary, grams binary, marks binary"
    arrow = to_arrow_schema(_parse_datatype_string(kind))

    def run(batches):
        let_go()
        each = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
        for (shard, apart), own in itertools.groupby(each, key=lambda r: r[:2]):
            for some in itertools.batched(own, CHUNK):
                yield pa.RecordBatch.from_pylist([{"shard": shard, "apart": apart} | Chunk.of([r[3] for r in some], [r[2] for r in some]).packed()], schema=arrow)
        trim()

    return small_batches(rows).select("shard", "apart", "y", "text").mapInArrow(run, kind)


def _pieces(learner: Learner, before: Learner, shard: int) -> Iterable[dict]:
    """What a shard has learnt: a row for each PIECE buckets that it met, and one for all that is no embedding."""
    yield {"piece": -1, "shard": shard, "n": learner.rows, "met": b"", "moved": b"", "value": learner.dense().tobytes(), "sums": learner.dense_sums.tobytes()}
    fresh = learner.met & ~before.met
    for k in range(BUCKETS // PIECE):
        own = slice(k * PIECE, (k + 1) * PIECE)
        moved = np.flatnonzero(learner.moved[own]).astype(np.int32)
        if len(moved) or fresh[own].any():
            yield {"piece": k, "shard": shard, "n": learner.rows, "met": np.packbits(learner.met[own]).tobytes(), "moved": moved.tobytes(), "value": learner.model.embed[own][moved].tobytes(), "sums": learner.sums[own][moved].tobytes()}


def _mean(group: pa.Table) -> pa.Table:
    """One piece of all shards: embeddings as the mean of the shards that moved them, all else as the mean over rows learnt from."""
    rows = sorted(group.to_pylist(), key=lambda r: r["shard"])
    n = sum(r["n"] for r in rows)
    out = {"piece": rows[0]["piece"], "shard": 0, "n": n, "met": b"", "moved": b""}
    if rows[0]["piece"] < 0:
        out |= {c: sum(np.frombuffer(r[c]) * (r["n"] / n) for r in rows).tobytes() for c in ("value", "sums")}
    else:
        met, times, value, sums = np.zeros(PIECE // 8, np.uint8), np.zeros(PIECE), np.zeros((PIECE, DIM)), np.zeros((PIECE, 1))
        for r in rows:
            at = np.frombuffer(r["moved"], np.int32)
            met |= np.frombuffer(r["met"], np.uint8)
            times[at] += 1
            value[at] += np.frombuffer(r["value"], np.float32).reshape(-1, DIM)
            sums[at] += np.frombuffer(r["sums"], np.float32).reshape(-1, 1)
        at = np.flatnonzero(times).astype(np.int32)
        mean = [(v[at] / times[at, None]).astype(np.float32).tobytes() for v in (value, sums)]
        out |= {"met": met.tobytes(), "moved": at.tobytes(), "value": mean[0], "sums": mean[1]}
    return pa.Table.from_pylist([out], schema=group.schema)


def _epoch(chunks: DataFrame, learner: Learner, weight: float, rate: float) -> None:
    """Each shard goes over its texts, from what all have learnt so far; then what they have learnt is put together.

    Chunks of a shard stream by, and the driver gets one model, 10 MB.
    """
    learner.rows = 0
    learner.moved[:] = False
    sent = chunks.sparkSession.sparkContext.broadcast(learner)
    arrow = to_arrow_schema(_parse_datatype_string(PIECES))

    def run(batches):
        let_go()
        each = (r for b in batches for k in range(b.num_rows) for r in b.slice(k, 1).to_pylist())
        for shard, own in itertools.groupby(each, key=lambda r: r["shard"]):
            new = copy.deepcopy(sent.value)
            for chunk in map(Chunk.unpacked, own):
                for at in range(0, len(chunk.y), BATCH):
                    new.learn(chunk, np.arange(at, min(at + BATCH, len(chunk.y))), weight, rate)
            yield pa.RecordBatch.from_pylist(list(_pieces(new, sent.value, shard)), schema=arrow)
            del new
        trim()

    found = chunks.mapInArrow(run, PIECES).groupBy("piece").applyInArrow(_mean, PIECES).collect()
    sent.destroy()
    for r in found:
        if r["piece"] < 0:
            learner.set_dense(np.frombuffer(r["value"]))
            learner.dense_sums = np.frombuffer(r["sums"]).copy()
            continue
        own, at = slice(r["piece"] * PIECE, (r["piece"] + 1) * PIECE), np.frombuffer(r["moved"], np.int32)
        learner.met[own] |= np.unpackbits(np.frombuffer(r["met"], np.uint8)).astype(bool)
        learner.model.embed[own][at] = np.frombuffer(r["value"], np.float32).reshape(-1, DIM)
        learner.sums[own][at] = np.frombuffer(r["sums"], np.float32).reshape(-1, 1)


def _thresholds(chunks: DataFrame, model: Model) -> np.ndarray:
    """Cuts from the logits of all texts, counted by language, label and logit on a grid of GRID."""
    sent = chunks.sparkSession.sparkContext.broadcast(model)
    kind = "lang int, z int, y int, n bigint"
    arrow = to_arrow_schema(_parse_datatype_string(kind))

    def run(batches):
        let_go()
        counts = Counter()
        for r in (r for b in batches for k in range(b.num_rows) for r in b.slice(k, 1).to_pylist()):
            chunk = Chunk.unpacked(r)
            z, lang = chunk.logits(sent.value, np.arange(len(chunk.y)))
            counts.update(zip(lang.tolist(), np.floor(np.clip(z, -30, 30) / GRID).astype(int).tolist(), chunk.y.astype(int).tolist()))
        yield pa.RecordBatch.from_pylist([{"lang": k, "z": z, "y": y, "n": n} for (k, z, y), n in counts.items()], schema=arrow)

    found = chunks.mapInArrow(run, kind).groupBy("lang", "z", "y").agg(F.sum("n").alias("n")).toArrow()
    sent.destroy()
    lang, z, y, n = (found[c].to_numpy() for c in ("lang", "z", "y", "n"))
    return calibrate(z * GRID, y, lang, n, GRID)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", shard_rows: int = SHARD_ROWS, seed: int = 7) -> Model:
    """A model from all labelled documents of the folds that are not held out: it learns from four fifths of them, and the others set the thresholds.

    Documents are dealt by a hash of the id to shards of about shard_rows, one for each task; after each epoch the
    model is the mean of what the shards have learnt. The same rows give the same model, however they are laid out.
    Rows with a null id or label teach nothing; of an id with both labels the toxic one counts; null texts have no words.
    """
    rows = _labelled(docs, labels, id_col, text_col, label_col)
    counts = {(r["y"], r["apart"]): r["n"] for r in rows.groupBy("y", "apart").agg(F.count("*").alias("n")).collect()}
    if len({y for y, _ in counts}) < 2:
        return nothing_learnt()
    if len(counts) < 4:  # too few to set some apart
        own, held = F.lit(True), F.lit(True)
        counts = {(y, False): counts.get((y, False), 0) + counts.get((y, True), 0) for y in (0, 1)}
    else:
        own, held = ~F.col("apart"), F.col("apart")
    shards = -(-sum(counts.values()) // shard_rows)
    rows = rows.withColumn("shard", F.expr(f"cast(pmod(xxhash64('shard', id), {shards}) as int)")).withColumn("at", F.expr("xxhash64('order', id)"))
    chunks = cut(_chunks(rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "apart", "at", "id", "text")), as_dealt=True)
    learner, weight = Learner(seed), toxic_weight(counts[0, False], counts[1, False])
    for epoch in range(EPOCHS):
        _epoch(chunks.where(own), learner, weight, RATE / (1 + epoch))
    model = learner.learnt()
    model.threshold = _thresholds(chunks.where(held), model)
    give_back()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for each row, over whole texts.

    Null and empty texts have no words and score as such. Repeated rows give equal scores. Null ids are kept.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 8 MB of embeddings, whatever the input

    def make():
        scorer = Scorer(sent.value)

        def f(ids, held, texts):
            s = scorer(texts)
            return [ids, held, s.tolist(), [1 if x >= THRESHOLD else 0 for x in s.tolist()]]

        return f

    kind = docs.schema[id_col].dataType.simpleString()
    return map_slices(docs, [F.col(id_col), (fold(id_col) == 1).alias("_held"), F.col(text_col)], make, f"`{id_col}` {kind}, held_out boolean, score double, predicted int", rows=64)


def reject(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text is not called toxic.

    Null and empty texts are scored as texts without words; repeated rows stay or go together.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    arrow = to_arrow_schema(docs.schema)
    at = docs.columns.index(text_col)

    def run(batches):
        let_go()
        scorer = Scorer(sent.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                keep = part.filter(pa.array(scorer(part.column(at).to_pylist()) < THRESHOLD))
                if keep.num_rows:
                    yield pa.RecordBatch.from_arrays([c.cast(x.type) for c, x in zip(keep.columns, arrow)], schema=arrow)
        del scorer
        trim()

    return small_batches(docs).mapInArrow(run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))
