import random
import zlib

import numpy as np

from arborlake.llm import toxicity as tox

BAD = ["clown", "loweian", "loweischaft", "vequeu", "chllanu"]


def made(n, seed):
    rnd = random.Random(seed)
    pools = {"en": "the of and to in is that erth onst".split(), "de": "der die und das den von ung keit schön".split()}
    out = []
    for i in range(n):
        pool = pools[rnd.choice(["en", "de"])]
        words = [rnd.choice(pool) + rnd.choice(["", "er", "ing", "st"]) for _ in range(rnd.randint(1, 60))]
        words += rnd.sample(pool, 3)
        y = int(rnd.random() < 0.25)
        for _ in range(3 * y):
            words.insert(rnd.randrange(len(words)), rnd.choice(BAD))
        out.append((i, " ".join(words), y))
    return out


def test_held_out_accuracy(spark):
    rows = made(1500, 1)
    df = spark.createDataFrame([(i, t, "zz", 0.5, 3) for i, t, _ in rows], "doc_id bigint, text string, lang string, score double, toxic int")
    labels = spark.createDataFrame([(i, y, y) for i, _, y in rows] + [(None, 1, 0), (99999, 1, 1), (5, None, None)], "doc_id bigint, toxic int, text int")
    model = tox.fit(df, labels)
    got = {r.doc_id: r for r in tox.score(df, model).collect()}
    assert len(got) == 1500
    wrong = 0
    for i, _, y in rows:
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        wrong += r.held_out and r.predicted != y
    assert wrong <= 5
    kept = tox.reject(df, model)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in got if not got[i].predicted}


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows = made(300, 2)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    flip = lambda i, y: 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y
    a = tox.fit(df, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int"))
    b = tox.fit(df, spark.createDataFrame([(i, flip(i, y)) for i, _, y in rows], "doc_id bigint, toxic int"))
    assert np.array_equal(a.embed, b.embed) and np.array_equal(a.threshold, b.threshold)


def test_odd_rows(spark):
    rows = made(200, 3)
    model = tox.train([(t, y) for _, t, y in rows])
    texts = [(1, None), (2, ""), (3, "!!! 123"), (None, "clown clown"), (4, "word " * 20000), (4, "word " * 20000), (5, "x")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = tox.score(df, model).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    one = [r.score for r in got if r.doc_id == 4]
    assert one[0] == one[1]
    assert tox.score(df.limit(0), model).count() == 0
    assert tox.reject(df.limit(0), model).count() == 0
    s = tox.Scorer(model)
    apart = [float(s([t])[0]) for _, t in texts]  # the same alone as in a slice
    assert np.allclose(apart, tox.Scorer(model)([t for _, t in texts]), atol=1e-5)


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "clown")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    r = tox.score(df, tox.fit(df, none)).first()
    assert r.predicted == 0 and 0 <= r.score < 0.7


def test_cut():
    assert tox.best_cut(np.array([0.0, 1.0, 4.0, 5.0]), np.array([0, 0, 1, 1])) == 3.0
    z, y = np.array([0.0, 1, 2, 3, 4, 5]), np.array([0, 1, 0, 1, 1, 1])
    c = tox.best_cut(z, y)
    f = lambda c: 2 * ((z > c) & (y == 1)).sum() / ((z > c).sum() + y.sum())
    assert f(c) == max(f(k - 0.5) for k in range(7))


def test_language():
    v = tox.Vocabulary()
    ids = [v.ids(tox.words_of(t)) for t in ("the cat and of", "der Hund und die", "le chat et qui", "el gato y los", "zzz")]
    docs = np.repeat(np.arange(5), [len(i) for i in ids])
    got = tox.languages(np.array(v.marks)[np.concatenate(ids)], docs, 5)
    assert [tox.LANGUAGES[k] for k in got] == ["en", "de", "fr", "es", "other"]


def plain_score(model, text):
    """The forward pass of one text, window by window."""
    words = tox.words_of(text)
    embed = [sum((model.embed[b].astype(float) for b in tox.features(w)), np.zeros(tox.DIM)) for w in words]
    embed += [np.zeros(tox.DIM)] * tox.GAP + [np.zeros(tox.DIM)]  # what follows a document
    pooled = []
    for f, bias, width in zip(model.filters, model.bias, tox.WIDTHS):
        for j in range(tox.FILTERS):
            best = max(np.concatenate(embed[k : k + width]) @ f[:, j].astype(float) + bias[j] for k in range(len(embed) - width + 1))
            pooled.append(max(best, 0.0))
    z = float(np.dot(pooled, model.out.astype(float)) + model.base)
    counts = [sum(w in words_in.split() for w in words) for words_in in tox.FUNCTION_WORDS.values()]
    lang = counts.index(max(counts)) if max(counts) else len(counts)
    z = min(30, max(-30, z - model.threshold[lang] + np.log(tox.THRESHOLD / (1 - tox.THRESHOLD))))
    return 1 / (1 + np.exp(-z))


def test_scores_against_a_plain_forward_pass():
    rows = made(300, 5)
    model = tox.train((t, y) for _, t, y in rows)
    texts = [t for _, t, _ in made(80, 6)] + [None, "", "clown", "der clown und", "zzz " * 50]
    assert np.allclose(tox.Scorer(model)(texts), [plain_score(model, t) for t in texts], atol=1e-4)


def test_training_lowers_the_loss():
    rows = made(400, 9)
    y = np.array([r[2] for r in rows])
    loss = []
    for epochs in (0, 1, 5):
        z = np.log((p := np.clip(tox.Scorer(tox.train(((t, y) for _, t, y in rows), epochs=epochs))([t for _, t, _ in rows]), 1e-6, 1 - 1e-6)) / (1 - p))
        pairs = z[y == 1][:, None] - z[y == 0][None, :]
        loss.append(float((pairs <= 0).mean()))
    assert loss[0] > loss[1] >= loss[2] and loss[2] < 0.02


def test_every_labelled_document_teaches(spark):
    """Of 3,300 toxic documents the 300 with the greatest hash of the id, and no other, have a word of their own."""
    rnd = random.Random(11)
    ids = [r.id for r in spark.range(8000).where(tox.fold("id") != 1).selectExpr("id", "xxhash64(id) AS h").orderBy("h").collect()]
    toxic, clean = ids[:3300], ids[3300:]
    word = dict.fromkeys(toxic[:3000], "clown") | dict.fromkeys(toxic[3000:], "vequeu")
    rows = [(i, " ".join([*rnd.choices("erth onst and of to in is".split(), k=6), word.get(i, "that")]), int(i in word)) for i in ids]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    assert len(clean) > 1500
    scorer = tox.Scorer(tox.fit(df, labels))
    made_like = lambda last: [" ".join([*rnd.choices("erth onst and of to in is".split(), k=6), last]) for _ in range(50)]
    assert [int((scorer(made_like(w)) >= tox.THRESHOLD).sum()) for w in ("vequeu", "clown", "that")] == [50, 50, 0]


def test_shards(spark):
    """Models of shards, put together, are as good as one, and do not depend on how the rows are laid out."""
    rows = made(1500, 13)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    a = tox.fit(df.repartition(1), labels.repartition(5), shard_rows=250)
    b = tox.fit(df.repartition(7), labels, shard_rows=250)
    assert np.array_equal(a.embed, b.embed) and np.array_equal(a.threshold, b.threshold) and all(np.array_equal(x, y) for x, y in zip(a.filters, b.filters))
    held = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    called = tox.Scorer(a)([t for t, _ in held]) >= tox.THRESHOLD
    assert (called != np.array([y for _, y in held])).sum() <= 5


def test_cut_of_counts():
    rnd = np.random.default_rng(3)
    z, y = np.round(rnd.normal(0, 2, 500) * 8) / 8, (rnd.random(500) < 0.3).astype(int)
    z[y == 1] += 2
    counts = {}
    for k in zip(z.tolist(), y.tolist()):
        counts[k] = counts.get(k, 0) + 1
    cz, cy, n = np.array([k[0] for k in counts]), np.array([k[1] for k in counts]), np.array(list(counts.values()))
    assert tox.best_cut(cz, cy, n) == tox.best_cut(z, y)
    assert tox.best_cut(np.array([0.0, 0.5]), np.array([0, 1]), np.array([9, 2]), 0.5) == 0.5


def test_training_brings_no_text_to_the_driver(spark, monkeypatch):
    rows = made(200, 17)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    brought = []
    for name in ("collect", "toLocalIterator", "toArrow", "toPandas", "take", "head"):
        monkeypatch.setattr(type(df), name, lambda self, *a, f=getattr(type(df), name), **b: (brought.append(self.columns), f(self, *a, **b))[1])
    tox.fit(df, labels)
    assert brought and not any("text" in columns for columns in brought)
