import hashlib
import re

import corpus_pipeline
from tokenizers import Tokenizer

from arborlake.llm import bpe, secrets, toxicity
from arborlake.llm.common import read

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contaminated(text, items):
    split = lambda t: WORD.findall((t or "").translate(LOWER))
    wins = set()
    for t in items:
        w = split(t)
        n = min(13, len(w))
        wins |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1 if n else 0)}
    w, hit = split(text), set()
    for n in {len(x) for x in wins}:
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in wins:
                hit |= set(range(k, k + n))
    return bool(hit) and 20 * len(hit) >= len(w)


def test_stages(spark):
    docs = read(spark, DIR, "documents")
    items = [r.text for r in read(spark, DIR, "benchmark").collect()]
    columns = docs.columns
    one = corpus_pipeline.remove_toxic(spark, docs, DIR).persist()
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, read(spark, DIR, "labels"))).collect()}
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {i for i, s in scores.items() if s < 0.7}
    two = corpus_pipeline.remove_near_copies(spark, one, DIR).persist()
    left, all_one = {r.doc_id: r.text for r in two.collect()}, {r.doc_id: r.text for r in one.collect()}
    assert two.columns == columns and set(left) <= set(all_one)
    assert len(set(left.values())) == len(left)
    cuts = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    kept = {i: cuts(t) for i, t in left.items()}
    for i, t in all_one.items():
        if i not in left:  # each that went has something much alike, of a smaller id
            own = cuts(t)
            assert any(j < i and len(own & s) >= 0.6 * len(own | s) for j, s in kept.items())
    three = corpus_pipeline.remove_contaminated(spark, two, DIR).persist()
    assert three.columns == columns and {r.doc_id for r in three.collect()} == {i for i, t in left.items() if not contaminated(t, items)}
    four = corpus_pipeline.mask_secrets(spark, three, DIR).persist()
    assert four.columns == columns and four.count() == three.count()
    forest = secrets.train()
    for r in four.collect():
        assert r.text == secrets.redacted(left[r.doc_id], secrets.spans([left[r.doc_id]], forest)[0][1]) and r.n_chars == len(r.text)
    lib = Tokenizer.from_file(bpe.vocabulary_path())
    text = {r.doc_id: r.text for r in four.collect()}
    five = corpus_pipeline.encode(spark, four, DIR).collect()
    assert len(five) == len(text)
    for r in five:
        ids = lib.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.token_ids == ids and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    whole = corpus_pipeline.run(spark, DIR).collect()
    assert sorted(map(str, whole)) == sorted(map(str, five))


NAMES = "gone _gone gone_id gone_th own_th row id key items words n th fp k a b t h s at text_ span held_out score predicted".split()
ODD = [(1, None, "en", "s", None), (2, "", None, None, 0), (None, "x", "en", "s", 1), (3, "word " * 30000, "en", "s", 5), (3, "word " * 30000, "en", "s", 5), (3, "other words", None, "s", None), (None, None, None, None, None)]


def test_odd_documents(spark):
    """Nulls in any column, empty and very long texts, repeated rows and ids, columns of any name, an empty table."""
    df = spark.createDataFrame([(*r, *range(len(NAMES))) for r in ODD], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} int" for n in NAMES))
    plain = lambda rows: sorted(map(str, {(r.doc_id, r.text) for r in rows}))
    every = df.collect()
    want = {
        "toxicity": every,
        "near_dedup": [every[0], *every[2:4], every[5]],  # null and empty texts are one group, rows of one id and text one document
        "decontamination": every,
        "secrets": every,
    }
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, DIR)
        if name == "bpe":
            assert out.columns[:2] == ["doc_id", "token_ids"] and out.count() == len(every)
            continue
        got = out.collect()
        assert out.columns == df.columns and len(got) == len(want[name]) and plain(got) == plain(want[name]), name
        none = stage(spark, df.limit(0), DIR)
        assert none.columns == df.columns and none.count() == 0
    rows = df
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, DIR).persist()
        rows.count()
    assert "token_ids" in rows.columns
