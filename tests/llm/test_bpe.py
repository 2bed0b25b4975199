import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from arborlake.llm import bpe

PATH = bpe.vocabulary_path()
LIB = Tokenizer.from_file(PATH)
LIB.no_truncation()
LIB.no_padding()
OWN = bpe.load(PATH)

TEXTS = [
    "", " ", "Hello, World's best 123 tokens!!", "ŒUVRE naïve Ärger STRASSE ß", "ΟΔΥΣΣΕΥΣ ΣΑΣ İstanbul", "a<|endoftext|>b <|startoftext|>", "<|endoftext|",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "日本語のテキスト 한국어 🙂🙂 👩‍👩‍👧", "été   x", "don't I'LL we've 'S", "https://x.example.com/a_b?c=1&d=%20", "\x00\x01\x7f", "x" * 3000,
    "hahahaha hahahahahahaha lololol", "isnt thethethe andandand ingingingtioning",
]


@pytest.mark.parametrize("text", TEXTS)
def test_as_the_library(text):
    want = LIB.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text) == want
    assert OWN.decode(want) == LIB.decode(want, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet="abcdehinorstu 'AE", max_size=60), st.text(alphabet=st.characters(codec="utf-8", exclude_categories=["Cn", "Co"], max_codepoint=0x2FFF), max_size=20)))
def test_as_the_library_on_any_text(text):
    assert OWN.encode(text) == LIB.encode(text, add_special_tokens=False).ids


def brute(merges, word):
    parts = list(word)
    for a, b in merges:
        out, i = [], 0
        while i < len(parts):
            if parts[i : i + 2] == [a, b]:
                out.append(a + b)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_gadgets_against_merging(data):
    known, merges = list("abc"), []
    for _ in range(data.draw(st.integers(0, 14))):
        a, b = data.draw(st.sampled_from(known)), data.draw(st.sampled_from(known))
        if a + b not in known:
            known.append(a + b)
            merges.append((a, b))
    vocab = {t: i for i, t in enumerate(known)}
    auto = bpe.Automaton(vocab, merges, "")
    word = data.draw(st.text("abc", max_size=14))
    assert [known[i] for i in auto.encode(list(word))] == brute(merges, word)


def test_rows(spark):
    rows = [(1, "The cat"), (1, "The cat"), (2, None), (3, ""), (None, "x"), (4, "word " * 5000)]
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id bigint, text string, n_tokens string")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(df).collect()}
    want = set()
    for i, t in rows:
        ids = LIB.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want
    assert bpe.encode_digests(df).count() == 6
    assert bpe.encode_digests(df.limit(0)).count() == 0
    full = {r.doc_id: r for r in bpe.encode_texts(df.where("doc_id = 4")).collect()}
    assert full[4].token_ids == LIB.encode("word " * 5000, add_special_tokens=False).ids


def test_table_and_words_that_start_anew(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_STATES", 20)
    small = bpe.Words(OWN.word, 6)
    words = [w for w in "the cat sat on the mat while thirteen other cats were sitting on other mats the end".split()] * 3
    assert [list(small[w]) for w in words] == [LIB.encode(w, add_special_tokens=False).ids for w in words]
    assert len(small) <= 6 and len(small.elder) <= 6
    OWN.automaton.empty()


def test_table_is_deterministic():
    """A row has one entry a symbol, and what ends there is the last token of the prefix."""
    OWN.automaton.empty()
    for w in ["thethethinging", "hahahahahaha", "internationalization"]:
        OWN.automaton.run(w[:-1], w[-1] + OWN.automaton.suffix)
        row = OWN.automaton.first
        for k, c in enumerate(w[:-1]):
            row = row[c]
            assert row[OWN.automaton.ENDED] == OWN.automaton.encode(list(w[: k + 1]))[-1]
