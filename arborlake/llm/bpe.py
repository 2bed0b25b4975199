"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens and accepts exactly the sequences that merging yields. It starts as one state with a
loop for each symbol; each merge (u, v), in order of rank, adds one gadget: wherever u then v could be read, an arc
for the merged token is added, and the state behind u loses its arc v. A state depends on the last token alone, so
states are named by tokens, and their arcs are held as the set of arcs lost, with the rank at which each went. That
keeps it as small as the merge list.

For words of symbols it is made deterministic: a state there is the set of arcs that are being read, each with how far
into its label, and a transition says which token ends at the symbol. There is one, as each prefix of a word has one
tokenization. Its table is filled where it is first read and bounded, like that of other subset constructions. A word
is encoded by one transition a symbol, and by going back over the tokens that ended. Decoding emits the labels of the
arcs.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from itertools import chain

import regex
from pyspark.sql import DataFrame, SparkSession

from arborlake.llm.common import kept, map_slices, read

#: Words that a task keeps with their ids. States of the table, which starts anew beyond them. Bounds of memory only.
CACHED_WORDS, MOST_STATES = 150_000, 200_000


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class Automaton:
    """Gadgets by merges, and the table of the deterministic automaton over symbols."""

    START = -1
    #: Keys of a row that are no symbols.
    ENDED, STATE = "", "  "

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.suffix = suffix
        self.label = {i: t for t, i in vocab.items()}
        most = max(vocab.values(), default=0) + 1
        self.lost: dict[int, int] = {}  # u, v in one number: the rank of the gadget that took arc v from the state behind u
        self.left, self.right = array("i", [-1]) * most, array("i", [-1]) * most  # the parts of a merged token
        self.rank = array("i", [0]) * most
        spelled: dict[int, tuple[str, ...]] = {}  # the symbols of a merged token
        dead = set()
        for rank, (a, b) in enumerate(merges):
            u, v, uv = vocab[a], vocab[b], vocab[a + b]
            if uv in spelled:
                raise ValueError("two merges make one token; the gadgets need one each")
            spelled[uv] = spelled.get(u, (a,)) + spelled.get(v, (b,))
            if u in dead or v in dead or not self.opens(u, v, rank):
                dead.add(uv)  # no path u, v is left when this gadget's turn comes, so no arc arises
            self.lost[u << 32 | v] = rank
            self.left[uv], self.right[uv], self.rank[uv] = u, v, rank
        self.arcs = {t: i for t, i in vocab.items() if i not in dead}
        self.length = array("i", [0]) * most
        leaf: dict[str, int] = {}
        self.inside: list[dict[str, int]] = [{}]  # the places inside labels: where a symbol leads
        self.ends = array("i", [-1])  # the token whose label ends there
        for t, i in self.arcs.items():
            symbols = spelled.get(i, (t,))
            self.length[i] = len(symbols)
            at = 0
            for c in symbols:
                if (to := self.inside[at].get(c)) is None:
                    to = len(self.inside)
                    if self.inside[at] is leaf:
                        self.inside[at] = {}
                    self.inside[at][c] = to
                    self.inside.append(leaf)
                    self.ends.append(-1)
                at = to
            self.ends[at] = i
        self.empty()

    def empty(self) -> None:
        """The table with its first row: behind no token, inside no label.

        A row is {symbol: the next row}, under ENDED the token that ends there, and under STATE what it stands for: the
        arcs that are being read, each a token and a place inside the label behind it, as one number.
        """
        start = array("q", [self.START << 32]).tobytes()
        self.first: dict = {self.STATE: start}
        self.rows: dict[bytes, dict] = {start: self.first}

    def opens(self, u: int, v: int, before: int | None = None) -> bool:
        """Whether arc v leaves the state behind u once all gadgets (or those before a rank) are in place.

        The state behind u is a copy of the one behind u's right part, taken at u's rank; an arc for v came from
        one for v's left part, present at v's rank. So an arc lost along either spine counts if it went in time.
        """
        lost, left, right, rank = self.lost, self.left, self.right, self.rank
        most = len(rank) if before is None else before
        x, until_x = u, most
        while True:
            y, until_y = v, most
            row = x << 32
            while True:
                gone = lost.get(row | y)
                if gone is not None and gone < until_x and (gone < most if y == v else gone <= until_y):
                    return False
                if left[y] < 0:
                    break
                y, until_y = left[y], rank[y]
            if right[x] < 0:
                return True
            x, until_x = right[x], rank[x]

    def _fill(self, row: dict, symbol: str) -> dict:
        """The row behind a symbol; a new entry of the table."""
        out, ended, inside = [], None, self.inside
        for read in memoryview(row[self.STATE]).cast("q"):
            token = read >> 32
            to = inside[read & 0xFFFFFFFF].get(symbol)
            if to is None:
                continue
            if inside[to]:
                out.append(token << 32 | to)
            here = self.ends[to]
            if here >= 0 and ended is None and (token < 0 or self.opens(token, here)):
                ended = here
        out.append(ended << 32)
        key = array("q", out).tobytes()
        if (to := self.rows.get(key)) is None:
            to = self.rows[key] = {self.STATE: key, self.ENDED: ended}
        row[symbol] = to
        return to

    def encode(self, symbols: list[str]) -> list[int]:
        """The ids of a word given as symbols, the last of which may be longer than one character.

        Symbols outside the vocabulary are skipped.
        """
        if any(s not in self.arcs for s in symbols):
            symbols = [s for s in symbols if s in self.arcs]
        return self.run(symbols[:-1], symbols[-1]) if symbols else []

    def run(self, symbols, last: str) -> list[int]:
        """The same for symbols that the vocabulary has: a string or list of them, and the last one."""
        if len(self.rows) > MOST_STATES:
            self.empty()
        row, passed = self.first, []
        for c in symbols:
            try:
                row = row[c]
            except KeyError:
                row = self._fill(row, c)
            passed.append(row)
        passed.append(row.get(last) or self._fill(row, last))
        out, at, ended, length = [], len(passed), self.ENDED, self.length
        while at:
            token = passed[at - 1][ended]
            out.append(token)
            at -= length[token]
        out.reverse()
        return out


class Words(dict):
    """The ids of words, found as they are asked for. Of two generations the elder goes when the younger is full."""

    def __init__(self, find, most: int):
        super().__init__()
        self.find, self.most, self.elder = find, most, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        got = self.elder.get(word)
        if got is None:
            got = tuple(self.find(word))
        if len(self) >= self.most // 2:
            self.elder = dict(self)
            self.clear()
        self[word] = got
        return got

    def forget(self) -> None:
        self.elder = {}
        self.clear()


class WordBpe:
    """A tokenizer file whose words are lower-cased, split by its pattern and closed by an end-of-word mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None or model["unk_token"] is not None:
            raise ValueError(f"{path}: not a file of the kind that is encoded here")
        merges = [tuple(m if isinstance(m, list) else m.split(" ", 1)) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"])
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.symbols = byte_symbols()
        suffix = self.automaton.suffix
        self.whole = all(s in self.automaton.arcs and s + suffix in self.automaton.arcs for s in self.symbols)
        labels = self.automaton.label | {i: t for t, i in self.special.items()}
        self.label = [labels.get(i) for i in range(max(labels) + 1)]
        self.decimal = [str(i) for i in range(len(self.label))]
        self.words = Words(self.word, CACHED_WORDS)

    def word(self, w: str) -> list[int]:
        """A split word's ids."""
        suffix = self.automaton.suffix
        if w.isascii() and w.isprintable() and self.whole:
            return self.automaton.run(w[:-1], w[-1] + suffix)  # each byte is its own symbol
        s = [self.symbols[b] for b in w.encode("utf-8")]
        s[-1] += suffix
        return self.automaton.encode(s)

    def encode(self, text: str) -> list[int]:
        """The ids of the whole text, special tokens included."""
        if self.special_split is not None and "<" in text:
            spans = self.special_split.split(text)
        else:
            spans = [text]
        out: list[int] = []
        for k, span in enumerate(spans):
            if k % 2:
                out.append(self.special[span])
            elif span:
                if not span.isascii():
                    # each capital sigma alone, as the library lower-cases character by character
                    span = unicodedata.normalize("NFC", span).replace("Σ", "σ")
                out.extend(chain.from_iterable(map(self.words.__getitem__, self.pattern.findall(span.lower()))))
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.label[i] for i in ids if 0 <= i < len(self.label) and self.label[i] is not None])

    def digests(self, ids: list[int]) -> tuple[str, str]:
        """SHA-256 of own ids in decimal and of their labels, both joined by spaces."""
        return tuple(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode("utf-8")).hexdigest() for names in (self.decimal, self.label))


def load(path: str) -> WordBpe:
    return kept(("bpe", path), lambda: WordBpe(path))


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """The token ids of every whole text, and the text that they decode to.

    Null texts count as empty; empty texts have no ids and decode to the empty text. Repeated rows and null ids
    give one row each; very long texts are encoded whole. The file must be at `path` on every executor.
    """
    path = path or vocabulary_path()

    def make():
        bpe = load(path)

        def f(ids, texts):
            tokens = [bpe.encode(t or "") for t in texts]
            return [ids, tokens, [bpe.decode(t) for t in tokens]]

        f.close = bpe.words.forget  # the table stays for the next task of this operator
        return f

    kind = df.schema[id_col].dataType.simpleString()
    return map_slices(df, [id_col, text_col], make, f"`{id_col}` {kind}, token_ids array<int>, decoded string", rows=64, keeps=True)


def encode_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """encode_texts() as digests: number of ids, SHA-256 of the ids and of the decoded text."""
    path = path or vocabulary_path()

    def make():
        bpe = load(path)

        def f(ids, texts):
            tokens = [bpe.encode(t or "") for t in texts]
            return [ids, [len(t) for t in tokens], *zip(*map(bpe.digests, tokens))]

        f.close = bpe.words.forget  # the table stays for the next task of this operator
        return f

    kind = df.schema[id_col].dataType.simpleString()
    return map_slices(df, [id_col, text_col], make, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", rows=64, keeps=True)


def encode_with_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, token_ids, n_tokens, ids_sha256, decoded_sha256): encode_texts() and encode_digests() in one pass."""
    path = path or vocabulary_path()

    def make():
        bpe = load(path)

        def f(ids, texts):
            tokens = [bpe.encode(t or "") for t in texts]
            return [ids, tokens, [len(t) for t in tokens], *zip(*map(bpe.digests, tokens))]

        f.close = bpe.words.forget  # the table stays for the next task of this operator
        return f

    kind = df.schema[id_col].dataType.simpleString()
    return map_slices(df, [id_col, text_col], make, f"`{id_col}` {kind}, token_ids array<int>, n_tokens bigint, ids_sha256 string, decoded_sha256 string", rows=64, keeps=True)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(read(spark, sf_dir, "documents"))
