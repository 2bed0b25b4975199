"""Secret scans: candidates by pattern, false positives removed by a random forest trained in numpy.

The forest sees how long a candidate is, how its characters follow one another, how much of it dictionary words cover,
whether it stands in a path, and which words are its neighbours. It is trained from labelled findings: a table of
(before, candidate, after, label). findings() makes the table that the queries use, by rule and with a fixed seed, as
the tables hold no such labels; any other may be given instead.
"""

from __future__ import annotations

import math
import random
import re
import string
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from arborlake.llm.common import let_go, map_slices, read, small_batches

#: A run of 16 and more key characters with a digit in it, or of 16 and more capitals and digits.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*[0-9]|[A-Z0-9]{16,})[A-Za-z0-9_+/-]{16,}={0,2}")
#: Letters of both cases without a digit.
LETTERS = re.compile(r"(?<![A-Za-z0-9_+/-])(?=[a-z]*[A-Z])(?=[A-Z]*[a-z])[A-Za-z]{20,}(?![A-Za-z0-9_+/-])")
#: What is given to a name that tells of a secret, in quotes or up to white space.
GIVEN = re.compile(
    r"""(?i:(?<![a-z])(?:password|passwd|pwd|passphrase|secret|token|credential|auth|(?:api|access|private|secret|auth)[_-]?key)["']?[ \t]*(?::|=>|=)[ \t]*)(?:"([^"\n]{6,})"|'([^'\n]{6,})'|([^\s"'<>,;]{6,}))"""
)
#: Three parts of base64 of which the first opens an object, and a private key with its armour.
DOTTED = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}(?:\.[A-Za-z0-9_-]*)?")
ARMOURED = re.compile(r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----[^-]*-----END \1PRIVATE KEY-----")
CONTEXT = 48
THRESHOLD = 0.5
MASK = "[SECRET]"
# Words that tell secrets, and that tell other long strings.
TELLING = frozenset("password passwd pwd secret token key apikey api auth bearer credential credentials access private passphrase login aws".split())
OTHERWISE = frozenset("commit sha md5 sha1 sha256 hash checksum digest uuid guid id revision version etag integrity href src path file image example placeholder sample doc docs page isbn order invoice ticket build".split())
DICTIONARY = frozenset(
    "about access account action address admin after agent alpha also android apache apple application archive article asset author average back background base beta blog board book branch browser build button cache category center change channel chapter check city class client cloud code collection color column comment commit common company component config content control copy country course create current data database date debug default delete demo design detail develop device dialog digital direct document domain download draft draw edit editor email empty engine english error event example export false feature field figure file final first folder font form format forum frame free friend from full function game general global group guide handler head header health help hidden history home hotel house icon image import index info input install item java journal just label language large last layout level library license light line link linux list load local location login logo long main manager mark market media member memory menu message method micro mobile model module month more move music name network news next node note null number object office online open option order other output package page panel parent part pass patch path phone photo picture place plan player plugin point policy popup post power press price print private process product profile program project public query question quick random read record release remote report request resource response result return review right root round sample scale school script search section secure select server service session setting share shop short show side simple site size small social software source space special spring stack start state static status store story stream string style subject submit summary support system table target task team template test text theme thread time title today token tool topic total track travel tree true type under unit update upload user value version video view visit water web week white width window with word work world write year zone".split()
)
LONGEST_WORD = max(map(len, DICTIONARY))
WORDS = re.compile(r"[A-Za-z]+")


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of what may be a secret, in order; of those that overlap the first, and of these the longest."""
    found = [m.span() for m in CANDIDATE.finditer(text)] + [m.span() for m in LETTERS.finditer(text)]
    for m in GIVEN.finditer(text):
        a, b = m.span(m.lastindex)
        if m.lastindex == 3:
            b = a + len(m[3].rstrip(".:!?)]}"))
        if b - a >= 6:
            found.append((a, b))
    if "eyJ" in text:
        found += [m.span() for m in DOTTED.finditer(text)]
    if "-----BEGIN" in text:
        found += [m.span() for m in ARMOURED.finditer(text)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


@lru_cache(maxsize=1)
def _pairs() -> dict[str, float]:
    """Log frequency of letter pairs in the dictionary, as a measure of how speakable a run is."""
    count: dict[str, int] = {}
    for w in DICTIONARY:
        for a, b in zip(w, w[1:]):
            count[a + b] = count.get(a + b, 0) + 1
    total = sum(count.values())
    return {p: math.log(n / total * 676) for p, n in count.items()}


def coverage(s: str) -> float:
    """The share of characters that dictionary words of four letters and more cover, taken greedily from the left."""
    low, at, n = s.lower(), 0, 0
    while at < len(low):
        for m in range(min(LONGEST_WORD, len(low) - at), 3, -1):
            if low[at : at + m] in DICTIONARY:
                n += m
                at += m
                break
        else:
            at += 1
    return n / max(1, len(s))


def features(before: str, candidate: str, after: str) -> list[float]:
    """before and after: up to CONTEXT characters of the text on either side."""
    n = len(candidate)
    kinds = [_kind(c) for c in candidate]
    share = [kinds.count(k) / n for k in range(4)]
    moves = [[0] * 4 for _ in range(4)]
    for a, b in zip(kinds, kinds[1:]):
        moves[a][b] += 1
    m = max(1, n - 1)
    counts = [candidate.count(c) / n for c in set(candidate)]
    pairs = _pairs()
    low = candidate.lower()
    letters = [pairs.get(a + b, -3.0) for a, b in zip(low, low[1:]) if a.isalpha() and b.isalpha()]
    left = WORDS.findall(before.lower())[-3:]
    right = WORDS.findall(after.lower())[:2]
    tail = before.rstrip(" \"'`")[-1:]
    return [
        n,
        *share,
        sum(kinds[k] != kinds[k + 1] for k in range(n - 1)) / m,
        (moves[0][2] + moves[2][0]) / m,
        (moves[1][2] + moves[2][1]) / m,
        (moves[0][1] + moves[1][0]) / m,
        -sum(p * math.log2(p) for p in counts),
        sum(letters) / len(letters) if letters else 0.0,
        float(all(c in "0123456789abcdef" for c in candidate)),
        float(all(c in "0123456789ABCDEF" for c in candidate)),
        coverage(candidate),
        candidate.count("/") + candidate.count("-") + candidate.count("_"),
        float(before[-1:] in ("/", ".", "#", "?", "&") or after[:1] in ("/", ".")),
        float("://" in before[-CONTEXT:] and " " not in before[before.rfind("://") :]),
        float(tail in ("=", ":") and tail != ""),
        float(any(w in TELLING for w in left)),
        float(any(w in OTHERWISE for w in left) or any(w in OTHERWISE for w in right)),
        float(candidate.startswith(("AKIA", "ASIA", "ghp_", "gho_", "sk_", "sk-", "xox", "AIza", "eyJ"))),
        float(candidate.startswith("-----BEGIN")),
        candidate.count(" ") + candidate.count("."),
        len(set(kinds)),
    ]


class Forest:
    """Trees of thresholds on features, grown on bootstrap samples; the score is the mean of the leaves' shares."""

    def __init__(self, n_trees: int = 24, depth: int = 8, least: int = 3, seed: int = 11):
        self.n_trees, self.depth, self.least, self.seed = n_trees, depth, least, seed
        self.trees: list[tuple[np.ndarray, ...]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rnd = np.random.default_rng(self.seed)
        tried = max(1, int(round(math.sqrt(x.shape[1]))))
        for _ in range(self.n_trees):
            own = rnd.integers(0, len(x), len(x))
            self.trees.append(self._grow(x[own], y[own].astype(float), tried, rnd))
        return self

    def _grow(self, x, y, tried, rnd):
        feature, cut, low, high, value = [], [], [], [], []
        todo = [(np.arange(len(x)), 0, None, 0)]
        while todo:
            rows, depth, parent, side = todo.pop()
            node = len(feature)
            if parent is not None:
                (high if side else low)[parent] = node
            feature.append(-1)
            cut.append(0.0)
            low.append(-1)
            high.append(-1)
            value.append(float(y[rows].mean()) if len(rows) else 0.0)
            if depth == self.depth or len(rows) < 2 * self.least or value[-1] in (0.0, 1.0):
                continue
            best = None
            for f in rnd.permutation(x.shape[1])[: 2 * tried]:
                order = np.argsort(x[rows, f], kind="stable")
                v, t = x[rows, f][order], y[rows][order]
                can = np.flatnonzero(v[:-1] < v[1:]) + 1
                can = can[(can >= self.least) & (can <= len(rows) - self.least)]
                if not len(can):
                    continue
                total = np.cumsum(t)
                a, b = total[can - 1], total[-1] - total[can - 1]
                gini = a * (1 - a / can) + b * (1 - b / (len(rows) - can))
                k = int(np.argmin(gini))
                if best is None or gini[k] < best[0]:
                    best = gini[k], f, (v[can[k] - 1] + v[can[k]]) / 2
            if best is None:
                continue
            feature[node], cut[node] = int(best[1]), float(best[2])
            under = x[rows, best[1]] <= best[2]
            todo += [(rows[~under], depth + 1, node, 1), (rows[under], depth + 1, node, 0)]
        return np.array(feature), np.array(cut), np.array(low), np.array(high), np.array(value)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for feature, cut, low, high, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                under = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at]
                at = np.where(inner, np.where(under, low[at], high[at]), at)
            out += value[at]
        return out / max(1, len(self.trees))


def findings(n: int = 5000, seed: int = 5) -> list[tuple[str, str, str, int]]:
    """(before, candidate, after, label): labelled findings made by rule. 1: a secret."""
    rnd = random.Random(seed)
    hexa, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    words = sorted(DICTIONARY)
    prose = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    run = lambda pool, k: "".join(rnd.choice(pool) for _ in range(k))
    out = []
    while len(out) < n:
        kind = rnd.randrange(24)
        a, b = prose(rnd.randint(0, 5)), prose(rnd.randint(0, 4))
        name = rnd.choice(sorted(TELLING))
        sep = rnd.choice(["=", ": ", " = ", ' = "', "='", " "])
        other = rnd.choice(sorted(OTHERWISE))
        if kind == 0:
            c, label, a = run(hexa, rnd.choice([16, 18, 24, 32, 40, 64])), 1, f"{a} {name}{sep}"
        elif kind == 1:
            c, label, a = run(alnum, rnd.randint(16, 48)), 1, f"{a} {name}{sep}"
        elif kind == 2:
            c, label = rnd.choice(["AKIA", "ASIA"]) + run(string.ascii_uppercase + string.digits, 16), 1
            a += rnd.choice([" ", " key ", " = "])
        elif kind == 3:
            c, label, a = rnd.choice(["ghp_", "gho_", "xoxb-", "sk_live_"]) + run(alnum, rnd.randint(24, 36)), 1, a + " "
        elif kind == 4:
            c, label, a = run(alnum + "+/", rnd.choice([22, 38, 42])) + rnd.choice(["", "=", "=="]), 1, f"{a} {name}{sep}"
        elif kind == 5:
            c, label, a = run(alnum, 39), 1, f'{a} {rnd.choice(["api key", "access token", "auth"])}{sep}'
        elif kind == 6:
            c, label, a = run(hexa, rnd.choice([16, 32, 40, 64])), 0, f"{a} {other} "
        elif kind == 7:
            c, label, a = str(uuid.UUID(int=rnd.getrandbits(128))), 0, f"{a} {rnd.choice(['id', 'uuid', 'order', ''])} "
        elif kind == 8:
            c, label, a = "/".join(rnd.choice(words) + rnd.choice(["", str(rnd.randrange(99))]) for _ in range(rnd.randint(3, 6))) + str(rnd.randrange(9)), 0, f"{a} {rnd.choice(['http://x.example.org/', './', 'path ', ''])}"
        elif kind == 9:
            c, label, a = rnd.choice("_-").join(rnd.choice(words) for _ in range(rnd.randint(3, 5))) + str(rnd.randrange(2050)), 0, f"{a} {rnd.choice(['', name + ' ', 'version '])}"
        elif kind == 10:
            c, label, a = "".join(rnd.choice(words).capitalize() for _ in range(rnd.randint(3, 5))) + str(rnd.randrange(100)), 0, f"{a} "
        elif kind == 11:
            c, label, a = run("0123456789", rnd.randint(16, 24)), 0, f"{a} {rnd.choice(['order', 'invoice', 'isbn', ''])} "
        elif kind == 12:
            c, label, a = "".join(rnd.choice(words) for _ in range(4)).upper() + rnd.choice(["", "2"]), 0, f"{a} "
        elif kind in (13, 14):  # made up by people: a word, digits and signs
            c = rnd.choice([run(alnum, rnd.randint(5, 9)), rnd.choice(words).capitalize() + run("0123456789", rnd.randint(1, 4)), run(string.ascii_letters, 4) + rnd.choice(words)])
            at = rnd.randrange(1, len(c) + 1)
            c, label, a = c[:at] + run("!@#$%^&*?+", rnd.randint(1, 2)) + c[at:] + run("0123456789", rnd.randint(1, 3)), 1, f"{a} {name}{rnd.choice(['=', ': ', ' = ', ' = ' + chr(34)])}"
        elif kind == 15:
            c, label, a = ".".join(p + run(alnum + "_-", rnd.randint(16, 60)) for p in ("eyJ", "eyJ", "")), 1, f"{a} {rnd.choice([name + sep, 'Bearer ', ''])}"
        elif kind == 16:
            armour = rnd.choice(["", "RSA ", "EC ", "OPENSSH "]) + "PRIVATE KEY-----"
            c, label = f"-----BEGIN {armour}\n" + "\n".join(run(alnum + "+/", 64) for _ in range(rnd.randint(2, 5))) + f"\n-----END {armour}", 1
        elif kind == 17:
            c, label, a = run(string.ascii_letters, rnd.randint(20, 48)), 1, f"{a} {name}{sep}"
        elif kind == 18:  # what stands for a secret, or tells of one
            c = rnd.choice([rnd.choice(words), rnd.choice(words) + rnd.choice("_-. ") + rnd.choice(words), "YOUR_" + rnd.choice(words).upper(), "${" + rnd.choice(words).upper() + "}", "*" * rnd.randint(6, 12), "x" * rnd.randint(6, 12), "os.environ[" + rnd.choice(words), rnd.choice(["required", "undefined", "optional", "changeme", "string", "getToken()", "process.env.TOKEN", "user.password", "self.secret"])])
            label, a = 0, f"{a} {name}{rnd.choice(['=', ': ', ' = ', ' = ' + chr(34)])}"
        elif kind == 19:
            c, label, a = "".join(rnd.choice(words).capitalize() for _ in range(rnd.randint(4, 6))), 0, f"{a} {rnd.choice(['', 'class ', 'import ', name + ' '])}"
        elif kind in (22, 23):  # words of no dictionary, shouted or run together
            spoken = ["".join(rnd.choice("bcdfghklmnprstvwz") + rnd.choice(["a", "e", "i", "o", "u", "ei", "au", "io"]) + rnd.choice(["", "", "n", "r", "s", "t", "ch", "ng", "st"]) for _ in range(rnd.randint(2, 4))) for _ in range(4)]
            c, label, a = ("".join(spoken).upper() if kind == 22 else "".join(w.capitalize() for w in spoken)), 0, f"{a} {rnd.choice(['', '', name + ' '])}"
        elif kind == 20:
            c, label, a = " ".join(rnd.choice(words) for _ in range(rnd.randint(2, 6))), 0, f"{a} {name}{rnd.choice([': ', ' = ' + chr(34)])}"
        else:
            c, label, a = f"{rnd.choice(words)}-{rnd.randrange(2000, 2030)}-{rnd.randrange(10, 13)}-{rnd.randrange(10, 29)}-{rnd.choice(words)}", 0, f"{a} {rnd.choice(['file ', 'page ', name + ' '])}"
        if len(c) >= 6:
            close = '"' if a.endswith('"') else "'" if a.endswith("'") else ""
            out.append((a[-CONTEXT:], c, f"{close} {b}"[:CONTEXT], label))
    return out


def train(labelled: list[tuple[str, str, str, int]] | None = None) -> Forest:
    rows = findings() if labelled is None else labelled
    return Forest().fit(np.array([features(a, c, b) for a, c, b, _ in rows]), np.array([y for *_, y in rows]))


def spans(texts: list[str | None], forest: Forest) -> list[tuple[int, list[tuple[int, int, float]]]]:
    """For each text the number of candidates, and (start, end, score) of those that the forest takes for secrets."""
    where, rows = [], []
    n = [0] * len(texts)
    for k, t in enumerate(texts):
        for a, b in candidates(t or ""):
            n[k] += 1
            where.append((k, a, b))
            rows.append(features(t[max(0, a - CONTEXT) : a], t[a:b], t[b : b + CONTEXT]))
    out: list[tuple[int, list]] = [(c, []) for c in n]
    if rows:
        for (k, a, b), s in zip(where, forest.score(np.array(rows)).tolist()):
            if s >= THRESHOLD:
                out[k][1].append((a, b, s))
    return out


def redacted(text: str | None, found: list[tuple[int, int, float]]) -> str | None:
    if not found:
        return text
    out, at = [], 0
    for a, b, _ in found:
        out += [text[at:a], MASK]
        at = b
    return "".join([*out, text[at:]])


def scan(df: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_candidates, secrets, redacted) for every row, over whole texts.

    secrets: start, end and score, offsets in code points. Null texts have no secrets and stay null. Repeated rows and
    null ids give one row each.
    """
    sent = df.sparkSession.sparkContext.broadcast(forest)

    def make():
        def f(ids, texts):
            got = spans(texts, sent.value)
            return [ids, [n for n, _ in got], [[{"start": a, "end": b, "score": s} for a, b, s in found] for _, found in got], [redacted(t, found) for t, (_, found) in zip(texts, got)]]

        return f

    kind = df.schema[id_col].dataType.simpleString()
    return map_slices(df, [id_col, text_col], make, f"`{id_col}` {kind}, n_candidates bigint, secrets array<struct<start:int,end:int,score:double>>, redacted string")


def redact(docs: DataFrame, forest: Forest, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with all columns, each secret in the text masked and the length column, if there is one, set anew.

    Null texts stay null, and rows without a secret as they are; repeated rows stay. Other columns may have any name.
    """
    sent = docs.sparkSession.sparkContext.broadcast(forest)
    arrow = to_arrow_schema(docs.schema)
    at = docs.columns.index(text_col)
    size = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches):
        let_go()
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                texts = part.column(at).to_pylist()
                got = [found for _, found in spans(texts, sent.value)]
                columns = [c.cast(x.type) for c, x in zip(part.columns, arrow)]
                if any(got):
                    clean = [redacted(t, found) for t, found in zip(texts, got)]
                    columns[at] = pa.array(clean, arrow.field(at).type)
                    if size is not None:
                        columns[size] = pa.array([len(c) if found else old for c, found, old in zip(clean, got, columns[size].to_pylist())], arrow.field(size).type)
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return small_batches(docs).mapInArrow(run, docs.schema)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"), train())
    places = F.transform("secrets", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string")))
    return found.select("doc_id", "n_candidates", F.size("secrets").cast("bigint").alias("n_secrets"), F.array_join(places, ";").alias("spans"), F.sha2(F.coalesce("redacted", F.lit("")).cast("binary"), 256).alias("redacted_sha256"))
