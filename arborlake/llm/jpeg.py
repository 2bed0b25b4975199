"""Media columns: baseline JPEG, read down to a thumbnail of the luminance's DC coefficients.

A block's DC coefficient is its mean, so decoding only these gives the picture at an eighth of its size without any
inverse transform. The same unit stores bytes without loss: a grey picture whose blocks are flat, one for each byte,
with a DC quantiser of 8 and restart markers every 24 blocks. The restarts make segments that are decoded side by
side in numpy, one table look-up for a block of all segments at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from arborlake.llm.common import map_slices, read

#: Blocks in a row of a stored picture and between two restart markers.
ROW, RESTART = 576, 24
#: Rows of blocks in one picture at most (65,528 of the format's 65,535 lines); longer payloads take several, end to end.
MOST_ROWS = 8191
#: The usual luminance DC table of the JPEG standard (codes of each length from 1 to 16; categories in order).
DC_COUNTS, DC_VALUES = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))
#: An AC table of one code, for end of block.
AC_COUNTS, AC_VALUES = bytes([1, *[0] * 15]), bytes([0])


class BadMedia(ValueError):
    """Not a baseline JPEG, or one cut short."""


def _codes(counts: bytes, values: bytes) -> dict[int, tuple[int, int]]:
    """{value: (code, length)}"""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[values[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


@lru_cache(maxsize=1)
def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """The bits and their number that store a difference of -255 .. 255 with the end of block, at difference + 255."""
    dc, (end, end_n) = _codes(DC_COUNTS, DC_VALUES), _codes(AC_COUNTS, AC_VALUES)[0]
    bits, size = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        n = abs(d).bit_length()
        code, length = dc[n]
        more = d if d >= 0 else d + (1 << n) - 1
        bits[d + 255], size[d + 255] = (code << n | more) << end_n | end, length + n + end_n
    return bits, size


def _part(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def _head(rows: int) -> bytes:
    return (
        b"\xff\xd8"
        + _part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
        + _part(0xDB, b"\0" + bytes([8] * 64))
        + _part(0xC0, struct.pack(">BHHBBBB", 8, 8 * rows, 8 * ROW, 1, 1, 0x11, 0))
        + _part(0xC4, b"\0" + DC_COUNTS + DC_VALUES)
        + _part(0xC4, b"\x10" + AC_COUNTS + AC_VALUES)
        + _part(0xDD, struct.pack(">H", RESTART))
        + _part(0xDA, b"\1\1\0\0\x3f\0")
    )


def _scans(samples: np.ndarray, rows: list[int]) -> list[bytes]:
    """The entropy-coded data of pictures of so many rows each, whose samples follow one another."""
    bits, size = _symbols()
    level = samples.reshape(-1, RESTART).astype(np.int64) - 128
    level[:, 1:] -= level[:, :-1].copy()
    level += 255
    value, length = bits[level], size[level]
    at = np.cumsum(length, axis=1)
    n_bytes = (at[:, -1] + 7) >> 3
    first = np.cumsum(n_bytes) - n_bytes
    at += (first * 8)[:, None] - length
    value, length, at = value.ravel(), length.ravel(), at.ravel()
    out = np.ones(int(n_bytes.sum()) * 8, np.uint8)
    for k in range(int(length.max())):
        if k >= int(length.min()):
            keep = length > k
            value, length, at = value[keep], length[keep], at[keep]
        out[at + k] = (value >> (length - 1 - k)) & 1
    data = np.packbits(out)
    full = data == 255
    segment = np.repeat(np.arange(len(n_bytes)), n_bytes)
    of = np.repeat(np.arange(len(rows)), np.array(rows) * (ROW // RESTART))  # picture of each segment
    start = np.searchsorted(of, np.arange(len(rows)))
    marks = np.arange(len(n_bytes)) - start[of]  # segments of the picture before it, each with a marker behind
    to = np.arange(len(data)) + np.cumsum(full) - full + 2 * (segment - of[segment])
    total = len(data) + int(full.sum()) + 2 * (len(n_bytes) - len(rows))
    stored = np.zeros(total, np.uint8)
    stored[to] = data
    heads = to[first[marks > 0]]
    stored[heads - 2] = 255
    stored[heads - 1] = 0xD0 + (marks[marks > 0] - 1) % 8
    edges = [*to[first[start]].tolist(), total]
    return [stored[a:b].tobytes() for a, b in zip(edges, edges[1:])]


def padded(data: bytes) -> bytes:
    """Bytes 255 appended up to a positive multiple of a row."""
    return data + b"\xff" * (max(ROW, -(-len(data) // ROW) * ROW) - len(data))


def store(payloads: list[bytes]) -> list[bytes]:
    """Each payload, a positive multiple of 576 bytes, as one baseline JPEG or, beyond MOST_ROWS rows, several end to end."""
    rows, owner = [], []
    for k, p in enumerate(payloads):
        if not p or len(p) % ROW:
            raise ValueError("a payload is a positive multiple of 576 bytes")
        n = len(p) // ROW
        for at in range(0, n, MOST_ROWS):
            rows.append(min(MOST_ROWS, n - at))
            owner.append(k)
    out = [b""] * len(payloads)
    if rows:
        for k, n, scan in zip(owner, rows, _scans(np.frombuffer(b"".join(payloads), np.uint8), rows)):
            out[k] += _head(n) + scan + b"\xff\xd9"
    return out


def _markers(data: bytes, at: int) -> dict:
    """The tables of the picture that starts at `at`, and where its first scan's data starts."""
    if data[at : at + 2] != b"\xff\xd8":
        raise BadMedia("no start of image")
    p, found = at + 2, {"quant": {}, "dc": {}, "ac": {}, "restart": 0}
    while True:
        if p + 4 > len(data) or data[p] != 255:
            raise BadMedia("no marker where one must be")
        kind = data[p + 1]
        if kind == 255:
            p += 1
            continue
        (n,) = struct.unpack_from(">H", data, p + 2)
        body = data[p + 4 : p + 2 + n]
        if n < 2 or len(body) != n - 2:
            raise BadMedia("cut short")
        p += 2 + n
        try:
            if kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    found["quant"][body[0] & 15] = struct.unpack(">H", body[1:3])[0] if wide else body[1]
                    body = body[1 + 64 * (1 + wide) :]
            elif kind == 0xC4:
                while body:
                    counts = body[1:17]
                    found["ac" if body[0] >> 4 else "dc"][body[0] & 15] = (counts, body[17 : 17 + sum(counts)])
                    body = body[17 + sum(counts) :]
            elif kind == 0xDD:
                (found["restart"],) = struct.unpack(">H", body)
            elif kind == 0xC0:
                bits, h, w, n_parts = struct.unpack(">BHHB", body[:6])
                if bits != 8 or not h or not w:
                    raise BadMedia("not 8-bit baseline")
                found |= {"h": h, "w": w, "parts": [tuple(body[6 + 3 * k : 9 + 3 * k]) for k in range(n_parts)]}
            elif 0xC1 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
                raise BadMedia("not baseline")
            elif kind == 0xDA:
                if "parts" not in found:
                    raise BadMedia("a scan before the frame")
                found["scan"] = [tuple(body[1 + 2 * k : 3 + 2 * k]) for k in range(body[0])]
                return found | {"data": p}
        except (struct.error, IndexError) as e:
            raise BadMedia("a marker's body is cut short") from e


def _segments(data: bytes, at: int) -> tuple[list[tuple[int, int]], int]:
    """The spans between restart markers of the scan that starts at `at`, and the place of the marker that ends it."""
    spans, p, start = [], at, at
    while True:
        p = data.find(b"\xff", p)
        if p < 0 or p + 1 >= len(data):
            raise BadMedia("no end of image")
        kind = data[p + 1]
        if kind == 0:
            p += 2
        elif 0xD0 <= kind <= 0xD7:
            spans.append((start, p))
            p = start = p + 2
        else:
            return [*spans, (start, p)], p


@lru_cache(maxsize=16)
def _lookup(dc: tuple, ac: tuple) -> tuple[np.ndarray, np.ndarray]:
    """For 16 bits: the difference and length of a block of a DC coefficient alone; length 0 if it is none."""
    value, length = np.zeros(65536, np.int32), np.zeros(65536, np.int64)
    end = _codes(*ac).get(0)
    for n, (code, size) in _codes(*dc).items():
        if end is None or size + n + end[1] > 16:
            continue
        for more in range(1 << n):
            bits, total = (code << n | more) << end[1] | end[0], size + n + end[1]
            at = bits << 16 - total
            value[at : at + (1 << 16 - total)] = more if not n or more >> n - 1 else more - (1 << n) + 1
            length[at : at + (1 << 16 - total)] = total
    return value, length


def _side_by_side(stream: np.ndarray, starts: np.ndarray, ends: np.ndarray, steps: int, last_steps: np.ndarray, table: tuple) -> np.ndarray | None:
    """The DC values of all segments, steps each; None if some block has more than a DC coefficient."""
    value, length = table
    w = np.full(len(stream) + 4, 255, np.uint32)
    w[: len(stream)] = stream
    w = w[:-3] << 24 | w[1:-2] << 16 | w[2:-1] << 8 | w[3:]
    at, out = starts * 8, np.zeros((len(starts), steps), np.int32)
    total = np.zeros(len(starts), np.int32)
    for k in range(steps):
        live = last_steps > k
        bits = (w[np.minimum(at >> 3, len(w) - 1)] << (at & 7).astype(np.uint32)) >> 16
        n = length[bits]
        if (n[live] == 0).any():
            return None
        total += value[bits]
        at += n
        out[:, k] = total
    if (at[last_steps == steps] > ends[last_steps == steps] * 8).any():
        raise BadMedia("a segment ends early")
    return out


class _Bits:
    """The bits of a segment, a few bytes of which are held as a number."""

    def __init__(self, data: bytes):
        self.data, self.at, self.value, self.left = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.left < n:
            more = self.data[self.at : self.at + 8]
            if not more:
                raise BadMedia("a segment ends early")
            self.at += len(more)
            self.value = (self.value & ((1 << self.left) - 1)) << 8 * len(more) | int.from_bytes(more, "big")
            self.left += 8 * len(more)
        self.left -= n
        return self.value >> self.left & ((1 << n) - 1)

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (got := codes.get((code, n))) is not None:
                return got
        raise BadMedia("no such code")


def _block_by_block(data: bytes, m: dict, spans: list[tuple[int, int]]) -> np.ndarray:
    """The luminance's DC values of any baseline scan: the first component's blocks in an array of its own."""
    parts = {p[0]: p for p in m["parts"]}
    scan = [(parts[c], {v: k for k, v in _codes(*m["dc"][t >> 4]).items()}, {v: k for k, v in _codes(*m["ac"][t & 15]).items()}) for c, t in m["scan"]]
    luma = m["parts"][0]
    most_h, most_v = max(p[1] >> 4 for p in m["parts"]), max(p[1] & 15 for p in m["parts"])
    alone = len(scan) == 1
    h, v = (1, 1) if alone else (luma[1] >> 4, luma[1] & 15)
    wide = -(-m["w"] * (luma[1] >> 4) // (8 * most_h)) if alone else -(-m["w"] // (8 * most_h))
    high = -(-m["h"] * (luma[1] & 15) // (8 * most_v)) if alone else -(-m["h"] // (8 * most_v))
    out = np.zeros((high * v, wide * h), np.int64)
    unit, each = 0, m["restart"] or wide * high
    for a, b in spans:
        bits, before = _Bits(data[a:b].replace(b"\xff\0", b"\xff")), [0] * len(scan)
        for unit in range(unit, min(unit + each, wide * high)):
            for k, (part, dc, ac) in enumerate(scan):
                for y in range(1 if alone else part[1] & 15):
                    for x in range(1 if alone else part[1] >> 4):
                        n = bits.symbol(dc)
                        more = bits.take(n)
                        before[k] += more if not n or more >> n - 1 else more - (1 << n) + 1
                        at = 1
                        while at < 64:
                            s = bits.symbol(ac)
                            if not s:
                                break
                            at += 16 if s == 0xF0 else (s >> 4) + 1
                            bits.take(s & 15)
                        if part[0] == luma[0]:
                            out[unit // wide * v + y, unit % wide * h + x] = before[k]
        unit += 1
    if unit < wide * high:
        raise BadMedia("blocks are missing")
    return out[: -(-m["h"] * (luma[1] & 15) // (8 * most_v)), : -(-m["w"] * (luma[1] >> 4) // (8 * most_h))]


def thumbnails(files: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """(width, height, DC-only luminance as bytes) of each picture of each file; one grey value for a block of 8 x 8.

    Raises BadMedia for what is no baseline JPEG. Pictures with the same tables are decoded together.
    """
    out: list[list] = []
    groups: dict[tuple, list] = {}
    for k, data in enumerate(files):
        out.append([])
        at = 0
        while True:
            m = _markers(data, at)
            spans, at = _segments(data, m["data"])
            if data[at + 1] != 0xD9:
                raise BadMedia("more than one scan")
            wide, high = -(-m["w"] // 8), -(-m["h"] // 8)
            out[k].append([m["w"], m["h"], None])
            place = (k, len(out[k]) - 1, data, m, spans, wide, high)
            try:
                key = (m["dc"][m["scan"][0][1] >> 4], m["ac"][m["scan"][0][1] & 15], m["restart"], m["quant"][m["parts"][0][2]]) if len(m["parts"]) == 1 and m["restart"] else (place[:2],)
            except KeyError as e:
                raise BadMedia("a table is missing") from e
            groups.setdefault(key, []).append(place)
            at += 2
            if at >= len(data):
                break
    for key, places in groups.items():
        got = None
        if len(key) == 4:
            chunks, lengths = [], []
            for _, _, data, m, spans, _, _ in places:
                raw = data[m["data"] : spans[-1][1]]
                size = np.array([b - a for a, b in spans], np.int64)
                if b"\xff\0" in raw:
                    flat = np.frombuffer(raw, np.uint8)
                    stuffed = np.flatnonzero((flat[:-1] == 255) & (flat[1:] == 0)) + 1
                    own = np.searchsorted(np.array([a for a, _ in spans]) - m["data"], stuffed, side="right") - 1
                    size -= np.bincount(own, minlength=len(spans))
                chunks += [data[a:b] for a, b in spans]
                lengths.append(size)
            joined = b"".join(chunks).replace(b"\xff\0", b"\xff")
            size = np.concatenate(lengths)
            starts = np.cumsum(size) - size
            steps = np.concatenate([np.minimum(key[2], w * h - key[2] * np.arange(len(spans))) for _, _, _, _, spans, w, h in places])
            if all(len(spans) == -(-w * h // key[2]) for _, _, _, _, spans, w, h in places):
                got = _side_by_side(np.frombuffer(joined, np.uint8), starts, starts + size, key[2], steps, _lookup(key[0], key[1]))
        at = 0
        for k, j, data, m, spans, wide, high in places:
            if got is not None:
                dc = got[at : at + len(spans)].ravel()[: wide * high].reshape(high, wide)
                at += len(spans)
            else:
                try:
                    dc = _block_by_block(data, m, spans)
                except KeyError as e:
                    raise BadMedia("a table is missing") from e
            q = m["quant"].get(m["parts"][0][2])
            if q is None:
                raise BadMedia("a table is missing")
            out[k][j][2] = np.clip((dc.astype(np.int64) * q + 4) // 8 + 128, 0, 255).astype(np.uint8)
    return [[tuple(p) for p in one] for one in out]


def average_hash(grey: np.ndarray) -> int:
    """64 bits of an 8 x 8 reduction: set where a cell's mean is over the mean of all cells."""
    h, w = grey.shape
    ys, xs = np.arange(9) * h // 8, np.arange(9) * w // 8
    total = np.zeros((h + 1, w + 1), np.int64)
    total[1:, 1:] = grey.cumsum(axis=0, dtype=np.int64).cumsum(axis=1)
    y0, x0 = np.minimum(ys[:8], h - 1), np.minimum(xs[:8], w - 1)
    y1, x1 = np.maximum(ys[1:], y0 + 1), np.maximum(xs[1:], x0 + 1)
    s = total[y1][:, x1] - total[y0][:, x1] - total[y1][:, x0] + total[y0][:, x0]
    mean = s * 64 // ((y1 - y0)[:, None] * (x1 - x0)[None, :])
    return int("".join("1" if b else "0" for b in (mean * 64 > mean.sum()).ravel()), 2)


def describe(pictures: list[tuple[int, int, np.ndarray]]) -> str:
    return ";".join(f"{w}x{h}:{average_hash(grey):016x}" for w, h, grey in pictures)


def media_features(df: DataFrame, id_col: str = "media_id", media_col: str = "media") -> DataFrame:
    """(id, n_pictures, width, height, thumbnail_hash, error) of a column of JPEG bytes, width and height of the first.

    Null or damaged media give null features and the reason in `error`; the rest of the table is not affected.
    """

    def make():
        def f(ids, media):
            got, why = [], []
            for data in media:
                try:
                    got.append(thumbnails([data])[0] if data is not None else None)
                    why.append(None if data is not None else "null")
                except BadMedia as e:
                    got.append(None)
                    why.append(str(e))
            return [ids, [g and len(g) for g in got], [g and g[0][0] for g in got], [g and g[0][1] for g in got], [g and describe(g) for g in got], why]

        return f

    kind = df.schema[id_col].dataType.simpleString()
    return map_slices(df, [id_col, media_col], make, f"`{id_col}` {kind}, n_pictures int, width int, height int, thumbnail_hash string, error string")


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text, in UTF-8 and padded, as JPEG. Null texts count as empty."""

    def make():
        def f(ids, texts):
            raw = [(t or "").encode("utf-8") for t in texts]
            return [ids, [len(r) for r in raw], store([padded(r) for r in raw])]

        return f

    return map_slices(df, [id_col, text_col], make, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_bytes bigint, media binary", rows=64)


def payload_of(pictures: list[tuple[int, int, np.ndarray]]) -> bytes:
    return b"".join(grey.tobytes() for _, _, grey in pictures)


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every whole text as JPEG, reads the stored bytes back and returns digests and the feature.

    Null and empty texts are one row of padding. Repeated rows and null ids give one row each. Equal texts have equal
    values. Texts beyond the format's size take several pictures.
    """

    def make():
        def f(ids, texts):
            raw = [(t or "").encode("utf-8") for t in texts]
            media = store([padded(r) for r in raw])
            pictures = thumbnails(media)
            back = [payload_of(p) for p in pictures]
            sha = lambda xs: [hashlib.sha256(x).hexdigest() for x in xs]
            return [ids, [len(r) for r in raw], [len(b) for b in back], sha(back), [zlib.crc32(b[-32:]) for b in back], [len(m) for m in media], sha(media), [describe(p) for p in pictures]]

        return f

    kind = df.schema[id_col].dataType.simpleString()
    return map_slices(df, [id_col, text_col], make, f"`{id_col}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string", rows=64)


def op8_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(read(spark, sf_dir, "documents"))
