import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from arborlake.llm import jpeg


def own_reader(data):
    """A plain bit by bit reader of what store() writes."""
    out, at = b"", 0
    while at < len(data):
        m = jpeg._markers(data, at)
        spans, end = jpeg._segments(data, m["data"])
        out += (jpeg._block_by_block(data, m, spans) + 128).astype(np.uint8).tobytes()
        at = end + 2
    return out


def test_round_trip():
    rnd = random.Random(3)
    raw = [b"", b"a", bytes(range(256)) * 9, rnd.randbytes(576), rnd.randbytes(5000), b"\xff" * 576, b"\0\xff" * 700, b"x" * 577]
    payloads = [jpeg.padded(r) for r in raw]
    media = jpeg.store(payloads)
    for p, m, pictures in zip(payloads, media, jpeg.thumbnails(media)):
        assert jpeg.payload_of(pictures) == p
        assert own_reader(m) == p
        assert jpeg.store([p]) == [m]
        assert pictures[0][0] == 8 * 576 and pictures[0][1] == 8 * len(p) // 576


def test_many_pictures(monkeypatch):
    monkeypatch.setattr(jpeg, "MOST_ROWS", 2)
    p = random.Random(4).randbytes(576 * 5)
    (m,) = jpeg.store([p])
    (pictures,) = jpeg.thumbnails([m])
    assert len(pictures) == 3 and jpeg.payload_of(pictures) == p


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, codes, v):
        code, n = codes[v]
        self.bits += f"{code:0{n}b}"

    def number(self, d):
        n = abs(d).bit_length()
        if n:
            self.bits += f"{d if d > 0 else d + (1 << n) - 1:0{n}b}"
        return n


def colour_picture(dcs):
    """A 32 x 16 picture of 4:2:0 with AC coefficients and no restarts; dcs: the luminance's, 2 x 4 blocks."""
    dc = jpeg._codes(jpeg.DC_COUNTS, jpeg.DC_VALUES)
    ac_counts, ac_values = bytes([0, 1, 2, 1, *[0] * 12]), bytes([0, 0x01, 0x12, 0xF0])
    ac = jpeg._codes(ac_counts, ac_values)
    w, before = Writer(), [0, 0, 0]
    for u in range(2):
        for part, blocks in ((0, [dcs[0][2 * u], dcs[0][2 * u + 1], dcs[1][2 * u], dcs[1][2 * u + 1]]), (1, [7]), (2, [-9])):
            for v in blocks:
                d = v - before[part]
                before[part] = v
                w.put(dc, abs(d).bit_length())
                w.number(d)
                w.put(ac, 0x01)
                w.bits += "1"
                w.put(ac, 0xF0)
                w.put(ac, 0x12)
                w.bits += "10"
                w.put(ac, 0)
    w.bits += "1" * (-len(w.bits) % 8)
    scan = int(w.bits, 2).to_bytes(len(w.bits) // 8, "big").replace(b"\xff", b"\xff\0")
    part = jpeg._part
    return (
        b"\xff\xd8" + part(0xFE, b"note") + part(0xDB, b"\0" + bytes([16] * 64)) + part(0xC0, struct.pack(">BHHB", 8, 16, 32, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        + part(0xC4, b"\0" + jpeg.DC_COUNTS + jpeg.DC_VALUES + b"\x10" + ac_counts + ac_values) + part(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    )


def test_colour_and_ac():
    dcs = [[10, -20, 30, 63], [-64, 0, 5, -1]]
    ((w, h, grey),) = jpeg.thumbnails([colour_picture(dcs)])[0]
    assert (w, h) == (32, 16)
    assert grey.tolist() == [[min(255, 128 + 2 * v) for v in row] for row in dcs]


def test_damaged(spark):
    good = jpeg.store([jpeg.padded(b"hello")])[0]
    bad = [b"", b"\xff\xd8", good[:-40], good[:30], b"GIF89a", good.replace(b"\xff\xc0", b"\xff\xc2")]
    for b in bad:
        with pytest.raises(jpeg.BadMedia):
            jpeg.thumbnails([b])
    df = spark.createDataFrame([(1, good, "x"), (2, None, "x"), *[(10 + k, b, "y") for k, b in enumerate(bad)]], "media_id bigint, media binary, width string")
    got = {r.media_id: r for r in jpeg.media_features(df).collect()}
    assert (got[1].width, got[1].height, got[1].error) == (4608, 8, None)
    assert got[2].error == "null" and all(got[10 + k].error and got[10 + k].width is None for k in range(len(bad)))


def test_hash_by_definition():
    rnd = np.random.default_rng(1)
    for shape in ((1, 576), (3, 11), (40, 576), (8, 8)):
        grey = rnd.integers(0, 256, shape).astype(np.uint8)
        cells = []
        for i in range(8):
            for j in range(8):
                y0, y1 = i * shape[0] // 8, (i + 1) * shape[0] // 8
                x0, x1 = j * shape[1] // 8, (j + 1) * shape[1] // 8
                c = grey[y0 : max(y1, y0 + 1), x0 : max(x1, x0 + 1)].astype(int)
                cells.append(int(c.sum()) * 64 // c.size)
        want = int("".join("1" if c * 64 > sum(cells) else "0" for c in cells), 2)
        assert jpeg.average_hash(grey) == want


def test_rows(spark):
    texts = [(1, "abc"), (2, None), (3, ""), (1, "abc"), (None, "é" * 400), (5, "long text " * 9000)]
    df = spark.createDataFrame([(i, t, "c") for i, t in texts], "doc_id bigint, text string, feature string")
    got = sorted(map(tuple, jpeg.text_media(df).collect()), key=str)
    want = []
    for i, t in texts:
        raw = (t or "").encode()
        p = jpeg.padded(raw)
        (m,) = jpeg.store([p])
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), jpeg.describe(jpeg.thumbnails([m])[0])))
    assert got == sorted(want, key=str)
    assert jpeg.text_media(df.limit(0)).count() == 0
    assert jpeg.store_texts(df).count() == 6
