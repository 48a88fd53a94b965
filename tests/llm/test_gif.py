import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from veritrail.llm import gif


@pytest.mark.parametrize("n", [1, 2, 300, 576, 20_000, 576 * 64])
@pytest.mark.parametrize("kinds", [1, 3, 256])
def test_lzw_round_trip(n, kinds):
    data = bytes(random.Random(n).randrange(kinds) for _ in range(n))
    assert gif.lzw_decode(gif.lzw_encode(data), 8, n) == data


def test_payload_round_trip():
    for text in ("", "é" * 1000, "abc\n" * 50_000):
        payload, n = gif.padded(text)
        frames = list(gif.decode(gif.encode(payload)))
        assert b"".join(f.own[:, :, 0].tobytes() for f in frames) == payload and len(payload) % 576 == 0 < len(payload)
        assert [f.start_ms for f in frames] == [100 * i for i in range(len(frames))]


def picture(frames, width=4, height=4):
    """A GIF of 8-bit frames: (disposal, transparent, interlaced, local palette, box, samples)."""
    grey = bytes(x for v in range(256) for x in (v, v, v))
    out = b"GIF89a" + struct.pack("<HHBBB", width, height, 0xF7, 0, 0) + grey
    for disposal, clear, laced, local, (x, y, w, h), samples in frames:
        out += b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), 5, clear or 0) + b"\0"
        out += b"\x2c" + struct.pack("<HHHHB", x, y, w, h, (0x87 if local else 0) | (0x40 if laced else 0)) + (bytes(v for i in range(256) for v in (i, 0, 0)) if local else b"") + b"\x08"
        code = gif.lzw_encode(samples)
        out += b"".join(bytes((len(code[k : k + 255]),)) + code[k : k + 255] for k in range(0, len(code), 255)) + b"\0"
    return out + b"\x3b"


def test_disposal_transparency_palette_interlace():
    base = bytes(range(10, 26))
    frames = list(gif.decode(picture([
        (1, None, False, False, (0, 0, 4, 4), base),
        (2, 9, False, False, (1, 1, 2, 2), bytes([9, 200, 9, 201])),
        (3, None, False, True, (0, 0, 1, 1), b"\x07"),
        (1, None, True, False, (0, 0, 4, 4), bytes(range(16))),
    ])))
    first = np.array(list(base)).reshape(4, 4)
    assert (frames[0].rgb[:, :, 0] == first).all()
    second = first.copy()
    second[1, 2], second[2, 2] = 200, 201
    assert (frames[1].rgb[:, :, 0] == second).all()
    third = first.copy()
    third[1:3, 1:3] = 0  # the second frame's place was cleared
    assert frames[2].rgb[0, 0].tolist() == [7, 0, 0] and (frames[2].rgb[1:, 1:, 0] == third[1:, 1:]).all()
    rows = [0, 2, 1, 3]  # passes: 0; then 2 (from row 4 on: none); then odd rows
    assert frames[3].rgb[:, 0, 0].tolist() == [4 * rows.index(r) for r in range(4)]


def test_query_columns(messy, empty):
    got = gif.read_payloads(gif.encode_payloads(messy)).toPandas()
    texts = messy.select("doc_id", "text").toPandas()
    assert len(got) == len(texts)
    want = sorted((hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), n, len(p)) for p, n in (gif.padded(t or "") for t in texts["text"]))
    assert sorted(zip(got.payload_sha256, got.tail_crc32, got.n_bytes, got.payload_bytes, strict=True)) == want
    assert gif.read_payloads(gif.encode_payloads(empty)).count() == 0


def test_broken_media_end_as_such(spark):
    rng = random.Random(7)
    whole = picture([(1, None, False, True, (0, 0, 4, 4), bytes(range(16)))] * 2)
    broken = []
    for _ in range(600):
        bad = bytearray(whole)
        for _ in range(rng.randint(1, 4)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        broken.append(bytes(bad[: rng.choice([len(bad), rng.randrange(len(bad))])]))
    for b in broken:
        try:
            list(gif.decode(b, 1 << 16))
        except ValueError:
            pass
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b"\x3b"
    with pytest.raises(ValueError):
        list(gif.decode(huge))
    media = [((1 << 60) + 1, whole), (None, whole), (3, huge), (4, whole[:50])]
    rows = gif.gif_frames(spark.createDataFrame(media, "k long, m binary"), "k", "m").select("k", "frame").collect()
    assert sorted((r.k or 0, r.frame) for r in rows) == [(0, 0), (0, 1), ((1 << 60) + 1, 0), ((1 << 60) + 1, 1)]


def test_frames_of_a_column(spark):
    media = [(1, picture([(1, None, False, False, (0, 0, 4, 4), bytes(16))] * 3)), (2, b"no picture"), (3, None)]
    rows = gif.gif_frames(spark.createDataFrame(media, "k long, m binary"), "k", "m").orderBy("frame").collect()
    assert [(r.k, r.frame, r.start_ms) for r in rows] == [(1, 0, 0), (1, 1, 50), (1, 2, 100)] and rows[0].hist_r[0] == 16
