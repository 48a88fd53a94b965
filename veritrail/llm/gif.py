"""GIF media columns: an LZW codec, frame composition (palettes, disposal, transparency, timing) and
colour histograms.

``encode_payloads`` stores bytes as 8-bit samples of frames under an identity grey palette, which makes
the storage lossless; ``decode`` reads any GIF; ``gif_frames`` turns a media column into timed frames.

Defined results: null text counts as empty; an empty text is one row of padding; long texts take more
frames; broken media give no frames (``gif_frames``) rather than a failed job, and so do canvases of more than
``MAX_PIXELS`` pixels; repeated rows repeat; ids are carried exactly, null ones stay null.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import computed, text_or_empty

#: Payloads are padded to whole rows of this many samples; a frame holds up to ROWS of them.
WIDTH, ROWS = 576, 64
PAD = 255
#: Hundredths of a second that each stored frame is shown.
DELAY = 10
#: Pixels that a canvas or a frame may declare (a broken header may claim 12 GB of them).
MAX_PIXELS = 1 << 26
_TOP = 4096
_GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


def _widths(min_size: int, count: int) -> np.ndarray:
    """Bits of the j-th code after a clear code: the table grows by one entry with every code."""
    reached = np.minimum((1 << min_size) + 1 + np.arange(count), _TOP - 1)
    return np.maximum(min_size + 1, np.floor(np.log2(reached)).astype(np.int64) + 1)


_W8 = _widths(8, _TOP)
_MASK8 = np.arange(16)[None, :] < _W8[:, None]
#: Data codes between two clear codes when 8-bit samples are stored.
_SEGMENT = _TOP - 258


def lzw_encode(samples: bytes) -> bytes:
    """8-bit samples to a GIF code stream: a clear code, greedy longest matches, an end code."""
    codes: list[int] = []
    cuts: list[int] = []
    table: dict[int, int] = {}
    get, put = table.get, codes.append
    free, word = 258, samples[0]
    for c in samples[1:]:
        key = word << 8 | c
        known = get(key)
        if known is not None:
            word = known
            continue
        put(word)
        word = c
        if free < _TOP - 1:
            table[key] = free
            free += 1
        else:
            cuts.append(len(codes))
            table.clear()
            free = 258
    put(word)
    all_codes = np.asarray(codes, dtype="<u2")
    bits = [np.unpackbits(np.asarray([256], dtype="<u2").view(np.uint8), bitorder="little")[:9]]
    at = 0
    for end in [*cuts, len(codes)]:
        part = np.append(all_codes[at:end], np.uint16(256 if end < len(codes) else 257)).astype("<u2")
        spread = np.unpackbits(part.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
        bits.append(spread[_MASK8[: len(part)]])
        at = end
    return np.packbits(np.concatenate(bits), bitorder="little").tobytes()


def lzw_decode(stream: bytes, min_size: int, expected: int) -> bytes:
    """A GIF code stream to samples (at most ``expected``).

    An entry of the table is the text of one code plus the next character, so it is a slice of the
    output: only where it starts and its length are kept.
    """
    clear = 1 << min_size
    first = clear + 2
    widths = _W8 if min_size == 8 else _widths(min_size, _TOP)
    data = np.frombuffer(stream + b"\0\0\0", dtype=np.uint8).astype(np.uint32)
    total_bits = 8 * len(stream)
    out = bytearray()
    at, done = 0, False
    while not done and len(out) < expected:
        starts: list[int] = []
        lengths: list[int] = []
        fresh = True
        while True:  # blocks of codes up to the next clear code
            block = widths if fresh else np.full(_TOP, 12)
            offsets = at + np.concatenate(([0], np.cumsum(block[:-1])))
            n = int(np.searchsorted(offsets + block, total_bits, side="right"))
            if not n:
                done = True
                break
            offsets, block = offsets[:n], block[:n]
            b = offsets >> 3
            value = data[b] | data[b + 1] << 8 | data[b + 2] << 16
            codes = value >> (offsets & 7).astype(np.uint32) & ((1 << block) - 1).astype(np.uint32)
            stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
            stop = int(stops[0]) if len(stops) else n
            pos = len(out)
            for c in codes[:stop].tolist():
                if c < clear:
                    out.append(c)
                    size = 1
                else:
                    k = c - first
                    if k >= len(starts):
                        raise ValueError("a code beyond the table")
                    p = starts[k]
                    size = lengths[k] + 1
                    piece = out[p : p + size]
                    out += piece
                    if len(piece) < size:
                        out.append(out[p])
                starts.append(pos)
                lengths.append(size)
                pos += size
            if len(stops):
                done = bool(codes[stop] == clear + 1)
                at = int(offsets[stop] + block[stop])
                break
            at = int(offsets[-1] + block[-1])
            fresh = False
    return bytes(out[:expected])


@dataclass
class Frame:
    """One composed picture: its own rectangle, when it is shown, and the whole canvas as RGB."""

    start_ms: int
    delay_ms: int
    box: tuple[int, int, int, int]
    disposal: int
    rgb: np.ndarray

    @property
    def own(self) -> np.ndarray:
        x, y, w, h = self.box
        return self.rgb[y : y + h, x : x + w]


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 3 << (flags & 7) + 1
    table = np.zeros((256, 3), dtype=np.uint8)
    table[: n // 3] = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
    return table, at + n


def decode(data: bytes, most: int = MAX_PIXELS) -> Iterator[Frame]:
    """Composed frames in order.  Disposal 2 clears the frame's rectangle, 3 restores what was there.

    Raises ValueError for anything that is no sound GIF, or that declares a canvas or a frame of more than
    ``most`` pixels.
    """
    try:
        yield from _frames(data, most)
    except (IndexError, OverflowError, struct.error) as e:
        raise ValueError(f"a broken GIF: {e}") from e


def _frames(data: bytes, most: int) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF header")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    if width * height > most:
        raise ValueError("the canvas is too large")
    shared, at = _palette(data, 13, flags)
    canvas = np.zeros((height, width, 3), dtype=np.uint8)
    clock = 0
    delay, disposal, transparent = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            label = data[at + 1]
            body, at = _blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                packed, ticks, index = struct.unpack_from("<BHB", body)
                delay, disposal = 10 * ticks, packed >> 2 & 7
                transparent = index if packed & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("an unknown block")
        x, y, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        own, at = _palette(data, at + 10, flags)
        palette = own if own is not None else shared
        if palette is None:
            raise ValueError("a frame without a palette")
        min_size = data[at]
        if not 1 <= min_size <= 8 or w * h > most:
            raise ValueError("samples of an impossible size")
        stream, at = _blocks(data, at + 1)
        samples = np.frombuffer(lzw_decode(stream, min_size, w * h).ljust(w * h, b"\0"), np.uint8).reshape(h, w)
        if flags & 0x40:  # rows come in four passes
            order = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
            samples = samples[np.argsort(order)]
        before = canvas.copy() if disposal == 3 else None
        region = canvas[y : y + h, x : x + w]
        colours = palette[samples][: region.shape[0], : region.shape[1]]
        if transparent is None:
            region[...] = colours
        else:
            shown = samples[: region.shape[0], : region.shape[1]] != transparent
            region[shown] = colours[shown]
        yield Frame(clock, delay, (x, y, w, h), disposal, canvas.copy())
        clock += delay
        if disposal == 2:
            region[...] = 0
        elif before is not None:
            canvas = before
        delay, disposal, transparent = 0, 0, None


def encode(payload: bytes) -> bytes:
    """Samples, whole rows of WIDTH, as the frames of a grey GIF."""
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), _GREY]
    for top in range(0, rows, ROWS):
        h = min(ROWS, rows - top)
        stream = lzw_encode(payload[top * WIDTH : (top + h) * WIDTH])
        out.append(b"\x21\xf9\x04\x04" + struct.pack("<HB", DELAY, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, h, 0) + b"\x08")
        out.extend(bytes((len(stream[k : k + 255]),)) + stream[k : k + 255] for k in range(0, len(stream), 255))
        out.append(b"\0")
    out.append(b"\x3b")
    return b"".join(out)


def histogram(rgb: np.ndarray) -> np.ndarray:
    """Counts of eight equal bands of red, then green, then blue."""
    flat = rgb.reshape(-1, 3) >> 5
    return np.concatenate([np.bincount(flat[:, k], minlength=8) for k in range(3)])


def padded(text: str) -> tuple[bytes, int]:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes([PAD]) * (max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw)), len(raw)


def encode_payloads(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every text as a GIF."""

    def store(texts):
        return [(n, encode(p)) for p, n in map(padded, texts)]

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return computed(source, ["doc_id"], ["text"], store, {"n_bytes": "long", "media": "binary"})


def read_payloads(media: DataFrame) -> DataFrame:
    """Decode stored media back to payloads and describe them (one row per media)."""

    def row(blob: bytes):
        payload, hist, ms, n = [], np.zeros(24, dtype=np.int64), 0, 0
        for f in decode(blob):
            own = f.own
            payload.append(np.ascontiguousarray(own[:, :, 0]).tobytes())
            hist += histogram(own)
            ms, n = f.start_ms + f.delay_ms, n + 1
        data = b"".join(payload)
        feature = f"frames={n};ms={ms};rgb8=" + ",".join(map(str, hist.tolist()))
        return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), feature

    described = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}
    return computed(media, ["doc_id", "n_bytes"], ["media"], lambda blobs: [row(b) for b in blobs], described)


def gif_frames(df: DataFrame, key: str, media: str) -> DataFrame:
    """Timed frames of a media column: key, frame, start_ms, delay_ms, left, top, width, height, rgb,
    hist_r, hist_g, hist_b.  Null or broken media give no rows (a medium that breaks off gives none of its
    frames)."""
    counts = pa.list_(pa.int64())
    kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.binary(), counts, counts, counts]
    names = ["frame", "start_ms", "delay_ms", "left", "top", "width", "height", "rgb", "hist_r", "hist_g", "hist_b"]

    def split(batches):
        for batch in batches:
            for k, blob in enumerate(batch.column("m")):
                rows = []
                try:
                    for i, f in enumerate(decode(blob.as_py())):
                        hist = histogram(f.rgb).tolist()
                        rows.append((i, f.start_ms, f.delay_ms, *f.box, f.rgb.tobytes(), hist[:8], hist[8:16], hist[16:]))
                except ValueError:
                    continue
                if rows:
                    keys = batch.column("k").take(pa.array([k] * len(rows)))
                    yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=["k", *names])

    kind = df.schema[key].dataType.simpleString()
    out = df.where(F.col(media).isNotNull()).select(F.col(key).alias("k"), F.col(media).alias("m")).mapInArrow(
        split,
        f"k {kind}, frame int, start_ms long, delay_ms long, left int, top int, width int, height int, rgb binary, hist_r array<long>, hist_g array<long>, hist_b array<long>",
    )
    return out.withColumnRenamed("k", key)
