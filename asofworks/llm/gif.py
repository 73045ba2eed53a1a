"""GIF as a media column: LZW code streams, palettes, disposal, transparency, timed frames, colour histograms.

`decode` reads any GIF87a or GIF89a bytes: global and local palettes,
interlacing, delays, the four disposal methods and transparent indices. Code
streams are decoded with array operations. The width of every code between two
clear codes follows from its place alone, so all codes of such a run are cut
out at once; each code's string is a copy of earlier output (entry k repeats
the string of the run's code k - 258 and one sample more), so lengths and
samples are found by pointer jumping instead of a table built code by code.

`encode` writes 8-bit samples as grey frames, losslessly. `store` turns a text
column into such media, writes the column as a table and reads the stored bytes
back: payload, digests, brightness feature, times and colour histogram.

Defined results: a null or empty text is a payload of 576 bytes of 255; a text
of any length is stored whole, in frames of at most 36,864 samples. Equal texts
get equal media and features, so repeated rows do. An empty table gives an empty
result. Kept columns named like a result are replaced. Bytes that are no GIF, or
a broken one, raise ValueError in `decode` and `measured` and give a null in
`frames`.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField

from .common import Texts, annotate, written

SIDE = 24
BLOCK = SIDE * SIDE
#: Blocks that a frame holds at most, one below the other.
FRAME_BLOCKS = 64
DELAY = 10
GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
LIMIT = 4096


def widths(first: int, n: int) -> np.ndarray:
    """The width in bits of each of n codes after a clear code; first: the first free entry."""
    entry = first + np.maximum(0, np.arange(n) - 1)
    return np.minimum(12, np.maximum(int(first - 1).bit_length(), np.floor(np.log2(np.minimum(entry, LIMIT))).astype(np.int64) + 1))


WIDTHS8 = widths(258, LIMIT)


def lzw_encode(samples: bytes) -> bytes:
    """The code stream of 8-bit samples; a clear code at the start and whenever the table is full."""
    out, runs, table = [256], [], {}
    get, entry = table.get, 258
    now = samples[0]
    for c in samples[1:]:
        key = now << 8 | c
        code = get(key)
        if code is not None:
            now = code
            continue
        out.append(now)
        if entry < LIMIT:
            table[key] = entry
            entry += 1
        else:
            out.append(256)
            runs.append(out)
            out, entry = [], 258
            table.clear()
        now = c
    out += [now, 257]
    runs.append(out)
    codes = np.concatenate([np.array(r, np.int64) for r in runs])
    width = np.concatenate([np.concatenate([[9], WIDTHS8[: len(r) - 1]]) if k == 0 else WIDTHS8[: len(r)] for k, r in enumerate(runs)])
    at = np.cumsum(width) - width
    value, byte = codes << (at & 7), at >> 3
    size = int(at[-1] + width[-1] + 7) // 8
    packed = np.zeros(size + 3)
    for k in range(3):
        packed += np.bincount(byte + k, value >> 8 * k & 255, size + 3)
    return packed[:size].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, bits: int, most: int) -> np.ndarray:
    """At most `most` samples of a code stream whose smallest code size is bits."""
    data = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    total, clear, at, out, got = 8 * len(stream), 1 << bits, 0, [], 0
    width = widths(clear + 2, LIMIT)
    while at < total and got < most:
        n = LIMIT
        while True:
            own = width if n <= len(width) else np.concatenate([width, np.full(n - len(width), 12)])
            place = at + np.cumsum(own[:n]) - own[:n]
            place = place[place + own[: len(place)] <= total]
            b = place >> 3
            codes = (data[b] | data[b + 1] << 8 | data[b + 2] << 16) >> (place & 7) & ((1 << own[: len(place)]) - 1)
            stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
            if len(stop) or len(place) < n:
                break
            n *= 2
        end = int(stop[0]) if len(stop) else len(codes)
        if end:
            out.append(run_samples(codes[:end], clear))
            got += len(out[-1])
        if not len(stop) or codes[end] == clear + 1:
            break
        at = int(place[end] + own[end])
    return np.concatenate(out)[:most] if out else np.zeros(0, np.int64)


def run_samples(codes: np.ndarray, clear: int) -> np.ndarray:
    """The samples of the codes between two clear codes."""
    index = np.arange(len(codes))
    copy = codes > clear
    source = np.where(copy, codes - clear - 2, index)
    if (source[copy] >= index[copy]).any():
        raise ValueError("a code that the table does not have yet")
    length, up = copy.astype(np.int64), source
    while (up != up[up]).any():  # length: steps to a literal, and then one
        length, up = length + length[up], up[up]
    length += 1
    start = np.cumsum(length) - length
    n = int(start[-1] + length[-1])
    owner = np.repeat(index, length)
    place = np.arange(n)
    origin = np.where(copy[owner], start[source[owner]] + place - start[owner], place)
    while True:
        further = origin[origin]
        if (further == origin).all():
            return codes[owner[origin]]
        origin = further


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int | None
    samples: np.ndarray  # palette indices, row by row
    canvas: np.ndarray  # the whole screen's RGBA after this frame


def sub_blocks(raw: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while at < len(raw) and raw[at]:
        out.append(raw[at + 1 : at + 1 + raw[at]])
        at += 1 + raw[at]
    return b"".join(out), at + 1


def decode(raw: bytes) -> list[Frame]:
    """All frames, composed in order."""
    if raw[:6] not in (b"GIF87a", b"GIF89a") or len(raw) < 13:
        raise ValueError("no GIF")
    word = lambda at: int.from_bytes(raw[at : at + 2], "little")
    wide, high, flags = word(6), word(8), raw[10]
    at = 13
    palette = np.zeros((0, 3), np.uint8)
    if flags & 128:
        size = 2 << (flags & 7)
        palette = np.frombuffer(raw, np.uint8, 3 * size, at).reshape(-1, 3)
        at += 3 * size
    frames, canvas = [], np.zeros((high, wide, 4), np.uint8)
    delay, disposal, transparent = 0, 0, None
    while at < len(raw):
        kind, at = raw[at], at + 1
        if kind == 0x3B:
            break
        if kind == 0x21:
            label = raw[at]
            body, at = sub_blocks(raw, at + 1)
            if label == 0xF9 and len(body) >= 4:
                delay, disposal = 10 * int.from_bytes(body[1:3], "little"), body[0] >> 2 & 7
                transparent = body[3] if body[0] & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h, own = word(at), word(at + 2), word(at + 4), word(at + 6), raw[at + 8]
        at += 9
        colours = palette
        if own & 128:
            size = 2 << (own & 7)
            colours = np.frombuffer(raw, np.uint8, 3 * size, at).reshape(-1, 3)
            at += 3 * size
        bits = raw[at]
        stream, at = sub_blocks(raw, at + 1)
        samples = lzw_decode(stream, bits, w * h)
        if len(samples) < w * h or not len(colours) or samples.max(initial=0) >= max(len(colours), 1):
            raise ValueError("a broken frame")
        samples = samples.astype(np.uint8)
        if own & 64:
            order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            rows = np.empty((h, w), np.uint8)
            rows[order] = samples.reshape(h, w)
            samples = rows.ravel()
        before = canvas.copy() if disposal == 3 else None
        part = canvas[top : top + h, left : left + w]
        grid = samples.reshape(h, w)[: part.shape[0], : part.shape[1]]
        drawn = np.ones(grid.shape, bool) if transparent is None else grid != transparent
        part[drawn] = np.concatenate([colours[grid[drawn]], np.full((int(drawn.sum()), 1), 255, np.uint8)], axis=1)
        frames.append(Frame(left, top, w, h, delay, disposal, transparent, samples, canvas.copy()))
        if disposal == 2:
            part[:] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, transparent = 0, 0, None
    return frames


def encode(payload: bytes) -> bytes:
    """Grey frames of SIDE samples a row; the payload's size is a multiple of BLOCK."""
    number = lambda n: n.to_bytes(2, "little")
    blocks = len(payload) // BLOCK
    out = [b"GIF89a", number(SIDE), number(SIDE * min(blocks, FRAME_BLOCKS)), b"\xf7\0\0", GREY]
    for at in range(0, len(payload), FRAME_BLOCKS * BLOCK):
        part = payload[at : at + FRAME_BLOCKS * BLOCK]
        stream = lzw_encode(part)
        out += [b"\x21\xf9\x04\x04", number(DELAY), b"\0\0", b"\x2c\0\0\0\0", number(SIDE), number(len(part) // SIDE), b"\0\x08"]
        out += [bytes([len(s)]) + s for s in (stream[k : k + 255] for k in range(0, len(stream), 255))]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def histogram(frame: Frame) -> np.ndarray:
    """Shares, in parts of 255, of the 64 colours of two bits a channel among the screen's opaque pixels."""
    rgba = frame.canvas.reshape(-1, 4)
    seen = rgba[rgba[:, 3] > 0] >> 6
    count = np.bincount(seen[:, 0].astype(int) * 16 + seen[:, 1].astype(int) * 4 + seen[:, 2], minlength=64)
    return (count * 255 + len(seen) // 2) // max(1, len(seen))


def grey_levels(frames: list[Frame]) -> np.ndarray:
    """Shares, in parts of 255, of 16 levels of brightness over all frames' samples on the screen."""
    count = np.zeros(16, np.int64)
    for f in frames:
        area = f.canvas[f.top : f.top + f.height, f.left : f.left + f.width, :3].reshape(-1, 3)
        level = (area @ np.array([77, 150, 29])) >> 12
        count += np.bincount(level, minlength=16)
    return (count * 255 + count.sum() // 2) // max(1, count.sum())


def payload_of(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % BLOCK if raw else BLOCK)


def media(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep (default: all columns of df), n_bytes of the text and its media bytes."""

    def f(batch: pa.RecordBatch) -> list:
        texts = list(Texts(batch.column(text_col)))
        return [pa.array([len(raw) for raw in texts], pa.int64()), pa.array([encode(payload_of(raw)) for raw in texts], pa.binary())]

    return annotate(df, [StructField("n_bytes", LongType()), StructField("media", BinaryType())], lambda: f, [text_col], df.columns if keep is None else keep, text_col)


def measured(df: DataFrame, media_col: str = "media", keep: list[str] | None = None) -> DataFrame:
    """keep (default: all columns of df) and what stored media bytes hold: payload, digests, feature, frames, times, colour histogram."""
    fields = [StructField("payload_bytes", LongType()), StructField("payload_sha256", StringType()), StructField("tail_crc32", LongType()), StructField("media_bytes", LongType()), StructField("media_sha256", StringType()), StructField("feature", StringType()), StructField("n_frames", IntegerType()), StructField("duration_ms", LongType()), StructField("histogram", ArrayType(IntegerType()))]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int32())]

    def f(batch: pa.RecordBatch) -> list:
        rows = []
        for raw in Texts(batch.column(media_col)):
            frames = decode(raw)
            back = b"".join(x.samples.tobytes() for x in frames)
            colours = sum(histogram(x) for x in frames) // max(1, len(frames))
            rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), bytes(grey_levels(frames).astype(np.uint8)).hex(), len(frames), sum(x.delay_ms for x in frames), colours.tolist()))
        return [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]

    return annotate(df, fields, lambda: f, [media_col], df.columns if keep is None else keep, media_col)


def store(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep (default: all columns of df), n_bytes, the media column as it was written to the shared folder, and what is read back from it."""
    return measured(written(media(df, text_col, keep)))


def frames(df: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """A row for each frame of a media column: its place, times, rules and colour histogram; frame null where the bytes are no sound GIF."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, frame int, `left` int, top int, width int, height int, begin_ms long, delay_ms long, disposal int, transparent int, histogram array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    begin = 0
                    for k, x in enumerate(decode(raw.as_py() or b"")):
                        rows.append((key, k, x.left, x.top, x.width, x.height, begin, x.delay_ms, x.disposal, x.transparent, histogram(x).tolist()))
                        begin += x.delay_ms
                except (ValueError, IndexError):
                    rows.append((key, *[None] * 10))
            types = [b.schema.types[0], *[pa.int32()] * 5, pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [x.split()[0].strip("`") for x in schema.split(", ")])

    return df.select(id_col, media_col).mapInArrow(run, schema)
