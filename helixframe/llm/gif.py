"""GIF media columns: LZW decoding, palettes, disposal, transparency, timed frames and colour histograms.

``store_payload`` writes bytes losslessly as palette indices of a 64-pixel-wide GIF. ``frames``
reads any GIF column into one row for each composed frame; ``digests`` reads one row for each GIF.
Every GIF is handled by itself in Arrow batches, so nothing is shuffled, and a long payload is
spread over frames of at most FRAME_ROWS rows, which bounds the canvas.

Defined cases: null media gives no frames and a digest with null fields; empty payloads are padded
to one 64-byte row; bytes that are not a GIF, or break off, give the frames before the damage and
``ok`` false. A GIF whose header, or a frame of which, asks for more than MAX_PIXELS pixels ends in a row with
an empty canvas and ``ok`` false, so that a few bytes cannot ask for a task's memory. Repeated rows give repeated rows; an empty table gives none. Input columns other than
the id and the media are ignored, so their names cannot clash.
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

WIDTH = 64
#: Rows of one stored frame: 1 MiB of samples.
FRAME_ROWS = 16_384
DELAY_CS = 10
#: Pixels of a canvas or frame that is decoded; 64 MiB of colours.
MAX_PIXELS = 1 << 24
BINS = 4  # colour-histogram levels for each channel


# ---------------------------------------------------------------- LZW


def lzw_encode(samples: bytes, min_bits: int = 8) -> bytes:
    """LZW code stream of the samples: codes grow to 12 bits, then the table is cleared."""
    clear, stop = 1 << min_bits, (1 << min_bits) + 1
    codes: list[int] = [clear]
    breaks: list[int] = [0]  # where a table begins
    table: dict[int, int] = {}
    following = stop + 1
    it = iter(samples)
    prefix = next(it, -1)
    for byte in it:
        key = prefix << 8 | byte
        known = table.get(key)
        if known is not None:
            prefix = known
            continue
        codes.append(prefix)
        table[key] = following
        following += 1
        prefix = byte
        if following == 4096:
            codes.append(prefix)  # its entry is not needed: the table is full
            prefix = next(it, -1)
            breaks.append(len(codes))
            codes.append(clear)
            table.clear()
            following = stop + 1
            if prefix < 0:
                break
    if prefix >= 0:
        codes.append(prefix)
    codes.append(stop)
    return _pack(np.array(codes, dtype=np.uint32), np.array(breaks), min_bits)


def _widths(n: int, min_bits: int) -> np.ndarray:
    """Bits of each code after a clear code: the first two come before the table's first entry."""
    entries = (1 << min_bits) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.clip(np.ceil(np.log2(entries + 1)).astype(np.int64), min_bits + 1, 12)


_WIDTHS = {b: _widths(5000, b) for b in range(2, 9)}


def _pack(codes: np.ndarray, breaks: np.ndarray, min_bits: int) -> bytes:
    since = np.arange(len(codes)) - np.repeat(breaks, np.diff(np.append(breaks, len(codes))))
    # The clear code itself has the width that the table before it has reached.
    width = _WIDTHS[min_bits][np.maximum(since - 1, 0)]
    for b in breaks[1:]:
        width[b] = _WIDTHS[min_bits][min(b - breaks[np.searchsorted(breaks, b) - 1] - 1, 4999)]
    width[0] = min_bits + 1
    at = np.concatenate(([0], np.cumsum(width)))
    out = np.zeros((int(at[-1]) + 7) // 8 + 4, dtype=np.uint32)
    word, shift = at[:-1] >> 3, (at[:-1] & 7).astype(np.uint32)
    bits = codes << shift
    for k in range(3):
        out += np.bincount(word + k, weights=(bits >> np.uint32(8 * k)) & np.uint32(255), minlength=len(out)).astype(np.uint32)[: len(out)]
    return out[:-4].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, min_bits: int, limit: int) -> tuple[np.ndarray, bool]:
    """At most ``limit`` samples, and whether the stream is whole.

    The table entry made after code i is the output of code i and the next sample, so it lies in the
    output itself: each code copies from an earlier place, and all copies of one table are resolved
    together by pointer jumping.
    """
    clear, stop = 1 << min_bits, (1 << min_bits) + 1
    data = np.frombuffer(stream + b"\0\0\0\0", dtype=np.uint8)
    total_bits = 8 * len(stream)
    widths, pieces, made, bit = _WIDTHS[min_bits], [], 0, 0
    offsets = np.concatenate(([0], np.cumsum(widths)))
    if total_bits >= min_bits + 1 and _one(data, 0, min_bits + 1) == clear:
        bit = min_bits + 1
    while made < limit:
        fits = int(np.searchsorted(offsets, total_bits - bit, side="right")) - 1
        if fits <= 0:
            return _joined(pieces, limit), False
        # A table that is full keeps its entries and 12-bit codes until the next clear code.
        n = min(fits, 4999)
        at = bit + offsets[:n]
        word = at >> 3
        raw = data[word].astype(np.uint32) | data[word + 1].astype(np.uint32) << np.uint32(8) | data[word + 2].astype(np.uint32) << np.uint32(16)
        codes = ((raw >> (at & 7).astype(np.uint32)) & ((np.uint32(1) << widths[:n].astype(np.uint32)) - np.uint32(1))).astype(np.int64)
        ends = np.flatnonzero((codes == clear) | (codes == stop))
        used = int(ends[0]) if len(ends) else n
        if not len(ends) and n == 4999 and fits > n:
            codes, used, bit_after, last = _long_table(data, bit, offsets, total_bits, codes, clear, stop)
        else:
            bit_after = bit + int(offsets[min(used + 1, n)])
            last = int(codes[used]) if len(ends) else -1
        piece, good = _expand(codes[:used], stop + 1, limit - made)
        pieces.append(piece)
        made += len(piece)
        if not good:
            return _joined(pieces, limit), False
        if last == stop:
            return _joined(pieces, limit), made >= limit
        if last == -1:
            return _joined(pieces, limit), False
        bit = bit_after
    return _joined(pieces, limit), True


def _one(data: np.ndarray, bit: int, width: int) -> int:
    word = bit >> 3
    return (int(data[word]) | int(data[word + 1]) << 8 | int(data[word + 2]) << 16) >> (bit & 7) & ((1 << width) - 1)


def _long_table(data, bit, offsets, total_bits, codes, clear, stop):
    """Codes of a table that stays full for long (deferred clear codes)."""
    found = list(codes)
    at = bit + int(offsets[len(codes)])
    while at + 12 <= total_bits:
        code = _one(data, at, 12)
        at += 12
        found.append(code)
        if code in (clear, stop):
            return np.array(found), len(found) - 1, at, code
    return np.array(found), len(found), at, -1


def _joined(pieces: list[np.ndarray], limit: int) -> np.ndarray:
    return (np.concatenate(pieces) if pieces else np.zeros(0, dtype=np.uint8))[:limit]


def _expand(codes: np.ndarray, first: int, limit: int) -> tuple[np.ndarray, bool]:
    """The samples that one table's codes stand for; false if a code names an entry not yet made."""
    n, good = len(codes), True
    if not n:
        return np.zeros(0, dtype=np.uint8), True
    source = codes - first  # the code whose output begins this entry, below 0 for a plain sample
    bad = np.flatnonzero(source >= np.arange(n))
    if len(bad):
        n, good = int(bad[0]), False
        codes, source = codes[:n], source[:n]
        if not n:
            return np.zeros(0, dtype=np.uint8), False
    literal = source < 0
    jump = np.where(literal, np.arange(n), source)
    steps = np.where(literal, 0, 1)
    while True:  # the length of an entry is one more than that of the code it begins with
        more = steps[jump]
        if not more.any():
            break
        steps = steps + more
        jump = jump[jump]
    length = steps + 1
    start = np.concatenate(([0], np.cumsum(length)))
    size = int(start[-1])
    owner = np.repeat(np.arange(n), length)
    inside = np.arange(size) - start[owner]
    place = np.where(literal[owner], np.arange(size), start[np.maximum(source, 0)[owner]] + inside)
    while True:
        further = place[place]
        if np.array_equal(further, place):
            break
        place = further
    samples = np.zeros(size, dtype=np.uint8)
    samples[start[:-1][literal]] = codes[literal]
    return samples[place][:limit], good


# ---------------------------------------------------------------- files


@dataclass
class Frame:
    """One composed frame: the canvas after drawing, and the rectangle that was drawn."""

    index: int
    left: int
    top: int
    width: int
    height: int
    start_ms: int
    delay_ms: int
    disposal: int
    transparent: int
    canvas: np.ndarray  # height x width x 4
    ok: bool


def encode(payload: bytes) -> bytes:
    """A 64-pixel-wide GIF whose frames' palette indices are the payload, which is a multiple of 64 bytes."""
    rows = len(payload) // WIDTH
    palette = bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, max(1, min(rows, FRAME_ROWS)), 0xF7, 0, 0), palette]
    for top in range(0, max(rows, 1), FRAME_ROWS):
        part = payload[top * WIDTH : (top + FRAME_ROWS) * WIDTH]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, DELAY_CS, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08")
        stream = lzw_encode(part)
        out += [bytes([len(stream[i : i + 255])]) + stream[i : i + 255] for i in range(0, len(stream), 255)]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def decode(data: bytes) -> Iterator[Frame]:
    """Composed frames in order; drawing follows palettes, interlacing, transparency and disposal."""
    if len(data) < 13 or data[:6] not in (b"GIF87a", b"GIF89a"):
        return
    width, height, flags, _background, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared = np.frombuffer(data[at : at + 3 * n].ljust(3 * n, b"\0"), dtype=np.uint8).reshape(n, 3)
        at += 3 * n
    nothing = np.zeros((0, 0, 4), dtype=np.uint8)
    if width * height > MAX_PIXELS:
        yield Frame(0, 0, 0, width, height, 0, 0, 0, -1, nothing, False)
        return
    canvas = np.zeros((height, width, 4), dtype=np.uint8)
    disposal, delay, transparent, index, clock = 0, 0, -1, 0, 0
    while at < len(data):
        kind = data[at]
        if kind == 0x21:
            if at + 1 < len(data) and data[at + 1] == 0xF9 and at + 7 < len(data):
                packed, delay, hidden = struct.unpack_from("<BHB", data, at + 3)
                disposal, transparent = packed >> 2 & 7, hidden if packed & 1 else -1
            _, at = _blocks(data, at + 2)
        elif kind == 0x2C and at + 10 < len(data):
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            palette = shared
            if flags & 0x80:
                n = 2 << (flags & 7)
                palette = np.frombuffer(data[at : at + 3 * n].ljust(3 * n, b"\0"), dtype=np.uint8).reshape(n, 3)
                at += 3 * n
            if at >= len(data) or not 2 <= data[at] <= 8:
                return
            if w * h > MAX_PIXELS:
                yield Frame(index, left, top, w, h, clock, 10 * delay, disposal, transparent, nothing, False)
                return
            stream, after = _blocks(data, at + 1)
            samples, ok = lzw_decode(stream, data[at], w * h)
            at = after
            if len(samples) < w * h:
                samples = np.concatenate((samples, np.zeros(w * h - len(samples), dtype=np.uint8)))
            picture = samples.reshape(h, w)
            if flags & 0x40:
                order = np.concatenate([np.arange(s, h, p) for s, p in ((0, 8), (4, 8), (2, 4), (1, 2))])
                picture = picture[np.argsort(order)]
            before = canvas.copy() if disposal == 3 else None
            colours = np.zeros((256, 4), dtype=np.uint8)
            if palette is not None:
                colours[: len(palette), :3] = palette
            colours[:, 3] = 255
            area = canvas[top : top + h, left : left + w]
            picture = picture[: area.shape[0], : area.shape[1]]
            if transparent >= 0:
                shown = picture != transparent
                area[shown] = colours[picture[shown]]
            else:
                area[...] = colours[picture]
            yield Frame(index, left, top, w, h, clock, 10 * delay, disposal, transparent, canvas, ok)
            clock += 10 * delay
            index += 1
            if disposal == 2:
                area[...] = 0
            elif disposal == 3 and before is not None:
                canvas = before
            disposal, delay, transparent = 0, 0, -1
        else:
            return


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Counts of the visible pixels in BINS levels for each of red, green and blue."""
    seen = canvas.reshape(-1, 4)
    if not (whole := bool(seen[:, 3].all())):
        seen = seen[seen[:, 3] > 0]
    step = 256 // BINS
    key = seen[:, 0] // step * (BINS * BINS) + seen[:, 1] // step * BINS + seen[:, 2] // step
    return np.bincount(key, minlength=BINS**3) if len(seen) or whole else np.zeros(BINS**3, dtype=np.int64)


# ---------------------------------------------------------------- columns

FRAME_SCHEMA = "frame int, x int, y int, width int, height int, start_ms long, delay_ms int, disposal int, transparent int, histogram array<long>, rgba binary, ok boolean"
DIGEST_SCHEMA = "payload_bytes long, payload_sha256 string, tail_crc32 long, n_frames int, duration_ms long, feature string, ok boolean"


def _id_type(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def store_payload(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as a GIF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for at in range(0, batch.num_rows, 256):
                raw = [t.as_py() or b"" for t in texts[at : at + 256]]
                media = [encode(t.ljust(-(-max(len(t), 1) // WIDTH) * WIDTH, b"\0")) for t in raw]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 256], pa.array([len(t) for t in raw], pa.int64()), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {_id_type(df, id_col)}, n_bytes long, media binary")


def frames(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row for each composed frame of each GIF: time, place, disposal, colour histogram and RGBA canvas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, media in zip(batch.column(0), batch.column(1)):
                for f in decode(media.as_py() or b""):
                    row = [key.as_py(), f.index, f.left, f.top, f.width, f.height, f.start_ms, f.delay_ms, f.disposal, f.transparent, histogram(f.canvas).tolist(), f.canvas.tobytes(), f.ok]
                    types = [batch.schema.field(0).type, *[pa.int32()] * 5, pa.int64(), *[pa.int32()] * 3, pa.list_(pa.int64()), pa.binary(), pa.bool_()]
                    names = [id_col, *(c.split()[0] for c in FRAME_SCHEMA.split(", "))]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

    return df.select(id_col, media_col).mapInArrow(run, f"`{id_col}` {_id_type(df, id_col)}, {FRAME_SCHEMA}")


def _digest(media: bytes | None) -> tuple:
    if media is None:
        return (None,) * 7
    sha, size, tail, n, clock, good = hashlib.sha256(), 0, b"", 0, 0, True
    colours = np.zeros(BINS**3, dtype=np.int64)
    for f in decode(media):
        drawn = f.canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        samples = drawn[:, :, 0].tobytes()
        sha.update(samples)
        size += len(samples)
        tail = (tail + samples)[-64:]
        colours += histogram(drawn)
        n, clock, good = n + 1, f.start_ms + f.delay_ms, good and f.ok
    grey = [int(colours[i * (BINS * BINS + BINS + 1)]) for i in range(BINS)]
    return size, sha.hexdigest(), zlib.crc32(tail), n, clock, f"frames={n};ms={clock};grey=" + "/".join(map(str, grey)), good and n > 0


def digests(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row for each GIF, from its stored bytes: the red samples of what each frame draws, their digest and features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in DIGEST_SCHEMA.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]
        for batch in batches:
            found = [_digest(m.as_py()) for m in batch.column(1)]
            columns = [pa.array([r[i] for r in found], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, *names])

    return df.select(id_col, media_col).mapInArrow(run, f"`{id_col}` {_id_type(df, id_col)}, {DIGEST_SCHEMA}")


def round_trip(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts stored as GIFs and read back: what was stored, what was read, and features of the frames."""
    stored = store_payload(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in DIGEST_SCHEMA.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]
        for batch in batches:
            found = [_digest(m.as_py()) for m in batch.column(2)]
            columns = [pa.array([r[i] for r in found], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(4), *columns], [id_col, "n_bytes", "media_bytes", "media_sha256", *names])

    measured = stored.select(id_col, "n_bytes", "media", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    return measured.mapInArrow(run, f"`{id_col}` {_id_type(df, id_col)}, n_bytes long, media_bytes long, media_sha256 string, {DIGEST_SCHEMA}")
