"""Media columns: GIF.

``encode`` stores 8-bit samples as a GIF89a of 64-pixel-wide grey frames with an
LZW stream each; ``decode`` reads GIF87a and GIF89a: LZW code streams with
growing codes, clear and end codes, global and local palettes, interlacing,
transparency and the disposal methods, giving timed frames composed on the
canvas as well as each frame's own samples.  ``decoded`` turns a media column into timed
frames with colour-histogram columns, frame by frame, and ``frames`` into a row for each; the
query writes the media column to a table, reads it back, writes the frames to another, and takes
payload and feature from these.

Defined cases: a null or empty text is 64 zero bytes; a payload over one frame's
height spans several frames, so a text of any length is stored whole; repeated rows
give equal media; an empty table gives an empty table; a stream that isn't a GIF, ends
early, has too few samples for a frame, a code size outside 1 to 8 or a canvas or frame
of over MAX_PIXELS raises ValueError in ``decode`` and gives a row without values in
``frames``.  Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WIDTH, MAX_ROWS, DELAY = 64, 4096, 10
#: Pixels of a canvas or frame: its four bytes each, twice, bound what a task holds.
MAX_PIXELS = 1 << 24


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_cs: int
    disposal: int
    transparent: int | None
    samples: bytes  # palette indices, row by row
    canvas: np.ndarray | None  # height x width x 4 (RGBA), composed


@lru_cache(maxsize=64)
def _widths(n: int, bits: int) -> np.ndarray:
    """Widths of the first n codes after a clear code, as the decoder's table grows: entry k is added with code k."""
    size = (1 << bits) + 2 + np.maximum(np.arange(n) - 1, -1)
    return np.minimum(12, np.maximum(bits + 1, np.floor(np.log2(np.maximum(size, 1))).astype(np.int64) + 1))


#: The encoder clears when the next entry would get this number.
_FULL = 4095
_W8 = _widths(4096, 8)


def lzw_encode(data: bytes) -> bytes:
    """An 8-bit LZW code stream: clear codes whenever the table is full, then the end code."""
    segments: list[list[int]] = []
    at, n = 0, len(data)
    while at < n:
        table: dict[int, int] = {}
        get, codes, fresh = table.get, [], 258
        add = codes.append
        samples = iter(data[at:])
        code = next(samples)
        for b in samples:
            k = code << 8 | b
            if (nxt := get(k)) is not None:
                code = nxt
                continue
            add(code)
            table[k] = fresh
            fresh += 1
            code = b
            if fresh == _FULL:
                break  # the pending sample starts the next segment
        else:
            add(code)
        at = at + _samples(table, codes) if fresh == _FULL else n
        segments.append(codes)
    return _pack(segments)


def _samples(table: dict[int, int], codes: list[int]) -> int:
    """Samples that the codes stand for."""
    length = [1] * 258
    for k in table:  # in order of making
        length.append(length[k >> 8] + 1)
    return sum(map(length.__getitem__, codes))


def _pack(segments: list[list[int]]) -> bytes:
    """Codes to bits, lowest first: a clear code before each segment, the end code after all."""
    codes, widths = [], []
    for k, seg in enumerate(segments):
        # the clear code has the width that the decoder expects at that point
        before = 9 if not k else int(_W8[len(segments[k - 1])])
        codes.append(np.array([256, *seg], np.int64))
        widths.append(np.concatenate([[before], _W8[: len(seg)]]))
    codes.append(np.array([257], np.int64))
    widths.append(np.array([9 if not segments else int(_W8[len(segments[-1])])]))
    c, w = np.concatenate(codes), np.concatenate(widths)
    start = np.cumsum(w) - w
    total = int(w.sum())
    out = np.zeros(total // 8 + 4, np.uint8)
    # a code of up to 12 bits touches at most 3 bytes; bits never overlap, so sums are ors
    v = c << (start & 7)
    for k in range(3):
        out += np.bincount((start >> 3) + k, weights=((v >> (8 * k)) & 255), minlength=len(out))[: len(out)].astype(np.uint8)
    return out[: (total + 7) // 8].tobytes()


def _expand(codes: np.ndarray, first: int) -> np.ndarray:
    """What a segment's codes stand for; `first` is the code of the first table entry.

    Entry j is what code j gave and the first sample of what code j + 1 gave, so code i that
    names entry j copies from the output at the place of code j.  Lengths, then sources,
    are found by doubling pointers, in steps logarithmic in the longest string.
    """
    n = len(codes)
    ref = codes - first
    own = ref < 0
    ref = np.where(own, 0, ref)
    if not own[0] or (ref > np.maximum(np.arange(n) - 1, 0)).any():
        raise ValueError("LZW: code before its entry")
    if own.all():
        return codes.astype(np.uint8)
    # the length is that of the chain of entries down to a literal
    ptr = np.where(own, np.arange(n), ref)
    total = np.where(own, 0, 1)
    while True:
        nxt = ptr[ptr]
        if (nxt == ptr).all():
            break
        total, ptr = total + total[ptr], nxt
    length = total + 1
    end = np.cumsum(length)
    start = end - length
    where = np.repeat(np.arange(n), length)
    at = np.arange(end[-1])
    src = np.where(own[where], at, start[ref[where]] + (at - start[where]))
    while True:
        nxt = src[src]
        if (nxt == src).all():
            break
        src = nxt
    return codes[where[src]].astype(np.uint8)


def lzw_decode(stream: bytes, bits: int, most: int) -> bytes:
    """The samples of a code stream with the given minimum code size; at most `most` of them.

    Between clear codes the width of the n-th code is known, so a segment's codes are read at once.
    """
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.int32)
    n_bits, pos, out, made = len(stream) * 8, 0, [], 0
    while pos < n_bits and made < most:
        codes, n = np.zeros(0, np.int32), 1024
        while True:  # codes from here to the next clear or end code; widths stay at 12 once the table is full
            w = _widths(n, bits)
            at = pos + np.cumsum(w) - w
            ok = np.searchsorted(at + w, n_bits, "right")
            w, at = w[:ok], at[:ok]
            byte = at >> 3
            codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (at & 7)) & ((1 << w) - 1)
            marks = np.flatnonzero((codes == clear) | (codes == end))
            if len(marks) or ok < n:
                break
            n *= 4
        n = int(marks[0]) if len(marks) else len(codes)
        if n:
            out.append(_expand(codes[:n], clear + 2).tobytes())
            made += len(out[-1])
        if not len(marks) or codes[n] == end:
            break
        pos = int(at[n] + w[n])
    return b"".join(out)[:most]


_GREY = bytes(i for v in range(256) for i in (v, v, v))


def encode(payload: bytes) -> bytes:
    """A GIF whose frames' samples, one after another, are the payload; its length is a positive multiple of 64."""
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, MAX_ROWS), 0xF7, 0, 0), _GREY]
    for top in range(0, rows, MAX_ROWS):
        part = payload[top * WIDTH : (top + MAX_ROWS) * WIDTH]
        # restore to background before the next frame: no pixel of this one stays
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 2 << 2, DELAY, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08")
        stream = lzw_encode(part)
        for k in range(0, len(stream), 255):
            block = stream[k : k + 255]
            out.append(bytes([len(block)]) + block)
        out.append(b"\0")
    out.append(b"\x3b")
    return b"".join(out)


def _blocks(gif: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while (n := gif[at]) > 0:
        parts.append(gif[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def play(gif: bytes, compose: bool = True) -> Iterator[Frame]:
    """The frames one by one, so that one canvas is held at a time.  Without compose the canvases aren't drawn."""
    try:
        yield from _played(gif, compose)
    except (IndexError, struct.error) as e:
        raise ValueError("GIF ends early") from e


def decode(gif: bytes, compose: bool = True) -> tuple[int, int, list[Frame]]:
    """Width, height and frames."""
    got = list(play(gif, compose))
    return *struct.unpack_from("<HH", gif, 6), got


def _played(gif: bytes, compose: bool) -> Iterator[Frame]:
    if gif[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", gif, 6)
    at = 13
    palette = None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        palette, at = np.frombuffer(gif[at : at + n], np.uint8).reshape(-1, 3), at + n
    if width * height > MAX_PIXELS:
        raise ValueError("GIF: canvas too large")
    canvas = np.zeros((height, width), "<u4") if compose else None  # a pixel's bytes: red, green, blue, opacity
    delay, disposal, clear = 0, 0, None
    while (kind := gif[at]) != 0x3B:
        if kind == 0x21:
            body, nxt = _blocks(gif, at + 2)
            if gif[at + 1] == 0xF9 and len(body) >= 4:
                bits, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear = bits >> 2 & 7, index if bits & 1 else None
            at = nxt
            continue
        if kind != 0x2C:
            raise ValueError("GIF: unknown block")
        left, top, w, h, bits = struct.unpack_from("<HHHHB", gif, at + 1)
        at += 10
        colours = palette
        if bits & 0x80:
            n = 3 << ((bits & 7) + 1)
            colours, at = np.frombuffer(gif[at : at + n], np.uint8).reshape(-1, 3), at + n
        size = gif[at]
        stream, at = _blocks(gif, at + 1)
        if not 1 <= size <= 8:
            raise ValueError("GIF: code size")
        if w * h > MAX_PIXELS:
            raise ValueError("GIF: frame too large")
        samples = lzw_decode(stream, size, w * h)
        if len(samples) < w * h:
            raise ValueError("GIF: frame ends early")
        if bits & 0x40:
            rows = np.frombuffer(samples, np.uint8).reshape(h, w)
            order = np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])
            straight = np.empty_like(rows)
            straight[order] = rows
            samples = straight.tobytes()
        shown = None
        if canvas is not None:
            before = canvas.copy() if disposal == 3 else None
            pixels = np.frombuffer(samples, np.uint8).reshape(h, w)
            paint = np.zeros((256, 4), np.uint8)
            paint[:, 3] = 255
            if colours is not None:
                paint[: len(colours), :3] = colours
            part = canvas[top : top + h, left : left + w]
            pixels = pixels[: part.shape[0], : part.shape[1]]
            drawn = paint.view("<u4")[:, 0][pixels]
            if clear is None:
                part[...] = drawn
            else:
                np.copyto(part, drawn, where=pixels != clear)
            shown = canvas.copy().view(np.uint8).reshape(height, width, 4)
            if disposal == 2:
                part[...] = 0
            elif disposal == 3:
                canvas = before
        yield Frame(left, top, w, h, delay, disposal, clear, samples, shown)
        delay, disposal, clear = 0, 0, None


def histogram(samples: bytes, bins: int = 16) -> list[int]:
    """Counts of the samples' values in equal bins."""
    return np.bincount(np.frombuffer(samples, np.uint8), minlength=256).reshape(bins, -1).sum(1).tolist()


def payload_of(text: str) -> tuple[bytes, int]:
    raw = text.encode("utf-8", "replace")
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"), len(raw)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: the text's payload as GIF bytes."""

    def make(batch: pa.RecordBatch) -> dict:
        got = [payload_of(t) for t in C.texts_of(batch, "text")]
        return {"doc_id": batch.column(0), "n_bytes": [g[1] for g in got], "media": [encode(g[0]) for g in got]}

    return C.per_batch(docs.select("doc_id", "text"), make, "doc_id long, n_bytes long, media binary", 256)


TIMED = "frame:int,start_cs:bigint,delay_cs:int,width:int,height:int,red:array<bigint>,green:array<bigint>,blue:array<bigint>"
DECODED = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames array<struct<{TIMED}>>"


def decoded(media: DataFrame) -> DataFrame:
    """A row for each row of media (doc_id, n_bytes, media): the payload's digests, and the timed frames with the colour histograms of their composed canvases.

    Media that can't be read have no frames and no digests of a payload.
    """

    def make(batch: pa.RecordBatch) -> dict:
        out: dict = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames")}
        for gif in batch.column(2).to_pylist():
            whole, n, tail, start, shown = hashlib.sha256(), 0, b"", 0, []
            try:
                for k, f in enumerate(play(gif or b"")):
                    whole.update(f.samples)
                    n, tail = n + len(f.samples), (tail + f.samples)[-64:] if len(f.samples) < 64 else f.samples[-64:]
                    height, width = f.canvas.shape[:2]
                    opaque = f.canvas[..., 3] > 0
                    red, green, blue = (histogram(f.canvas[..., c][opaque].tobytes()) for c in range(3))
                    shown.append({"frame": k, "start_cs": start, "delay_cs": f.delay_cs, "width": width, "height": height, "red": red, "green": green, "blue": blue})
                    start += f.delay_cs
                values = (n, whole.hexdigest(), crc32(tail))
            except ValueError:
                values, shown = (None, None, None), None
            media_of = (len(gif), hashlib.sha256(gif).hexdigest()) if gif is not None else (None, None)
            for name, v in zip(out, (*values, *media_of, shown), strict=True):
                out[name].append(v)
        return {"doc_id": batch.column(0), "n_bytes": batch.column(1)} | out

    return C.per_batch(media.select("doc_id", "n_bytes", "media"), make, DECODED, 64)


def frames(media: DataFrame, column: str = "media") -> DataFrame:
    """A row per frame of a media column: doc_id, frame, start_cs, delay_cs, width, height and the colour histogram of the composed canvas (16 bins each for red, green, blue)."""
    got = decoded(media.select("doc_id", F.lit(None).cast("long").alias("n_bytes"), F.col(column).alias("media")))
    return got.where("frames IS NULL OR size(frames) > 0").select("doc_id", F.explode_outer("frames").alias("f")).select("doc_id", "f.*")


def feature() -> Column:
    """Number and time of the frames, and the sums of their histograms: equal texts give equal frames."""
    none = F.array_repeat(F.lit(0).cast("long"), 16)
    band = lambda c: F.array_join(F.aggregate(F.transform("frames", lambda f: f[c]), none, lambda x, y: F.zip_with(x, y, lambda p, q: p + q)).cast("array<string>"), ",")
    time = F.aggregate(F.transform("frames", lambda f: f["delay_cs"].cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    return F.concat(F.size("frames"), F.lit(":"), time, F.lit(":"), F.concat_ws("|", *map(band, ("red", "green", "blue"))))


def op3_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media, _ = C.save(store(C.documents(spark, sf_dir)), "media")
    shown, _ = C.save(decoded(media), "frames")
    return shown.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature().alias("feature"), F.size("frames").alias("n_frames"))
