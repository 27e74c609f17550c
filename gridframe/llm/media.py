"""Media columns: PNG images in binary columns.

``encode`` and ``decode`` write and read 8-bit PNG of one to four channels: chunks with checksums, zlib data, and the five
row filters undone with numpy.  ``dct_hash`` keeps the signs of an image's low frequencies.  ``as_media`` stores any
bytes as pixels, losslessly, and reads them back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridframe.llm.common import map_batches, utf8

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Colour type of each number of channels.
COLOUR = {1: 0, 2: 4, 3: 2, 4: 6}
CHANNELS = {0: 1, 4: 2, 2: 3, 6: 4}
#: Pixels in a row of stored payloads: 64 pixels of 3 channels are the 192 bytes to which payloads are padded.
WIDTH = 64
ROW = 3 * WIDTH
#: Row filter of stored payloads (bytes less those of the pixel to the left), which reading back undoes at once.
FILTER = 1
IDAT = 1 << 20
GRID, LOW = 32, 8


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def _filtered(rows: np.ndarray, bpp: int, kind: int) -> np.ndarray:
    """Row filter ``kind`` applied to bytes (height, width * bpp)."""
    left = np.zeros_like(rows)
    left[:, bpp:] = rows[:, :-bpp]
    up = np.zeros_like(rows)
    up[1:] = rows[:-1]
    if kind == 0:
        return rows
    if kind == 1:
        return rows - left
    if kind == 2:
        return rows - up
    if kind == 3:
        return rows - ((left.astype(np.uint16) + up) >> 1).astype(np.uint8)
    corner = np.zeros_like(rows)
    corner[1:, bpp:] = rows[:-1, :-bpp]
    return rows - _paeth(left.astype(np.int16), up.astype(np.int16), corner.astype(np.int16))


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    p = a + b - c
    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c)).astype(np.uint8)


def encode(pixels: np.ndarray, kind: int = 0, level: int = 1) -> bytes:
    """PNG of 8-bit ``pixels`` (height, width, channels), all rows with row filter ``kind`` (0 to 4)."""
    height, width, bpp = pixels.shape
    rows = _filtered(pixels.reshape(height, width * bpp), bpp, kind)
    raw = np.empty((height, width * bpp + 1), np.uint8)
    raw[:, 0], raw[:, 1:] = kind, rows
    data = zlib.compress(raw.tobytes(), level)
    parts = [_chunk(b"IDAT", data[i : i + IDAT]) for i in range(0, len(data), IDAT)]
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, COLOUR[bpp], 0, 0, 0)) + b"".join(parts) + _chunk(b"IEND", b"")


def chunks(png: bytes):
    """(kind, body) of each chunk; ValueError where a checksum or length is wrong."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("truncated chunk")
        n, kind = struct.unpack_from(">I4s", png, at)
        if at + 12 + n > len(png):
            raise ValueError("truncated chunk")
        body = png[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", png, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of {kind!r}")
        yield kind, body
        at += 12 + n
        if kind == b"IEND":
            return
    raise ValueError("no end chunk")


def _unfiltered(kinds: np.ndarray, rows: np.ndarray, bpp: int) -> np.ndarray:
    """Row filters undone; runs of rows with one of the filters 0 to 2 are undone at once, sums wrapping at 256."""
    out = np.empty_like(rows)
    height, n = rows.shape
    ends = np.append(np.flatnonzero(np.diff(kinds)) + 1, height)
    y = 0
    for end in ends.tolist():
        k, part = int(kinds[y]), rows[y:end]
        if k == 0:
            out[y:end] = part
        elif k == 1:
            out[y:end] = np.cumsum(part.reshape(-1, n // bpp, bpp), axis=1, dtype=np.uint8).reshape(-1, n)
        elif k == 2:
            out[y:end] = np.cumsum(part, axis=0, dtype=np.uint8)
            if y:
                out[y:end] += out[y - 1]
        elif k in (3, 4):
            for r in range(y, end):
                up = out[r - 1].reshape(-1, bpp).astype(np.int16) if r else np.zeros((n // bpp, bpp), np.int16)
                line, left, corner = rows[r].reshape(-1, bpp), np.zeros(bpp, np.int16), np.zeros(bpp, np.int16)
                own = out[r].reshape(-1, bpp)
                for x in range(n // bpp):
                    guess = ((left + up[x]) >> 1).astype(np.uint8) if k == 3 else _paeth(left, up[x], corner)
                    own[x] = line[x] + guess
                    left, corner = own[x].astype(np.int16), up[x]
        else:
            raise ValueError(f"row filter {k}")
        y = end
    return out


def decode(png: bytes) -> np.ndarray:
    """Pixels (height, width, channels) of an 8-bit PNG without palette or interlace; ValueError for anything else."""
    head, data = None, []
    for kind, body in chunks(png):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[4:] != (0, 0, 0):
        raise ValueError(f"unsupported PNG: {head}")
    width, height, bpp = head[0], head[1], CHANNELS[head[3]]
    try:
        raw = zlib.decompress(b"".join(data))
    except zlib.error as e:
        raise ValueError(str(e)) from None
    if len(raw) != height * (width * bpp + 1):
        raise ValueError("wrong amount of image data")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width * bpp + 1)
    return _unfiltered(lines[:, 0], lines[:, 1:], bpp).reshape(height, width, bpp)


def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(GRID)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * GRID))


_COSINES = _cosines()


def _shrunk(a: np.ndarray, axis: int) -> np.ndarray:
    """Means of ``GRID`` stretches along an axis; short axes repeat."""
    n = a.shape[axis]
    starts = np.arange(GRID) * n // GRID
    if n < GRID:
        return np.take(a, starts, axis=axis)
    sums = np.add.reduceat(a, starts, axis=axis, dtype=np.float64)
    shape = [1, 1]
    shape[axis] = GRID
    return sums / np.diff(np.append(starts, n)).reshape(shape)


def dct_hash(pixels: np.ndarray) -> bytes:
    """8 bytes: which of the lowest 8 x 8 cosine coefficients of the grey image lie above their median."""
    grey = pixels.mean(axis=2) if pixels.shape[2] > 1 else pixels[:, :, 0].astype(np.float64)
    small = _shrunk(_shrunk(grey, 0), 1)
    low = np.round(_COSINES @ small @ _COSINES.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def as_media(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``media`` (the PNG), ``hash`` (binary), and what was read back: lengths and digests of the payload.

    A payload is the text's UTF-8 with spaces up to a positive multiple of 192 bytes; a null text is an empty one.  Null
    ids and repeated rows pass through; other columns are ignored; equal texts give equal values.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t in b.column("text"):
            text = t.as_py() or b""
            payload = text + b" " * (-len(text) % ROW or ROW * (not text))
            png = encode(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3), FILTER)
            pixels = decode(png)
            back = pixels.tobytes()
            rows.append((png, dct_hash(pixels), len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), hashlib.sha256(png).hexdigest()))
        cols = list(zip(*rows, strict=True))
        kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "media", "hash", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_sha256"])

    schema = f"doc_id {kind}, media binary, hash binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string"
    return map_batches(docs.select("doc_id", utf8().alias("text")), run, schema)


def read_media(images: DataFrame) -> DataFrame:
    """``doc_id``, ``hash``, ``payload_bytes``, ``payload_sha256`` and ``fault`` of each row of ``images`` (``doc_id``, ``media``; others ignored).

    A missing or damaged image has nulls and a ``fault`` that says why; others have a null ``fault``.  Null ids and repeated
    rows pass through; an empty table gives none.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for m in b.column("media"):
            try:
                if not m.is_valid:
                    raise ValueError("no image")
                pixels = decode(m.as_py())
                back = pixels.tobytes()
                rows.append((dct_hash(pixels), len(back), hashlib.sha256(back).hexdigest(), None))
            except (ValueError, struct.error, zlib.error) as e:
                rows.append((None, None, None, str(e) or type(e).__name__))
        cols = zip(*rows, strict=True)
        arrays = [pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int64(), pa.string(), pa.string()), strict=True)]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *arrays], ["doc_id", "hash", "payload_bytes", "payload_sha256", "fault"])

    kind = images.schema["doc_id"].dataType.simpleString()
    return map_batches(images.select("doc_id", "media"), run, f"doc_id {kind}, hash binary, payload_bytes long, payload_sha256 string, fault string")


def op5_media(docs: DataFrame) -> DataFrame:
    """The digest of ``as_media``: the feature is the cosine hash as hex digits."""
    from pyspark.sql import functions as F

    return as_media(docs).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.length("media").cast("long").alias("media_bytes"), "media_sha256", F.lower(F.hex("hash")).alias("feature"))
