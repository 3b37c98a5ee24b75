"""Media columns: a text's bytes as an 8-bit greyscale PNG, read back through its zlib chunks with checksum
tests and numpy unfiltering, and a hash of the image's low cosine frequencies in a binary column.

A payload is padded with bytes 255 to a positive multiple of the row width, one byte a pixel; a null or empty
text is one row of padding. Equal payloads give equal files and hashes. Damaged files raise ValueError, which
names the failing test. Very long texts only make taller images. An empty table gives an empty result. Columns by the
new names are replaced.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, trimmed

WIDTH = 576
#: Rows of one image strip that the cosine transform sees; the side of its low-frequency square.
GRID = 32
LOW = 8
# Fixed values of the format: its signature, and bytes a pixel by colour type at eight bits.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """Greyscale rows of `width` bytes; of the filters none and up, the one that leaves the smaller sum over the image."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    up = rows.copy()
    up[1:] -= rows[:-1]
    kind = 2 if int(up.view(np.int8).astype(np.int32).__abs__().sum()) < int(rows.view(np.int8).astype(np.int32).__abs__().sum()) else 0
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = up if kind else rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def chunks(png: bytes):
    """Kind and body of each chunk; each checksum is tested."""
    if png[:8] != SIGNATURE:
        raise ValueError("signature")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("truncated chunk")
        size, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + size]
        if len(body) < size or len(png) < at + 12 + size:
            raise ValueError("truncated chunk")
        if zlib.crc32(kind + body) != struct.unpack(">I", png[at + 8 + size : at + 12 + size])[0]:
            raise ValueError(f"checksum of {kind.decode('latin-1')}")
        yield kind, body
        at += 12 + size


def _unfilter(lines: np.ndarray, kinds: np.ndarray, bpp: int) -> np.ndarray:
    """Rows of samples from filtered rows. Runs of rows with filters none and up go in one step; sub is a running sum."""
    out = np.empty_like(lines)
    n, width = lines.shape
    i = 0
    while i < n:
        j = i + 1
        while j < n and kinds[j] == kinds[i]:
            j += 1
        kind, above = kinds[i], out[i - 1] if i else np.zeros(width, np.uint8)
        if kind == 0:
            out[i:j] = lines[i:j]
        elif kind == 1:
            pixels = lines[i:j].reshape(j - i, -1, bpp)
            out[i:j] = np.add.accumulate(pixels, axis=1, dtype=np.uint8).reshape(j - i, width)
        elif kind == 2:
            out[i:j] = np.add.accumulate(np.vstack([above[None], lines[i:j]]), axis=0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            for r in range(i, j):
                above = out[r - 1] if r else np.zeros(width, np.uint8)
                left, corner = np.zeros(bpp, np.int32), np.zeros(bpp, np.int32)
                for x in range(0, width, bpp):
                    b = above[x : x + bpp].astype(np.int32)
                    if kind == 3:
                        guess = (left + b) // 2
                    else:
                        p = left + b - corner
                        da, db, dc = abs(p - left), abs(p - b), abs(p - corner)
                        guess = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, b, corner))
                    left = (lines[r, x : x + bpp] + guess) & 255
                    out[r, x : x + bpp] = left
                    corner = b
        else:
            raise ValueError(f"filter {kind}")
        i = j
    return out


def decode_png(png: bytes) -> np.ndarray:
    """Samples of an 8-bit, not interlaced PNG as rows of bytes."""
    head, data, ended = None, [], False
    for kind, body in chunks(png):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            ended = True
    if head is None or not ended or not data:
        raise ValueError("missing chunk")
    width, height, depth, colour, _, _, interlace = head
    if depth != 8 or interlace or colour not in CHANNELS:
        raise ValueError("unsupported image")
    bpp = CHANNELS[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if len(raw) != height * (width * bpp + 1):
        raise ValueError("size of image data")
    lines = raw.reshape(height, width * bpp + 1)
    return _unfilter(lines[:, 1:], lines[:, 0], bpp)


def _cosines(n: int) -> np.ndarray:
    k, x = np.mgrid[0:LOW, 0:n]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


_BASIS = _cosines(GRID)


def dct_hash(image: np.ndarray) -> bytes:
    """64 bits: whether each of the 8 x 8 lowest cosine coefficients of the image, averaged to a 32 x 32 grid, is above their median.

    Sums are of integers until the averages are taken, so that equal images give equal hashes everywhere.
    """
    h, w = image.shape
    rows = np.linspace(0, h, GRID + 1).astype(np.int64)
    cols = np.linspace(0, w, GRID + 1).astype(np.int64)
    wide = np.add.reduceat(image.astype(np.int64), np.minimum(cols[:-1], w - 1), axis=1)
    up = np.concatenate([np.zeros((1, GRID), np.int64), np.cumsum(wide, axis=0)])
    lo, hi = rows[:-1], np.maximum(rows[1:], np.minimum(rows[:-1] + 1, h))
    lo = np.minimum(lo, hi - 1)
    area = (hi - lo)[:, None] * np.maximum(1, np.diff(cols))[None]
    grid = (up[hi] - up[lo]) / area
    low = np.round(_BASIS @ grid @ _BASIS.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


MEDIA = "n_bytes long, payload binary, media binary, phash binary"


def to_media(docs: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """docs with n_bytes (unpadded), media (PNG), payload (samples read back from media) and phash (8 bytes)."""
    small_batches(docs.sparkSession)
    new = ["n_bytes", "payload", "media", "phash"]
    kept = docs.drop(*new)
    at = kept.columns.index(text)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields] + [MEDIA])

    names = [*kept.columns, *new]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                raw = [t or b"" for t in part.column(at).cast(pa.binary()).to_pylist()]
                files, back, hashes = [], [], []
                for t in raw:
                    files.append(encode_png(t + b"\xff" * (-len(t) % width if t else width), width))
                    image = decode_png(files[-1])
                    back.append(image.tobytes())
                    hashes.append(dct_hash(image))
                extra = [pa.array([len(t) for t in raw], pa.int64()), *(pa.array(x, pa.binary()) for x in (back, files, hashes))]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=names)

    return kept.mapInArrow(trimmed(run), schema)


def read_media(df: DataFrame, media: str = "media") -> DataFrame:
    """df with the samples of a PNG column, its hash and, for a damaged or null file, the failing test's name."""
    small_batches(df.sparkSession)
    new = ["payload", "phash", "media_error"]
    kept = df.drop(*new)
    at = kept.columns.index(media)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields] + ["payload binary, phash binary, media_error string"])

    names = [*kept.columns, *new]

    def one(png):
        if png is None:
            return None, None, "null"
        try:
            image = decode_png(png)
        except (ValueError, zlib.error, struct.error) as e:
            return None, None, str(e)
        return image.tobytes(), dct_hash(image), None

    def run(batches):
        for batch in batches:
            got = [one(x) for x in batch.column(at).to_pylist()]
            extra = [pa.array([g[i] for g in got], k) for i, k in enumerate((pa.binary(), pa.binary(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=names)

    return kept.mapInArrow(trimmed(run), schema)


def report(media: DataFrame) -> DataFrame:
    size = F.octet_length("payload")
    return media.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2(F.col("payload"), 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2(F.col("media"), 256).alias("media_sha256"),
        F.lower(F.hex("phash")).alias("feature"),
    )
