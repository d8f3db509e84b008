"""Media columns: payloads as PNG images, read back and hashed by their low frequencies.

``encode`` stores bytes losslessly as an 8-bit grey PNG, 64 samples a row, with
signature, IHDR, IDAT (zlib) and IEND chunks and their CRC-32; each row takes
the filter (none, sub, up) of the least sum of differences.  ``decode`` walks
the chunks, tests every checksum, inflates and unfilters with numpy (all five
filter types, 1 to 4 channels of 8 bits) and gives the samples.  The feature is
a 64-bit perceptual hash: the image is averaged to 32 x 32, taken through a
two-dimensional cosine transform, and the 8 x 8 lowest frequencies are compared
with their median.

Defined results: a null or empty text is 64 zero bytes.  A text of a multiple
of 64 bytes is not padded.  Damaged media raise an error in ``decode`` and give
null features in ``media_features``.  Equal texts, repeated rows among them, give equal media; each row has its own, and a null doc_id is kept.
Very long texts are stored whole, 64 samples a row, about 4 MB of text (one text at least) at a time.  An empty table gives an empty table.  Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import arrow_map, slices

WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_SIDE, _LOW = 32, 8
_COS = np.cos(np.pi / _SIDE * (np.arange(_SIDE) + 0.5) * np.arange(_LOW)[:, None])


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with zeros to a positive multiple of the width, and their number before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH), len(raw)


def encode(data: bytes, level: int = 1) -> bytes:
    """A grey PNG whose samples are ``data`` (a positive multiple of 64 bytes)."""
    rows = np.frombuffer(data, dtype=np.uint8).reshape(-1, WIDTH)
    sub, up = rows.copy(), rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    cost = [np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1) for x in (rows, sub, up)]
    best = np.argmin(cost, axis=0)
    lines = np.empty((len(rows), WIDTH + 1), dtype=np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = np.where((best == 0)[:, None], rows, np.where((best == 1)[:, None], sub, up))
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _chunks(media: bytes) -> Iterator[tuple[bytes, bytes]]:
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG signature")
    at = 8
    while at < len(media):
        if at + 12 > len(media):
            raise ValueError("cut-off chunk")
        (n,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if len(data) < n or at + 12 + n > len(media):
            raise ValueError("cut-off chunk")
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + data):
            raise ValueError(f"checksum of chunk {kind!r}")
        yield kind, data
        at += 12 + n
        if kind == b"IEND":
            return
    raise ValueError("no IEND chunk")


def _unfilter(lines: np.ndarray, filters: np.ndarray, bpp: int) -> np.ndarray:
    """Samples of filtered rows; runs of rows with one filter go together where they don't depend on each other."""
    out = np.zeros_like(lines)
    h, w = lines.shape
    blank = np.zeros(w, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(filters, prepend=-1, append=-1))
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        kind = filters[a]
        if kind == 0:
            out[a:z] = lines[a:z]
        elif kind == 1:
            out[a:z] = np.cumsum(lines[a:z].reshape(z - a, -1, bpp), axis=1, dtype=np.uint8).reshape(z - a, w)
        elif kind == 2:
            above = out[a - 1] if a else blank
            out[a:z] = np.cumsum(lines[a:z], axis=0, dtype=np.uint8) + above
        elif kind in (3, 4):
            for y in range(a, z):
                up = (out[y - 1] if y else blank).astype(np.int32)
                row = np.zeros(w + bpp, dtype=np.int32)
                corner = np.concatenate([np.zeros(bpp, dtype=np.int32), up])
                for x in range(w):
                    left, over, diag = row[x], up[x], corner[x]
                    if kind == 3:
                        guess = (left + over) // 2
                    else:
                        p = left + over - diag
                        pa_, pb, pc = abs(p - left), abs(p - over), abs(p - diag)
                        guess = left if pa_ <= pb and pa_ <= pc else over if pb <= pc else diag
                    row[x + bpp] = (int(lines[y, x]) + guess) & 255
                out[y] = row[bpp:]
        else:
            raise ValueError(f"filter {kind}")
    return out


def decode(media: bytes) -> np.ndarray:
    """Samples (height, width * channels) of an 8-bit PNG without interlacing."""
    head, data = None, []
    for kind, part in _chunks(media):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            data.append(part)
    if head is None or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[4:] != (0, 0, 0):
        raise ValueError("unsupported header")
    bpp = {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    raw = zlib.decompress(b"".join(data))
    if len(raw) != head[1] * (head[0] * bpp + 1):
        raise ValueError("wrong number of samples")
    lines = np.frombuffer(raw, dtype=np.uint8).reshape(head[1], head[0] * bpp + 1)
    return _unfilter(lines[:, 1:], lines[:, 0].astype(np.int16), bpp)


def _averaged(image: np.ndarray, n: int, axis: int) -> np.ndarray:
    """``n`` averages along an axis; a shorter axis repeats its values."""
    size = image.shape[axis]
    if size < n:
        return np.take(image, np.arange(n) * size // n, axis=axis)
    cut = np.arange(n) * size // n
    shape = [1, 1]
    shape[axis] = n
    return np.add.reduceat(image, cut, axis=axis) / np.diff(np.append(cut, size)).reshape(shape)


def cosine_hash(samples: np.ndarray) -> str:
    """16 hex digits: which of the 8 x 8 lowest frequencies are above their median."""
    small = _averaged(_averaged(samples.astype(np.float64), _SIDE, 0), _SIDE, 1)
    low = (_COS @ small @ _COS.T).ravel()
    # a small tolerance, so that equal values don't fall on both sides
    bits = low > np.median(low) + 1e-9
    return np.packbits(bits).tobytes().hex()


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a PNG column."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch, "text"):
            made = [payload(t.as_py()) for t in part.column("text")]
            yield {"doc_id": part.column("doc_id"), "n_bytes": [n for _, n in made], "media": [encode(d) for d, _ in made]}

    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), run, "doc_id bigint, n_bytes bigint, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Features of a ``media`` column, read back from its bytes; other columns doc_id and n_bytes."""
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch, "media"):
            out: dict[str, list] = {k: [] for k in names}
            for value in part.column("media"):
                raw = value.as_py()
                row: tuple = (None,) * len(names)
                if raw is not None:
                    try:
                        samples = decode(raw)
                    except (ValueError, zlib.error):
                        samples = None
                    if samples is not None:
                        data = samples.tobytes()
                        row = (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), cosine_hash(samples), samples.shape[1], samples.shape[0])
                for k, v in zip(names, row, strict=True):
                    out[k].append(v)
            yield {"doc_id": part.column("doc_id"), "n_bytes": part.column("n_bytes"), **out}

    return arrow_map(media, run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, width int, height int")


def op3_media_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
