"""Media columns: texts as grey PNG images, and low-frequency cosine-transform hashes of them.

A payload is stored 192 samples a row in a PNG of its own: signature, IHDR, zlib-compressed IDAT
chunks, IEND, each chunk with its CRC. Rows carry the PNG filter (none, sub or up) whose residuals
sum least. Reading tests the signature and every chunk's CRC, inflates, and undoes all five filters
with numpy. The hash scales the samples to 32 x 32 by block means, applies a two-dimensional cosine
transform, and keeps one bit for each of the 64 lowest frequencies: above their median or not.

Two steps, each a column: ``store`` makes the binary column ``media``; ``describe`` reads that column
back and makes the binary column ``feature``. Nothing is shuffled. Rows are filtered and compressed in
strips of ``STRIP``, so a text of any length takes some four times its bytes; an Arrow batch of texts
comes in, and rows go out once their images exceed ``BATCH_BYTES``.

Defined results: null counts as empty; an empty text is one row of 192 spaces; equal texts give equal
values; a doc_id is a long; other columns are ignored; any length is stored whole (IDAT chunks hold at
most 1 MiB each).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
IDAT_BYTES = 1 << 20
LEVEL = 6
SIDE, LOW = 32, 8
STRIP = 4096
BATCH_BYTES = 16 << 20


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with spaces to a positive multiple of the width, and their number before."""
    raw = (text or "").encode()
    rows = max(1, -(-len(raw) // WIDTH))
    return raw.ljust(rows * WIDTH, b" "), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _filtered(rows: np.ndarray, above: np.ndarray) -> bytes:
    """Rows behind the number of the filter that suits each; ``above`` is the row before the first."""
    up = np.vstack((above[None, :], rows[:-1]))
    left = np.hstack((np.zeros((len(rows), 1), np.uint8), rows[:, :-1]))
    tries = np.stack((rows, rows - left, rows - up))  # filters 0, 1, 2; uint8 wraps as PNG asks
    best = np.abs(tries.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0)
    return np.hstack((best[:, None].astype(np.uint8), tries[best, np.arange(len(rows))])).tobytes()


def encode_png(payload: bytes) -> bytes:
    """8-bit grey PNG of the payload, rows of WIDTH samples."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    deflate, above, packed = zlib.compressobj(LEVEL), np.zeros(WIDTH, np.uint8), bytearray()
    for k in range(0, len(rows), STRIP):
        packed += deflate.compress(_filtered(rows[k : k + STRIP], above))
        above = rows[min(k + STRIP, len(rows)) - 1]
    packed += deflate.flush()
    parts = [_chunk(b"IDAT", bytes(packed[k : k + IDAT_BYTES])) for k in range(0, len(packed), IDAT_BYTES)]
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"".join([SIGNATURE, _chunk(b"IHDR", head), *parts, _chunk(b"IEND", b"")])


def _paeth(line: np.ndarray, above: np.ndarray, out: np.ndarray) -> None:
    left = corner = 0
    for k in range(len(line)):
        up = int(above[k])
        p = left + up - corner
        near = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
        left = (int(line[k]) + near) & 255
        out[k] = left
        corner = up


def unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Undo the PNG filters of one-byte samples."""
    out = lines.copy()
    sub = kinds == 1
    out[sub] = np.add.accumulate(lines[sub], axis=1, dtype=np.uint8)
    rest = np.flatnonzero(kinds > 1)
    if not len(rest):
        return out
    if (kinds[rest] == 2).all():  # runs of "up" rows are running sums down from the row before
        breaks = np.flatnonzero(np.diff(rest) > 1) + 1
        for run in np.split(rest, breaks):
            base = out[run[0] - 1] if run[0] else np.zeros(lines.shape[1], np.uint8)
            out[run] = np.add.accumulate(lines[run], axis=0, dtype=np.uint8) + base
        return out
    for k in rest:
        above = out[k - 1] if k else np.zeros(lines.shape[1], np.uint8)
        if kinds[k] == 2:
            out[k] = lines[k] + above
        elif kinds[k] == 3:
            left = 0
            for x in range(lines.shape[1]):
                left = (int(lines[k, x]) + (left + int(above[x])) // 2) & 255
                out[k, x] = left
        else:
            _paeth(lines[k], above, out[k])
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit grey PNG as rows; raises ValueError where a test fails."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG signature")
    at, head, parts, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("the file ends inside a chunk")
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError(f"checksum of chunk {kind!r} does not hold")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("no whole 8-bit grey image")
    width, height = head[:2]
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    if len(lines) != height * (width + 1):
        raise ValueError("the image data has another size than its header")
    lines = lines.reshape(height, width + 1)
    if lines[:, 0].max(initial=0) > 4:
        raise ValueError("unknown filter")
    return unfilter(lines[:, 0], lines[:, 1:])


def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE))


_COS = _cosines()


def block_means(image: np.ndarray) -> np.ndarray:
    """The image scaled to SIDE x SIDE; where it has fewer rows or columns, they repeat."""
    out = image
    for axis in (0, 1):
        size = image.shape[axis]
        at = np.arange(SIDE + 1) * size // SIDE
        begin, held = np.minimum(at[:-1], size - 1), np.maximum(at[1:] - at[:-1], 1)
        sums = np.add.reduceat(out, begin, axis=axis, dtype=np.float64)
        out = sums / (held[:, None] if axis == 0 else held[None, :])
    return out


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: which of the lowest 8 x 8 cosine coefficients exceed their median (all but the first's)."""
    low = np.round(_COS @ block_means(image) @ _COS.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


STORED = "doc_id long, n_bytes long, media binary"
DESCRIBED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature binary"
_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def store(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: every whole text as a PNG in a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                payload, n_bytes = payload_of(text.as_py())
                rows.append({"doc_id": doc.as_py(), "n_bytes": n_bytes, "media": encode_png(payload)})
                size += len(rows[-1]["media"])
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, _STORED)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _STORED)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, STORED)


def describe(stored: DataFrame) -> DataFrame:
    """What the images of a column ``media`` hold once they are read back, and their hash as the binary column ``feature``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in DESCRIBED.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        types = [kinds[f.split()[1]] for f in DESCRIBED.split(", ")]
        for batch in batches:
            rows = []
            for doc, size, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = media.as_py()
                image = decode_png(data)
                back = memoryview(image).cast("B")
                rows.append((doc, size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(image)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, DESCRIBED)


def digest(described: DataFrame) -> DataFrame:
    return described.withColumn("feature", F.lower(F.hex("feature")))
