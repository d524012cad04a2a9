import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from vacantia.llm import media

from .conftest import rows_of


def columns(docs):
    return media.digest(media.describe(media.store(docs)))


def read_png(data):
    """A PNG read by hand: chunks, inflation, one filter a row, sample by sample."""
    at, body, head = 8, b"", None
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        kind, held = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        assert int.from_bytes(data[at + 8 + size : at + 12 + size], "big") == zlib.crc32(kind + held)
        head = held if kind == b"IHDR" else head
        body += held if kind == b"IDAT" else b""
        at += 12 + size
    width, height = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    raw, rows = zlib.decompress(body), [[0] * width]
    for y in range(height):
        kind, line = raw[y * (width + 1)], raw[y * (width + 1) + 1 : (y + 1) * (width + 1)]
        own = []
        for x in range(width):
            own.append((line[x] + {0: 0, 1: own[x - 1] if x else 0, 2: rows[-1][x]}[kind]) % 256)
        rows.append(own)
    return rows[1:]


def slow_hash(rows):
    """Means of 32 x 32 blocks, the definition of the cosine transform, bits against the median."""
    h, w = len(rows), len(rows[0])
    spot = lambda k, n: range(k * n // 32, (k + 1) * n // 32) or range(min(k * n // 32, n - 1), min(k * n // 32, n - 1) + 1)
    small = [[np.mean([rows[y][x] for y in spot(i, h) for x in spot(j, w)]) for j in range(32)] for i in range(32)]
    cos = [[math.cos(math.pi * k * (2 * n + 1) / 64) for n in range(32)] for k in range(8)]
    low = [round(sum(small[i][j] * cos[u][i] * cos[v][j] for i in range(32) for j in range(32)), 6) for u in range(8) for v in range(8)]
    middle = float(np.median(low[1:]))
    return f"{sum(int(x > middle) << (63 - k) for k, x in enumerate(low)):016x}"


def test_stored_form_and_feature_by_hand(docs):
    some = docs.where("doc_id IN (0, 1, 2, 60, 62, 63, 90)")
    stored = {r.doc_id: bytes(r.media) for r in media.store(some).collect()}
    texts = {r.doc_id: r.text or "" for r in some.collect()}
    for r in columns(some).collect():
        rows = read_png(stored[r.doc_id])
        assert bytes(x for row in rows for x in row).rstrip(b" ") == texts[r.doc_id].encode().rstrip(b" ")
        assert (r.media_sha256, r.feature) == (hashlib.sha256(stored[r.doc_id]).hexdigest(), slow_hash(rows))


def test_columns_are_binary_and_long_texts_are_whole(spark):
    docs = spark.range(3).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 300000 + CAST(id AS INT)) AS text")
    stored = media.store(docs)
    assert dict(stored.dtypes)["media"] == dict(media.describe(stored).dtypes)["feature"] == "binary"
    for r in columns(docs).collect():
        raw = (f"word{r.doc_id} " * (300_000 + r.doc_id)).encode()
        assert r.n_bytes == len(raw) and r.payload_sha256 == hashlib.sha256(raw + b" " * (-len(raw) % 192)).hexdigest()


def test_payload_comes_back_whole(docs):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in columns(docs).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_all_filters_are_undone():
    rnd = np.random.default_rng(3)
    image = rnd.integers(0, 256, (12, 20)).astype(np.uint8)
    kinds = np.array([0, 1, 2, 3, 4, 4, 3, 2, 1, 0, 2, 2])
    lines = np.zeros_like(image)
    for y, kind in enumerate(kinds):
        for x in range(20):
            a = int(image[y, x - 1]) if x else 0
            b = int(image[y - 1, x]) if y else 0
            c = int(image[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            lines[y, x] = (int(image[y, x]) - [0, a, b, (a + b) // 2, near][kind]) % 256
    assert (media.unfilter(kinds, lines) == image).all()


def test_damage_is_found():
    data = bytearray(media.encode_png(media.payload_of("abc" * 500)[0]))
    for at in random.Random(1).sample(range(len(data)), 40):
        bad = bytes(data[:at]) + bytes([data[at] ^ 1]) + bytes(data[at + 1 :])
        with pytest.raises((ValueError, zlib.error)):
            media.decode_png(bad)


def test_hash_follows_the_image():
    rnd = np.random.default_rng(1)
    smooth = np.cumsum(rnd.normal(size=(96, media.WIDTH)), axis=1)
    smooth = np.interp(smooth, (smooth.min(), smooth.max()), (0, 250))
    near = int.from_bytes(media.cosine_hash(smooth)) ^ int.from_bytes(media.cosine_hash(smooth + rnd.normal(size=smooth.shape)))
    far = int.from_bytes(media.cosine_hash(smooth)) ^ int.from_bytes(media.cosine_hash(smooth[::-1, ::-1]))
    assert near.bit_count() <= 4 < far.bit_count()


def test_equal_texts_empty_table_and_clashing(docs, empty, clashing):
    rows = columns(docs).collect()
    assert len({tuple(r)[1:] for r in rows if 65 <= (r.doc_id or 0) < 90}) == 1
    assert columns(empty).count() == 0
    assert rows_of(columns(clashing)) == rows_of(columns(docs))
