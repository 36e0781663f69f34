"""Media columns against zlib, hashlib and a cosine transform written out."""

import hashlib
import math
import zlib

import numpy as np

from sozlab.llm import media


def plain_hash(image: np.ndarray) -> str:
    """Averages over the cells of a 32 x 32 grid, the 8 x 8 lowest cosine coefficients, bits above the median."""
    rows, columns = image.shape
    grid = [[0.0] * 32 for _ in range(32)]
    for y in range(32):
        for x in range(32):
            ys = range(y * rows // 32, max((y + 1) * rows // 32, y * rows // 32 + 1))
            xs = range(x * columns // 32, max((x + 1) * columns // 32, x * columns // 32 + 1))
            cells = [float(image[j, i]) for j in ys for i in xs]
            grid[y][x] = sum(cells) / len(cells)
    low = [
        round(sum(grid[y][x] * math.cos(math.pi * (2 * y + 1) * v / 64) * math.cos(math.pi * (2 * x + 1) * u / 64) for y in range(32) for x in range(32)), 6)
        for v in range(8) for u in range(8)
    ]
    rest = sorted(low[1:])
    middle = rest[len(rest) // 2]
    return f"{int(''.join('1' if c > middle else '0' for c in low), 2):016x}"


def test_columns_match_brute_force(spark):
    texts = ["", None, "abc", "x" * 64, "ə" * 1000, "Some words, and more. " * 700, "abc"]
    docs = spark.createDataFrame([(i, t, b"clash") for i, t in enumerate(texts)], "doc_id long, text string, png binary").repartition(2)
    rows = {r.doc_id: r for r in media.media_features(docs).collect()}
    stored = {r.doc_id: bytes(r.png) for r in media.to_media(docs).collect()}
    assert set(rows) == set(range(len(texts)))
    for i, text in enumerate(texts):
        data = (text or "").encode()
        payload = data + b"\0" * ((64 - len(data) % 64) if len(data) % 64 or not data else 0)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.intact
        assert (r.media_bytes, r.media_sha256) == (len(stored[i]), hashlib.sha256(stored[i]).hexdigest())
        assert bytes(r.cosine_hash).hex() == plain_hash(media.decode_png(stored[i]))


def test_damaged_and_missing_images_are_told(spark):
    good = media.encode_png(bytes(range(64)) * 4, 64)
    images = [good, good[:40] + bytes([good[40] ^ 1]) + good[41:], good[:30], b"", None, b"\x89PNG\r\n\x1a\n"]
    frame = spark.createDataFrame(list(enumerate(images)), "id long, image binary")
    rows = sorted(media.read_media(frame, "image").collect())
    assert [r.intact for r in rows] == [True] + [False] * 5
    assert [r.media_bytes for r in rows] == [len(i) if i is not None else None for i in images]
    assert rows[0].payload_bytes == 256 and all(r.cosine_hash is None and r.payload_sha256 is None for r in rows[1:])
    assert media.read_media(frame.limit(0), "image").count() == 0
