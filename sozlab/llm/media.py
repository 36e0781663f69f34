"""Media columns: texts stored as 8-bit greyscale PNG, read back, and hashed perceptually.

The bytes are laid out as image rows, each row gets a PNG line filter (none, sub or up, whichever has the smallest sum
of absolute residuals), the filtered rows go through zlib, and every chunk carries its CRC-32.  Reading
verifies signature, chunk checksums and header, inflates, and undoes any of the five standard filters.  The feature is a
low-frequency cosine-transform hash of the image that was read back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import documents_of, map_texts

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
#: Widest image row; longer payloads only get more rows.
MOST_WIDTH = 4096
LEVEL = 1
READ = (
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "cosine_hash binary, intact boolean"
)
SIDE, KEEP = 32, 8


def padded(data: bytes) -> bytes:
    """Zero bytes up to the next positive multiple of 64."""
    return data + bytes(-len(data) % 64 if data else 64)


def width_for(size: int) -> int:
    """A power-of-two row width near the square root that divides the payload's size."""
    width = WIDTH
    while width < MOST_WIDTH and width * width < size and size % (2 * width) == 0:
        width *= 2
    return width


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _residuals(rows: np.ndarray) -> list[np.ndarray]:
    """What the line filters none, sub and up leave of 8-bit greyscale rows."""
    sub, up = rows.copy(), rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    return [rows, sub, up]


def encode_png(data: bytes, width: int) -> bytes:
    """``data`` (a multiple of ``width`` bytes) as a greyscale PNG."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, width)
    kinds = _residuals(rows)
    costs = np.stack([np.abs(k.view(np.int8)).view(np.uint8).sum(axis=1, dtype=np.int64) for k in kinds])
    chosen = costs.argmin(axis=0).astype(np.uint8)
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = chosen
    for kind, residual in enumerate(kinds):
        lines[chosen == kind, 1:] = residual[chosen == kind]
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    body = zlib.compress(lines.tobytes(), LEVEL)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", body) + _chunk(b"IEND", b"")


def _chunks(stored: bytes) -> Iterator[tuple[bytes, bytes]]:
    if stored[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(stored):
        size, kind = struct.unpack(">I4s", stored[at : at + 8])
        data = stored[at + 8 : at + 8 + size]
        (crc,) = struct.unpack(">I", stored[at + 8 + size : at + 12 + size])
        if crc != zlib.crc32(kind + data):
            raise ValueError(f"checksum of chunk {kind!r} fails")
        yield kind, data
        at += 12 + size


def _undo_average(line: np.ndarray, up: np.ndarray) -> np.ndarray:
    out, left = bytearray(len(line)), 0
    for i, (x, b) in enumerate(zip(line.tolist(), up.tolist())):
        left = out[i] = (x + ((left + b) >> 1)) & 255
    return np.frombuffer(bytes(out), np.uint8)


def _undo_paeth(line: np.ndarray, up: np.ndarray) -> np.ndarray:
    out, left, corner = bytearray(len(line)), 0, 0
    for i, (x, b) in enumerate(zip(line.tolist(), up.tolist())):
        p = left + b - corner
        da, db, dc = abs(p - left), abs(p - b), abs(p - corner)
        best = left if da <= db and da <= dc else b if db <= dc else corner
        left = out[i] = (x + best) & 255
        corner = b
    return np.frombuffer(bytes(out), np.uint8)


def decode_png(stored: bytes) -> np.ndarray:
    """The 8-bit samples of a greyscale PNG as a matrix; raises ValueError where it is damaged."""
    parts = list(_chunks(stored))
    if not parts or parts[0][0] != b"IHDR" or parts[-1][0] != b"IEND":
        raise ValueError("header or end is missing")
    width, height, depth, colour, method, filters, interlaced = struct.unpack(">IIBBBBB", parts[0][1])
    if (depth, colour, method, filters, interlaced) != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit greyscale is read")
    raw = zlib.decompress(b"".join(d for k, d in parts if k == b"IDAT"))
    if len(raw) != height * (width + 1):
        raise ValueError("image data has the wrong size")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    out = np.empty((height, width), np.uint8)
    above = np.zeros(width, np.uint8)
    for y in range(height):
        kind, line = lines[y, 0], lines[y, 1:]
        if kind == 0:
            out[y] = line
        elif kind == 1:
            out[y] = np.add.accumulate(line, dtype=np.uint8)
        elif kind == 2:
            np.add(line, above, out=out[y])
        elif kind == 3:
            out[y] = _undo_average(line, above)
        elif kind == 4:
            out[y] = _undo_paeth(line, above)
        else:
            raise ValueError("unknown line filter")
        above = out[y]
    return out


def _cosine_basis() -> np.ndarray:
    n = np.arange(SIDE)
    return np.cos(np.pi * (2 * n[None, :] + 1) * np.arange(KEEP)[:, None] / (2 * SIDE))


BASIS = _cosine_basis()


def _shrunk(image: np.ndarray) -> np.ndarray:
    """The image averaged down (or repeated up) to SIDE x SIDE."""
    for axis in (0, 1):
        size = image.shape[axis]
        if size >= SIDE:
            edges = np.arange(SIDE + 1) * size // SIDE
            sums = np.add.reduceat(image.astype(np.float64), edges[:-1], axis=axis)
            counts = np.diff(edges).reshape((-1, 1) if axis == 0 else (1, -1))
            image = sums / counts
        else:
            image = np.take(image.astype(np.float64), np.arange(SIDE) * size // SIDE, axis=axis)
    return image


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: which low-frequency cosine coefficients exceed their median (the mean is left out of it)."""
    low = (BASIS @ _shrunk(image) @ BASIS.T).round(6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes()


def _stored(texts: list[str]) -> dict[str, list]:
    data = [t.encode("utf-8") for t in texts]
    payloads = map(padded, data)
    return {"n_bytes": list(map(len, data)), "png": [encode_png(p, width_for(len(p))) for p in payloads]}


def to_media(docs: DataFrame) -> DataFrame:
    """Each row's text as a PNG in a binary column: doc_id, n_bytes, png.

    Null and empty texts are 64 zero bytes; null ids stay null; repeated rows give repeated results; columns besides
    doc_id and text are ignored; an empty table gives none.
    """
    return map_texts(documents_of(docs), _stored, ["doc_id"], ["text"], "n_bytes long, png binary")


def described(stored: bytes | None) -> tuple:
    """What READ lists of a stored image; nulls and False where nothing is stored or the image is damaged."""
    if stored is None:
        return (None,) * 5 + (None, False)
    known = (len(stored), hashlib.sha256(stored).hexdigest())
    try:
        image = decode_png(stored)
    except (ValueError, struct.error, zlib.error):
        return (None, None, None, *known, None, False)
    back = image.tobytes()
    return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), *known, cosine_hash(image), True


def read_media(media: DataFrame, column: str = "png") -> DataFrame:
    """The table with its images read back: chunk checksums tested, lines unfiltered, hashed; ``column`` itself goes.

    payload_bytes, payload_sha256 and tail_crc32 (of the last 64 bytes) describe the samples, media_bytes and
    media_sha256 the stored form; cosine_hash is binary; intact tells whether the image could be read.  Of a damaged image
    the stored form only is described, of a null nothing; other columns, repeated rows and nulls stay as they are; columns
    of these names are replaced; an empty table gives none.
    """
    names = [f.split()[0] for f in READ.split(", ")]

    def features(images: list[bytes | None]) -> dict[str, list]:
        rows = [described(i) for i in images]
        return {n: [r[i] for r in rows] for i, n in enumerate(names)}

    return map_texts(media, features, [c for c in media.columns if c not in (*names, column)], [column], READ)


def media_features(docs: DataFrame) -> DataFrame:
    """Store every text as PNG, read it back and describe what was read: one row per input row, cosine_hash binary.

    Row for row: null and empty texts are 64 zero bytes; null ids stay null; repeated rows give repeated results;
    equal texts give equal values; columns besides doc_id and text are ignored; an empty table gives none.
    """
    return read_media(to_media(docs))
