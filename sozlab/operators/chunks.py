"""Chunks by sentence and by structure, with byte offsets."""

from __future__ import annotations

import regex
from pyspark.sql import DataFrame

from ..functions import tokens
from .rows import map_rows

MOST_CHUNKS, SHORT = 10_000, 10
DEFAULT_SIZE, DEFAULT_OVERLAP = 512, 50
CHUNKS = "array<struct<text:string,start:int,end:int,index:int>>"


def _same_rule(pattern: str) -> regex.Pattern:
    """A pattern of the column expressions, for the words of which Java and Python differ."""
    return regex.compile(pattern.replace(r"\s\x{85}", r"\t\n\x0b\f\r \x85").replace(r"\s", r"[\t\n\x0b\f\r ]").replace("(?iu:", "(?i:"))


SENTENCE, TOKEN = _same_rule(tokens.SENTENCE_BREAK), _same_rule(tokens.TOKEN)
PARAGRAPH = regex.compile(r"(?s).*?\n\n|.+")


def _cut(text: str, places: list[int]) -> list[str]:
    edges = [0, *places, len(text)]
    return [text[a:b] for a, b in zip(edges, edges[1:]) if b > a]


def sentences(text: str) -> list[str]:
    return _cut(text, [m.start() for m in SENTENCE.finditer(text)])


def _spans(pieces: list[str], groups: list[tuple[int, int]]) -> list[dict]:
    """Chunks of groups of neighbouring pieces that tile a text."""
    sizes = [0]
    for piece in pieces:
        sizes.append(sizes[-1] + len(piece.encode("utf-8")))
    return [
        {"text": "".join(pieces[a:b]), "start": sizes[a], "end": sizes[b], "index": i}
        for i, (a, b) in enumerate(groups[:MOST_CHUNKS])
    ]


def by_sentence(text: str, size: int, overlap: int) -> list[dict] | None:
    """Whole sentences up to ``size`` characters; the next chunk takes back trailing ones that fit the overlap."""
    if not text or size <= 0:
        return None
    overlap = max(0, min(overlap, size - 1))
    pieces = sentences(text)
    groups, start = [], 0
    while start < len(pieces):
        end, length = start + 1, len(pieces[start])
        while end < len(pieces) and length + len(pieces[end]) <= size:
            length += len(pieces[end])
            end += 1
        groups.append((start, end))
        back, kept = end, 0
        while end < len(pieces) and back - 1 > start and kept + len(pieces[back - 1]) <= overlap:
            back -= 1
            kept += len(pieces[back])
        start = back
    return _spans(pieces, groups)


def _pieces(text: str, size: int, level: int) -> list[str]:
    if len(text) <= size:
        return [text]
    if level == 3:
        return [text[i : i + size] for i in range(0, len(text), size)]
    parts = (PARAGRAPH.findall, sentences, lambda t: [m[0] for m in TOKEN.finditer(t)])[level](text)
    return [q for p in parts for q in (_pieces(p, size, level + 1) if len(p) > size or len(parts) == 1 else [p])]


def recursive(text: str, size: int, overlap: int = 0) -> list[dict] | None:
    """Paragraphs, sentences, tokens, then characters, merged again up to ``size``; a short rest joins the chunk before it.

    Contiguous, so nothing overlaps.
    """
    if not text or size <= 0:
        return None
    pieces = _pieces(text, size, 0)
    filled: list[list[int]] = []
    for i, piece in enumerate(pieces):
        if filled and filled[-1][2] + len(piece) <= size:
            filled[-1][1:] = [i + 1, filled[-1][2] + len(piece)]
        else:
            filled.append([i, i + 1, len(piece)])
    groups: list[tuple[int, int]] = []
    for first, last, length in filled:
        if groups and length < SHORT:
            groups[-1] = (groups[-1][0], last)
        else:
            groups.append((first, last))
    return _spans(pieces, groups)


def with_chunks(frame: DataFrame, column: str, size: int, overlap: int, kind: str = "recursive", name: str = "chunks") -> DataFrame:
    """The table with an array of chunks of a text; null for null, empty text or a size below 1."""
    cut = {"recursive": recursive, "sentence": by_sentence}[kind]
    return map_rows(frame, [column], f"{name} {CHUNKS}", lambda t: cut(t, size, overlap) if t else None)


def with_chunk_texts(frame: DataFrame, column: str, name: str = "chunks") -> DataFrame:
    """The table with the texts of recursive chunks of the default size."""

    def texts(text: str | None) -> list[str] | None:
        made = recursive(text, DEFAULT_SIZE, DEFAULT_OVERLAP) if text else None
        return made and [c["text"] for c in made]

    return map_rows(frame, [column], f"{name} array<string>", texts)
