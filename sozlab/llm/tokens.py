"""Token counts by overlap resynchronisation.

A long text (over 8192 characters unless told otherwise) is encoded in overlapping chunks; each chunk gives the offsets at which its tokens' pieces begin.  Two
neighbours are spliced at an offset at which both begin a piece and at which a piece begins whatever stands before
(after white space, at a digit, between a letter and a symbol): from there on pieces depend only on what follows, so
the counts before it from the left chunk and after it from the right one add up to the whole text's.  If an overlap
holds no such offset it is widened.  Shorter texts are one chunk.  Texts with code points that the Unicode tables here
do not assign go to the tokenizers library itself, whose tables may be newer.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from . import bpe
from .common import documents_of, map_texts

SCHEMA = "n_bytes long, n_tokens long, over_limit boolean"
#: Fixed value: the pattern whose matches are the pieces of the word vocabulary; all else is dropped.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + bpe.SPACES + r"\p{L}\p{N}]+"
#: Offsets at which a piece begins whatever stands before.
PROVEN = (
    rf"(?<=[{bpe.SPACES}\p{{N}}])(?=[^{bpe.SPACES}])|(?=\p{{N}})|(?<=\p{{L}})(?=[^{bpe.SPACES}\p{{L}}\p{{N}}])"
)
CHUNK, OVERLAP = 1 << 13, 1 << 8
#: Control characters that Python counts as white space and the tokenizer does not.
SEPARATORS = re.compile("[\x1c-\x1f]")


class Counter:
    """Counts the tokens of one vocabulary; remembers short words, within a bound."""

    def __init__(self, path: str):
        vocab = bpe.vocabulary(path)
        self.merger = bpe.Merger(vocab)
        self.pieces = regex.compile(WORD_PATTERN)
        self.proven = regex.compile(PROVEN)
        self.blank = regex.compile(f"[{bpe.SPACES}]+")
        self.added = regex.compile("|".join(map(regex.escape, vocab.added))) if vocab.added else None
        self.of_piece = PieceCounts(self.merger)
        self.of_word = WordCounts(self.pieces, self.of_piece)
        self.path = path

    def normalised(self, text: str) -> str:
        """Composed, white space as single spaces, lower case without regard to a letter's place in its word."""
        text = self.blank.sub(" ", unicodedata.normalize("NFC", text))
        return text.replace("Σ", "σ").lower()

    def plain(self, text: str) -> int:
        """Tokens of normalised text that is one chunk."""
        return sum(map(self.of_word.__getitem__, text.split(" ")))

    def short(self, text: str) -> int:
        """Tokens of text that is one chunk; pieces hold no white space, so words can be taken apart first."""
        if SEPARATORS.search(text):
            return self.plain(self.normalised(text))
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return sum(map(self.of_word.__getitem__, text.split()))

    def offsets(self, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of a chunk begin in the text, and how many tokens stand before each (and in all)."""
        found = [(m.start(), self.of_piece[m[0]]) for m in self.pieces.finditer(text, start, end)]
        begins = np.array([b for b, _ in found], np.int64)
        return begins, np.concatenate([[0], np.cumsum([n for _, n in found], dtype=np.int64)])

    def splice(self, text: str, left: np.ndarray, start: int, end: int) -> int | None:
        """The first proven offset in the overlap at which the left chunk and the right one begin a piece."""
        right, _ = self.offsets(text, start, end)
        for match in self.proven.finditer(text, start + 1, end):
            at = match.start()
            if at < end and _holds(left, at) and _holds(right, at):
                return at
        return None

    def resynchronised(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of normalised text of any length, chunk by chunk."""
        total, begin = 0, 0
        while begin + chunk + overlap < len(text):
            wide, cut = overlap, None
            while cut is None:
                end = min(len(text), begin + chunk + wide)
                begins, before = self.offsets(text, begin, end)
                cut = self.splice(text, begins, begin + chunk, end)
                if cut is None and end == len(text):
                    return total + int(before[-1])
                wide *= 4
            total += int(before[np.searchsorted(begins, cut)])
            begin = cut
        return total + self.plain(text[begin:])

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        if not text.isascii() and unassigned().search(text):
            return len(library(self.path).encode(text, add_special_tokens=False).ids)
        if len(text) <= chunk and not (self.added and self.added.search(text)):
            return self.short(text)
        total, at = 0, 0
        for match in self.added.finditer(text) if self.added else ():
            total += 1 + self.resynchronised(self.normalised(text[at : match.start()]), chunk, overlap)
            at = match.end()
        return total + self.resynchronised(self.normalised(text[at:]), chunk, overlap)


class PieceCounts(dict):
    def __init__(self, merger: bpe.Merger):
        super().__init__()
        self.merger = merger

    def __missing__(self, piece: str) -> int:
        count = len(self.merger.merged(piece.encode("utf-8")))
        if len(piece) <= bpe.MEMO_CHARS:
            if len(self) >= bpe.MEMO_SIZE:
                self.clear()
            self[piece] = count
        return count


class WordCounts(dict):
    def __init__(self, pieces, of_piece: PieceCounts):
        super().__init__()
        self.pieces, self.of_piece = pieces, of_piece

    def __missing__(self, word: str) -> int:
        if word.isalpha():
            count = len(self.of_piece.merger.merged(word.encode("utf-8")))
        elif word[-1:] in bpe.STOPS and word[:-1].isalpha():
            count = self[word[:-1]] + self.of_piece[word[-1]]
        else:
            count = sum(map(self.of_piece.__getitem__, self.pieces.findall(word)))
        if len(word) <= bpe.MEMO_CHARS:
            if len(self) >= bpe.WORD_MEMO_SIZE:
                self.clear()
            self[word] = count
        return count


@functools.lru_cache(maxsize=1)
def unassigned():
    """Code points without a category here: case and composition tables of another Unicode version may know them."""
    ranges, last = [], -2
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c)) == "Cn":
            if c != last + 1:
                ranges.append([c, c])
            ranges[-1][1] = last = c
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]")


@functools.lru_cache(maxsize=4)
def library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def _holds(ascending: np.ndarray, value: int) -> bool:
    at = np.searchsorted(ascending, value)
    return at < len(ascending) and ascending[at] == value


@functools.lru_cache(maxsize=8)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    Texts of over ``chunk`` characters are encoded in chunks that share ``overlap`` characters, or more where that many
    hold no offset to splice at; the counts do not depend on either.

    Null and empty texts have 0 bytes and 0 tokens; strings of added tokens inside a text count as one token each;
    null ids and repeated rows come back as they are; columns besides doc_id and text are ignored.
    """

    def counts(texts: list[str]) -> dict[str, list]:
        n = [counter(path).count(t, chunk, overlap) for t in texts]
        size = [len(t.encode("utf-8")) for t in texts]
        return {"n_bytes": size, "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_texts(documents_of(docs), counts, ["doc_id"], ["text"], SCHEMA)
