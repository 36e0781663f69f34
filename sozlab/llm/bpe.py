"""Byte-pair encoding and decoding as streaming transducers.

A merge list has a *sufficient lookahead*: a number of bytes beyond which text further right cannot change a token.
``sufficient_lookahead`` computes it from the merges alone.  The encoder keeps at most a block plus that many bytes of
an unfinished piece, and emits a token as soon as it ends that far before what has been read; so its memory does not
depend on the text's length.  The decoder feeds token bytes through an incremental byte-to-text state machine.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import regex
import tiktoken

#: Fixed value: white space as the tokenizer's pattern language has it.
SPACES = r"\t\n\x0B\x0C\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: Fixed value: the pattern that cuts text into pieces before the merges of byte-level vocabularies.
BYTE_LEVEL_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACES + r"\p{L}\p{N}]+"
    r"|[" + SPACES + r"]+(?![^" + SPACES + r"])|[" + SPACES + r"]+"
)
BLOCK = 1 << 14
#: Pieces up to this many characters are remembered, at most so many of them.
MEMO_CHARS, MEMO_SIZE, WORD_MEMO_SIZE = 48, 1 << 18, 1 << 19
#: Punctuation that stands alone after letters.
STOPS = frozenset(".,;:!?)")
NO_MERGE = 1 << 40
#: Where a space has white space beside it, words are not cut at spaces.
WIDE_GAP = re.compile(r" \s|\s ")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Merges, ids and added tokens of a BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.path = path
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        alphabet = byte_alphabet()
        self.of_byte = {a: b for b, a in enumerate(alphabet)}
        self.alphabet = alphabet
        #: ids of a byte inside a word and at its end
        self.inner = [self.ids[a] for a in alphabet]
        self.final = [self.ids[a + self.suffix] for a in alphabet]
        self.merges: list[tuple[int, int, int]] = []
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.append((self.ids[left], self.ids[right], self.ids[left + right]))
        self.ranks = {(a, b): rank for rank, (a, b, _) in enumerate(self.merges)}
        self.made_by = [made for _, _, made in self.merges]
        self.bytes_of: dict[int, bytes] = {i: self._bytes(t) for t, i in self.ids.items()}
        self.bytes_of |= {i: t.encode("utf-8") for t, i in self.added.items()}

    def _bytes(self, token: str) -> bytes:
        token = token.removesuffix(self.suffix) if self.suffix else token
        return bytes(self.of_byte[c] for c in token)


@functools.lru_cache(maxsize=8)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def sufficient_lookahead(vocab: Vocabulary) -> int:
    """Bytes after which further text cannot change a token.

    What stands beyond the end of the text is uncertain.  A merge (x, s) with an uncertain s makes x and xs uncertain,
    a merge (s, y) makes sy uncertain; as information travels left only through ever later merges, one pass over the
    list in order finds how far to the left of the end an uncertain symbol can begin.
    """
    reach: dict[int, int] = {}
    size = {i: len(b) for i, b in vocab.bytes_of.items()}
    for left, right, made in vocab.merges:
        over_left = reach.get(left, 0)
        through_right = reach.get(right, 0) + size[left]
        reach[left] = max(over_left, through_right)
        reach[made] = max(reach.get(made, 0), over_left, through_right)
    return max(reach.values(), default=0)


class Merger:
    """Applies the merge list to the bytes of one piece."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.lookahead = sufficient_lookahead(vocab)

    def merged(self, data: bytes, ended: bool = True) -> list[int]:
        """Token ids of ``data``; ``ended``: the word ends with it."""
        vocab = self.vocab
        symbols = [vocab.inner[b] for b in data]
        if ended and symbols:
            symbols[-1] = vocab.final[data[-1]]
        return self._short(symbols) if len(symbols) <= 64 else self._long(symbols)

    def _short(self, symbols: list[int]) -> list[int]:
        """Always the earliest merge of the list that fits, leftmost first; ranks of neighbours are kept beside."""
        ranks, made_by = self.vocab.ranks, self.vocab.made_by
        fits = list(map(ranks.get, zip(symbols, symbols[1:]), repeat(NO_MERGE)))
        while fits and (best := min(fits)) != NO_MERGE:
            at = fits.index(best)
            symbols[at : at + 2] = (made_by[best],)
            del fits[at]
            if at:
                fits[at - 1] = ranks.get((symbols[at - 1], symbols[at]), NO_MERGE)
            if at < len(fits):
                fits[at] = ranks.get((symbols[at], symbols[at + 1]), NO_MERGE)
        return symbols

    def _long(self, symbols: list[int]) -> list[int]:
        """The same with a heap of pairs and linked neighbours."""
        ranks, made_by, n = self.vocab.ranks, self.vocab.made_by, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(ranks[p], i, p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            rank, at, pair = heapq.heappop(heap)
            nxt = after[at] if alive[at] else n
            if nxt >= n or (symbols[at], symbols[nxt]) != pair:
                continue
            symbols[at], alive[nxt] = made_by[rank], False
            after[at] = after[nxt]
            if after[at] < n:
                before[after[at]] = at
            for start in (before[at], at):
                if start >= 0 and after[start] < n:
                    p = (symbols[start], symbols[after[start]])
                    if p in ranks:
                        heapq.heappush(heap, (ranks[p], start, p))
        return [s for s, live in zip(symbols, alive) if live]


class PieceMemo(dict):
    """piece -> ids, for short pieces; emptied when full, so that its size is bounded."""

    def __init__(self, merger: Merger):
        super().__init__()
        self.merger = merger

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.merger.merged(piece.encode("utf-8")))
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_SIZE:
                self.clear()
            self[piece] = ids
        return ids


class WordMemo(dict):
    """What a space and the characters up to the next one give, by these characters; emptied when full."""

    def __init__(self, pieces, memo: PieceMemo):
        super().__init__()
        self.pieces, self.memo = pieces, memo

    def __missing__(self, word: str) -> tuple[int, ...]:
        if word.isalpha():
            ids = self.memo[" " + word]
        elif word[-1:] in STOPS and word[:-1].isalpha():
            ids = self.memo[" " + word[:-1]] + self.memo[word[-1]]
        else:
            ids = tuple(chain.from_iterable(map(self.memo.__getitem__, self.pieces.findall(" " + word))))
        if len(word) <= MEMO_CHARS and "\n" not in word:
            if len(self) >= WORD_MEMO_SIZE:
                self.clear()
            self[word] = ids
        return ids


class OpenPiece:
    """A piece that is still being read: emits tokens once the lookahead behind them is complete."""

    def __init__(self, merger: Merger):
        self.merger, self.pending = merger, b""

    def feed(self, data: bytes) -> list[int]:
        self.pending += data
        if len(self.pending) < BLOCK + self.merger.lookahead:
            return []
        sure = len(self.pending) - self.merger.lookahead
        out, end = [], 0
        for token in self.merger.merged(self.pending, ended=False):
            size = len(self.merger.vocab.bytes_of[token])
            if end + size > sure:
                break
            out.append(token)
            end += size
        self.pending = self.pending[end:]
        return out

    def finish(self) -> list[int]:
        out, self.pending = self.merger.merged(self.pending), b""
        return out


class Shared:
    """What all transducers of one vocabulary share in a process."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.merger = Merger(self.vocab)
        self.memo = PieceMemo(self.merger)
        self.pieces = regex.compile(BYTE_LEVEL_PATTERN)
        self.words = WordMemo(self.pieces, self.memo)
        self.added = regex.compile("|".join(map(regex.escape, self.vocab.added))) if self.vocab.added else None
        self.longest_added = max(map(len, self.vocab.added), default=0)
        self.runs = [
            regex.compile(c)
            for c in (rf"[{SPACES}]+", r"\p{L}+", r"\p{N}+", rf"[^{SPACES}\p{{L}}\p{{N}}]+")
        ]


    def ids(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self.pieces.findall(text))))


@functools.lru_cache(maxsize=8)
def shared(path: str) -> Shared:
    return Shared(path)


class Encoder:
    """Text in parts of any size in, stable token ids out."""

    def __init__(self, path: str):
        self.shared = shared(path)
        self.held = ""
        self.open: OpenPiece | None = None
        self.run = None

    def feed(self, text: str) -> list[int]:
        return self._drain(self.held + text, final=False)

    def finish(self) -> list[int]:
        return self._drain(self.held, final=True)

    def _drain(self, text: str, final: bool) -> list[int]:
        out: list[int] = []
        if self.shared.added is not None:
            at = 0
            for match in self.shared.added.finditer(text):
                out += self._complete(text[at : match.start()])
                out.append(self.shared.vocab.added[match[0]])
                at = match.end()
            text = text[at:]
        if final:
            self.held = ""
            return out + self._complete(text)
        return out + self._partial(text)

    def _complete(self, text: str) -> list[int]:
        """Ids of text after which a piece surely ends."""
        out: list[int] = []
        if self.open is not None:
            text = self._continue(text, out, ended=True)
        if WIDE_GAP.search(text):
            return out + self.shared.ids(text)
        first, *words = text.split(" ")
        out += self.shared.ids(first)
        out.extend(chain.from_iterable(map(self.shared.words.__getitem__, words)))
        return out

    def _partial(self, text: str) -> list[int]:
        out: list[int] = []
        if self.open is not None:
            text = self._continue(text, out, ended=False)
            if self.open is not None:
                self.held = text
                return out
        cut = safe_cut(text)
        if cut:
            out += self._complete(text[:cut])
            text = text[cut:]
        if len(text) > BLOCK:
            text = self._open_long(text, out)
        self.held = text
        return out

    def _open_long(self, text: str, out: list[int]) -> str:
        """Text without a safe cut: emit its pieces but the last few; a long last piece is opened."""
        spare = self.shared.longest_added + 4
        ready = []
        for match in self.shared.pieces.finditer(text):
            if match.end() > len(text) - spare:
                break
            ready.append(match)
        ready = ready[:-2]
        out.extend(chain.from_iterable(self.shared.memo[m[0]] for m in ready))
        text = text[ready[-1].end() :] if ready else text
        first = self.shared.pieces.match(text)
        if first and len(first[0]) > BLOCK // 2:
            lead = 1 if text[0] == " " and len(text) > 1 and not self.shared.runs[0].match(text[1]) else 0
            self.run = next(r for r in self.shared.runs if r.match(text, lead))
            self.open = OpenPiece(self.shared.merger)
            out += self.open.feed(text[:lead].encode("utf-8"))
            text = self._continue(text[lead:], out, ended=False)
        return text

    def _continue(self, text: str, out: list[int], ended: bool) -> str:
        """Take from ``text`` what belongs to the open piece; returns the rest."""
        match = self.run.match(text)
        end = match.end() if match else 0
        over = ended or end < len(text)
        blank = self.run is self.shared.runs[0]
        if not over:
            end = max(0, end - (self.shared.longest_added + 1))
        elif blank and end < len(text):
            end = max(0, end - 1)  # the last blank before a word belongs to the word
        out += self.open.feed(text[:end].encode("utf-8"))
        if over:
            out += self.open.finish()
            self.open = self.run = None
        return text[end:]


def safe_cut(text: str) -> int:
    """The last place where a space follows a character that is no white space: pieces never span it.  0: none."""
    at = text.rfind(" ")
    while at > 0 and text[at - 1].isspace():
        at = text.rfind(" ", 0, at)
    return max(at, 0)


def parts(text: str, size: int = 4 * BLOCK) -> Iterator[str]:
    for at in range(0, len(text), size):
        yield text[at : at + size]


def encode_stream(path: str, texts: Iterable[str]) -> Iterator[list[int]]:
    """Stable ids, in lists, of a text that comes in parts."""
    encoder = Encoder(path)
    for text in texts:
        if ids := encoder.feed(text):
            yield ids
    if ids := encoder.finish():
        yield ids


class Decoder:
    """Token ids in, text out as soon as its bytes are whole; malformed bytes become U+FFFD."""

    def __init__(self, path: str):
        self.bytes_of = vocabulary(path).bytes_of
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        return self.machine.decode(b"", final=True)


def encode(path: str, text: str) -> list[int]:
    return list(chain.from_iterable(encode_stream(path, parts(text))))


def decode(path: str, ids: Iterable[int]) -> str:
    decoder = Decoder(path)
    return decoder.feed(ids) + decoder.finish()


@functools.lru_cache(maxsize=4)
def rank_encoding(path: str) -> tiktoken.Encoding:
    """The same vocabulary in a native encoder, for whole texts that fit in memory.

    It merges by token id, which is the order of the merge list only where the ids follow it; that is checked.
    """
    vocab = vocabulary(path)
    if vocab.suffix or vocab.made_by != sorted(vocab.made_by) or max(vocab.inner) >= min(vocab.made_by):
        raise ValueError("ids do not follow the merges")
    ranks = {vocab.bytes_of[i]: i for i in vocab.ids.values()}
    return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=vocab.added)


def encode_whole(path: str, text: str) -> np.ndarray:
    """The ids of a text as unsigned 32-bit numbers, by the native encoder."""
    return rank_encoding(path).encode_to_numpy(text, allowed_special="all")
