import random
from itertools import chain

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sozlab.llm import bpe, tokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = [
    "a", "the", "'", "'s", "'l", "l", " ", "  ", "\n", "\t", "1", "23", "!", "<|endoftext|>", "<|endof", "é", "日本", "　",
    "x" * 300, "!!!!", "ab" * 40, "the.", "\x1c", "İ", "Σ", "é", "😀",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return ["", " ", "a" * 5000, " " * 3000 + "x"] + ["".join(rng.choices(PARTS, k=rng.randint(0, 60))) for _ in range(200)]


def test_encoding_matches_the_library(texts):
    library = Tokenizer.from_file(BYTES)
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert bpe.encode(BYTES, text) == want
        assert bpe.encode_whole(BYTES, text).tolist() == want
        assert bpe.decode(BYTES, want) == library.decode(want, skip_special_tokens=False) == text


def test_streams_do_not_depend_on_their_parts(texts, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 16)
    for text in texts:
        for size in (1, 7, 50):
            assert list(chain.from_iterable(bpe.encode_stream(BYTES, bpe.parts(text, size)))) == bpe.encode(BYTES, text)


def test_open_pieces_keep_a_bounded_part(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 64)
    merger = bpe.Merger(bpe.vocabulary(BYTES))
    rng, piece, out = random.Random(1), bpe.OpenPiece(merger), []
    data = "".join(rng.choices("etaoinsh", k=5000)).encode()
    for at in range(0, len(data), 10):
        out += piece.feed(data[at : at + 10])
        assert len(piece.pending) <= 64 + merger.lookahead + 10
    assert out + piece.finish() == merger.merged(data)


def test_lookahead_suffices():
    merger = bpe.Merger(bpe.vocabulary(BYTES))
    rng = random.Random(2)
    for _ in range(30):
        data = "".join(rng.choices(["th", "e", "ing", "an", "re", "a"], k=300)).encode()
        whole = merger.merged(data)
        cut = rng.randint(200, len(data))
        begun, at = merger.merged(data[:cut], ended=False), 0
        for i, token in enumerate(begun):
            at += len(merger.vocab.bytes_of[token])
            if at > cut - merger.lookahead:
                break
            assert whole[i] == token


def test_counts_match_the_library_however_chunked(texts):
    library, counter = Tokenizer.from_file(WORDS), tokens.counter(WORDS)
    for text in texts:
        want = len(library.encode(text, add_special_tokens=False).ids)
        assert counter.count(text) == want
        assert counter.count(text, chunk=12, overlap=3) == want
