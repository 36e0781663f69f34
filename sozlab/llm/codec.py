"""BPE encoding and decoding of a text column with the streaming transducers of ``bpe``."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame

from . import bpe
from .common import documents_of, map_texts

DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(path: str, text: str) -> tuple[int, str, str]:
    """Token count, digest of the ids, and digest of the text decoded from them; ids live only in passing."""
    ids_digest, text_digest = hashlib.sha256(), hashlib.sha256()
    decoder, count = bpe.Decoder(path), 0
    for ids in bpe.encode_stream(path, bpe.parts(text)):
        if count:
            ids_digest.update(b",")
        ids_digest.update(",".join(map(str, ids)).encode("ascii"))
        count += len(ids)
        text_digest.update(decoder.feed(ids).encode("utf-8"))
    text_digest.update(decoder.finish().encode("utf-8"))
    return count, ids_digest.hexdigest(), text_digest.hexdigest()


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per input row: token count and digests of ids and of the decoded text.

    Null and empty texts have no tokens and the digests of empty strings; strings of added tokens inside a text are
    those tokens; null ids and repeated rows come back as they are; columns besides doc_id and text are ignored.
    """

    def digests(texts: list[str]) -> dict[str, list]:
        rows = [round_trip(path, t) for t in texts]
        return {c: [r[i] for r in rows] for i, c in enumerate(("n_tokens", "ids_sha256", "decoded_sha256"))}

    return map_texts(documents_of(docs), digests, ["doc_id"], ["text"], DIGESTS)


def encoded(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """The table with an array column of token ids (replacing a column of that name); null text: empty array."""
    kept = [c for c in docs.columns if c != ids_col]

    def encode(texts: list[str | None]) -> dict[str, list]:
        return {ids_col: [bpe.encode(path, t or "") for t in texts]}

    return map_texts(docs, encode, kept, [text_col], f"`{ids_col}` array<int>")


def decoded(frame: DataFrame, path: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """The table with a text column decoded from an array of ids (replacing one of that name); null ids: null."""
    kept = [c for c in frame.columns if c != text_col]

    def decode(lists: list[list[int] | None]) -> dict[str, list]:
        return {text_col: [None if ids is None else bpe.decode(path, ids) for ids in lists]}

    return map_texts(frame, decode, kept, [ids_col], f"`{text_col}` string")
