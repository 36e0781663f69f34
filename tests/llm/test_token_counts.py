"""Token counts of a table against the library, most texts over the default chunk."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sozlab.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_default_chunks_match_the_library(spark):
    rng = np.random.default_rng(5)
    alphabets = ["abcdefgh ,.'", "əğışçö I'll 12", "漢字かな", "0123456789", "a", " \n\t x", "!?-—…x ", "😀👍é z"]
    texts = [None, "", "short", "x" * 30_000, " " * 30_000, "<|endoftext|>" * 900, "don't " * 6000, "7" * 20_000, "it's" * 7000]
    for letters in alphabets:
        for size in (tokens.CHUNK - 1, tokens.CHUNK, tokens.CHUNK + tokens.OVERLAP, tokens.CHUNK + tokens.OVERLAP + 1, 40_000):
            texts.append("".join(rng.choice(list(letters), size)))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    for options in ({}, {"chunk": 1000, "overlap": 5}):
        rows = tokens.token_counts(frame, PATH, **options).collect()
        assert {r.doc_id: r.n_tokens for r in rows} == want
        assert all(r.n_bytes == len((texts[r.doc_id] or "").encode()) and r.over_limit == (want[r.doc_id] > 2048) for r in rows)
