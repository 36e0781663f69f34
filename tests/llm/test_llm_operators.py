import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sozlab.llm import chat, codec, components, licenses, media, neardup, packing, substrings, tokens, topk, toxicity

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, sequence_id string"
BIG = 2**60 + 1


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, clashing column names."""
    long = "word and other things. " * 3000
    rows = [(1, None), (2, ""), (None, "no id here"), (BIG, long), (3, "a b c"), (3, "a b c"), (4, long), (None, None)]
    return spark.createDataFrame([(i, t, None, "s", None, "x", "y") for i, t in rows], COLUMNS)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


ROW_WISE = {
    "codec": lambda d: codec.token_digests(d, BYTES),
    "media": media.media_features,
    "png": media.to_media,
    "tokens": lambda d: tokens.token_counts(d, WORDS),
    "licenses": licenses.scan_licenses,
    "neardup": neardup.near_duplicates,
    "substrings": substrings.substring_dedup,
}


@pytest.mark.parametrize("name", ROW_WISE)
def test_one_row_per_row_and_ids_survive(name, odd, none):
    out = ROW_WISE[name](odd)
    want = sorted(str(r.doc_id) for r in odd.collect())
    assert sorted(str(r.doc_id) for r in out.collect()) == want
    assert ROW_WISE[name](none).count() == 0


def test_codec_round_trip(odd):
    for row in codec.token_digests(odd, BYTES).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        assert row.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
    ids = codec.encoded(odd, BYTES)
    back = codec.decoded(ids, BYTES).select(F.coalesce("text", F.lit("")).alias("a"), F.col("decoded").alias("b"))
    assert all(r.a == r.b for r in back.collect())


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 4096, 100_001])
def test_png_round_trip(size):
    data = bytes(np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8))
    payload = media.padded(data)
    stored = media.encode_png(payload, media.width_for(len(payload)))
    assert len(payload) % 64 == 0 and payload and media.decode_png(stored).tobytes() == payload
    with pytest.raises(ValueError):
        media.decode_png(stored[:40] + bytes([stored[40] ^ 1]) + stored[41:])


def test_png_undoes_every_filter():
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (5, 7)).astype(np.int32)
    lines = bytearray()
    for y in range(5):
        lines.append(y)
        for x in range(7):
            a, b = (image[y, x - 1] if x else 0), (image[y - 1, x] if y else 0)
            c = image[y - 1, x - 1] if x and y else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            lines.append((image[y, x] - [0, a, b, (a + b) // 2, paeth][y]) & 255)
    header = (7).to_bytes(4, "big") + (5).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    png = media.SIGNATURE + media._chunk(b"IHDR", header) + media._chunk(b"IDAT", zlib.compress(bytes(lines))) + media._chunk(b"IEND", b"")
    assert (media.decode_png(png) == image).all()


def _brute_components(docs: dict[int, str]) -> dict[int, int]:
    sets = {}
    for i, text in docs.items():
        w = (text or "").lower().split()
        sets[i] = {tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))} if w else set()
    label = {i: i for i in docs}
    changed = True
    while changed:
        changed = False
        for a in docs:
            for b in docs:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_near_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, at = {}, 0
    for _ in range(12):
        base = list(rng.choice(vocabulary, rng.integers(1, 80)))
        for _ in range(rng.integers(1, 12)):
            copy = list(base)
            for _ in range(rng.integers(0, 3)):
                copy[rng.integers(0, len(copy))] = str(rng.choice(vocabulary))
            docs[at] = " ".join(copy)
            at += 1
    docs |= {at: "", at + 1: None, at + 2: "ONE two", at + 3: "one TWO"}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.component_id, r.kept) for r in neardup.near_duplicates(frame).collect()}
    want = _brute_components(docs)
    assert got == {i: (c, c == i) for i, c in want.items()}


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(139, 200), (7, 7)]
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r.id: r.component for r in components.connected_components(frame).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in [*range(100, 140), 200]}


@pytest.mark.parametrize("size", [1, 10, 53])
def test_candidates_do_not_depend_on_batches(size):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(1, 4, neardup.VALUES).astype(">u4").tobytes()) for i in range(53)]
    order = sorted((r[1][:32], r[0]) for r in rows)
    whole = pd.DataFrame({"o": 0, "key": [k for k, _ in order], "id": [i for _, i in order], "n": 10})
    want, crowded = neardup.neighbours(whole, 0)
    pairs, marks, carried = set(), set(), None
    for at in range(0, len(whole), size):
        batch = whole.iloc[at : at + size]
        seen = batch if carried is None else pd.concat([carried, batch], ignore_index=True)
        found, more = neardup.neighbours(seen, 0 if carried is None else len(carried))
        pairs |= set(zip(found["a"], found["b"]))
        marks |= set(more.tolist())
        carried = seen.tail(neardup.REACH)
    assert pairs == set(zip(want["a"], want["b"])) and marks == set(crowded.tolist()) and crowded.size


def test_passages_keep_their_first_occurrence(spark):
    passage = "one two three four five six seven eight nine ten. Then eleven twelve thirteen fourteen fifteen sixteen seventeen. "
    docs = {
        1: "Quite another beginning of a text here. " + passage + "And an end.",
        2: "Words that come first and differ a lot from all. " + passage + "Its own end comes here now.",
        3: "Short. Lines.\nShort. Lines.\n",
        4: "The same line of eight words or more stands here.\nThe same line of eight words or more stands here.\nx",
        5: "ONE two, three four five six seven eight nine ten. Then eleven twelve thirteen fourteen fifteen sixteen seventeen!",
    }
    frame = spark.createDataFrame([(i, t, "en") for i, t in docs.items()], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in substrings.substring_dedup(frame, 8).collect()}
    assert got[1].text == docs[1] and got[3].text == docs[3]
    assert "thirteen" not in got[2].text and got[2].text.endswith("Its own end comes here now.") and got[4].text.count("same") == 1
    kept = {r.doc_id: r.text for r in substrings.deduplicated(frame, 8).collect()}
    assert kept == {i: r.text for i, r in got.items()}


@pytest.mark.parametrize("lengths", [[], [1], [1024] * 3, [600] * 9, list(range(1, 700))])
def test_packing_is_valid_and_certified(lengths):
    sizes = np.array(lengths, dtype=np.int64)
    bins, offsets, free = packing.best_fit_decreasing(sizes, 1024)
    fill = defaultdict(list)
    for b, o, n in zip(bins, offsets, lengths):
        fill[b].append((o, n))
    for b, pieces in fill.items():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at == 1024 - free[b]
    assert packing.lower_bound(sizes, 1024) <= len(free)


def test_pack_documents(spark, odd):
    packed = packing.pack_documents(odd, BYTES, capacity=64, per_part=20, keep_ids=True).toPandas()
    per_doc = packed.groupby(packed["doc_id"].astype(str))["length"].sum()
    for row in odd.select("doc_id", "text").distinct().collect():
        if row.doc_id in (2, 4, BIG):
            assert per_doc[str(float(row.doc_id)) if packed["doc_id"].dtype == float else str(row.doc_id)] == len(codec.bpe.encode(BYTES, row.text or "")) + 1
    ordered = packed.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"] == ordered["offset"]).all()
    assert packed.groupby("sequence_id")["length"].sum().max() <= 64
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in packed.itertuples())
    made = packing.sequences(spark.createDataFrame(packed[["sequence_id", "offset", "length", "ids"]])).collect()
    assert all(len(r.ids) == 4 * r.n_tokens for r in made)
    assert packing.pack_documents(odd.limit(0), BYTES).count() == 0


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.choice([0.0, 0.5, -0.25], 6)]) for i in range(250)]
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")]), (400, []), (500, [1.0]), (None, [1.0])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    usable = [(i, v) for i, v in rows if i is not None and i not in (300, 301, 302)]
    q = {i: [int(np.floor(1024 * x)) for x in v] for i, v in usable}
    want = []
    for a in q:
        if a % 100 == 0:
            scores = sorted((-sum(x * y for x, y in zip(q[a], q[b])), b) for b in q if b != a)[:10]
            want += [(a, r + 1, b, -s) for r, (s, b) in enumerate(scores)]
    got = topk.exact_topk(frame, F.col("vec_id") % 100 == 0, candidate_block=64, query_block=2)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.exact_topk(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_chat_keeps_maximal_conversations(spark):
    a, b, c = ("user", "hi"), ("assistant", "hello"), ("user", None)
    logs = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, c], 5: [b], 6: [a, c]}
    rows = [(k, t, r, x, 0) for k, turns in logs.items() for t, (r, x) in enumerate(turns)] + [(3, 0, *a, 0), (None, 0, *b, 0)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r for r in chat.collapse_and_render(frame).collect()}
    assert set(got) == {3, 6, None} and got[3].n_copies == 2 and got[None].n_copies == 2
    assert got[3].chat == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert chat.collapse_and_render(frame.limit(0)).count() == 0


def test_licenses_match_brute_force(spark):
    texts = [
        "Released under the MIT License.", "mit, LICENSE: cc by-nc 4.0 CC BY", "GNU General Public License, version 3; GNU general public license",
        "Licensed under the Apache License, Version 2.0", "version 3 gnu general public license", "mit einer license", None, "",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in licenses.scan_licenses(frame).collect():
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[row.doc_id] or "")
        words = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text).split()
        found = [
            (label, i) for label, (phrase,) in licenses.BASE.items() for i in range(len(words))
            if words[i : i + len(phrase.split())] == phrase.split()
        ]
        starts = [i for _, i in found]
        assert (row.n_words, row.n_base, row.first_word, row.last_word) == (len(words), len(found), min(starts, default=None), max(starts, default=None))
        assert row.base_labels == ",".join(sorted({x for x, _ in found})) and 0 <= row.score <= 1
    labels = {r.doc_id: r.labels for r in licenses.scan_licenses(frame).collect()}
    assert labels[2] == "gpl,gpl-3" and labels[4] == "gpl,gpl-3" and labels[3] == "apache,apache-2" and labels[1] == "cc-by,cc-by-nc,mit"


def test_toxicity_on_held_out_rows(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        words = list(rng.choice(vocabulary, 40))
        toxic = i % 5 == 0
        if toxic:
            words[5], words[9], words[20] = "blorgish", "blorger", str(rng.choice(["idiot", "1d10t"]))
        rows.append((i, " ".join(words), "z"))
        labels.append((i, 0, int(toxic)))
    rows += [(None, None, "z"), (901, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(2)
    table = spark.createDataFrame(labels + [(None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, table).toPandas()
    known = got[got["doc_id"].notna() & (got["doc_id"] < 900)]
    held = known[known["held_out"]]
    assert len(got) == 902 and got["score"].between(0, 1).all()
    assert (held["held_out"] == (held["doc_id"].map(lambda i: zlib.crc32(str(int(i)).encode()) % 5 == 0))).all()
    assert ((held["doc_id"] % 5 == 0) == (held["predicted"] == 1)).mean() > 0.97
    assert toxicity.toxicity(docs.limit(0), table).count() == 0
    untaught = toxicity.toxicity(docs, table.limit(0)).toPandas()
    assert (untaught["score"] == 0).all() and (untaught["predicted"] == 0).all()


def test_pipeline_matches_its_stages(spark, tmp_path):
    import corpus_pipeline

    shared = " ".join(f"shared{i}" for i in range(60)) + ". "
    rng = np.random.default_rng(9)
    docs = [(i, " ".join(rng.choice([f"w{j}" for j in range(500)], 60)) + ". ", "en", "s", 1) for i in range(30)]
    docs += [(30, docs[0][1], "en", "s", 1), (31, "begin a new one. " + shared, "en", "s", 1), (32, "other start of it. " + shared + " ".join(f"own{i}" for i in range(40)), "en", "s", 1)]
    docs += [(33, None, None, None, None), (None, "stays without an id at all", "en", "s", 1)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame(docs, columns)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    current = frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, str(tmp_path))
        assert current.dtypes == frame.dtypes
    texts = {r.doc_id: r.text for r in current.collect()}
    assert 30 not in texts and None in texts and "shared5" in texts[31] and "shared5" not in texts[32]
    assert {i for i in range(30)} <= set(texts)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(texts)
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES]
