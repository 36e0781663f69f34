import random
import threading

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from sozlab.operators import lexical, neighbours


def _made(seed, n, least, most):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice("abcdə") for _ in range(rng.randrange(least, most))) for _ in range(n)})


def _asked(spark, words):
    return spark.createDataFrame([(w,) for w in words], "word string")


@pytest.mark.parametrize("bound", [1, 2])
def test_best_suggestions_match_brute_force(spark, bound):
    terms = _made(1, 150, 1, 10) + [32 * "x" + t for t in _made(2, 20, 2, 6)]
    words = _made(3, 150, 2, 10) + [32 * "x" + t for t in _made(4, 20, 2, 6)]
    freq = {t: i % 3 for i, t in enumerate(terms)}
    left_out = lambda w, t: len(w) <= lexical.PREFIX and len(w) - len(t) == bound
    near = {
        w: [(0, -freq[w], w)] if w in freq else sorted(
            (lexical.alignment_distance(w, t), -f, t) for t, f in freq.items() if not left_out(w, t) and abs(len(w) - len(t)) <= bound
        ) for w in words
    }
    want = {(w, i + 1, t, d, -f) for w, found in near.items() for i, (d, f, t) in enumerate(x for x in found if x[0] <= bound)}
    table = spark.createDataFrame(list(freq.items()), "word string, freq long")
    assert set(map(tuple, lexical.suggestions(_asked(spark, words), table, bound).collect())) == want
    best = set(map(tuple, lexical.suggestions(_asked(spark, words), table, bound, top=3).collect()))
    assert best == {x for x in want if x[1] <= 3}


def test_blocks_of_any_size_find_the_same(monkeypatch):
    rows = [("kit" + w, known) for known in (False, True) for w in _made(5 + known, 150, 1, 6)]
    words, known = map(list, zip(*rows))
    columns = {"word": words, "known": known, "frequency": [1] * len(rows), "bucket": [0] * len(rows)}
    table = pa.table(columns | {"cut": pa.array([neighbours.LETTERS] * len(rows), pa.int32())})
    asked, terms = table.filter(pc.invert(table.column("known"))), table.filter(table.column("known"))

    def met(pairs, top=None):
        monkeypatch.setattr(neighbours, "PAIRS", pairs)
        a, b, distance = neighbours._met(asked, terms, 2, 0, top)
        return list(zip(a.column("word").to_pylist(), b.column("word").to_pylist(), distance.tolist()))

    assert len(met(1)) > 150 and met(1) == met(1 << 21) and met(1, 2) == met(1 << 21, 2)


def test_words_of_one_beginning_do_not_all_meet(spark):
    rng = random.Random(7)
    tails = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(4000)})
    table = spark.createDataFrame([("kitabda" + t, 1) for t in tails], "word string, freq long")
    late = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        got = {(r.word, r.term) for r in lexical.suggestions(_asked(spark, ["kitabda" + t[1:] for t in tails]), table).collect()}
    finally:
        late.cancel()
    assert {("kitabda" + t[1:], "kitabda" + t) for t in tails} <= got
