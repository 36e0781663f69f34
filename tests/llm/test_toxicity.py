import time

import numpy as np
import pytest

from sozlab.llm import toxicity
from sozlab.llm.trees import Isotonic


@pytest.mark.parametrize("piece", ["!", "a!", "1", "a", "a ", "a.", " ", "x1", "@", "A! ", "aa1"])
def test_features_of_long_runs_take_linear_time(piece):
    text = piece * (1_000_000 // len(piece))
    began = time.time()
    found = toxicity.features(text, toxicity.Lexicon({}))
    assert len(found) == len(toxicity.FEATURES) and np.isfinite(found).all()
    assert time.time() - began < 10


def test_disguised_words_are_signed():
    signed = lambda t: [r for r in toxicity.SIGNS.findall(t) if toxicity.SIGNED.search(r)]
    assert signed("an 1d10t and a mor0n, f*ck 12 $tupid !! plain c3po x5 @ $$") == ["1d10t", "mor0n", "f*ck", "$tupid", "c3po"]


def test_equal_margins_are_pooled():
    rng = np.random.default_rng(3)
    margin = rng.integers(0, 12, 400).astype(float)
    y = (rng.random(400) < margin / 14).astype(float)
    scales = []
    for _ in range(4):
        order = rng.permutation(len(y))
        scales.append(Isotonic.fit(margin[order], y[order]))
    assert all((s.at == scales[0].at).all() and (s.value == scales[0].value).all() for s in scales)
    one, other = Isotonic.fit(np.zeros(2), np.array([0.0, 1.0])), Isotonic.fit(np.zeros(2), np.array([1.0, 0.0]))
    assert one(np.zeros(1)) == other(np.zeros(1)) == 0.5


def test_runs_give_equal_scores(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(300):
        words = [f"w{x}" for x in rng.integers(0, 60, 25)]
        if i % 4 == 0:
            words[3:5] = ["idiot", "blorg"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    known = spark.createDataFrame(labels, "doc_id long, toxic int")

    def scores(parts, seed):
        order = np.random.default_rng(seed).permutation(len(rows))
        docs = spark.createDataFrame([rows[k] for k in order], "doc_id long, text string").repartition(parts)
        return sorted((r.doc_id, r.score) for r in toxicity.toxicity(docs, known).collect())

    assert scores(2, 1) == scores(5, 2)
