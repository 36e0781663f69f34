import numpy as np
import pytest

from sozlab.llm import neardup


def _texts(words: list[list[str]]) -> dict[int, str]:
    return {i: " ".join(w) for i, w in enumerate(words)}


def _components(docs: dict[int, str]) -> dict[int, int]:
    """Brute force over shared shingle counts."""
    sets = {i: set(neardup.shingles(t).tolist()) for i, t in docs.items()}
    every = {s: k for k, s in enumerate(sorted(set().union(*sets.values())))}
    there = np.zeros((len(docs), len(every)), np.float32)
    for i, found in sets.items():
        there[i, [every[s] for s in found]] = 1
    both = there @ there.T
    sizes = there.sum(axis=1)
    linked = 100 * both >= 80 * (sizes[:, None] + sizes[None, :] - both)
    label = np.arange(len(docs))
    while True:
        low = np.where(linked, label[None, :], len(docs)).min(axis=1)
        if (low == label).all():
            return dict(enumerate(label.tolist()))
        label = low


def _got(spark, docs: dict[int, str]) -> dict[int, int]:
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    return {r.doc_id: r.component_id for r in neardup.near_duplicates(frame).collect()}


def test_links_among_unlinked_documents_of_one_template(spark):
    template = [f"t{i}" for i in range(160)]
    own = lambda i, n: [f"d{i}x{j}" for j in range(n)]
    # backgrounds share about 0.74 with each other; pairs share a few more words of their own
    words = [template + own(i, 28) for i in range(900)]
    for i in range(150):
        rest = own(f"p{i}", 8)
        words += [template + rest + own(f"a{i}", 18), template + rest + own(f"b{i}", 18)]
    order = np.random.default_rng(3).permutation(len(words))
    docs = _texts([words[i] for i in order])
    want = _components(docs)
    assert 100 < len(docs) - len(set(want.values())) < 200
    assert _got(spark, docs) == want


@pytest.mark.parametrize("block", [64, 1024])
def test_exact_pairs_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = np.random.default_rng(5)
    template = [f"t{i}" for i in range(90)]
    docs = _texts([template + [f"w{x}" for x in rng.integers(0, 40, rng.integers(4, 16))] for _ in range(300)])
    assert _got(spark, docs) == _components(docs)


def test_links_out_of_a_component_longer_than_a_batch(spark):
    # 600 near copies of one text, and pairs of another component that only meet some of them
    base = [f"t{i}" for i in range(120)]
    words = [base + [f"m{i}"] for i in range(600)]
    words += [base[: 92 + i % 20] + [f"q{j}" for j in range(20)] + [f"e{i}"] for i in range(60)]
    order = np.random.default_rng(6).permutation(len(words))
    docs = _texts([words[i] for i in order])
    assert _got(spark, docs) == _components(docs)
