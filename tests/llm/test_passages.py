import re
import time

import numpy as np
import pytest

from sozlab.llm import substrings


@pytest.mark.parametrize("mark", [" ", ", ", " | ", ".&&& ", ". "])
def test_passage_without_sentence_ends_is_cut(spark, mark):
    rng = np.random.default_rng(9)
    passage = [f"p{x}" for x in rng.permutation(60)]
    before, behind = ([f"{c}{x}" for x in rng.permutation(40)] for c in "uv")
    first = " ".join(before) + " " + " ".join(passage) + " one more word"
    second = "Another start " + mark.join(passage) + " " + " ".join(behind)
    frame = spark.createDataFrame([(1, first), (2, second)], "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.substring_dedup(frame).collect()}
    assert got[1].text == first
    assert got[2].n_cut > 0 and got[2].text.startswith("Another start") and " ".join(behind) in got[2].text


def test_every_run_of_fifty_words_holds_a_unit():
    rng = np.random.default_rng(2)
    for _ in range(200):
        passage = " ".join(f"w{x}" for x in rng.integers(0, 30, 50))
        sides = [" ".join(f"{c}{x}" for x in rng.integers(0, 30, 45)) for c in "abcd"]
        x, y = (f"{sides[k]} {passage} {sides[k + 1]}" for k in (0, 2))
        assert set(substrings.units(x)[2].tolist()) & set(substrings.units(y)[2].tolist())


def test_repeated_words_keep_their_first_run(spark):
    text = "a " * 200
    row = substrings.substring_dedup(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert 20 <= len(row.text.split()) < 60 and row.text == substrings.without(text, [(s.start, s.end) for s in row.spans])


def brute_units(text: str, least: int) -> dict[tuple[int, int], tuple[str, ...]]:
    """The docstring's rules, word by word."""
    words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", text)]
    sentences, at, line_starts = [], 0, set()  # (start, end, its words)
    for gap in [*(m.span() for m in re.finditer(r"\s+", text)), (len(text), len(text))]:
        newline = gap[1] == len(text) or "\n" in text[slice(*gap)]
        if newline or (gap[0] and text[gap[0] - 1] in ".!?…"):
            inside = [i for i, w in enumerate(words) if at <= w[0] < gap[1]]
            if inside:
                sentences.append([at, gap[1], inside, newline])
            elif newline and sentences:
                sentences[-1][3] = True
            at = gap[1]
    if sentences:
        sentences[-1][3] = True
    found = {}

    def add(run):
        found[run[0][0], run[-1][1]] = tuple(words[i][2] for s in run for i in s[2])

    for i in range(len(sentences)):
        for j in range(i, len(sentences)):
            if sum(len(s[2]) for s in sentences[i : j + 1]) >= least:
                add(sentences[i : j + 1])
                break
        if sentences[i][3]:
            j = i
            while sum(len(s[2]) for s in sentences[j : i + 1]) < least and j and not sentences[j - 1][3]:
                j -= 1
            if sum(len(s[2]) for s in sentences[j : i + 1]) >= least:
                add(sentences[j : i + 1])
    cuts = substrings.borders(substrings.words_of(text)[2]).tolist()
    for i in cuts:
        j = next((j for j in cuts if j >= i + least), None)
        if j is not None:
            found[words[i][0], words[j][0]] = tuple(w[2] for w in words[i:j])
    return found


def brute_cuts(docs: dict[int, str], least: int) -> dict[int, list[tuple[int, int]]]:
    owner, want = {}, {}
    for i, text in sorted(docs.items()):
        spans, free = [], {}
        for (start, end), words in sorted(brute_units(text, least).items()):
            if start < free.get(words, 0):
                continue
            if words in free or owner.get(words, i) < i:
                spans.append({"start": start, "end": end})
            free[words] = end
        for words in free:
            owner.setdefault(words, i)
        want[i] = substrings.merged(spans)
    return want


@pytest.mark.parametrize("least", [1, 8, 20])
def test_cuts_match_brute_force(spark, least):
    rng = np.random.default_rng(least)
    lines = [" ".join(f"w{x}" for x in rng.integers(0, 25, rng.integers(1, 30))) for _ in range(40)]
    marks = [". ", ".\n", "\n", " ", "! ", "… ", " --- \n\n", "\n*\n", ", ", "._ ", ".. \t"]
    docs = {}
    for i in range(60):
        chosen = rng.integers(0, len(lines), rng.integers(0, 25))
        docs[i] = "".join(lines[k].upper() if rng.random() < 0.2 else lines[k] + str(rng.choice(marks)) for k in chosen)
    docs |= {60: "", 61: "\n\n", 62: " . \n" * 50, 63: "Ünï ß İstanbul 漢字 " * 30, 64: "lead\n" + docs[1], 65: "_x_ " * 60, 66: docs[2]}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    want = brute_cuts(docs, least)
    assert sum(map(bool, want.values())) > 20
    for row in substrings.substring_dedup(frame, least).collect():
        assert [(s.start, s.end) for s in row.spans] == want[row.doc_id], row.doc_id
        assert row.text == substrings.without(docs[row.doc_id], want[row.doc_id])


@pytest.mark.parametrize("piece", [" ", ". \n", "!", "\n", "a ", "._"])
def test_long_texts_of_one_kind_take_linear_time(piece):
    text = piece * (1_000_000 // len(piece))
    began = time.time()
    substrings._units(substrings.MIN_WORDS)([text])
    assert time.time() - began < 10
