"""License scans with a positional index of rare words (DataFrame functions only).

A licence is described by key phrases.  Documents are cut into words once; those that hold all words of some phrase
keep their words.  Corpus-wide document frequencies of the few template words make each phrase's rarest word its
anchor: the index maps anchors to (phrase, offset), a lookup of a file's anchors proposes starts, the words of each
phrase are verified in place, and postings of a licence's phrases are intersected by where each puts the template's start.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents_of, settle

#: Phrases and labels that are always reported.
BASE = {
    "gpl": ["gnu general public license"],
    "apache": ["apache license"],
    "cc-by": ["cc by"],
    "mit": ["mit license"],
}
#: Further licences, their mandatory key phrases and at which word of the template each begins.
MORE = {
    "gpl-3": {"gnu general public license": 0, "version 3": 4},
    "apache-2": {"licensed under the apache license": 0, "version 2 0": 5},
    "cc-by-nc": {"cc by nc": 0},
    "cc-by-nd": {"cc by nd": 0},
    "cc-by-sa": {"cc by sa": 0},
    "mit-text": {
        "permission is hereby granted free of charge": 0,
        "the above copyright notice and this permission notice shall be included": 67,
        "the software is provided as is": 87,
    },
    "bsd": {
        "redistribution and use in source and binary forms": 0,
        "provided that the following conditions are met": 14,
    },
    "isc": {"permission to use copy modify and or distribute this software": 0},
    "mpl": {"mozilla public license": 0},
    "lgpl": {"gnu lesser general public license": 0},
    "agpl": {"gnu affero general public license": 0},
    "creative-commons": {"creative commons attribution": 0},
    "unlicense": {"this is free and unencumbered software": 0},
}
#: Two phrases belong to one licence text if the template starts that they propose are at most so many words apart.
SLACK = 16
TEMPLATES = {label: dict.fromkeys(phrases, 0) for label, phrases in BASE.items()} | MORE
PHRASES = sorted({p for phrases in TEMPLATES.values() for p in phrases})
VOCABULARY = sorted({w for p in PHRASES for w in p.split()})
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Lowering beyond A-Z maps just one other character to a plain letter, this one, which no phrase holds.
assert not any("k" in w for w in VOCABULARY)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SEPARATORS), lambda w: w != "")


def _literal(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def _starts(phrase: str, anchor: str) -> Column:
    """Verified starts of a phrase, from the places of its anchor."""
    words = phrase.split()
    proposed = F.transform(
        F.filter("hits", lambda h: h["word"] == anchor), lambda h: h["pos"] - F.lit(words.index(anchor))
    )
    return F.filter(
        proposed, lambda s: (s >= 0) & (F.slice("words", s + 1, F.lit(len(words))) == _literal(words))
    )


def _weights(files: DataFrame) -> dict[str, float]:
    """Inverse document frequency of every template word over all files; as many rows as the vocabulary has words."""
    counted = files.select(F.explode("found").alias("word")).groupBy("word").count().collect()
    held, n = {r["word"]: r["count"] for r in counted}, files.count()
    return {w: math.log((n + 1) / (held.get(w, 0) + 1)) + 1 for w in VOCABULARY}


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    ``places`` lists (phrase, start) of every verified phrase, by word number.  A licence gets its label when all its key
    phrases are there and, for some place of the first, each other one proposes a template start within SLACK words of
    it; the score is the largest share of a licence's phrases, weighted by their words' inverse document frequencies, that
    is there.  Null and empty texts have no words,
    empty labels and score 0; null ids and repeated rows come back as they are; columns besides doc_id and text are
    ignored; an empty table gives an empty result.
    """
    cut = documents_of(docs).select("doc_id", words_of(F.col("text")).alias("words")).select(
        "doc_id", "words", F.array_intersect("words", _literal(VOCABULARY)).alias("found")
    )
    complete = [F.size(F.array_except(_literal(sorted(set(p.split()))), "found")) == 0 for p in PHRASES]
    maybe = F.lit(False)
    for condition in complete:
        maybe = maybe | condition
    files = settle(
        cut.select(
            "doc_id", F.size("words").cast("long").alias("n_words"), "found", F.when(maybe, F.col("words")).alias("words")
        )
    )
    weight = _weights(files)
    anchor = {p: max(p.split(), key=lambda w: (weight[w], w)) for p in PHRASES}
    anchors = _literal(sorted(set(anchor.values())))
    placed = F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("word")))
    hits = files.withColumn("hits", F.filter(placed, lambda h: F.array_contains(anchors, h["word"])))
    column = {p: f"p{i}" for i, p in enumerate(PHRASES)}
    none = F.array().cast("array<int>")
    starts = hits.select(
        "doc_id", "n_words", *[F.coalesce(_starts(p, anchor[p]), none).alias(column[p]) for p in PHRASES]
    )
    return starts.select("doc_id", "n_words", *_report(column, weight))


def _report(column: dict[str, str], weight: dict[str, float]) -> list[Column]:
    base = F.concat(*[F.col(column[p]) for phrases in BASE.values() for p in phrases])
    there = {label: _all_there(phrases, column) for label, phrases in TEMPLATES.items()}

    def names(labels) -> Column:
        return F.array_join(
            F.filter(F.array(*[F.when(there[x], F.lit(x)) for x in sorted(labels)]), lambda x: x.isNotNull()), ","
        )

    def share(phrases: dict[str, int]) -> Column:
        each = {p: sum(weight[w] for w in p.split()) for p in phrases}
        got = sum((F.when(F.size(column[p]) > 0, F.lit(each[p])).otherwise(F.lit(0.0)) for p in phrases), F.lit(0.0))
        return got / F.lit(sum(each.values()))

    return [
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base).cast("long").alias("first_word"),
        F.array_max(base).cast("long").alias("last_word"),
        names(BASE).alias("base_labels"),
        names(TEMPLATES).alias("labels"),
        F.round(F.greatest(*[share(p) for p in TEMPLATES.values()]), 6).alias("score"),
        F.concat(*[_placed(p, column[p]) for p in PHRASES]).alias("places"),
    ]


def _proposed_near(starts: str, offset: int) -> Column:
    """All places within SLACK words of a template start that the starts of a phrase propose."""
    return F.flatten(F.transform(starts, lambda s: F.sequence(s - F.lit(offset + SLACK), s - F.lit(offset - SLACK))))


def _placed(phrase: str, starts: str) -> Column:
    return F.transform(starts, lambda s: F.struct(F.lit(phrase).alias("phrase"), s.alias("start")))


def _all_there(phrases: dict[str, int], column: dict[str, str]) -> Column:
    """Whether postings of all phrases meet; every step is linear in the number of places."""
    (first, _), *later = phrases.items()
    meeting = F.col(column[first])
    for phrase, offset in later:
        meeting = F.array_intersect(meeting, _proposed_near(column[phrase], offset))
    return F.size(meeting) > 0


def oracle_sql() -> str:
    """The scan's report without ``places`` as DuckDB SQL over ``documents``."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    column = {p: f"p{i}" for i, p in enumerate(PHRASES)}

    def quoted(words) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    def starts(p: str) -> str:
        n = len(p.split())
        return (
            f"list_filter(range(len(words) - {n - 1}), lambda i: words[i + 1 : i + {n}] = {quoted(p.split())}) "
            f"AS {column[p]}"
        )

    def there(phrases: dict[str, int]) -> str:
        (first, _), *later = phrases.items()
        met = " AND ".join(
            f"len(list_filter({column[p]}, lambda t: abs(t - {o} - s) <= {SLACK})) > 0" for p, o in later
        )
        return f"(len(list_filter({column[first]}, lambda s: {met or 'true'})) > 0)"

    def names(labels) -> str:
        each = ", ".join(f"CASE WHEN {there(TEMPLATES[x])} THEN '{x}' END" for x in sorted(labels))
        return f"array_to_string(list_filter([{each}], lambda x: x IS NOT NULL), ',')"

    def mass(p: str) -> str:
        return "(" + " + ".join(f"idf['{w}']" for w in p.split()) + ")"

    def share(phrases: dict[str, int]) -> str:
        got = " + ".join(f"CASE WHEN len({column[p]}) > 0 THEN {mass(p)} ELSE 0 END" for p in phrases)
        return f"({got}) / ({' + '.join(map(mass, phrases))})"

    base = "list_concat(" * 3 + column[BASE["gpl"][0]]
    for label in ("apache", "cc-by", "mit"):
        base += f", {column[BASE[label][0]]})"
    return f"""
WITH cut AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{alphabet}', '{alphabet.lower()}'),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words FROM documents),
held AS (
  SELECT word, count(*) AS n FROM (
    SELECT unnest(list_distinct(list_filter(words, lambda w: list_contains({quoted(VOCABULARY)}, w)))) AS word
    FROM cut) GROUP BY word),
weights AS (
  SELECT map(list(word), list(ln(((SELECT count(*) FROM documents) + 1.0) / (coalesce(n, 0) + 1.0)) + 1)) AS idf
  FROM (SELECT unnest({quoted(VOCABULARY)}) AS word) LEFT JOIN held USING (word)),
found AS (SELECT doc_id, len(words) AS n_words, {", ".join(map(starts, PHRASES))} FROM cut)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, len({base}) AS n_base,
       list_min({base}) AS first_word, list_max({base}) AS last_word,
       {names(BASE)} AS base_labels, {names(TEMPLATES)} AS labels,
       round(greatest({", ".join(map(share, TEMPLATES.values()))}), 6) AS score
FROM found, weights
"""
