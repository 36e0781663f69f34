"""Vocabulary operators: diacritics, spelling, keywords, sentiment.  All are joins over distinct words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.casing import az_lower
from .neighbours import near_pairs
from .rows import explode_rows

#: Letters that lose their mark when typed plainly.
MARKED, PLAIN = "əöüğçş", "eougcs"
PREFIX, MOST_DISTANCE = 7, 2
#: Function words that are no keywords.
STOPWORDS = (
    "mən sən o biz siz onlar bu belə elə həmin kim nə hara hansı neçə öz kimsə nəsə heç və ilə da də həm ya ancaq lakin "
    "amma ki çünki üçün qarşı doğru qədər dək görə sonra əvvəl başqa yalnız lap ən əlbəttə bəlkə yəqin əslində "
    "həqiqətən deməli guya var yox deyil ol et ed de get gəl ver al qoy"
).split()
NEGATION = "deyil"


def folded(word: Column) -> Column:
    return F.translate(word, MARKED, PLAIN)


def restore_diacritics(words: DataFrame, dictionary: DataFrame, column: str = "word") -> DataFrame:
    """Distinct words with their marked spelling where the dictionary has exactly one: word, restored.

    Known words, words that have marks and words with more than ten doubtful letters stay as they are.
    """
    lemmas = dictionary.select("lemma").distinct()
    unique = lemmas.groupBy(folded(F.col("lemma")).alias("plain")).agg(F.count("*").alias("n"), F.min("lemma").alias("lemma"))
    distinct = words.select(F.col(column).alias("word")).where("word is not null").distinct()
    low = distinct.withColumn("low", az_lower(F.col("word")))
    doubtful = (F.length(F.regexp_replace(F.col("low"), "[^eougcs]", "")) <= 10) & ~F.col("low").rlike(f"[{MARKED}]")
    hit = low.join(unique, F.col("low") == F.col("plain"), "left")
    clear = doubtful & (F.col("n") == 1) & (F.col("lemma") != F.col("low"))
    letters = F.zip_with(
        F.split("word", ""), F.split("lemma", ""), lambda a, b: F.when(a == az_lower(a), b).otherwise(F.upper(F.translate(b, "iı", "İI")))
    )
    return hit.select("word", F.when(clear, F.array_join(letters, "")).otherwise(F.col("word")).alias("restored"))


def alignment_distance(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours, no part edited twice."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
    return row[-1]


def suggestions(
    words: DataFrame, frequencies: DataFrame, max_distance: int = MOST_DISTANCE, column: str = "word", top: int | None = None
) -> DataFrame:
    """Ranked dictionary terms near each distinct word: word, rank, term, distance, frequency; the first ``top`` or all.

    A term has itself as its only suggestion.  Of words with up to ``PREFIX`` letters, terms that have ``max_distance``
    letters less are left out, as a deletion index of the first letters does not have them.
    """
    bound = max(0, min(max_distance, MOST_DISTANCE))
    distinct = words.select(az_lower(F.col(column)).alias("word")).where("word is not null and length(word) >= 2").distinct()
    freq = frequencies.where("word is not null").groupBy(F.col("word").alias("term")).agg(F.max("freq").alias("frequency"))
    found = distinct.join(freq, F.col("word") == F.col("term")).select("word", "term", F.lit(0).alias("distance"), "frequency")
    if bound:
        unknown = distinct.join(freq, F.col("word") == F.col("term"), "left_anti")
        found = found.unionByName(near_pairs(unknown, freq, bound, PREFIX, top))
    order = Window.partitionBy("word").orderBy("distance", F.desc("frequency"), "term")
    ranked = found.repartition("word").dropDuplicates(["word", "term"]).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.lit(True) if top is None else F.col("rank") <= top).select("word", "rank", "term", "distance", "frequency")


def correct_words(words: DataFrame, frequencies: DataFrame, column: str = "word") -> DataFrame:
    """Each distinct word with its best suggestion, or itself: word, corrected."""
    best = suggestions(words, frequencies, column=column).where("rank = 1").select("word", "term")
    distinct = words.select(az_lower(F.col(column)).alias("word")).where("word is not null").distinct()
    return distinct.join(best, "word", "left").select("word", F.coalesce("term", "word").alias("corrected"))


def tfidf(stems: DataFrame, frequencies: DataFrame, top: int = 10) -> DataFrame:
    """Top keywords by count over length times ln(total / (1 + frequency)): doc_id, rank, stem, score, count.

    ``stems`` has doc_id and stem, a row per place; ``frequencies`` has stem and freq.
    """
    total = frequencies.agg(F.sum("freq").cast("double").alias("total"))
    counts = stems.groupBy("doc_id", "stem").agg(F.count("*").alias("count"))
    length = counts.groupBy("doc_id").agg(F.sum("count").alias("n"))
    freq = frequencies.groupBy("stem").agg(F.max("freq").alias("freq"))
    scored = counts.join(length, "doc_id").join(freq, "stem", "left").join(F.broadcast(total))
    score = F.col("count") / F.col("n") * F.ln(F.col("total") / (1 + F.coalesce("freq", F.lit(0))))
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "stem")
    ranked = scored.withColumn("score", F.round(score, 9)).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= (top if top > 0 else 10)).select("doc_id", "rank", "stem", "score", "count")


def page_ranks(stems: list[str], damping: float = 0.85, rounds: int = 30, settled: float = 1e-4) -> dict[str, float]:
    """Ranks of the stems of one document by the weights of their neighbours up to two places away."""
    weights: dict[str, dict[str, float]] = {s: {} for s in stems}
    for gap in (1, 2):
        for a, b in zip(stems, stems[gap:]):
            if a != b:
                weights[a][b] = weights[a].get(b, 0) + 1
                weights[b][a] = weights[b].get(a, 0) + 1
    n = len(weights)
    sums = {s: sum(w.values()) for s, w in weights.items()}
    rank = dict.fromkeys(weights, 1 / n) if n else {}
    for _ in range(rounds):
        fresh = {
            s: (1 - damping) / n + damping * sum(rank[o] * w / sums[o] for o, w in weights[s].items()) for s in weights
        }
        moved = max((abs(fresh[s] - rank[s]) for s in fresh), default=0.0)
        rank = fresh
        if moved < settled:
            break
    return rank


def textrank(documents: DataFrame, top: int = 10, column: str = "stems") -> DataFrame:
    """Top keywords of each document's array of stems by rank among neighbours: doc_id, rank, stem, score, count."""
    limit = top if top > 0 else 10

    def best(doc_id, stems):
        ranks = page_ranks(stems or [])
        order = sorted(ranks, key=lambda s: (-ranks[s], s))[:limit]
        return [(doc_id, i + 1, s, round(ranks[s], 9), stems.count(s)) for i, s in enumerate(order)]

    return explode_rows(documents, ["doc_id", column], "doc_id long, rank int, stem string, score double, count long", best)


def sentiment(stems: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Mean lexicon score of each document's stems, turned round before a negation.

    ``stems`` has doc_id, pos, stem; ``lexicon`` has stem, score.  Returns doc_id, sentiment, score, positive, negative,
    total (all words).
    """
    after = Window.partitionBy("doc_id").orderBy("pos")
    known = lexicon.groupBy("stem").agg(F.max_by("score", F.col("ord")).alias("value")) if "ord" in lexicon.columns else lexicon.groupBy("stem").agg(F.max("score").alias("value"))
    placed = stems.withColumn("next", F.lead("stem").over(after))
    value = F.when(F.col("stem") != NEGATION, F.when(F.col("next") == NEGATION, -F.col("value")).otherwise(F.col("value")))
    scored = placed.join(known, "stem", "left").withColumn("value", value)
    totals = scored.groupBy("doc_id").agg(
        F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 9).alias("score"),
        F.count_if(F.col("value") > 0).alias("positive"),
        F.count_if(F.col("value") < 0).alias("negative"),
        F.count("*").alias("total"),
    )
    label = F.when(F.col("score") > 0, "Positive").when(F.col("score") < 0, "Negative").otherwise("Neutral")
    return totals.select("doc_id", label.alias("sentiment"), "score", "positive", "negative", "total")
