"""Whole texts: diacritics, spelling, stems, keywords and sentiment from one token array.

Texts give up their distinct words, which are decided on once each by joins with the vocabularies, and take the results
back.  ``key`` names a column that tells rows apart.  Null and empty texts, and texts of over a megabyte, stay as they are
and have no words; words of over 256 bytes stay too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens
from ..functions.casing import apply_case, az_lower, compose_nfc, is_title_case
from ..sources.shared import settled
from . import lexical, morphology

MOST_BYTES, MOST_WORD_BYTES, MOST_PARTS, LEAST_LETTERS = 1 << 20, 256, 8, 2
#: A hyphen between two parts; an apostrophe behind a stem, with what follows it.
HYPHENATED, TAILED = r"(?s)^[^-]+-.", r"(?s)^(.+?)('.+|[’ʼ].*)$"


def _is_word(piece: Column) -> Column:
    return tokens.token_type(piece) == "Word"


def _pieces(frame: DataFrame, key: str, text: Column) -> DataFrame:
    """A row per token: key, pos, piece, word (the piece if it is a word, else null)."""
    fits = F.octet_length(text) <= MOST_BYTES
    rows = frame.where(fits).select(key, F.posexplode(tokens.token_texts(text)).alias("pos", "piece"))
    return rows.withColumn("word", F.when(_is_word(F.col("piece")), F.col("piece")))


def _replaced(frame: DataFrame, key: str, text: Column, replacements: DataFrame, name: str) -> DataFrame:
    """The table with the column ``name``: the text, its words replaced by ``replacements`` (word, new)."""
    rows = _pieces(frame, key, text).join(replacements, "word", "left")
    shown = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("new", "piece").alias("shown")))), lambda p: p["shown"])
    made = rows.groupBy(key).agg(F.array_join(shown, "").alias("_made"))
    return frame.join(made, key, "left").withColumn(name, F.coalesce("_made", text)).drop("_made")


def _distinct(words: DataFrame, column: str) -> DataFrame:
    return words.select(F.col(column).alias("word")).where("word is not null and word != ''").distinct()


def restore_words(words: DataFrame, dictionary: DataFrame, column: str = "word") -> DataFrame:
    """Distinct words with diacritics restored: word, restored.

    Parts between hyphens (up to eight) are restored each, before an apostrophe only the stem is; letters are composed first.
    """
    word = F.col("nfc")
    parts = F.when(word.rlike(HYPHENATED), F.split(word, "-")).when(
        word.rlike(TAILED), F.array(F.regexp_extract(word, TAILED, 1))
    ).otherwise(F.array(word))
    tail = F.when(~word.rlike(HYPHENATED) & word.rlike(TAILED), F.regexp_extract(word, TAILED, 2)).otherwise("")
    split = _distinct(words, column).withColumn("nfc", compose_nfc(F.col("word"))).withColumns({"parts": parts, "tail": tail})
    asked = (F.size("parts") <= MOST_PARTS) & (F.octet_length("nfc") <= MOST_WORD_BYTES)
    rows = split.where(asked).select("word", "tail", F.posexplode("parts").alias("pos", "part"))
    found = lexical.restore_diacritics(rows, dictionary, "part").select(F.col("word").alias("part"), "restored")
    joined = rows.join(found, "part", "left").groupBy("word", "tail").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("restored", "part").alias("shown")))).alias("shown")
    )
    whole = F.concat(F.array_join(F.transform("shown", lambda p: p["shown"]), "-"), "tail")
    return joined.select("word", whole.alias("restored")).union(split.where(~asked).select("word", "nfc"))


def normalize_texts(frame: DataFrame, key: str, column: str, dictionary: DataFrame, name: str = "normalized") -> DataFrame:
    """The table with the text, composed, the diacritics of its words restored."""
    text = F.when(F.octet_length(column) <= MOST_BYTES, compose_nfc(F.col(column))).otherwise(F.col(column))
    words = _pieces(frame, key, text).select("word")
    restored = restore_words(words, dictionary).where("restored != word").withColumnRenamed("restored", "new")
    return _replaced(frame, key, text, restored, name)


def check_words(words: DataFrame, dictionary: DataFrame, frequencies: DataFrame, column: str = "word") -> DataFrame:
    """Whether distinct words are spelt correctly: word, correct.

    Correct are words of the frequency list, words with suffixes on a dictionary word, words that are either once their
    diacritics are restored, words with digits, and words that are too short or too long to tell.  Each part between
    hyphens must be correct; of a part with an apostrophe, what stands before it.
    """
    parts = F.when(F.col("word").rlike(HYPHENATED), F.split("word", "-")).otherwise(F.array("word"))
    split = _distinct(words, column).withColumn("parts", parts)
    asked = (F.size("parts") <= MOST_PARTS) & (F.octet_length("word") <= MOST_WORD_BYTES)
    low = az_lower(F.col("part"))
    rows = split.where(asked).select("word", F.explode("parts").alias("part")).where("part != ''")
    rows = rows.select("word", F.when(low.rlike(TAILED), F.regexp_extract(low, TAILED, 1)).otherwise(low).alias("part"))
    plain = (F.length("part") < LEAST_LETTERS) | F.col("part").rlike(r"\p{Nd}")
    doubtful = rows.where(~plain).select("part").distinct()
    forms = settled(
        doubtful.select("part", F.col("part").alias("form")).union(
            restore_words(doubtful, dictionary, "part").where("restored != word").select("word", "restored")
        )
    )
    listed = frequencies.select(F.col("word").alias("form"), F.lit(True).alias("listed")).distinct()
    inflected = morphology.analyse_words(forms, dictionary, "form").select(F.col("word").alias("form"), "inflected")
    judged = forms.join(listed, "form", "left").join(inflected, "form", "left")
    good = judged.groupBy("part").agg(F.max(F.coalesce("listed", F.lit(False)) | F.coalesce("inflected", F.lit(False))).alias("good"))
    told = rows.withColumn("plain", plain).join(good, "part", "left")
    correct = told.groupBy("word").agg(F.min(F.col("plain") | F.coalesce("good", F.lit(False))).alias("correct"))
    return split.select("word").join(correct, "word", "left").select("word", F.coalesce("correct", F.lit(True)).alias("correct"))


def suggest_words(words: DataFrame, dictionary: DataFrame, frequencies: DataFrame, column: str = "word") -> DataFrame:
    """Ranked corrections of misspelt words: word, rank, term, distance, frequency; the word's case pattern is on the term.

    Words near the whole word come first; where there are none, an unknown stem is corrected and the suffixes are put back,
    if the result has an analysis on a dictionary word.
    """
    wrong = check_words(words, dictionary, frequencies, column).where("not correct and octet_length(word) <= %d" % MOST_WORD_BYTES)
    # distinct misspelt words and what is near them are read several times: as plans inside plans they outgrow the driver
    wrong = settled(wrong.select("word", az_lower(F.col("word")).alias("low")))
    near = settled(lexical.suggestions(wrong, frequencies, column="low").withColumnRenamed("word", "low").drop("rank"))
    rest = wrong.select("low").distinct().join(near.select("low").distinct(), "low", "left_anti")
    stems = morphology.analyse_words(rest, dictionary, "low").select(F.col("word").alias("low"), F.explode("analyses").alias("a"))
    suffix = F.array_join(F.transform("a.morphemes", lambda m: m["surface"]), "")
    open_stems = stems.where(F.size("a.morphemes") > 0).select("low", az_lower(F.col("a.stem")).alias("stem"), suffix.alias("suffix"))
    open_stems = settled(open_stems.join(dictionary.select(F.col("lemma").alias("stem")).distinct(), "stem", "left_anti").distinct())
    found = lexical.suggestions(open_stems, frequencies, column="stem").withColumnRenamed("word", "stem").drop("rank")
    built = settled(open_stems.join(found, "stem").select("low", F.concat("term", "suffix").alias("term"), "distance", "frequency"))
    valid = morphology.analyse_words(built, dictionary, "term").where("inflected").select(F.col("word").alias("term"))
    built = built.join(valid, "term", "left_semi").groupBy("low", "term").agg(
        F.min(F.struct("distance", (-F.col("frequency")).alias("f"))).alias("best")
    )
    found = near.unionByName(built.select("low", "term", F.col("best.distance").alias("distance"), (-F.col("best.f")).alias("frequency")))
    order = Window.partitionBy("word").orderBy("distance", F.desc("frequency"), "lowered")
    ranked = wrong.join(found.withColumnRenamed("term", "lowered"), "low").withColumn("rank", F.row_number().over(order))
    return ranked.select("word", "rank", apply_case(F.col("word"), F.col("lowered")).alias("term"), "distance", "frequency")


def correct_texts(frame: DataFrame, key: str, column: str, dictionary: DataFrame, frequencies: DataFrame, name: str = "corrected") -> DataFrame:
    """The table with the text, its misspelt words replaced by their best corrections; misspelt words in title case stay."""
    words = _pieces(frame, key, F.col(column)).select("word").where(~is_title_case(F.col("word")))
    best = suggest_words(words, dictionary, frequencies).where("rank = 1").select("word", F.col("term").alias("new"))
    return _replaced(frame, key, F.col(column), best, name)


def stems_of_texts(frame: DataFrame, key: str, column: str, dictionary: DataFrame) -> DataFrame:
    """A row per word of a text: key, pos, stem (lowered)."""
    rows = _pieces(frame, key, F.col(column)).where("word is not null")
    stems = morphology.analyse_words(rows, dictionary).select("word", az_lower(F.col("stem")).alias("stem"))
    return rows.join(stems, "word").select(key, "pos", "stem")


def keyword_stems(frame: DataFrame, key: str, column: str, dictionary: DataFrame) -> DataFrame:
    """A row per word that may be a keyword: key, pos, stem.

    Texts are normalised first; words with eight or more parts, one-letter stems and function words are left out.
    """
    clean = normalize_texts(frame.select(key, column), key, column, dictionary, "_clean").select(key, "_clean")
    rows = _pieces(clean, key, F.col("_clean")).where(f"word is not null and length(word) - length(replace(word, '-', '')) < {MOST_PARTS}")
    stems = morphology.analyse_words(rows, dictionary).select("word", az_lower(F.col("stem")).alias("stem"))
    kept = rows.join(stems, "word").where((F.length("stem") >= LEAST_LETTERS) & ~F.col("stem").isin(lexical.STOPWORDS))
    return kept.select(key, "pos", "stem")


def keywords(frame: DataFrame, key: str, column: str, dictionary: DataFrame, top: int = 10) -> DataFrame:
    """The stems of each text's best keywords by TextRank: key, keywords; texts without any are left out."""
    stems = keyword_stems(frame, key, column, dictionary)
    ordered = stems.groupBy(F.col(key).alias("doc_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "stem"))), lambda p: p["stem"]).alias("stems")
    )
    ranked = lexical.textrank(ordered, top).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "stem"))).alias("best"))
    return ranked.select(F.col("doc_id").alias(key), F.transform("best", lambda p: p["stem"]).alias("keywords"))


def sentiment_of_texts(frame: DataFrame, key: str, column: str, dictionary: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Sentiment of each text that has words: key, sentiment, score, positive, negative, total."""
    stems = stems_of_texts(frame, key, column, dictionary).withColumnRenamed(key, "doc_id")
    return lexical.sentiment(stems, lexicon).withColumnRenamed("doc_id", key)


def is_positive(sentiment: Column) -> Column:
    return sentiment == "Positive"
