"""Batch jobs that build vocabularies and report on corpora; relational from end to end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens, translit
from ..functions.casing import az_lower, compose_nfc
from ..operators import morphology, texts

LEAST_CORPUS, LEAST_LLR = 50, 10.83
#: Parts of speech of a dump and their letters.
POS = {"noun": "N", "name": "N", "pron": "N", "num": "N", "det": "N", "verb": "V", "adj": "A", "adv": "D", "intj": "D", "conj": "D", "postp": "D", "particle": "D"}
DROPPED = ("suffix", "prefix", "character")


def pos_letter(pos: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in POS.items() for x in kv])
    return F.when(~pos.isin(*DROPPED), F.coalesce(F.try_element_at(table, pos), F.lit("X")))


def valid_stem(word: Column) -> Column:
    return (F.length(word) >= 2) & word.rlike("[aıoueəiöü]")


def build_dictionary(dump: DataFrame) -> DataFrame:
    """Distinct acceptable lemmas of a dump with their part-of-speech letter: pos, lemma.

    Infinitives lose their ending; a noun that is another lemma with a plural or a possessive ending goes.
    """
    word = az_lower(F.col("word"))
    rows = dump.select(pos_letter(F.col("pos")).alias("pos"), word.alias("word")).where("pos is not null")
    rows = rows.where(F.col("word").rlike(r"^\p{L}{2,}$") & ~F.col("word").rlike(r"[\x{400}-\x{4FF}\x{600}-\x{6FF}]"))
    cut = F.regexp_replace("word", "(?:maq|mək)$", "")
    lemma = F.when((F.col("pos") == "V") & valid_stem(cut), cut).otherwise(F.col("word"))
    lemmas = rows.select("pos", lemma.alias("lemma")).distinct()
    bases = lemmas.where("pos = 'N'").select(
        "lemma", F.explode(F.array_distinct(F.array(*[F.regexp_replace("lemma", f"(?:{e})$", "") for e in ("lar|lər", "sı|si|su|sü", "ı|i|u|ü")]))).alias("base")
    ).where("base != lemma")
    known = lemmas.select(F.col("lemma").alias("base")).distinct()
    inflected = bases.join(known, "base", "left_semi").select("lemma").distinct()
    return lemmas.where("pos != 'N'").union(lemmas.where("pos = 'N'").join(inflected, "lemma", "left_anti").select("pos", "lemma"))


def word_frequencies(corpus: DataFrame, stems: DataFrame, column: str = "value") -> DataFrame:
    """Counts of words and of their stems over a corpus: word, freq.

    ``stems`` maps word to stem; every stem is there, with 1 at least, other words from LEAST_CORPUS on.
    """
    words = corpus.select(F.explode(tokens.words(F.col(column))).alias("word")).select(az_lower(F.col("word")).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    both = counted.join(stems.select("word", "stem"), "word", "left")
    each = both.select(F.explode(F.array_distinct(F.array("word", F.coalesce("stem", "word")))).alias("word"), "n")
    totals = each.groupBy("word").agg(F.sum("n").alias("freq"))
    lemmas = stems.select(F.col("stem").alias("word")).distinct().withColumn("is_stem", F.lit(True))
    merged = totals.join(lemmas, "word", "full_outer")
    return merged.where(F.col("is_stem") | (F.col("freq") >= LEAST_CORPUS)).select("word", F.greatest(F.coalesce("freq", F.lit(0)), F.lit(1)).cast("long").alias("freq"))


def review_class(score: Column) -> Column:
    return F.when(score <= 2, "negative").when(score >= 4, "positive").otherwise("neutral")


def confusion(reviews: DataFrame) -> DataFrame:
    """Counts of actual against predicted classes: actual, predicted, n."""
    return reviews.groupBy("actual", "predicted").agg(F.count("*").alias("n"))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each class of a confusion table: class, precision, recall, f1."""
    rows = matrix.select(F.col("actual").alias("class"), F.lit("a").alias("side"), "n", (F.col("actual") == F.col("predicted")).alias("hit")).union(
        matrix.select("predicted", F.lit("p"), "n", F.col("actual") == F.col("predicted"))
    )
    sums = rows.groupBy("class").agg(
        F.sum(F.when((F.col("side") == "a") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("side") == "a", F.col("n")).otherwise(0)).alias("actual"),
        F.sum(F.when(F.col("side") == "p", F.col("n")).otherwise(0)).alias("predicted"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    rated = sums.select("class", F.round(share("tp", "predicted"), 6).alias("precision"), F.round(share("tp", "actual"), 6).alias("recall"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return rated.withColumn("f1", F.round(f1, 6))


def _g(*cells: Column) -> Column:
    """Sum of x ln x, nothing for empty cells."""
    return sum((F.when(c > 0, c * F.ln(c)).otherwise(F.lit(0.0)) for c in cells), F.lit(0.0))


def mine_lexicon(stems: DataFrame, classes: DataFrame, lexicon: DataFrame, least_docs: int = 10, least_class: int = 5, top: int = 500) -> DataFrame:
    """Stems that tell positive from negative reviews, by likelihood ratio: rank, stem, pos, neg, neu, llr, score.

    ``stems`` has doc_id and stem; ``classes`` has doc_id and class.  A stem needs ``least_docs`` reviews in all and
    ``least_class`` in the commoner of the two classes.
    """
    docs = stems.select("doc_id", "stem").distinct().join(classes, "doc_id")
    is_class = lambda c: F.count_if(F.col("class") == c)
    totals = classes.agg(is_class("positive").cast("double").alias("all_pos"), is_class("negative").cast("double").alias("all_neg"))
    counts = docs.groupBy("stem").agg(is_class("positive").alias("pos"), is_class("negative").alias("neg"), is_class("neutral").alias("neu"))
    fresh = counts.join(lexicon.select("stem").distinct(), "stem", "left_anti")
    enough = (F.col("pos") + F.col("neg") + F.col("neu") >= least_docs) & (F.greatest("pos", "neg") >= least_class)
    a, b = F.col("pos").cast("double"), F.col("neg").cast("double")
    c, d = F.col("all_pos") - a, F.col("all_neg") - b
    llr = 2 * (_g(a, b, c, d) - _g(a + b, c + d, a + c, b + d) + _g(a + b + c + d))
    share = (a - b) / (a + b)
    rated = fresh.where(enough).join(F.broadcast(totals)).select(
        "stem", "pos", "neg", "neu", F.round(llr, 4).alias("llr"), F.round(F.round(share * 0.9 / 0.05) * 0.05, 2).alias("score")
    )
    order = Window.orderBy(F.desc("llr"), "stem")
    best = rated.where(F.col("llr") >= LEAST_LLR).orderBy(F.desc("llr"), "stem").limit(top)
    return best.withColumn("rank", F.row_number().over(order)).select("rank", "stem", "pos", "neg", "neu", "llr", "score")


def review_stems(reviews: DataFrame, key: str, column: str, dictionary: DataFrame) -> DataFrame:
    """Distinct stems of each review: key, stem (lowered).

    Texts are composed, words without a letter left out, the marks of the others restored before they are stemmed.
    """
    composed = reviews.select(key, compose_nfc(F.col(column)).alias("_text"))
    rows = composed.select(key, F.explode(tokens.words(F.col("_text"))).alias("word")).where(F.col("word").rlike(r"\p{L}")).distinct()
    restored = texts.restore_words(rows, dictionary)
    stems = morphology.analyse_words(restored, dictionary, "restored").select(F.col("word").alias("restored"), az_lower(F.col("stem")).alias("stem"))
    return rows.join(restored, "word").join(stems, "restored").select(key, "stem").where("stem != ''").distinct()


def predicted_classes(reviews: DataFrame, key: str, stems: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Each review's class by the mean score of its stems in a lexicon: key, predicted; neutral where none is listed."""
    scored = stems.join(lexicon.groupBy("stem").agg(F.max("score").alias("score")), "stem").groupBy(key).agg(F.avg("score").alias("mean"))
    told = F.when(F.col("mean") > 0, "positive").when(F.col("mean") < 0, "negative").otherwise("neutral")
    return reviews.select(key).join(scored, key, "left").select(key, told.alias("predicted"))


def clean_reviews(reviews: DataFrame, order: str) -> DataFrame:
    """Reviews with ten characters or more, the first of each content by ``order``: content, score."""
    first = Window.partitionBy("content").orderBy(order)
    trimmed = reviews.where("content is not null and score is not null").withColumn("content", F.trim(F.regexp_replace("content", r"\s+", " ")))
    return trimmed.where(F.length("content") >= 10).withColumn("_n", F.row_number().over(first)).where("_n = 1").select("content", "score")


def corpus_report(corpus: DataFrame) -> DataFrame:
    """Per file: bytes, tokens by type, sentences, paragraphs, whether tokens rebuild the text, and an outlier mark.

    A file is an outlier if it has over three times the median of sentences per paragraph.
    """
    text = F.col("value")
    counted = corpus.select("file", text, tokens.token_texts(text).alias("pieces"), tokens.sentences(text).alias("sents"))
    kinds = counted.withColumn("types", F.transform("pieces", tokens.token_type))
    rows = kinds.groupBy("file").agg(
        F.sum(F.octet_length("value")).alias("bytes"),
        F.sum(F.coalesce(F.size("pieces"), F.lit(0))).alias("tokens"),
        F.sum(F.coalesce(F.size(F.filter("types", lambda t: t == "Word")), F.lit(0))).alias("words"),
        F.sum(F.coalesce(F.size("sents"), F.lit(0))).alias("sentences"),
        F.count_if(text != "").alias("paragraphs"),
        F.bool_and(F.coalesce(F.array_join("pieces", ""), F.lit("")) == text).alias("rebuilt"),
        F.bool_or(text.rlike(r"[\x{400}-\x{4FF}]")).alias("cyrillic"),
        F.bool_and(F.array_join(tokens.token_texts(translit.cyrillic_to_latin(text)), "") == translit.cyrillic_to_latin(text)).alias("translit_rebuilt"),
    )
    ratio = rows.withColumn("ratio", F.try_divide("sentences", "paragraphs"))
    median = ratio.agg(F.expr("percentile(ratio, 0.5)").alias("median"))
    return ratio.join(F.broadcast(median)).withColumn("outlier", F.col("ratio") > 3 * F.col("median")).drop("median")


def first_divergence(original: Column, rebuilt: Column) -> Column:
    """Where two strings first differ: struct of pos (byte), got and want (their bytes in hex, 00 past an end); null if equal."""
    a, b = F.hex(F.encode(original, "UTF-8")), F.hex(F.encode(rebuilt, "UTF-8"))
    at = lambda s, i: F.substring(s, 2 * i + 1, F.lit(2))
    shorter = F.least(F.length(a), F.length(b)).try_cast("int") / 2
    places = F.sequence(F.lit(0), shorter.cast("int"))
    pos = F.get(F.filter(places, lambda i: (i == shorter) | (at(a, i) != at(b, i))), F.lit(0))
    byte = lambda s: F.rpad(at(s, pos), 2, "0")
    return F.when(original != rebuilt, F.struct(pos.alias("pos"), byte(b).alias("got"), byte(a).alias("want")))


def reconstruction_failures(corpus: DataFrame) -> DataFrame:
    """Lines that their tokens do not rebuild, as they are or turned to Latin: file, kind, pos, got, want."""
    latin = translit.cyrillic_to_latin(F.col("value"))
    pairs = F.array(
        F.struct(F.lit("RECON_FAIL").alias("kind"), F.col("value").alias("original")),
        F.when(F.col("value").rlike(r"[\x{400}-\x{4FF}]"), F.struct(F.lit("TRANSLIT_RECON_FAIL").alias("kind"), latin.alias("original"))),
    )
    rows = corpus.where("value != ''").select("file", F.explode(F.filter(pairs, lambda p: p.isNotNull())).alias("p")).select("file", "p.*")
    rebuilt = rows.withColumn("rebuilt", F.array_join(tokens.token_texts(F.col("original")), "")).where("original != rebuilt")
    return rebuilt.select("file", "kind", first_divergence(F.col("original"), F.col("rebuilt")).alias("d")).select("file", "kind", "d.*")


def token_type_shares(corpus: DataFrame) -> DataFrame:
    """Tokens of each type over a corpus and their share in percent: type, n, percent; types that are missing have none."""
    types = ["Word", "Number", "Punctuation", "Space", "Symbol", "URL", "Email"]
    each = F.transform(tokens.token_texts(F.col("value")), tokens.token_type)
    counted = corpus.select(F.explode(each).alias("type")).groupBy("type").agg(F.count("*").alias("n"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    listed = corpus.sparkSession.createDataFrame([(t,) for t in types], "type string")
    shown = listed.join(F.broadcast(counted), "type", "left").join(F.broadcast(total)).withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return shown.select("type", "n", F.round(F.coalesce(F.try_divide(100.0 * F.col("n"), F.col("total")), F.lit(0.0)), 1).alias("percent"))


def corpus_totals(report: DataFrame) -> DataFrame:
    """One row of a corpus report (``corpus_report``): files, bytes, rebuilt and not, outliers, Cyrillic files and their rebuilding."""
    said = lambda c, name: F.count_if(c).alias(name)
    rebuilt, cyrillic, latin = F.col("rebuilt"), F.col("cyrillic"), F.col("translit_rebuilt")
    return report.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), said(rebuilt, "rebuilt"), said(~rebuilt, "not_rebuilt"),
        said(F.col("outlier"), "outliers"), said(cyrillic, "cyrillic"), said(cyrillic & latin, "translit_rebuilt"), said(cyrillic & ~latin, "translit_not_rebuilt"),
    )
