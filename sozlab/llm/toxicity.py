"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features are densities of a general lexicon and of a learned one of words and word beginnings (inflected insults share a
stem), how near lexicon words stand to second-person words,
capitals, punctuation, and rates of obfuscation (digits or signs for letters, stretched letters, letters set apart).
Labelled rows outside the held-out fold are split by hash: half teach the lexicon, three tenths the trees, two tenths
the calibration.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, map_texts, settle, text_or_empty
from .trees import BoostedTrees, Isotonic

FOLDS = 5
#: Labelled rows that teach at most, the first by hash of their ids; with fewer, all of them.  They are broadcast.
MOST_LABELLED = 100_000
#: Entries that a task counts before it passes the counts on.
MOST_COUNTED = 200_000
LEXICON_SIZE, LEAST_TOXIC_DOCS, LEAST_ODDS = 600, 5, 2.0
#: Share of the toxic documents that an entry is found in at least; so the candidates are few, however many documents.
LEAST_TOXIC_SHARE = 0.005
#: Lengths of word beginnings that may become entries, which end in a mark.
STEMS, MARK = (4, 5, 6, 7), "~"
MEMO_SIZE, LONGEST_KEPT = 1 << 18, 64
#: Words of insult and contempt in general use, and words of address, in the languages expected.
INSULTS = frozenset(
    "idiot idiots moron morons stupid loser losers trash scum worthless pathetic disgusting clown dumb dumbass fool "
    "imbecile jerk bastard bitch asshole crap shit fuck fucking damn garbage ugly hate kill filth filthy freak vermin "
    "retard pig coward liar useless subhuman parasite "
    "idiota estupido estúpido imbécil basura asqueroso inútil payaso patético cerdo mierda escoria "
    "idiote stupide imbécile crétin ordure déchet pathétique minable clown salaud merde connard dégoûtant "
    "dumm dummkopf trottel abschaum wertlos widerlich arschloch scheiße versager müll clown erbärmlich".split()
)
ADDRESS = frozenset(
    "you your yours yourself u ur ya tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch tú ti tus "
    "usted ustedes vosotros".split()
)
LOOKALIKES = str.maketrans("013457@$!|+", "oleastasilt")
WORDS = re.compile(r"[^\W_]+(?:['’@$!|+*][^\W_]+)*")
#: Runs of letters and the signs that stand for some, and what marks such a run: signs between letters, or before two.
SIGNS = re.compile(r"[a-z0-9@$!|+*]+")
SIGNED = re.compile(r"[a-z][0-9@$!|+*]+[a-z]|(?<![a-z0-9@$])[0-9@$]+[a-z]{2}")
STRETCHED = re.compile(r"([a-z])\1{2,}")
APART = re.compile(r"\b(?:[a-z][ .\-_*]){3,}[a-z]\b")
NEAR, FAR = 5, 1_000_000
FEATURES = [
    "insults", "insult_share", "learned", "learned_share", "weight", "weight_share", "heaviest", "addressed", "address_share",
    "address_gap", "hidden", "signed_share", "stretched_share", "apart", "capital_share", "shouted_share",
    "mark_share", "exclaimed_share", "digit_share", "length",
]
SCORES = "score double, predicted int"


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def plain(word: str) -> str:
    """A word without the usual disguises: signs and digits for letters, repeated letters."""
    return STRETCHED.sub(r"\1", word.translate(LOOKALIKES).replace("*", ""))


def entries(word: str) -> list[str]:
    """The lexicon entries that a word can match: itself and its longer beginnings."""
    return [word, *(word[:k] + MARK for k in STEMS if len(word) > k)]


class Lexicon(dict):
    """word -> (is an insult, learned weight or 0); remembers what it has looked up, within a bound."""

    def __init__(self, learned: dict[str, float]):
        super().__init__()
        self.learned = learned

    def __reduce__(self):
        return Lexicon, (self.learned,)

    def __missing__(self, word: str) -> tuple[bool, float]:
        found = (word in INSULTS, max((self.learned.get(e, 0.0) for e in entries(word)), default=0.0))
        found = found if found != (False, 0.0) else NOTHING
        if len(self) >= MEMO_SIZE:
            self.clear()
        if len(word) <= LONGEST_KEPT:
            self[word] = found
        return found


NOTHING = (False, 0.0)


def features(text: str, lexicon: Lexicon) -> list[float]:
    lower = text.lower()
    words = WORDS.findall(lower)
    n, chars = max(1, len(words)), max(1, len(text))
    hits = [(i, *f) for i, f in enumerate(map(lexicon.__getitem__, words)) if f is not NOTHING]
    insults = sum(h[1] for h in hits)
    known = [h[2] for h in hits if h[2]]
    signed = [run for run in SIGNS.findall(lower) if SIGNED.search(run)] if any(c in text for c in "013457@$!|+*") else []
    stretched = STRETCHED.findall(lower)
    apart = [re.sub(r"[^a-z]", "", a) for a in APART.findall(lower)]
    hidden = {plain(w) for w in signed} | set(apart)
    if stretched:
        hidden |= {plain(w) for w in words if STRETCHED.search(w)}
    hidden_hits = sum(lexicon[w] is not NOTHING for w in hidden)
    addressed = np.array([i for i, w in enumerate(words) if w in ADDRESS] if hits else [], int)
    gaps = _gaps(np.array([h[0] for h in hits], int), addressed)
    capitals = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    letters = sum(map(len, words)) or 1
    marks = sum(map(text.count, ".,;:!?#*$%&|\"'()-"))
    shouted = sum(map(str.isupper, text.split())) if capitals > letters / 5 else 0
    digits = sum(map(text.count, "0123456789"))
    weight = sum(known)
    return [
        insults, insults / n, len(known), len(known) / n, weight, weight / n, max(known, default=0.0),
        float((gaps <= NEAR).sum()), len(addressed) / n, float(gaps.min(initial=FAR)), hidden_hits,
        len(signed) / n, len(stretched) / n, len(apart), capitals / letters, shouted / n, marks / chars,
        text.count("!") / chars, digits / chars, math.log1p(len(words)),
    ]


def _gaps(hits: np.ndarray, others: np.ndarray) -> np.ndarray:
    """From each hit the distance to the nearest of the other places, which ascend."""
    if not len(hits) or not len(others):
        return np.full(len(hits), FAR)
    at = np.searchsorted(others, hits)
    before, after = others[np.maximum(at - 1, 0)], others[np.minimum(at, len(others) - 1)]
    return np.minimum(abs(hits - before), abs(hits - after))


def _matrix(learned: dict[str, float]):
    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(learned)
        for batch in batches:
            x = [features(t, lexicon) for t in batch["text"]]
            yield pd.DataFrame({"toxic": batch["toxic"], "share": batch["share"], "x": x})

    return featured


def _presence(among: frozenset | None):
    """How many documents hold each entry (of ``among``, or any), summed within a task as far as memory allows."""

    def frame(counts: Counter) -> pd.DataFrame:
        return pd.DataFrame({"entry": pd.Series(list(counts), dtype=object), "n": pd.Series(list(counts.values()), dtype="int64")})

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                held = {e for w in set(words_of(text)) for e in entries(w)}
                counts.update(held if among is None else held & among)
                if len(counts) > MOST_COUNTED:
                    yield frame(counts)
                    counts.clear()
        yield frame(counts)

    return counted


def held_out(doc_id="doc_id"):
    """The fold that teaches nothing: crc32 of the id as text, mod 5, is 0.  A missing id is not in it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled texts outside the held-out fold: toxic, share (0-4 lexicon, 5-7 trees, 8-9 calibration), text.

    Texts are not moved: at most MOST_LABELLED labels go to where the documents are.  Equal texts are in one share.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    taught = known.where(~held_out()).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id", "toxic").limit(MOST_LABELLED).distinct()
    joined = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(taught), "doc_id")
    return joined.select("toxic", F.pmod(F.xxhash64("text", F.lit(5)), F.lit(10)).cast("int").alias("share"), "text")


def learned_lexicon(rows: DataFrame) -> dict[str, float]:
    """Entries that mark toxic documents, with their log odds.

    First all toxic documents of the share are counted; entries that enough of them hold (a bounded number) are then
    counted in all others.  At most LEXICON_SIZE entries stay.
    """
    share = rows.where("share < 5")
    totals = {r["toxic"]: r["n"] for r in share.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return {}

    def documents(toxic: int, among: frozenset | None) -> DataFrame:
        counts = share.where(F.col("toxic") == toxic).select("text").mapInPandas(_presence(among), "entry string, n long")
        return counts.groupBy("entry").agg(F.sum("n").alias("n"))

    least = max(LEAST_TOXIC_DOCS, totals[1] * LEAST_TOXIC_SHARE)
    toxic = {r["entry"]: r["n"] for r in documents(1, None).where(F.col("n") >= least).collect()}
    clean = {r["entry"]: r["n"] for r in documents(0, frozenset(toxic)).collect()}
    odds = {
        e: math.log((n + 0.5) / (totals[1] + 1)) - math.log((clean.get(e, 0) + 0.5) / (totals[0] + 1))
        for e, n in toxic.items()
    }
    marked = sorted((e for e in odds if odds[e] > LEAST_ODDS), key=lambda e: (-odds[e] * toxic[e], e))
    return {e: odds[e] for e in marked[:LEXICON_SIZE]}


class ToxicityModel:
    def __init__(self, learned: dict[str, float], trees: BoostedTrees | None, scale: Isotonic | None, prior: float):
        self.lexicon, self.trees, self.scale, self.prior = Lexicon(learned), trees, scale, prior

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.trees is None or not len(texts):
            return np.full(len(texts), self.prior)
        x = np.array([features(t, self.lexicon) for t in texts], float)
        return self.scale(self.trees.margin(x))


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn from labelled rows outside the held-out fold; without both labels every score is the labels' mean (or 0)."""
    rows = settle(training_rows(docs, labels))
    learned = learned_lexicon(rows)
    got = rows.where("share >= 5").select("toxic", "share", "text").mapInPandas(_matrix(learned), "toxic int, share int, x array<double>").toPandas()
    # one order whatever task a row comes from, so that sums of floats agree between runs
    got = got.iloc[np.lexsort((*np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES)).T, got["toxic"], got["share"]))]
    y = got["toxic"].to_numpy(float)
    fitted = (got["share"] < 8).to_numpy()
    if len(set(y[fitted])) < 2 or len(set(y[~fitted])) < 2:
        return ToxicityModel(learned, None, None, float(y.mean()) if len(y) else 0.0)
    x = np.array(got["x"].tolist(), float)
    trees = BoostedTrees().fit(x[fitted], y[fitted])
    return ToxicityModel(learned, trees, Isotonic.fit(trees.margin(x[~fitted]), y[~fitted]), float(y.mean()))


def scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Every row's score: doc_id, held_out, score, predicted."""

    def score(texts: list[str]) -> dict[str, list]:
        found = model.scores(texts)
        return {"score": found.tolist(), "predicted": (found >= 0.5).astype(int).tolist()}

    ready = documents_of(docs).withColumn("held_out", held_out())
    return map_texts(ready, score, ["doc_id", "held_out"], ["text"], SCORES)


def kept(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Rows of ``docs``, with all their columns, that are not predicted to be toxic."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(model.scores(texts) < 0.5))

    return docs.mapInArrow(keep, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all rows by a model learnt from the labelled ones.

    Null texts are empty texts and are scored as such; null ids come back as null and are not held out; labels other
    than 0 and 1 and labels without id teach nothing; repeated labelled texts teach as often; repeated rows give repeated
    results; columns besides doc_id, text and toxic are ignored; an empty table gives an empty result.
    """
    return scored(docs, fit(docs, labels))
