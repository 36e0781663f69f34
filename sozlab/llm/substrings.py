"""Substring deduplication by hashing runs of whole sentences and lines, and runs of words.

Words are normalised (case, punctuation and white space do not count).  A unit of the first kind begins at every sentence
or line and runs over whole sentences until it has ``min_words`` words; another ends at every end of a line.  Units of the
second kind ignore punctuation: their borders are words that a window minimum of word-pair hashes picks, so that every 50
words that repeat hold one, whatever ends or lines stand between them.  Digests are grouped globally; the earliest ranked
occurrence of each stays and the others are cut out of their texts, with the original offsets of what was cut.

Digests are sums of word hashes times powers of odd numbers, so that numpy takes them of all units of a text at once.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, documents_of, join_unique, map_texts, settle, text_or_empty

#: Words of a unit at least.  Shorter lines and sentences that repeat (headings, notices) are no passages by themselves.
MIN_WORDS = 20
#: Neighbouring word pairs of which one is a border; WINDOW + MIN_WORDS + WINDOW - 1 repeated words hold a unit.
WINDOW = 15
#: Marks that end a sentence where white space follows.
ENDS = ".!?…"
#: Characters whose hashes are held at once.
STRIP = 1 << 20
UNITS = "h1 array<long>, h2 array<int>, place array<long>, again array<boolean>"
CUT = "start:int,end:int"
LAST = (1 << 63) - 1
#: Odd numbers whose powers weigh characters, words, and words once more.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=64)
def _powers(base: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``most`` powers of an odd number and of its inverse, modulo 2**64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        powers = np.full(most, b, np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


def _sums(values: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each run from start to end of values their sum times powers of the base, counted from the start of the run."""
    up, down = _powers(base, 1 << max(15, len(values).bit_length()))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[end] - total[start]) * down[start]


@functools.lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point whether it is part of a word (1), white space (2) or neither, and its lower case."""
    kind, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for c in map(chr, range(0x110000)):
        if c.isalnum():
            kind[ord(c)], lower[ord(c)] = 1, ord(c.lower()[0])
        elif c.isspace():
            kind[ord(c)] = 2
    return kind, lower


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of a mask."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))
    return edges[::2], edges[1::2]


def words_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a text; where sentences end, and whether a line does (white space behind
    included)."""
    kind, lower = _characters()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = kind[points]
    start, end = _runs(kinds == 1)
    hashes = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + STRIP)))
        at = start[i]
        hashes[i:j] = _sums(_mixed(lower[points[at : end[j - 1]]].astype(np.uint64) + np.uint64(1)), BASES[0], start[i:j] - at, end[i:j] - at)
        i = j
    blank, after = _runs(kinds == 2)
    lines = np.concatenate(([0], np.cumsum(points == 10)))
    line = lines[after] > lines[blank]
    marked = np.isin(points[np.maximum(blank, 1) - 1], [ord(c) for c in ENDS]) & (blank > 0)
    return start, end, _mixed(hashes), after[line | marked], line[line | marked]


def borders(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of words that are a border: where the pair hash is the least (the last such) of some ``window`` pairs."""
    if len(hashes) <= window:
        return np.empty(0, np.int64)
    pairs = _mixed(hashes[:-1] * np.uint64(BASES[1]) + hashes[1:])
    seen = np.lib.stride_tricks.sliding_window_view(pairs[::-1], window)
    return np.unique(len(pairs) - 1 - (np.arange(len(seen)) + seen.argmin(axis=1)))


def _from_sentences(n: int, at: np.ndarray, line: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and words behind the last of runs of sentences; ``at`` are the sentences' first words, 0 and n too."""
    forward = np.searchsorted(at, at + min_words)
    first, behind = [at[forward < len(at)]], [at[forward[forward < len(at)]]]
    ends = np.flatnonzero(line)
    opened = np.concatenate(([0], at[ends]))[: len(ends)]
    backward = np.searchsorted(at, at[ends] - min_words, side="right") - 1
    inside = (at[ends] >= min_words) & (at[np.maximum(backward, 0)] >= opened)
    first.append(at[backward[inside]])
    behind.append(at[ends[inside]])
    return np.concatenate(first), np.concatenate(behind)


def units(text: str, min_words: int = MIN_WORDS, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (in characters), 64-bit and 32-bit digests of the units of a text, by their place."""
    start, end, hashes, breaks, line = words_of(text)
    n = len(start)
    if n < min_words:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    # sentences without words are part of none: a sentence starts behind the last break before its first word
    first = np.concatenate(([0], np.searchsorted(start, breaks), [n]))
    places = np.concatenate(([0], breaks, [len(text)]))
    at, earliest = np.unique(first, return_index=True)
    latest = len(first) - 1 - np.unique(first[::-1], return_index=True)[1]
    closed = np.maximum.reduceat(np.concatenate(([False], line, [True])), earliest)
    one, behind = _from_sentences(n, at, closed, min_words)
    cuts = borders(hashes, window)
    upto = np.searchsorted(cuts, cuts + min_words)
    two, last = cuts[upto < len(cuts)], cuts[upto[upto < len(cuts)]]
    begins = np.concatenate((places[latest[np.searchsorted(at, one)]], start[two]))
    ends = np.concatenate((places[earliest[np.searchsorted(at, behind)]], start[last]))
    one, behind = np.concatenate((one, two)), np.concatenate((behind, last))
    size = (behind - one).astype(np.uint64)
    h1 = _mixed(_sums(hashes, BASES[1], one, behind) + size)
    h2 = _mixed(_sums(_mixed(hashes), BASES[2], one, behind) + size) >> np.uint64(32)
    order = np.lexsort((ends, begins))
    order = order[np.r_[True, np.diff(begins[order]).astype(bool) | np.diff(ends[order]).astype(bool)]] if len(order) else order
    return begins[order], ends[order], h1[order], h2[order]


def _once(begins: np.ndarray, ends: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a unit counts (it does not overlap an equal one that counts and begins before), and whether it repeats one."""
    order = np.lexsort((begins, h2, h1))
    same = np.r_[False, (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])] if len(order) else np.empty(0, bool)
    counts, again = np.ones(len(order), bool), np.zeros(len(order), bool)
    free = 0
    for k in np.flatnonzero(same).tolist():
        if not same[k - 1]:
            free = ends[order[k - 1]]
        unit = order[k]
        again[unit] = counts[unit] = begins[unit] >= free
        if counts[unit]:
            free = ends[unit]
    return counts, again


def _units(min_words: int):
    def found(texts: list[str]) -> dict[str, list]:
        out: dict[str, list] = {"h1": [], "h2": [], "place": [], "again": []}
        for text in texts:
            begins, ends, h1, h2 = units(text, min_words)
            counts, again = _once(begins, ends, h1, h2)
            out["h1"].append(h1[counts].view(np.int64))
            out["h2"].append(h2[counts].astype(np.uint32).view(np.int32))
            out["place"].append((begins[counts] << 32) | ends[counts])
            out["again"].append(again[counts])
        return out

    return found


def merged(spans) -> list[tuple[int, int]]:
    """Sorted spans with overlapping and touching ones joined."""
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        at = end
    return "".join(kept) + text[at:]


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Spans to cut: (doc_id, text_hash, spans), for documents that have any.  A missing doc_id is read as the last."""
    read = documents_of(docs).select(
        F.monotonically_increasing_id().alias("row"), F.coalesce("doc_id", F.lit(LAST)).alias("rank"), F.xxhash64("text").alias("text_hash"), "text"
    )
    found = settle(map_texts(read, _units(min_words), ["row", "rank", "text_hash"], ["text"], UNITS))
    total = found.agg(F.coalesce(F.sum(F.size("again")), F.lit(0))).first()[0]
    placed = found.select("row", "rank", F.explode(F.arrays_zip("h1", "h2", "place", "again")).alias("u")).select("row", "rank", "u.*")
    firsts = placed.where("not again").drop("again")
    # one row per digest and task reaches a reducer, so a hot line is counted before it moves
    earliest = settle(
        firsts.groupBy("h1", "h2")
        .agg(F.min("rank").alias("keeper"), F.max("rank").alias("last"), F.count("*").alias("n"))
        .where("last > keeper")
        .select("h1", "h2", "keeper", "n")
    )
    later = join_unique(firsts, earliest, ["h1", "h2"], "n", total, "inner").where("rank > keeper").select("row", "place")
    cut = later.union(placed.where("again").select("row", "place")).groupBy("row").agg(F.collect_set("place").alias("places"))
    spans = F.transform("places", lambda p: F.struct(F.shiftright(p, 32).cast("int").alias("start"), p.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("end")))
    whose = found.select("row", F.col("rank").alias("doc_id"), "text_hash")
    out = settle(whose.join(cut, "row").select("doc_id", "text_hash", spans.alias("spans")))
    discard(docs.sparkSession, found, earliest)
    return out


def _cut(texts: list[str | None], cuts: list[list[dict] | None]) -> dict[str, list]:
    spans = [merged(c) if c else [] for c in cuts]
    return {
        "text": [without(t, s) if s else t for t, s in zip(texts, spans)],
        "spans": [[{"start": a, "end": b} for a, b in s] for s in spans],
    }


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The table, with all its columns, whose texts have lost what ``substring_dedup`` cuts."""
    names = docs.columns
    row = docs.select(F.struct(*names).alias("row")).select(
        "row",
        F.coalesce(F.col("row.doc_id").cast("long"), F.lit(LAST)).alias("rank_id"),
        F.xxhash64(F.coalesce(F.col("row.text"), F.lit(""))).alias("text_hash"),
    )
    cuts = repeats(docs, min_words).select(F.col("doc_id").alias("rank_id"), "text_hash", "spans")
    joined = row.join(cuts, ["rank_id", "text_hash"], "left").select("row", "spans")

    plain = joined.select(*[F.col(f"row.{c}").alias(c) for c in names if c != "text"], "row.text", "spans")
    rest = [c for c in names if c != "text"]
    return map_texts(plain, lambda t, s: {"text": _cut(t, s)["text"]}, rest, ["text", "spans"], "text string").select(*names)


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every row's remaining text and what was cut: doc_id, text, spans (original offsets in characters), n_cut.

    The earliest occurrence is the one in the smallest doc_id, there the first one.  Null texts stay null; texts with
    fewer than ``min_words`` words have no units and stay whole, as do repeated lines of fewer words (1 for every line); rows without doc_id rank last and share that rank;
    repeated rows, and rows that share a doc_id, rank alike and keep what they share with each other; columns besides
    doc_id and text are ignored; an empty table gives an empty result.
    """
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("rank_id"),
        F.xxhash64(text_or_empty()).alias("text_hash"),
    )
    cuts = repeats(docs, min_words).select(F.col("doc_id").alias("rank_id"), "text_hash", "spans")
    joined = base.join(cuts, ["rank_id", "text_hash"], "left").select("doc_id", "text", "spans")
    made = f"text string, spans array<struct<{CUT}>>"
    affected = map_texts(joined, _cut, ["doc_id"], ["text", "spans"], made)
    return affected.withColumn("n_cut", F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)"))
