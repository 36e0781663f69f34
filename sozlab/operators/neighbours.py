"""Pairs of words within a small distance: words meet where deletions of both leave the same letters."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Letters that name a bucket, letters from which deletions are made (the rest cannot hide a near word).
LETTERS, SPAN = 3, 24
#: Rows of words and pairs that are held as arrays at once.
BLOCK, PAIRS = 1 << 18, 1 << 21
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


def placed(words: DataFrame, bound: int) -> DataFrame:
    """The rows, once for each way to take the first letters of what up to ``bound`` deletions leave: bucket, cut.

    ``cut`` is where the letters after them begin.
    """
    word, ways = F.col("word"), []
    for at in combinations(range(LETTERS + bound), LETTERS):
        gone = max(set(range(at[-1])) - set(at), default=-1)
        bucket = F.xxhash64(F.concat(*[F.substring(word, i + 1, 1) for i in at]))
        ways.append(F.when(F.length(word) > gone, F.struct(bucket.alias("bucket"), F.lit(at[-1] + 1).alias("cut"))))
    return words.withColumn("_way", F.explode(F.array_compact(F.array(*ways)))).select("*", "_way.*").drop("_way")


class _Side:
    """Distinct words of a table, in order, as code points in one array, with the keys of their deletions; first: their rows."""

    def __init__(self, table: pa.Table, bound: int):
        words = table.column("word").to_pylist()
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.length) - self.length
        self.points = np.frombuffer(("".join(words) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        cut, bucket = table.column("cut").to_numpy().astype(np.int64), table.column("bucket").to_numpy().view(np.uint64)
        tail = np.maximum(np.minimum(self.length, SPAN) - cut, 0)
        keys, rows = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        kinds, of = np.unique(tail * 64 + cut, return_inverse=True)
        order, ends = np.argsort(of, kind="stable"), np.cumsum(np.bincount(of, minlength=len(kinds)))
        for kind, a, b in zip(kinds, ends - np.diff(ends, prepend=0), ends):
            at = order[a:b]
            made = self._deletions(at, int(kind % 64), int(kind // 64), bound + LETTERS - int(kind % 64))
            keys += [k + bucket[at] * np.uint64(BASE) for k in made]
            rows += [at] * len(made)
        number = table.column("word").combine_chunks().dictionary_encode().indices.to_numpy()
        self.first = np.unique(number, return_index=True)[1]
        self.keys, self.words = np.concatenate(keys), number[np.concatenate(rows)].astype(np.int64)
        self.length, self.start = self.length[self.first], self.start[self.first]

    def _deletions(self, at: np.ndarray, cut: int, size: int, most: int) -> list[np.ndarray]:
        """Hashes of ``size`` letters from ``cut`` on without up to ``most`` of them: polynomials, from sums of their terms."""
        sums = np.zeros((size + 1, len(at)), np.uint64)
        power, one, two = 1, np.uint64(UNBASE), np.uint64(UNBASE * UNBASE % 2**64)
        for i in range(size):
            value = (self.points[self.start[at] + cut + i].astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
            value = (value ^ (value >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            sums[i + 1] = sums[i] + (value ^ (value >> np.uint64(32))) * np.uint64(power)
            power = power * BASE % 2**64
        made = [sums[size]]
        if most > 0:
            made += [sums[a] + (sums[size] - sums[a + 1]) * one for a in range(size)]
        if most > 1:
            made += [
                sums[a] + (sums[b] - sums[a + 1]) * one + (sums[size] - sums[b + 1]) * two for a, b in combinations(range(size), 2)
            ]
        return made


def distances(a: _Side, b: _Side, left: np.ndarray, right: np.ndarray, bound: int) -> np.ndarray:
    """``lexical.alignment_distance`` of pairs of words whose lengths differ by ``bound`` at most; more than that is anything greater."""
    order = np.argsort(-a.length[left], kind="stable")
    left, right = left[order], right[order]
    size, gap = a.length[left], b.length[right] - a.length[left]
    found, far = np.zeros(len(left), np.int8), np.int8(bound + 1)
    begin, other, last = a.start[left], b.start[right], len(b.points) - 1
    active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 2), side="right")
    found[size == 0] = gap[size == 0]
    older, row, x_before = None, {d: np.full(len(left), d if d >= 0 else far, np.int8) for d in range(-bound, bound + 1)}, None
    point = lambda n, j: b.points[np.minimum(other[:n] + j - 1, last)]  # noqa: E731 - the letter j, from 1
    window = {j: point(len(left), j) for j in range(1, bound + 1)}
    for i in range(1, int(size[0]) + 1 if len(size) else 1):
        n = int(active[i - 1])
        x = a.points[begin[:n] + i - 1]
        window[i + bound] = point(n, i + bound)
        fresh = {}
        for d in range(-bound, bound + 1):
            j = i + d
            if j <= 0:
                fresh[d] = np.full(n, min(i, far) if j == 0 else far, np.int8)
                continue
            best = row[d][:n] + (x != window[j][:n])
            if d < bound:
                np.minimum(best, row[d + 1][:n] + np.int8(1), out=best)
            if d > -bound:
                np.minimum(best, fresh[d - 1] + np.int8(1), out=best)
            if i > 1 and j > 1:
                swap = (x == window[j - 1][:n]) & (x_before[:n] == window[j][:n])
                np.minimum(best, np.where(swap, older[d][:n] + np.int8(1), far), out=best)
            fresh[d] = np.minimum(best, far)
        older, row, x_before = row, fresh, x
        window.pop(i - bound - 1, None)
        ended = int(active[i])
        for d in range(-bound, bound + 1):
            found[ended:n][gap[ended:n] == d] = fresh[d][ended:n][gap[ended:n] == d]
    unsorted = np.empty_like(found)
    unsorted[order] = found
    return unsorted


def _first(codes: np.ndarray, top: int | None) -> np.ndarray:
    """Distinct codes in order, the ``top`` first ones of each asked word."""
    codes = np.sort(codes)
    codes = codes[np.diff(codes, prepend=codes[:1] + np.uint64(1)) != 0]
    if top is None or not len(codes):
        return codes
    word = codes >> np.uint64(34)
    starts = np.flatnonzero(np.diff(word, prepend=word[:1] + np.uint64(1)) != 0)
    return codes[np.arange(len(codes)) - np.repeat(starts, np.diff(starts, append=len(codes))) < top]


def _met(asked: pa.Table, known: pa.Table, bound: int, short: int, top: int | None) -> tuple[pa.Table, pa.Table, np.ndarray]:
    """Rows of both tables that are near, with distances; the best ``top`` of each asked word, by distance, frequency and term."""
    order = [("frequency", "descending"), ("word", "ascending")]
    known = known.take(pc.sort_indices(known, sort_keys=order, null_placement="at_end"))  # a term's number is its place
    a, b = _Side(asked, bound), _Side(known, bound)
    by_key = np.argsort(b.keys)
    keys, terms = b.keys[by_key], b.words[by_key]
    by_key = np.argsort(a.keys)
    wanted, askers = a.keys[by_key], a.words[by_key]
    low = np.searchsorted(keys, wanted)
    hit = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == wanted)
    low, askers, counts = low[hit], askers[hit], np.searchsorted(keys, wanted[hit], side="right") - low[hit]
    total, found = np.cumsum(counts), np.empty(0, np.uint64)
    i = 0
    while i < len(counts):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS, side="right")))
        n = counts[i:j]
        ends = np.cumsum(n)
        right = terms[np.repeat(low[i:j] - (ends - n), n) + np.arange(ends[-1])]
        left = np.repeat(askers[i:j], n)
        longer = a.length[left] - b.length[right]
        # a deletion index leaves out the words themselves, so it does not have short words with only extra letters
        fits = (np.abs(longer) <= bound) & ~((longer == bound) & (a.length[left] <= short))
        pairs = np.sort((left[fits].astype(np.uint64) << np.uint64(32)) | right[fits].astype(np.uint64))
        pairs = pairs[np.diff(pairs, prepend=pairs[:1] + np.uint64(1)) != 0]
        left, right = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(2**32 - 1)).astype(np.int64)
        distance = distances(a, b, left, right, bound)
        near = distance <= bound
        codes = (left[near].astype(np.uint64) << np.uint64(34)) | (distance[near].astype(np.uint64) << np.uint64(32)) | right[near].astype(np.uint64)
        found = _first(np.concatenate([found, codes]), top)
        i = j
    rows = a.first[(found >> np.uint64(34)).astype(np.int64)], b.first[(found & np.uint64(2**32 - 1)).astype(np.int64)]
    return asked.take(rows[0]), known.take(rows[1]), ((found >> np.uint64(32)) & np.uint64(3)).astype(np.int32)


def near_pairs(asked: DataFrame, known: DataFrame, bound: int, short: int, top: int | None = None) -> DataFrame:
    """(word, term, distance, frequency) of asked words and other known ones within a distance of 1 or 2; a pair can come twice.

    ``asked`` has word; ``known`` has term and frequency.  Pairs whose asked word has ``bound`` extra letters and ``short``
    letters at most are left out.  With ``top``, what cannot be among a word's first ``top`` may be missing; order is by
    distance, frequency (descending) and term.
    """
    frequency = known.schema["frequency"].dataType
    sides = known.select(F.col("term").alias("word"), "frequency", F.lit(True).alias("known")).unionByName(
        asked.select("word", F.lit(None).cast(frequency).alias("frequency"), F.lit(False).alias("known"))
    )
    made = StructType.fromDDL("word string, term string, distance int").add("frequency", frequency)

    def met(table: pa.Table) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(made)
        terms, words = table.filter(table.column("known")), table.filter(pc.invert(table.column("known")))
        for i in range(0, len(words) if len(terms) else 0, BLOCK):
            for j in range(0, len(terms), BLOCK):
                near, term, distance = _met(words.slice(i, BLOCK), terms.slice(j, BLOCK), bound, short, top)
                columns = [near.column("word"), term.column("word"), pa.array(distance), term.column("frequency")]
                yield from pa.table([c.cast(f.type) for c, f in zip(columns, types)], names=types.names).to_batches(max_chunksize=1 << 16)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 2 * BLOCK and batch.num_rows and held[0].column("bucket")[0] != batch.column("bucket")[-1]:
                table = pa.Table.from_batches(held)
                bucket = table.column("bucket").to_numpy()
                whole = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
                yield from met(table.slice(0, whole))
                held = table.slice(whole).combine_chunks().to_batches()
                n -= whole
        if n:
            yield from met(pa.Table.from_batches(held))

    return placed(sides, bound).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(mapped, made)
