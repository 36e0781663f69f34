"""Best-fit packing of token pieces with certified bin counts.

Pieces are dealt into partitions; each is packed by best-fit decreasing and certified by dual feasible functions: a
lower bound on the number of bins that its pieces need.  A partition whose bins exceed the bound (it has a gap) gives
up the pieces of all bins that are not full; one that meets the bound gives up its emptiest bin only, as rounding up
hides there.  What is given up is dealt anew into fewer partitions and packed again, until one partition holds it all
or nothing improves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .bpe import encode_whole
from .common import documents_of, settle, spread

CAPACITY = 1024
#: Pieces that one task packs; more pieces, more tasks.
PIECES_PER_PART = 32768
MOST_ROUNDS = 12
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "item long, length long, sequence_id long, offset long, released boolean, bins int, bound int"


def cuts(size: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than the capacity."""
    first = size % capacity or min(size, capacity)
    starts = [0, *range(first, size, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], size])]


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that pieces of these lengths need at least: the best of two families of dual feasible functions."""
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1)
    many, mass = np.cumsum(counts), np.cumsum(counts * sizes)
    # the threshold family: large pieces count as a whole bin, those below the threshold as nothing
    t = np.arange(1, capacity // 2 + 1)
    whole = many[-1] - many[capacity - t]
    threshold = whole + -(-(mass[capacity - t] - mass[t - 1]) // capacity)
    best = max(-(-int(mass[-1]) // capacity), int(threshold.max()))
    # the rounding family: a piece of x counts floor((k + 1) x / capacity) / k, or x / capacity where that is whole
    for k in range(1, 65):
        scaled = (k + 1) * sizes
        exact = scaled % capacity == 0
        worth = np.where(exact, sizes * k, (scaled // capacity) * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((worth * counts).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """For each piece its bin and its offset there, and each bin's free space."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[int] = []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces = 0  # bit s: some bin has s tokens of space
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        fitting = spaces >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            at = by_space[space].pop()
            if not by_space[space]:
                spaces ^= 1 << space
        else:
            space, at = capacity, len(free)
            free.append(capacity)
        bins[i], offsets[i] = at, capacity - space
        rest = free[at] = space - size
        if rest:
            by_space[rest].append(at)
            spaces |= 1 << rest
    return bins, offsets, free


def _pack_part(capacity: int, number: int, last: bool):
    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("item", kind="stable")
        lengths = part["length"].to_numpy()
        bins, offsets, free = best_fit_decreasing(lengths, capacity)
        space, bound = np.array(free), lower_bound(lengths, capacity)
        if last:
            open_bins = np.zeros(len(free), bool)
        elif len(free) > bound:
            open_bins = space > 0
        else:
            open_bins = (np.arange(len(free)) == space.argmax()) & (space > 0)
        return pd.DataFrame(
            {
                "item": part["item"].to_numpy(),
                "length": lengths,
                "sequence_id": (number << 56) + (int(key[0]) << 20) + bins,
                "offset": offsets,
                "released": open_bins[bins],
                "bins": len(free),
                "bound": bound,
            }
        )

    return pack


def pack_items(items: DataFrame, capacity: int = CAPACITY, per_part: int = PIECES_PER_PART) -> DataFrame:
    """Assign ``(item, length)`` rows (lengths from 1 to ``capacity``) to sequences: item, sequence_id, offset."""
    done, number, before = [], 0, None
    while True:
        count = items.count()
        parts = spread(count, per_part)
        last = parts == 1 or number >= MOST_ROUNDS or (before is not None and count >= before)
        keyed = items.withColumn("part", F.pmod(F.xxhash64("item", F.lit(number)), F.lit(parts)))
        packed = settle(
            keyed.repartition(parts, "part").groupBy("part").applyInPandas(_pack_part(capacity, number, last), PACKED)
        )
        done.append(packed.where(~F.col("released")).select("item", "sequence_id", "offset"))
        if last:
            return reduce(DataFrame.union, done)
        items, before, number = packed.where("released").select("item", "length"), count, number + 1


def pieces_of(docs: DataFrame, path: str, capacity: int, tail: tuple[int, ...], keep_ids: bool) -> DataFrame:
    """Every document's pieces with the checksum (and, if asked for, the bytes) of their ids."""

    names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * keep_ids
    ddl = PIECES + ", ids binary" * keep_ids

    fields = StructType.fromDDL(ddl)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(fields)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.concatenate([encode_whole(path, text), np.array(tail, np.uint32)]).astype("<u4")
                for n, (start, length) in enumerate(cuts(len(ids), capacity)):
                    data = ids[start : start + length].tobytes()
                    row = (doc_id, n, start, length, zlib.crc32(data))
                    rows.append((*row, data) if keep_ids else row)
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return documents_of(docs).mapInArrow(cut, ddl)


def pack_documents(
    docs: DataFrame,
    path: str,
    capacity: int = CAPACITY,
    tail: tuple[int, ...] = (2,),
    per_part: int = PIECES_PER_PART,
    keep_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents with their place in a sequence.

    doc_id, piece, start, length, ids_crc32 (and ids with ``keep_ids``), sequence_id, offset.  A document longer than
    the capacity is cut into full pieces, the first of which may be shorter.  Null and empty texts are documents of
    the tail alone; null ids and repeated rows are documents of their own; columns besides doc_id and text are
    ignored; an empty table gives an empty result.
    """
    pieces = settle(
        pieces_of(docs, path, capacity, tail, keep_ids).withColumn("item", F.monotonically_increasing_id())
    )
    full = pieces.where(F.col("length") == capacity)
    placed_full = full.withColumn("sequence_id", -1 - F.col("item")).withColumn("offset", F.lit(0).cast("long"))
    short = pieces.where(F.col("length") < capacity)
    placed = short.join(pack_items(short.select("item", "length"), capacity, per_part), "item")
    return placed_full.unionByName(placed).drop("item")


def sequences(packed: DataFrame) -> DataFrame:
    """Training sequences of pieces packed with ``keep_ids``: sequence_id, n_tokens, ids (little-endian 32 bit).

    A group is one sequence, so at most its capacity of pieces.
    """
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"),
    ).select("sequence_id", "n_tokens", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))").alias("ids"))
