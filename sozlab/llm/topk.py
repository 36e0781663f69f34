"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Vectors are turned into integer postings (dimension -> weight).  Candidates and queries are dealt into
blocks; each pair of a candidate block and a query block is one task that scatters the query rows' weights
over the block's postings into dense score arrays, one dimension (term) at a time.  Partition selection keeps
the best k of every block; a ranked window merges the blocks.  No index and no pruning, so the result is exact.
Every row is copied once per block of the other side, so n candidates and m queries in blocks of b rows shuffle 2 n m / b
rows; blocks are as large as a task's memory allows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spread

#: Components that a block of candidates or of queries holds at most (as 8-byte weights 32 MB), and its rows at most.
BLOCK_COMPONENTS, BLOCK_ROWS = 1 << 22, 1 << 16
#: Blocks are smaller than that, down to so many rows, while there are fewer of them than cores.
LEAST_ROWS = 8192
#: Scores in the dense arrays that are held at once.
STRIP_SCORES = 1 << 20
PARTIAL = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``(vec_id, q)`` with q = floor(scale * component) of usable vectors."""
    vec = F.col(vec_col)
    usable = (
        F.col(id_col).isNotNull()
        & vec.isNotNull()
        & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    )
    return vectors.where(usable).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(vec, lambda x: F.floor(x.cast("double") * F.lit(scale))).alias("q"),
    )


def _dense(rows: pd.Series) -> np.ndarray:
    """Rows of differing lengths as one matrix; a missing component is a zero weight."""
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Dense scores of every query row, one term after the other."""
    scores = np.zeros((len(queries), len(candidates)), dtype=np.int64)
    for term in range(min(queries.shape[1], candidates.shape[1])):
        weights = queries[:, term]
        postings = np.flatnonzero(candidates[:, term])
        rows = np.flatnonzero(weights)
        if not len(postings) or not len(rows):
            continue
        added = weights[rows][:, None] * candidates[postings, term][None, :]
        if len(rows) == len(weights) and len(postings) == scores.shape[1]:
            scores += added
        else:
            scores[np.ix_(rows, postings)] += added
    return scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores; ids ascend, so among ties the first positions win."""
    if len(scores) <= k:
        return np.arange(len(scores))
    kth = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > kth)
    return np.concatenate([above, np.flatnonzero(scores == kth)[: k - len(above)]])


def _search_block(k: int):
    def search(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(queries):
            candidates = candidates.sort_values("vec_id", kind="stable")
            ids, matrix = candidates["vec_id"].to_numpy(), _dense(candidates["q"])
            query_ids, weights = queries["vec_id"].to_numpy(), _dense(queries["q"])
            strip = max(1, STRIP_SCORES // len(ids))
            for at in range(0, len(query_ids), strip):
                scores = accumulate(weights[at : at + strip], matrix)
                for query, row in zip(query_ids[at : at + strip], scores):
                    others = ids != query
                    row, own = (row, ids) if others.all() else (row[others], ids[others])
                    top = best(row, own, k)
                    out.append(pd.DataFrame({"query_id": query, "vec_id": own[top], "score": row[top]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    return search


def exact_topk(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    scale: int = 1024,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    candidate_block: int | None = None,
    query_block: int | None = None,
) -> DataFrame:
    """The k best partners of each query row among all other rows: query_id, rank, vec_id, score.

    ``is_query`` is a condition on the column ``vec_id``; ``candidate_block`` and ``query_block`` are rows of a block, by
    default as many as BLOCK_COMPONENTS allow for the widest vector.  Defined results: null ids and vectors that are null or
    hold null or non-finite components take no part; components missing from the shorter of two vectors count as
    zero, so an empty vector scores 0 with everything; rows sharing an id are one query whose pairs rank together,
    and never partners of each other; ties go to the smaller id; an empty table gives an empty result; other
    columns of the table are ignored.  Scores are exact while the sum fits a signed 64-bit integer.
    """
    base = quantised(vectors, id_col, vec_col, scale)
    queries = base.where(is_query)
    counted = base.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("m"), F.max(F.size("q")).alias("width")).first()
    rows = max(1, min(BLOCK_ROWS, BLOCK_COMPONENTS // max(counted["width"] or 1, 1)))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    parts = spread(counted["n"], candidate_block or rows, min(cores, spread(counted["n"], LEAST_ROWS)))
    strips = spread(counted["m"], query_block or rows)
    seed = F.xxhash64("vec_id", "q")
    cand = base.select(
        F.pmod(seed, F.lit(parts)).cast("int").alias("cb"),
        F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("qb"),
        "vec_id",
        "q",
    )
    ask = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("cb"),
        F.pmod(seed, F.lit(strips)).cast("int").alias("qb"),
        "vec_id",
        "q",
    )
    partial = (
        cand.groupBy("cb", "qb").cogroup(ask.groupBy("cb", "qb")).applyInPandas(_search_block(k), schema=PARTIAL)
    )
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (
        partial.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
