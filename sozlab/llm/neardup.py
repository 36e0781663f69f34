"""Near-duplicate detection with a MinHash LSH forest.

Every text becomes its set of word shingles.  Equal sets collapse into one class first.  Each class has a MinHash
signature; the forest is several sorted orders of the classes, each by its own run of signature values.  Sorting is a
range partitioning of the whole key, so a region of any size spreads over as many tasks as it needs.  Candidates are
neighbours in an order that share at least the shortest prefix: in a region with few classes that is everyone, in a
crowded region only the next row, which has the longest common prefix, so the depth adapts by itself.  Sketches drop
candidates that cannot reach the threshold, and what is left is verified on the full sets.

Links between next rows make one component of a tight group, however large.  What classes of crowded regions may link
beyond that is found exactly: they meet in a prefix-filter join over their shingles, which leaves out pairs inside one
component.  Pairs of rare shingles are emitted and verified; the rows of a frequent shingle are compared in place, block
by block, and only give links that span the components among them.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, documents_of, join_unique, map_texts, settle, spread, text_or_empty
from .components import connected_components

SHINGLE, THRESHOLD = 4, 80
#: Sorted orders, signature values by which each sorts, and values that neighbours share at least.
ORDERS, DEPTH, SHORTEST = 16, 8, 2
#: Neighbours that a row of a region has at most before the region counts as crowded and its classes are joined exactly.
REACH = 6
#: Rows of a shingle up to which its pairs are emitted; those of more frequent ones are compared in place.
RARE = 64
#: Rows of each side of a frequent shingle that one task compares, and shingles that it lays out at once.
BLOCK, LAID_OUT = 1024, 2048
#: Shingles of all rows of such a side.
BLOCK_SHINGLES = 1 << 22
VALUES, SKETCH = 64, 256
#: Equal sketch values below which a pair at the threshold is five standard deviations away.
SKETCH_DEVIATIONS = 5
ROWS_PER_PART = 1 << 17
#: Ids that may be broadcast as a filter (16 bytes each); more are joined by shuffling.
BROADCAST_IDS = 1 << 20
#: Shingles whose values under all hash functions are held at once.
STRIP = 512
SIGNED = "n_shingles long, digest binary, signature binary, sketch binary"
SCANNED = "a long, b long, kind int, o int, key binary, n long, part int, side int"
LAST = (1 << 63) - 1
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: nearby inputs, unrelated outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    Words are runs without ASCII white space, A-Z lowered; fewer words than ``size`` are one shingle, none: empty.
    """
    words = text.encode("utf-8").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(size, len(words))
    n = len(words) - width + 1
    rolled = np.full(n, np.uint64(width), np.uint64)
    for i in range(width):
        rolled = _mixed(rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return np.unique(rolled)


@functools.lru_cache(maxsize=1)
def _multipliers() -> np.ndarray:
    seeds = np.arange(1, SKETCH + 1, dtype=np.uint64)
    return _mixed(seeds * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def minhashes(hashes: np.ndarray) -> np.ndarray:
    """The SKETCH smallest values of a set under as many hash functions (upper 32 bits)."""
    best = np.full(SKETCH, MASK, np.uint64)
    for at in range(0, len(hashes), STRIP):
        scrambled = _multipliers()[:, None] * hashes[None, at : at + STRIP]
        scrambled ^= scrambled >> np.uint64(29)
        scrambled *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(best, scrambled.min(axis=1), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def _signed(texts: list[str]) -> dict[str, list]:
    out: dict[str, list] = {c.split()[0]: [] for c in SIGNED.split(", ")}
    for text in texts:
        found = shingles(text)
        low = minhashes(found)
        out["n_shingles"].append(len(found))
        out["digest"].append(xxhash.xxh3_128_digest(found.tobytes()))
        out["signature"].append(low[:VALUES].astype(">u4").tobytes())
        out["sketch"].append(low.astype(np.uint8).tobytes())
    return out


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids, found, held = [], [], 0
        for class_id, text in zip(batch["id"], batch["text"]):
            ids.append(class_id)
            found.append(shingles(text).view(np.int64))
            held += len(found[-1])
            if held > 1 << 20:
                yield pd.DataFrame({"id": ids, "members": found})
                ids, found, held = [], [], 0
        if ids:
            yield pd.DataFrame({"id": ids, "members": found})


def _keys(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), ">u4").reshape(len(column), DEPTH)


def neighbours(rows: pd.DataFrame, fresh: int) -> tuple[pd.DataFrame, np.ndarray]:
    """Candidate pairs whose later row is at ``fresh`` or after, and ids in crowded regions, of sorted rows.

    A row meets the one before it and, unless its region is crowded, the REACH rows before it.  Pairs at a greater
    distance lie in a crowded region, and the ids of both are among those of crowded regions.
    """
    o, keys = rows["o"].to_numpy(), _keys(rows["key"])
    n, ids = rows["n"].to_numpy(), rows["id"].to_numpy()
    at = np.arange(fresh, len(rows))
    near = np.zeros((REACH + 1, len(at)), bool)
    for back in range(1, REACH + 1):
        there = at >= back
        i = at[there]
        near[back, there] = (o[i] == o[i - back]) & (keys[i, :SHORTEST] == keys[i - back, :SHORTEST]).all(axis=1)
    full = near[REACH]
    pairs = []
    for back in range(1, REACH + 1):
        i = at[near[back] & ~full] if back > 1 else at[near[back]]
        j = i - back
        fit = (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * THRESHOLD) & (ids[i] != ids[j])
        pairs.append(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])])[:, fit])
    found = np.unique(np.concatenate(pairs, axis=1), axis=1)
    crowded = np.unique(np.r_[ids[at[full]], ids[at[full] - REACH]])
    return pd.DataFrame({"a": found[0], "b": found[1]}), crowded


def _frame(pairs: pd.DataFrame, crowded: np.ndarray) -> pd.DataFrame:
    marks = pd.DataFrame({"a": crowded, "b": crowded, "kind": 1})
    out = pd.concat([pairs.assign(kind=0), marks], ignore_index=True)
    return out.reindex(columns=[c.split()[0] for c in SCANNED.split(", ")])


def _edge(rows: pd.DataFrame, side: int, part: int) -> pd.DataFrame:
    out = rows.rename(columns={"id": "a"}).assign(b=rows["id"], kind=2, part=part, side=side)
    return out.reindex(columns=[c.split()[0] for c in SCANNED.split(", ")])


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One sorted partition: candidates, crowded ids, and the rows at both ends for the partitions next to it.

    A partition of fewer than REACH rows gives all of them as its first end, and no last one.
    """
    part, carried, head = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not len(batch):
            continue
        if head < REACH:
            yield _edge(batch.head(REACH - head), 0, part)
            head += min(len(batch), REACH - head)
        rows = batch if carried is None else pd.concat([carried, batch], ignore_index=True)
        yield _frame(*neighbours(rows, 0 if carried is None else len(carried)))
        carried = rows.tail(REACH)
    if head == REACH:
        yield _edge(carried, 1, part)


def _scan_border(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["o", "key", "id"], kind="stable").reset_index(drop=True)
    return _frame(*neighbours(rows, 0))


def _orders(classes: DataFrame) -> DataFrame:
    """A row per class and sorted order: o, key (its run of signature values, cyclically), id, n."""
    stride = VALUES // ORDERS * 4
    turned = F.concat("signature", "signature")
    return classes.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1)))).select(
        "o",
        F.substring(turned, F.col("o") * stride + 1, F.lit(DEPTH * 4)).alias("key"),
        "id",
        F.col("n_shingles").alias("n"),
    )


def _forest(classes: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs and crowded ids of all sorted orders of ``classes`` (id, n_shingles, signature)."""
    rows = _orders(classes)
    parts = spread(count * ORDERS, ROWS_PER_PART)
    ordered = rows.repartitionByRange(parts, "o", "key", "id").sortWithinPartitions("o", "key", "id")
    scanned = settle(ordered.mapInPandas(_scan, SCANNED))
    edges = scanned.where("kind = 2")
    # a border lies between two partitions with a last end; a few numbers for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = edges.groupBy("part").agg(F.max("side").alias("full"))
    numbered = ends.select("part", F.coalesce(F.sum("full").over(before), F.lit(0)).alias("at"))
    border = (
        edges.join(F.broadcast(numbered), "part")
        .select(F.col("a").alias("id"), "o", "key", "n", (F.col("at") + F.col("side")).alias("border"))
        .groupBy("border")
        .applyInPandas(_scan_border, SCANNED)
    )
    found = scanned.where("kind < 2").union(border.where("kind < 2")).select("a", "b", "kind").distinct()
    found = settle(found)
    discard(classes.sparkSession, scanned)
    return found.where("kind = 0").select("a", "b"), found.where("kind = 1").select(F.col("a").alias("id"))


def _least_equal() -> int:
    j = THRESHOLD / 100
    expected = j + (1 - j) / 256
    return int(SKETCH * (expected - SKETCH_DEVIATIONS * (expected * (1 - expected) / SKETCH) ** 0.5))


def _similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        left = np.frombuffer(b"".join(batch["sa"]), np.uint8).reshape(-1, SKETCH)
        right = np.frombuffer(b"".join(batch["sb"]), np.uint8).reshape(-1, SKETCH)
        yield batch.loc[(left == right).sum(axis=1) >= _least_equal(), ["a", "b"]]


def _promising(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose sketches agree enough."""
    left = classes.select(F.col("id").alias("a"), F.col("sketch").alias("sa"))
    right = classes.select(F.col("id").alias("b"), F.col("sketch").alias("sb"))
    return settle(pairs.join(left, "a").join(right, "b").mapInPandas(_similar, "a long, b long"))


def only(frame: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``frame`` beside those of ``ids`` (settled, distinct): by broadcast while they are few, else by shuffling."""
    few = ids.count() <= BROADCAST_IDS
    return frame.join(F.broadcast(ids) if few else ids, columns)


def _members(ids: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Settled (id, members) of the classes ``ids`` (distinct), from the texts of the rows that stand for them."""
    needed = settle(classes.join(ids, "id", "left_semi").select("id", "rank_id", "text_hash"))
    sets = settle(only(texts, needed, ["rank_id", "text_hash"]).mapInPandas(_sets, "id long, members array<long>").dropDuplicates(["id"]))
    discard(texts.sparkSession, needed)
    return sets


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of settled pairs ``(a, b)`` those whose full shingle sets reach the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("members").alias("ma"))
    right = sets.select(F.col("id").alias("b"), F.col("members").alias("mb"))
    joined = pairs.join(left, "a").join(right, "b")
    common = joined.select("a", "b", F.size(F.array_intersect("ma", "mb")).alias("both"), (F.size("ma") + F.size("mb")).alias("total"))
    return settle(common.where(F.col("both") * 100 >= (F.col("total") - F.col("both")) * THRESHOLD).select("a", "b"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()


def _prefixes(crowd: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Settled rows (token, id, n, at, group) of the shingles by which classes of different components can meet first.

    Shingles stand in one order for all: those of a single component, which no such pair shares, then rare ones first.  A
    pair at the threshold shares one within the first n - ceil(0.8 n) + 1 places of both.
    """
    group = crowd.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("group"))
    held = settle(sets.join(group, "id").select("id", F.size("members").alias("n"), "group", F.explode("members").alias("token")))
    counted = held.groupBy("token").agg(F.count("*").alias("df"), F.min("group").alias("lo"), F.max("group").alias("hi"))
    shared = settle(counted.where("lo != hi").select("token", "df"))
    ordered = (
        only(held, shared, ["token"])
        .groupBy("id", "n", "group")
        .agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("tokens"))
        .withColumn("before", F.col("n") - F.size("tokens"))
        .withColumn("places", F.expr(f"int(floor(n * {100 - THRESHOLD} / 100)) + 1 - before"))
        .where("places > 0")
    )
    rows = ordered.select("id", "n", "group", "before", F.posexplode(F.expr("slice(tokens, 1, places)")).alias("i", "t"))
    out = settle(rows.select(F.col("t.token").alias("token"), "id", "n", (F.col("before") + F.col("i")).alias("at"), "group"))
    discard(crowd.sparkSession, held, shared)
    return out


def _pairs_of_rare(rows: DataFrame) -> DataFrame:
    """Pairs that a shingle of at most RARE rows brings together and that may reach the threshold."""
    over, t = 100 + THRESHOLD, THRESHOLD
    x = rows.where("early").select("token", *[F.col(c).alias(f"l_{c}") for c in ("id", "n", "at", "group")])
    y = rows.select("token", *[F.col(c).alias(f"r_{c}") for c in ("id", "n", "at", "group")])
    needed = f"{t} * (l_n + r_n)"
    fits = F.expr(
        f"l_group != r_group and l_n <= r_n and l_n * 100 >= r_n * {t}"
        f" and (l_n - l_at) * {over} >= {needed} and (r_n - r_at) * {over} >= {needed}"
    )
    return x.join(y, "token").where(fits).select(F.least("l_id", "r_id").alias("a"), F.greatest("l_id", "r_id").alias("b"))


def shared_counts(members: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets, laid out LAID_OUT values at a time."""
    owner = np.repeat(np.arange(len(members)), [len(m) for m in members])
    values, place, count = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    there = count[place] > 1
    owner, column = owner[there], column[place[there]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both, most = np.zeros((len(members), len(members))), int(column[-1]) + 1 if len(column) else 0
    for low in range(0, most, LAID_OUT):
        a, b = np.searchsorted(column, [low, low + LAID_OUT])
        grid = np.zeros((len(members), min(LAID_OUT, most)), np.float32)
        grid[owner[a:b], column[a:b] - low] = 1
        both += grid @ grid.T
    return both


def spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, root) pairs that connect what a symmetric matrix of links connects, one for each row that is no root."""
    label = np.arange(len(linked))
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked)))
        low = low[low]
        if (low == label).all():
            break
        label = low
    rows = np.flatnonzero(label != np.arange(len(linked)))
    return rows, label[rows]


def _compared(rows: pd.DataFrame) -> pd.DataFrame:
    """Links among the rows of one task of a frequent shingle that span the components among them."""
    rows = rows.drop_duplicates("id")
    n, group, ids = (rows[c].to_numpy() for c in ("n", "group", "id"))
    both = shared_counts(list(rows["members"]))
    linked = both * 100 >= (n[:, None] + n[None, :] - both) * THRESHOLD
    linked &= group[:, None] != group[None, :]
    one, other = spanning(linked)
    return pd.DataFrame({"a": np.minimum(ids[one], ids[other]), "b": np.maximum(ids[one], ids[other])})


def _links_of_frequent(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that span what the rows of frequent shingles connect.

    The component that has most rows of a shingle is not compared with itself.  The others are dealt out in blocks, each
    of which meets every other block.
    """
    blocks = [F.ceil(F.greatest(F.col(f"{c}_rows") / BLOCK, F.col(f"{c}_n") / BLOCK_SHINGLES)).cast("int") for c in ("other", "main")]
    dealt = rows.withColumns({"bo": blocks[0], "bm": blocks[1]}).withColumn(
        "own", F.expr("int(pmod(xxhash64(id), if(main, bm, bo)))")
    )
    tasks = F.expr(
        "if(main, transform(sequence(0, bo - 1), i -> struct(i as s, bo + own as t)),"
        " filter(transform(sequence(0, bo + bm - 1), i -> struct(least(i, own) as s, greatest(i, own) as t)),"
        " x -> x.s != x.t or bo + bm = 1))"
    )
    placed = dealt.withColumn("task", F.explode(tasks)).select("token", "task.s", "task.t", "id", "n", "group")
    return placed.join(sets, "id").groupBy("token", "s", "t").applyInPandas(_compared, "a long, b long")


def _met(crowd: DataFrame, classes: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Settled links that connect what links between classes of ``crowd`` connect beyond the components ``labels``."""
    rows = _prefixes(crowd, sets, labels)
    # the smaller set of a pair has the shingle among still earlier places
    rows = rows.withColumn("early", F.expr(f"at * {100 + THRESHOLD} <= n * {100 - THRESHOLD}"))
    sizes = rows.groupBy("token", "group").agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.count_if("early").alias("early"))
    buckets = settle(
        sizes.groupBy("token")
        .agg(F.max(F.struct("rows", "group", "n")).alias("most"), F.sum("rows").alias("all_rows"), F.sum("n").alias("all_n"),
             F.sum("early").alias("early_rows"), F.count("*").alias("groups"))
        .where("groups > 1 and early_rows > 0")
        .select("token", "all_rows", F.col("most.group").alias("main_group"), F.col("most.rows").alias("main_rows"),
                F.col("most.n").alias("main_n"), F.expr("all_rows - most.rows").alias("other_rows"),
                F.expr("all_n - most.n").alias("other_n"))
    )
    marked = settle(only(rows, buckets, ["token"]).withColumn("main", F.expr("group = main_group")))
    pairs = _promising(_pairs_of_rare(marked.where(f"all_rows <= {RARE}")).distinct(), classes)
    found = settle(_verified(pairs, sets).union(_links_of_frequent(marked.where(f"all_rows > {RARE}"), sets)).distinct())
    discard(crowd.sparkSession, rows, buckets, marked, pairs)
    return found


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, rank_id (doc_id, the last one for null), text_hash, text (null as empty)."""
    rank = F.coalesce("doc_id", F.lit(LAST)).alias("rank_id")
    return documents_of(docs).select("doc_id", rank, F.xxhash64("text").alias("text_hash"), "text")


def classes_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Settled rows with the digests of their sets, and classes of equal sets.

    Rows: doc_id, rank_id, text_hash, n_shingles, digest.  A class has an id of its own, the row that stands for it (the
    least rank_id, text_hash), its number of rows, its signature and its sketch.
    """
    signed = settle(map_texts(_hashed(docs), _signed, ["doc_id", "rank_id", "text_hash"], ["text"], SIGNED))
    row = ["digest", "rank_id", "text_hash"]
    shingled = signed.where("n_shingles > 0")
    least = shingled.groupBy("digest").agg(F.min(F.struct("rank_id", "text_hash")).alias("least"), F.count("*").alias("n_rows"))
    stand = shingled.select(*row, "n_shingles", "signature", "sketch").dropDuplicates(row)
    classes = settle(stand.join(least.select("digest", "least.*", "n_rows"), row).withColumn("id", F.monotonically_increasing_id()))
    rows = settle(signed.select("doc_id", "rank_id", "text_hash", "n_shingles", "digest"))
    discard(docs.sparkSession, signed)
    return rows, classes


def _decided(docs: DataFrame) -> DataFrame:
    """Every row: doc_id, rank_id, text_hash, n_shingles, and first (rank_id, text_hash of the row that its component
    keeps; null without shingles)."""
    rows, classes = classes_of(docs)
    candidates, crowded = _forest(classes, classes.count())
    pairs, crowd = _promising(candidates, classes), settle(crowded)
    sets = _members(_ends(pairs).union(crowd).distinct(), classes, _hashed(docs))
    links = _verified(pairs, sets)
    labels = connected_components(links)
    if crowd.limit(1).count():
        links = links.union(_met(crowd, classes, sets, labels))
        labels = connected_components(links)
    standing = classes.select("id", "digest", "n_rows", F.struct("rank_id", "text_hash").alias("own"))
    firsts = labels.join(standing, "id").groupBy("component").agg(F.min("own").alias("first"))
    known = settle(
        standing.join(labels.join(firsts, "component"), "id", "left").select("digest", "n_rows", F.coalesce("first", "own").alias("first"))
    )
    discard(docs.sparkSession, classes, sets)
    found = join_unique(rows.where("n_shingles > 0"), known, ["digest"], "n_rows", rows.count())
    return found.unionByName(rows.where("n_shingles = 0"), allowMissingColumns=True)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Every row with its shingle count and component: doc_id, n_shingles, component_id, kept.

    Documents whose sets of 4-word shingles have a Jaccard similarity of at least 0.8 are linked; the component is the
    smallest doc_id reachable.  Null and empty texts have no shingles and no links; rows without doc_id take part and rank
    last: their own component is null, and they are kept in it; repeated rows give repeated results; texts that share a
    doc_id are linked by what they hold alone; columns besides doc_id and text are ignored; an empty table gives an empty
    result.
    """
    component = F.when(F.col("n_shingles") > 0, F.nullif(F.col("first.rank_id"), F.lit(LAST))).otherwise(F.col("doc_id"))
    decided = _decided(docs).select("doc_id", "n_shingles", component.alias("component_id"))
    return decided.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The table, with all its columns, less near duplicates: one row of each component, the one with the least doc_id.

    Rows without words stay.  Of rows that share that doc_id one stays (by a hash of the text, then any), and of equal
    rows without doc_id too.
    """
    key, names = ["rank_id", "text_hash"], docs.columns
    decided = settle(_decided(docs).where("n_shingles > 0").select(*key, (F.struct(*key) == F.col("first")).alias("stays")))
    base = docs.select(
        F.struct(*names).alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("rank_id"),
        F.xxhash64(text_or_empty()).alias("text_hash"),
    )
    counted = decided.groupBy(*key).agg(F.max("stays").alias("stays"), F.count("*").alias("n"))
    # keys of rows that go, and of several rows of which one stays
    marked = settle(counted.where("not stays or n > 1").select(*key, "stays"))
    few = marked.count() <= BROADCAST_IDS
    found = F.broadcast(marked) if few else marked
    out = base.join(found, key, "left_anti").select("row")
    if marked.where("stays").limit(1).count():
        several = base.join(found.where("stays"), key).groupBy(*key).agg(F.first("row").alias("row"))
        out = out.union(several.select("row"))
    return out.select("row.*")
