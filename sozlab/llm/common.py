"""Shared plumbing of the training-data operators: inputs, shared storage, spreading."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

WORKING_PARTITION_ROWS = 4096
#: Texts that go to a Python worker at once; a batch of long ones still fits beside the executor's heap.
BATCH_ROWS = 500
#: A key is hot if it holds a part in so many of all rows.
HOT_KEYS = 10_000


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read through Spark so that any store works."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session leaves it unset, a temporary folder takes its place if driver and executors are one process (tests,
    a laptop); on a cluster that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs its running tasks only, and nothing upstream runs twice.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Remove settled tables that no later step reads."""
    jvm = spark.sparkContext._jvm
    for frame in frames:
        for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            if "/settled-" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(rows: int, per_part: int = WORKING_PARTITION_ROWS, least: int = 1) -> int:
    """Number of parts so that each holds about ``per_part`` rows, however many rows there are."""
    return max(least, math.ceil(rows / per_part))


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, how: str = "left") -> DataFrame:
    """``left`` beside the settled rows of ``right``, which are unique by ``keys``; ``weight`` is their number in ``left``.

    Keys that hold a part in HOT_KEYS of all rows, so at most HOT_KEYS of them, are broadcast; the others meet by
    shuffling.  No task gets the rows of a hot key.
    """
    heavy = f"{weight} * {HOT_KEYS} >= {max(total, 1000 * HOT_KEYS)}"
    hot = right.where(heavy).drop(weight)
    if not hot.limit(1).count():
        return left.join(right.drop(weight), keys, how)
    few = F.broadcast(hot)
    rest = left.join(few.select(*keys), keys, "left_anti").join(right.where(f"not ({heavy})").drop(weight), keys, how)
    return left.join(few, keys).unionByName(rest)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def map_texts(frame: DataFrame, compute: Callable[..., dict[str, list]], kept: list[str], read: list[str], ddl: str) -> DataFrame:
    """Columns ``kept`` as they are (nulls and large numbers too) beside columns that ``compute`` makes.

    ``compute`` gets the columns ``read`` of a batch as lists and returns the columns of ``ddl`` as lists.
    """
    made = StructType.fromDDL(ddl)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(made)
        for batch in batches:
            out = compute(*[batch.column(c).to_pylist() for c in read])
            arrays = [batch.column(c) for c in kept] + [pa.array(out[f.name], f.type) for f in types]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *types.names])

    schema = StructType(list(frame.select(*kept).schema.fields) + list(made.fields))
    return frame.select(*dict.fromkeys([*kept, *read])).mapInArrow(mapped, schema)


def spread_out(frame: DataFrame) -> DataFrame:
    """The rows of a table of fewer files than cores over all cores; larger tables stay as they are read."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    if frame.rdd.getNumPartitions() <= 2 * cores and len(frame.inputFiles()) < cores:
        return frame.repartition(cores)
    return frame


def documents_of(docs: DataFrame) -> DataFrame:
    """doc_id as long and text, null as empty, of a table whatever else it holds."""
    return spread_out(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")))
