"""Readers and writers of vocabularies, dumps, reviews and corpora.  Malformed lines are left out."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one part-of-speech letter and a lemma: pos, lemma."""
    line = F.col("value")
    return spark.read.text(path).where(line.rlike("^[NVADX].+")).select(line.substr(1, 1).alias("pos"), line.substr(F.lit(2), F.length(line)).alias("lemma"))


def frequencies(spark: SparkSession, path: str, word: str = "word") -> DataFrame:
    """Lines of a word, a space and a number; the last space parts them."""
    line = F.col("value")
    freq = F.regexp_extract(line, r" ([0-9]+)$", 1).try_cast("long")
    return spark.read.text(path).select(F.regexp_extract(line, r"^(.+) [0-9]+$", 1).alias(word), freq.alias("freq")).where(F.col("freq").isNotNull())


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a stem, a tab and a score; # begins a comment, later lines override: stem, score, ord."""
    line = F.col("value")
    parts = F.split(line, "\t")
    return (
        spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).where(~line.startswith("#") & (F.size(parts) == 2))
        .select(F.trim(parts[0]).alias("stem"), F.trim(parts[1]).try_cast("double").alias("score"), "ord")
        .where("stem != '' and score is not null")
    )


def dump(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with word and pos."""
    return spark.read.schema("word string, pos string, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad is null and word is not null").select("word", "pos")


def reviews(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated content and rating from 1 to 5."""
    table = spark.read.schema("content string, score int").option("sep", "\t").csv(path)
    return table.where("content is not null and score between 1 and 5")


def arrow_streams(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """The columns of ``ddl`` of files in Arrow's streaming format; a file (of up to 2 GB) is read by one task, batch by batch."""
    made = StructType.fromDDL(ddl)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(made)
        for batch in batches:
            for content in batch.column("content"):
                for held in pa.ipc.open_stream(io.BytesIO(content.as_py())):
                    yield pa.RecordBatch.from_arrays([held.column(f.name).cast(f.type) for f in schema], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, made)


def json_records(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Files that hold one JSON array of records each."""
    return spark.read.schema(ddl).option("multiLine", "true").json(path)


def corpus(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Text files of a tree, a row per line (or per file): file, value."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt")
    return (read.text(path, wholetext=True) if whole else read.text(path)).select(F.col("_metadata.file_path").alias("file"), "value")


def write_dictionary(lemmas: DataFrame, path: str) -> None:
    lemmas.orderBy("lemma", "pos").select(F.concat("pos", "lemma").alias("value")).write.text(path)


def write_frequencies(counts: DataFrame, path: str) -> None:
    counts.orderBy(F.desc("freq"), "word").select(F.concat_ws(" ", "word", F.col("freq").cast("string")).alias("value")).write.text(path)


def write_reviews(table: DataFrame, path: str) -> None:
    table.select("content", "score").write.option("sep", "\t").csv(path)
