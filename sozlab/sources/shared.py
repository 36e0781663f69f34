"""Tables in the folder that driver and executors share, which cut the lineage and the plan of what is read several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a temporary folder if driver and executors are one process, else an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def settled(frame: DataFrame) -> DataFrame:
    """The table, written to the shared folder at once and read again.

    It stays there until the folder is cleaned, as the caller's result is read later; empty tables keep their columns.
    """
    path = f"{shared_folder(frame.sparkSession)}/settled-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
