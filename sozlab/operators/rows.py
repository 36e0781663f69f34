"""Row-wise Python over Arrow batches, for what column expressions cannot say."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def map_rows(frame: DataFrame, read: list[str], ddl: str, compute: Callable) -> DataFrame:
    """The table with the columns of ``ddl`` (replacing any of those names), which ``compute`` makes of a row's ``read``."""
    made = StructType.fromDDL(ddl)
    kept = [c for c in frame.columns if c not in made.names]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(made)
        for batch in batches:
            rows = [compute(*values) for values in zip(*[batch.column(c).to_pylist() for c in read])]
            if len(types) == 1:
                rows = [(r,) for r in rows]
            arrays = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *arrays], names=[*kept, *types.names])

    source = frame.select(*dict.fromkeys([*kept, *read]))
    return source.mapInArrow(mapped, StructType([*frame.select(*kept).schema.fields, *made.fields]))


def explode_rows(frame: DataFrame, read: list[str], ddl: str, compute: Callable) -> DataFrame:
    """A row of ``ddl`` for each tuple that ``compute`` makes of a row's ``read``."""
    made = StructType.fromDDL(ddl)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(made)
        for batch in batches:
            rows = [r for values in zip(*[batch.column(c).to_pylist() for c in read]) for r in compute(*values)]
            arrays = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(types)]
            yield pa.RecordBatch.from_arrays(arrays, names=types.names)

    return frame.select(*read).mapInArrow(mapped, made)
