"""Helpers shared by the corpus operators: batching, tables in the shared folder, text columns."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shared_dir

SLICE_BYTES = 4 << 20  # text handled at once inside a task


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: ``df`` written as a table in the shared folder, and read again.

    A written table survives lost executors, as a checkpoint does, but is compressed by columns, and its size is known to the planner (the size
    that a checkpoint hands on is the product of all join inputs before it).
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    return next(name for i in range(len(taken) + 1) if (name := f"{stem}{i or ''}") not in taken)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of ``column`` (one row at least)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = np.cumsum(size) // limit
    edges = np.flatnonzero(np.diff(block)) + 1
    for a, b in zip([0, *edges], [*edges, batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)


def map_text(df: DataFrame, per_slice: Callable[[pa.RecordBatch], dict], schema: str, setup: Callable | None = None) -> DataFrame:
    """Apply ``per_slice`` (Arrow slice -> dict of columns) to every row of ``df``; ``schema`` is a DDL string."""
    out = pa_schema(schema)

    def run(batches):
        f = setup() if setup else per_slice
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_pydict(f(part), schema=out)

    return df.mapInArrow(run, schema)


def pa_schema(schema) -> pa.Schema:
    """Arrow's schema of a DDL string or a StructType."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def doc_table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder5(doc_id) -> F.Column:
    """crc32(doc_id as text) mod 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
