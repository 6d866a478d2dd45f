"""Small helpers the operators share: reading, storing, document keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetloom.session import scratch_path


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """Columns of a source table; a column it lacks comes back null."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
    return df.select(*columns)


#: Rows and bytes in one batch to Python: texts may be long, and two workers share an executor.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def arrow_map(df: DataFrame, function: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """``df.mapInArrow`` with batches that stay small when texts are long."""

    def whole(batches: Iterator) -> Iterator:
        yield from function(batches)
        # Workers live on: what Arrow keeps for reuse would count in every later stage.
        pa.default_memory_pool().release_unused()

    for key, value in BATCH.items():
        df.sparkSession.conf.set(key, value)
    return df.mapInArrow(whole, schema)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: executors may be lost after this."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: Column) -> Column:
    """32 bits that, with the id, tell rows apart that share an id but not their text."""
    return F.shiftrightunsigned(F.xxhash64(text), 32)


def free_name(columns: list[str], name: str) -> str:
    """``name``, or with enough underscores before it not to be one of ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_type(df: DataFrame, without: str = "") -> str:
    """Schema string of ``df`` for a function over its batches."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != without)
