"""Session settings, shared scratch space, lineage cuts and skew-proof joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Values of a join key are spread over this many salts when the other side has
# one row per key (see ``spread_join``).
DEFAULT_SALTS = 8

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply the engine's settings; cluster sizing stays with the submitter."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


# Tables whose files are larger than this are broadcast by measured size alone.
ASSUMED_SMALL = "10k"


def broadcast_measured(spark: SparkSession) -> None:
    """Hold the session's broadcast limit against measured sizes instead of the sizes of compressed files.

    Keys and repeated values shrink to a hundredth in Parquet, and exploded lists are not
    estimated at all: a file far below the limit may fill the driver.  Adaptive execution
    knows the bytes a shuffle wrote and broadcasts what is small.
    """
    limit, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    given = spark.conf.get(limit)
    if spark.conf.get(measured, None) is None and not given.startswith("-"):
        spark.conf.set(measured, given)
        spark.conf.set(limit, ASSUMED_SMALL)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="spark-facetloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably and drop its lineage."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut whose size Spark knows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def salt_of(salts: int, *columns: Column) -> Column:
    """Deterministic salt, so a recomputed task places its rows as before."""
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def spread_join(
    many: DataFrame,
    one: DataFrame,
    keys: list[str],
    spread_by: list[str],
    how: str = "inner",
    salts: int = DEFAULT_SALTS,
) -> DataFrame:
    """Join a long table with a table of few rows per key, spreading hot keys.

    Rows of ``many`` get a salt from ``spread_by``; each row of ``one`` is
    repeated once per salt, so a key holding a third of ``many`` is handled by
    ``salts`` tasks.  ``how`` may be inner, left, left_semi or left_anti.
    """
    salted = many.withColumn("_salt", salt_of(salts, *[F.col(c) for c in spread_by]))
    copies = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
