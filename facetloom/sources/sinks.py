"""Writers for derived tables and audit reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(
    df: DataFrame, path: str, overwrite: bool = False, partition_by: tuple[str, ...] = ()
) -> None:
    """Write parquet; an existing table is only replaced when asked to."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    if partition_by:
        # One shuffle on the partition values plus a spread, so that a partition
        # holding a third of the rows is still written by many tasks.
        df = df.repartition(*[F.col(c) for c in partition_by], F.pmod(F.xxhash64(*df.columns), F.lit(32)))
        writer = df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*partition_by)
    writer.parquet(path)


def write_facts(facts: DataFrame, path: str, overwrite: bool = False) -> None:
    """Facts partitioned by attribute: every per-attribute read prunes the rest."""
    write_table(facts, path, overwrite, ("attribute",))


def write_audit_csv(df: DataFrame, path: str, order: list, overwrite: bool = False) -> None:
    """CSV report in a given order; an empty report still has its header."""
    mode = "overwrite" if overwrite else "errorifexists"
    df.orderBy(*order).write.mode(mode).option("header", True).csv(path)
