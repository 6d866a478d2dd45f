"""Row numbers, running sums and top-k that survive a group holding a third of all rows.

A group is walked in blocks: ``block`` is a column that never decreases along
the order, so each (group, block) is handled by its own task and only one row
per block takes part in the window that stitches the blocks together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetloom.session import written


def numbered(
    df: DataFrame, keys: list[str], order: list[Column], block: Column, name: str = "rn"
) -> DataFrame:
    """Exact ``row_number`` per group, computed block by block."""
    df = df.withColumn("_block", block)
    sizes = df.groupBy(*keys, "_block").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = sizes.select(
        *keys, "_block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    local = Window.partitionBy(*keys, "_block").orderBy(*order)
    return (
        df.withColumn("_local", F.row_number().over(local))
        .join(starts, [*keys, "_block"])
        .withColumn(name, F.col("_start") + F.col("_local"))
        .drop("_block", "_local", "_start")
    )


def ranged(df: DataFrame, order: list[str], name: str = "range") -> DataFrame:
    """``df`` with the number of its range along ``order``: a block for keys of any shape.

    Ranges are cut at sampled rows, and equal rows share one.  A second sample may cut elsewhere,
    so the table is written once and read back.
    """
    return written(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id()), name)


def following(
    df: DataFrame, keys: list[str], order: str, block: Column, values: dict[str, Column], back: bool = False
) -> DataFrame:
    """For each of ``values`` its nearest non-null value after the row (before it, if ``back``), block by block.

    ``order`` is unique within a group.
    """
    df = df.withColumn("_block", block)
    for name, value in values.items():
        df = df.withColumn(f"_{name}", value)
    way = F.desc if back else F.asc
    pick = F.max_by if back else F.min_by
    nearest = df.groupBy(*keys, "_block").agg(
        *[pick(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), F.col(order))).alias(f"_first_{n}") for n in values]
    )
    after = Window.partitionBy(*keys).orderBy(way("_block")).rowsBetween(1, Window.unboundedFollowing)
    later = nearest.select(*keys, "_block", *[F.first(f"_first_{n}", ignorenulls=True).over(after).alias(f"_later_{n}") for n in values])
    local = Window.partitionBy(*keys, "_block").orderBy(way(order)).rowsBetween(1, Window.unboundedFollowing)
    here = df
    for n in values:
        here = here.withColumn(f"_next_{n}", F.first(f"_{n}", ignorenulls=True).over(local))
    joined = here.join(later, [*keys, "_block"])
    for n in values:
        joined = joined.withColumn(n, F.coalesce(f"_next_{n}", f"_later_{n}"))
    return joined.drop("_block", *[f"{p}{n}" for n in values for p in ("_", "_next_", "_later_")])


def running_sum(
    df: DataFrame, keys: list[str], order: list[Column], block: Column,
    value: Column, name: str,
) -> DataFrame:
    """Exact running sum per group (current row included), block by block."""
    df = df.withColumn("_block", block).withColumn("_value", value)
    sums = df.groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = sums.select(
        *keys, "_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start")
    )
    local = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        df.withColumn("_local", F.sum("_value").over(local))
        .join(starts, [*keys, "_block"])
        .withColumn(name, F.col("_start") + F.col("_local"))
        .drop("_block", "_value", "_local", "_start")
    )


def hash_block(hash_hex: Column, digits: int = 2) -> Column:
    """Block of a hash-ordered row: rows spread evenly over 16**digits blocks."""
    return F.substring(hash_hex, 1, digits)


def int_block(order: Column, size: int = 1024) -> Column:
    """Block of a row ordered by an integer such as a turn."""
    return F.floor(order / F.lit(size))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per group.

    Spark limits each group before the shuffle too (``WindowGroupLimit``), so a
    hot group sends at most ``k`` rows per input task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def ordered_dedup(df: DataFrame, key: str, value: str, order: str, size: int = 1024) -> DataFrame:
    """First occurrence of each value per key, renumbered in order of appearance."""
    firsts = df.groupBy(key, value).agg(F.min(order).alias(order))
    return numbered(
        firsts, [key], [F.col(order), F.col(value)], int_block(F.col(order), size), "position"
    )
