"""Buckets and stable hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetloom.functions import vocab as V

NUL = "\x00"


def stable_hash(*parts: Column) -> Column:
    """SHA-256 hex of the parts joined by NUL."""
    return F.sha2(F.concat_ws(NUL, *parts), 256)


def stable_int(*parts: Column) -> Column:
    """First eight digest bytes as an unsigned big-endian integer."""
    return F.conv(F.substring(stable_hash(*parts), 1, 16), 16, 10).cast("decimal(20,0)")


def hash_order(*parts: Column) -> Column:
    """Sort key with the order of ``stable_int``: the fixed-width hex prefix."""
    return F.substring(stable_hash(*parts), 1, 16)


def stable_mod(n: int | Column, *parts: Column) -> Column:
    return F.pmod(stable_int(*parts), F.lit(n).cast("decimal(20,0)") if isinstance(n, int) else n.cast("decimal(20,0)")).cast("long")


def hash_split(key: Column, seed: int = 2026) -> Column:
    bucket = stable_mod(10, F.lit("split"), F.lit(str(seed)), key)
    return F.when(bucket < 8, "train").when(bucket == 8, "validation").otherwise("test")


def price_bucket(price: Column) -> Column:
    result = F.when(price.isNull(), "missing")
    lower = 0
    for upper in V.PRICE_EDGES:
        result = result.when(price < upper, f"{lower}_{upper}")
        lower = upper
    return result.otherwise(f"{lower}_plus")


def rating_bucket(rating: Column) -> Column:
    """Nearest half point, exact halves to even, one decimal."""
    half = F.bround(rating * 2, 0) / 2
    return F.when(rating.isNull(), "missing").otherwise(F.format_string("%.1f", half))


def popularity_bucket(count: Column) -> Column:
    whole = F.greatest(F.lit(0).cast("long"), count.cast("long"))
    # bit length of n+1, minus one: an exact integer log2.
    log = F.char_length(F.conv((whole + 1).cast("string"), 10, 2)) - 1
    return F.when(count.isNull(), "missing").otherwise(F.least(F.lit(16), log).cast("string"))


def turn_bucket(turn: Column) -> Column:
    return F.when(turn <= 3, "early").when(turn <= 6, "middle").otherwise("late")


def width_bucket(width: Column) -> Column:
    return (
        F.when(width <= 10, "<=10").when(width <= 50, "11-50")
        .when(width <= 200, "51-200").otherwise(">200")
    )


def weight_band(weight: Column) -> Column:
    return (
        F.when(weight <= 0.0, "zero").when(weight <= 0.25, "low")
        .when(weight <= 0.75, "medium").otherwise("high")
    )


def evidence_weight(known: Column, empty: float = 0.05, saturation: int = 3) -> Column:
    """Weight of a state by its number of known constraints."""
    return F.when(known == 0, F.lit(empty)).otherwise(
        F.least(F.lit(1.0), known / F.lit(float(max(1, saturation))))
    )


def shortest_number(c: Column, digits: int = 6) -> Column:
    """A non-negative number with ``digits`` significant digits and no trailing zeros: 10, 9.5, 1e+06."""
    bare = lambda text: F.regexp_replace(text, r"(\.\d*?)0+$", "$1")
    trim = lambda text: F.regexp_replace(F.when(F.contains(text, F.lit(".")), bare(text)).otherwise(text), r"\.$", "")
    shown = None
    for whole in range(1, digits + 1):  # digits before the point
        places = digits - whole
        fits = c < 10.0**whole - 0.5 * 10.0**-places
        text = trim(F.format_string(f"%.{places}f", c))
        shown = F.when(fits, text) if shown is None else shown.when(fits, text)
    parts = F.split(F.format_string(f"%.{digits - 1}e", c), "e")
    return shown.otherwise(F.concat(trim(parts[0]), F.lit("e"), parts[1]))
