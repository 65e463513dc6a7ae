"""Distinct counts with multiresolution bitmaps.

An identifier is hashed once. The hash's leading part picks a level geometrically (level
``i`` takes a share of ``2**-(i+1)``), its low part a bit of the level's small bitmap.
Bitmaps are held as 64-bit words in rows ``(group..., level, word, bits)``: partial
results merge by OR, on the map side, across shuffles, across days and across files.

To estimate, the first level that is not saturated is the base; linear counting of the
base and of all finer levels is summed and scaled by ``2**base``. With ``BITS`` bits a
level the relative standard error stays below ``error_bound()`` at every scale, and small
sets (no saturated level) are counted with the error of plain linear counting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 2048
LEVELS = 40
FULL = 0.93  # a level is saturated once this share of its bits is set


def error_bound(bits: int = BITS) -> float:
    """Relative standard error: counting with ``bits`` slots at the worst base load."""
    return 2.2 / bits**0.5


def sketch(df: DataFrame, groups: list[str], identifier: str, bits: int = BITS) -> DataFrame:
    """Mergeable bitmaps ``(groups..., level, word, bits)`` of the distinct identifiers.

    Null and '' identifiers are not counted. Null group values are groups of their own.
    """
    rows = df.where(F.col(identifier).isNotNull() & (F.col(identifier) != ""))
    rows = rows.select(*groups, F.xxhash64(F.col(identifier)).alias("h"))
    # leading zeros of the upper bits, by the length of their binary form
    upper = F.shiftrightunsigned(F.col("h"), 64 - LEVELS)
    level = F.when(upper == 0, F.lit(LEVELS)).otherwise(F.lit(LEVELS) - F.length(F.bin(upper)))
    slot = F.pmod(F.col("h"), F.lit(bits))
    placed = rows.select(
        *groups, level.alias("level"), F.floor(slot / 64).cast("int").alias("word"), F.pmod(slot, F.lit(64)).cast("int").alias("bit")
    )
    one = F.expr("shiftleft(1L, bit)")
    return placed.groupBy(*groups, "level", "word").agg(F.bit_or(one).alias("bits"))


def merge(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """OR partial bitmaps together, down to ``groups``."""
    return sketches.groupBy(*groups, "level", "word").agg(F.bit_or("bits").alias("bits"))


def estimate(sketches: DataFrame, groups: list[str], bits: int = BITS) -> DataFrame:
    """``(groups..., estimate double)`` from bitmaps of exactly these groups."""
    filled = sketches.groupBy(*groups, "level").agg(F.sum(F.bit_count("bits")).alias("ones"))
    # at most LEVELS + 1 entries a group
    counts = filled.groupBy(*groups).agg(
        F.map_from_entries(F.collect_list(F.struct("level", "ones"))).alias("m")
    )

    def ones(i: Column) -> Column:
        return F.coalesce(F.element_at(F.col("m"), i), F.lit(0)).cast("double")

    levels = F.sequence(F.lit(0), F.lit(LEVELS))
    base = F.coalesce(
        F.array_min(F.filter(levels, lambda i: ones(i) < F.lit(FULL * bits))), F.lit(LEVELS)
    )
    b = float(bits)
    counted = counts.withColumn("base", base)
    total = F.aggregate(
        F.filter(levels, lambda i: i >= F.col("base")),
        F.lit(0.0),
        lambda acc, i: acc - F.lit(b) * F.log(F.lit(1.0) - F.least(ones(i), F.lit(b - 1)) / F.lit(b)),
    )
    return counted.select(*groups, (total * F.pow(F.lit(2.0), F.col("base"))).alias("estimate"))


def count_distinct(df: DataFrame, groups: list[str], identifier: str, bits: int = BITS) -> DataFrame:
    """Estimated distinct identifiers of each group."""
    return estimate(sketch(df, groups, identifier, bits), groups, bits)
