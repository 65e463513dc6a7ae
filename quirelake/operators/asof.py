"""As-of joins without a range join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_latest(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, buckets: int = 64) -> DataFrame:
    """``left`` with the ``value`` of the latest ``right`` row at or before each row's ``at``.

    Both sides are put into one time-ordered stream of a key and the last value is carried
    forward, so there is no pairwise comparison. A key's stream is cut into ``buckets`` time
    ranges that are worked on apart: within a range values are carried by a window over
    (key, range), and the last value before each range is carried over the ranges alone, of
    which a key has at most ``buckets``. A hot key thus spreads over as many tasks.
    Null keys match nothing; rows of ``right`` with equal keys and times must be unique;
    at equal times the right row counts as before the left one.
    """
    moment = F.unix_micros(F.col(at).cast("timestamp"))
    rows = left.select(F.struct(*[F.col(c) for c in left.columns]).alias("l"), *keys, moment.alias("m"), F.lit(None).cast(right.schema[value].dataType).alias("v"), F.lit(1).alias("side"))
    seen = right.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    facts = seen.select(F.lit(None).cast(rows.schema["l"].dataType).alias("l"), *keys, moment.alias("m"), F.col(value).alias("v"), F.lit(0).alias("side"))
    both = rows.unionAll(facts)
    span = both.agg(F.min("m").alias("a"), F.max("m").alias("b")).collect()[0]
    if span["a"] is None:
        return left.withColumn(value, F.lit(None).cast(right.schema[value].dataType))
    width = max(1, (span["b"] - span["a"]) // buckets + 1)
    cut = both.withColumn("bucket", F.floor((F.col("m") - F.lit(span["a"])) / F.lit(width)))
    inside = Window.partitionBy(*keys, "bucket").orderBy("m", "side").rowsBetween(Window.unboundedPreceding, 0)
    near = cut.withColumn("near", F.last("v", ignorenulls=True).over(inside))
    lasts = cut.where("side = 0").groupBy(*keys, "bucket").agg(F.max_by("v", "m").alias("last"))
    # ranges of a key that hold any row, with the last value of the ranges before
    ranges = cut.select(*keys, "bucket").distinct().join(lasts, [*keys, "bucket"], "left")
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select(*keys, "bucket", F.last("last", ignorenulls=True).over(before).alias("far"))
    out = near.where("side = 1").join(carried, [*keys, "bucket"], "left")
    return out.select("l.*", F.coalesce("near", "far").alias(value))
