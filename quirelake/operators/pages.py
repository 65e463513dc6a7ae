"""Sets and runs of page numbers, and labels by the range they fall in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions.labels import label


def runs(pages: DataFrame, keys: list[str], page: str) -> DataFrame:
    """``(keys, first, last)`` of the runs of consecutive pages; repeated pages count once.

    A key with many pages is bounded by its distinct pages. Null pages are in no run.
    """
    distinct = pages.where(F.col(page).isNotNull()).select(*keys, F.col(page).alias("p")).distinct()
    island = F.col("p") - F.row_number().over(Window.partitionBy(*keys).orderBy("p"))
    return distinct.withColumn("island", island).groupBy(*keys, "island").agg(F.min("p").alias("first"), F.max("p").alias("last")).drop("island")


def compact(pages: DataFrame, keys: list[str], page: str) -> DataFrame:
    """``(keys, pages)`` with pages as in '1-3,7'."""
    part = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", F.col("first").cast("string"), F.col("last").cast("string")))
    spans = runs(pages, keys, page).select(*keys, F.struct("first", part.alias("t")).alias("s"))
    listed = F.transform(F.array_sort(F.collect_list("s")), lambda x: x["t"])
    return spans.groupBy(*keys).agg(F.array_join(listed, ",").alias("pages"))


def with_labels(pages: DataFrame, page: str, ranges: list[tuple[int, str | None, str, int]]) -> DataFrame:
    """Pages with the label of the latest range that starts at or before them.

    ``ranges``: (start page, style, prefix, start number); of ranges with one start the last
    holds, and pages before the first range have decimal labels. The few ranges become one
    expression, so nothing is joined.
    """
    last = {start: (style, prefix, number) for start, style, prefix, number in ranges}
    last.setdefault(1, ("D", "", 1))
    out = None
    for start in sorted(last, reverse=True):
        style, prefix, number = last[start]
        value = label(F.lit(style).cast("string"), F.lit(prefix), F.lit(number), F.col(page) - start)
        out = F.when(F.col(page) >= start, value) if out is None else out.when(F.col(page) >= start, value)
    return pages.withColumn("label", out)
