"""Distinct visitors per day, country and their combinations, from mergeable bitmaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm import multires
from quirelake.runtime import cut

ALL = "*"
CLEAR = 6  # standard errors from the border at which an estimate settles a cell
WIDE = 16_384  # bits a level of the second bitmaps
FEW = 100_000  # cells that may be broadcast, about 4 MB


def _cells(df: DataFrame, *more: str) -> DataFrame:
    return df.where(F.col("created_at").isNotNull()).select(
        F.date_format(F.col("created_at").cast("timestamp_ntz"), "yyyy-MM-dd").alias("view_day"),
        F.coalesce("country", F.lit("")).alias("country"),
        *more,
    )


def _with_total(df: DataFrame, value) -> DataFrame:
    total = df.groupBy("view_day").agg(value).select("view_day", F.lit(ALL).alias("country"), "n")
    return df.select("view_day", "country", "n").unionAll(total)


def view_counts(views: DataFrame) -> DataFrame:
    """``(view_day, country, n)``; a repeated id counts once, a null id is a view of its own."""
    rows = _cells(views, "id")
    once = rows.where(F.col("id").isNotNull()).groupBy("id", "view_day", "country").agg(F.lit(1).alias("one"))
    counted = (
        once.select("view_day", "country")
        .unionAll(rows.where(F.col("id").isNull()).select("view_day", "country"))
        .groupBy("view_day", "country")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return _with_total(counted, F.sum("n").alias("n"))


def bitmaps(views: DataFrame, downloads: DataFrame) -> DataFrame:
    """Bitmaps of every (day, country) and, by OR, of every day over all countries."""
    groups = ["view_day", "country"]
    both = _cells(views, "visitor_hash").unionByName(_cells(downloads, "visitor_hash"))
    own = multires.sketch(both, groups, "visitor_hash")
    total = multires.merge(own, ["view_day"]).withColumn("country", F.lit(ALL))
    return own.unionByName(total)


def _judged(cells: DataFrame, estimate: DataFrame, share: float, bits: int, by: str) -> DataFrame:
    """``cells`` with their estimate, its bounds, and whether they lie clear of the border."""
    groups = ["view_day", "country"]
    v, border, e = F.coalesce("estimate", F.lit(0.0)), F.lit(share) * F.col("n"), multires.error_bound(bits)
    return cells.join(estimate, groups, "left").select(
        *groups,
        "n",
        v.alias("visitors"),
        (v * (1 - 3 * e)).alias("low"),
        (v * (1 + 3 * e)).alias("high"),
        (v < border).alias("crowded"),
        ((v < border * (1 - CLEAR * e)) | (v > border * (1 + CLEAR * e))).alias("clear"),
        F.lit(by).alias("settled_by"),
    )


def settled_cells(views: DataFrame, downloads: DataFrame, least_views: int = 60, share: float = 0.25) -> DataFrame:
    """``(view_day, country, n_views, visitors, low, high, crowded, settled_by)`` of all cells.

    Bitmaps of ``multires.BITS`` bits a level settle the cells whose estimate is clear of the
    border ``share * n_views`` by ``CLEAR`` standard errors, and those with too few views to
    matter; the others are counted with bitmaps of ``WIDE`` bits, and only what is still near
    the border exactly. Each step reads the tables only for its own cells and is left out
    when it has none. Visitors null or '' are none, but their views count; rows without a
    time are in no cell. Empty tables give no rows. ``low`` and ``high`` are three standard
    errors from the estimate, or the count itself.
    """
    groups = ["view_day", "country"]
    cells = view_counts(views)
    # one row a cell, used again by every step
    done = cut(_judged(cells, multires.estimate(bitmaps(views, downloads), groups), share, multires.BITS, "bitmap"))
    near = done.where(~F.col("clear") & (F.col("n") >= least_views))
    steps = [done.where(F.col("clear") | (F.col("n") < least_views))]

    def visits(of: DataFrame, n: int) -> DataFrame:
        both = _cells(views, "visitor_hash").unionByName(_cells(downloads, "visitor_hash")).where(F.col("visitor_hash") != "")
        each = both.select("view_day", F.explode(F.array("country", F.lit(ALL))).alias("country"), "visitor_hash")
        some = of.select(*groups)
        return each.join(F.broadcast(some) if n <= FEW else some, groups, "left_semi")

    n = near.count()
    if n:
        wide = multires.count_distinct(visits(near, n), groups, "visitor_hash", WIDE)
        finer = cut(_judged(near.select(*groups, "n"), wide, share, WIDE, "wide bitmap"))
        steps.append(finer.where("clear"))
        near = finer.where(~F.col("clear"))
        n = near.count()
    if n:
        # visitors of the cell: one row each, then a count
        who = visits(near, n).groupBy(*groups, "visitor_hash").agg(F.lit(1).alias("one"))
        exact = who.groupBy(*groups).agg(F.count(F.lit(1)).cast("double").alias("estimate"))
        m = F.coalesce("estimate", F.lit(0.0))
        last = near.select(*groups, "n").join(exact, groups, "left")
        steps.append(
            last.select(
                *groups, "n", m.alias("visitors"), m.alias("low"), m.alias("high"),
                (m < F.lit(share) * F.col("n")).alias("crowded"), F.lit(True).alias("clear"), F.lit("exact").alias("settled_by"),
            )
        )
    out = steps[0]
    for step in steps[1:]:
        out = out.unionByName(step)
    return out.select(*groups, F.col("n").alias("n_views"), "visitors", "low", "high", "crowded", "settled_by")


def estimates(views: DataFrame, downloads: DataFrame) -> DataFrame:
    """``settled_cells`` of the default border: every cell, with how it was settled."""
    return settled_cells(views, downloads)


def crowded_cells(views: DataFrame, downloads: DataFrame, least_views: int = 60, share: float = 0.25) -> DataFrame:
    """``(view_day, country)``: cells of enough views with few visitors for them.

    A cell of views without any visitor is crowded. Everything else as in ``settled_cells``.
    """
    cells = settled_cells(views, downloads, least_views, share)
    return cells.where(F.col("crowded") & (F.col("n_views") >= least_views)).select("view_day", "country")
