"""Joins and groupings of rectangles of a page."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.functions.geometry import area, crosses, iou, overlap, touches


def _rect(p: str):
    return tuple(F.col(f"{p}{c}") for c in ("left", "top", "right", "bottom"))


def _named(df: DataFrame, p: str, *more: str) -> DataFrame:
    return df.select(F.col("page"), *[F.col(c).alias(p + c) for c in ("id", "left", "top", "right", "bottom", *more)])


def neighbours(boxes: DataFrame, cell: float, closed: bool = True) -> DataFrame:
    """``(page, a_id, b_id)``, a_id < b_id: boxes of a page that intersect.

    Boxes are put into the grid cells they cover and only those of a common cell are
    compared; a pair is reported in the cell that holds the corner where both begin, so
    each comes once without a distinct. Pages of any size split over their cells.
    """
    cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    placed = (
        boxes.select("page", "id", "left", "top", "right", "bottom")
        .withColumn("cx", F.explode(cells("left", "right")))
        .withColumn("cy", F.explode(cells("top", "bottom")))
    )
    a = placed.select("page", "cx", "cy", *[F.col(c).alias("a_" + c) for c in ("id", "left", "top", "right", "bottom")])
    b = placed.select("page", "cx", "cy", *[F.col(c).alias("b_" + c) for c in ("id", "left", "top", "right", "bottom")])
    test = touches if closed else crosses
    first = (F.floor(F.greatest("a_left", "b_left") / cell) == F.col("cx")) & (F.floor(F.greatest("a_top", "b_top") / cell) == F.col("cy"))
    met = a.join(b, ["page", "cx", "cy"]).where((F.col("a_id") < F.col("b_id")) & test(_rect("a_"), _rect("b_")) & first)
    return met.select("page", "a_id", "b_id")


def fragments(boxes: DataFrame, selection: tuple[float, float, float, float]) -> DataFrame:
    """Parts of the boxes inside a selection, as ``(page, id, left, top, right, bottom)``; touching is not inside."""
    s = tuple(F.lit(float(x)) for x in selection)
    own = _rect("")
    inside = boxes.where(crosses(own, s))
    return inside.select(
        "page", "id", F.greatest(own[0], s[0]).alias("left"), F.greatest(own[1], s[1]).alias("top"), F.least(own[2], s[2]).alias("right"), F.least(own[3], s[3]).alias("bottom")
    )


def union_box(boxes: DataFrame, keys: list[str]) -> DataFrame:
    return boxes.groupBy(*keys).agg(F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"))


def best_overlap(boxes: DataFrame, marks: DataFrame, near: float = 40.0) -> DataFrame:
    """``(page, mark, id, score)``: for each mark the box with the largest IoU above 0, else the one
    with the nearest centre, at most ``near`` away, with score 0.

    ``marks`` is given by the user (a handful for each page); ties go to the smaller id.
    Boxes and marks without any area have no part in it.
    """
    a, b = _named(boxes, "a_"), marks.select("page", F.col("id").alias("mark"), *[F.col(c).alias("b_" + c) for c in ("left", "top", "right", "bottom")])
    met = a.join(b, "page").where((area(*_rect("a_")) > 0) & (area(*_rect("b_")) > 0)).withColumn("score", iou(_rect("a_"), _rect("b_")))
    middle = lambda p, lo, hi: (F.col(p + lo) + F.col(p + hi)) / 2
    far = F.hypot(middle("a_", "left", "right") - middle("b_", "left", "right"), middle("a_", "top", "bottom") - middle("b_", "top", "bottom"))
    best = F.max(F.when(F.col("score") > 0, F.struct("score", (-F.col("a_id")).alias("k")))).alias("m")
    close = F.min(F.when(far <= near, F.struct(far.alias("d"), F.col("a_id").alias("id")))).alias("c")
    chosen = met.groupBy("page", "mark").agg(best, close).where("m IS NOT NULL OR c IS NOT NULL")
    return chosen.select("page", "mark", F.coalesce(-F.col("m.k"), F.col("c.id")).alias("id"), F.coalesce("m.score", F.lit(0.0)).alias("score"))


def hit(boxes: DataFrame, points: DataFrame, tolerance: float) -> DataFrame:
    """``(page, point, id)``: the box under each point, by least ``distance² * 10000 + area``."""
    a = _named(boxes, "a_")
    p = points.select("page", F.col("id").alias("point"), "x", "y")
    met = a.join(p, "page").where(
        F.col("x").between(F.col("a_left") - tolerance, F.col("a_right") + tolerance) & F.col("y").between(F.col("a_top") - tolerance, F.col("a_bottom") + tolerance)
    )
    dx = F.greatest(F.col("a_left") - F.col("x"), F.lit(0.0), F.col("x") - F.col("a_right"))
    dy = F.greatest(F.col("a_top") - F.col("y"), F.lit(0.0), F.col("y") - F.col("a_bottom"))
    size = (F.col("a_right") - F.col("a_left")) * (F.col("a_bottom") - F.col("a_top"))
    score = (dx * dx + dy * dy) * 10000 + size
    return met.groupBy("page", "point").agg(F.min(F.struct(score.alias("s"), F.col("a_id").alias("id"))).alias("m")).select("page", "point", F.col("m.id").alias("id"))


def clusters(boxes: DataFrame, least_iou: float = 0.22, near: float = 0.028) -> DataFrame:
    """``(page, id, cluster)``: boxes joined greedily, top to bottom, to the first cluster they fit.

    A box fits when its IoU with the cluster's box is large enough or its centre is near in
    both directions; the cluster's box then grows. The order decides, so a page is worked
    on as a whole: pages hold what one page shows.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["top", "left", "id"], kind="stable")
        anchors: list[list[float]] = []
        at = []
        for l, t, r, b in pdf[["left", "top", "right", "bottom"]].itertuples(index=False):
            for k, c in enumerate(anchors):
                w, h = max(0.0, min(r, c[2]) - max(l, c[0])), max(0.0, min(b, c[3]) - max(t, c[1]))
                union = (r - l) * (b - t) + (c[2] - c[0]) * (c[3] - c[1]) - w * h
                close = abs((l + r) / 2 - (c[0] + c[2]) / 2) <= near and abs((t + b) / 2 - (c[1] + c[3]) / 2) <= near
                if close or union > 0 and w * h / union >= least_iou:
                    anchors[k] = [min(l, c[0]), min(t, c[1]), max(r, c[2]), max(b, c[3])]
                    at.append(k)
                    break
            else:
                anchors.append([l, t, r, b])
                at.append(len(anchors) - 1)
        return pd.DataFrame({"page": pdf["page"], "id": pdf["id"], "cluster": at})

    kind = boxes.schema
    return boxes.select("page", "id", "left", "top", "right", "bottom").groupBy("page").applyInPandas(
        run, f"page {kind['page'].dataType.simpleString()}, id {kind['id'].dataType.simpleString()}, cluster int"
    )


__all__ = ["best_overlap", "clusters", "fragments", "hit", "neighbours", "overlap", "union_box"]
