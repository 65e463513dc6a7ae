"""Order-dependent matchings within a page, and rectangles of split layouts."""

from __future__ import annotations

from math import hypot

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.functions.geometry import overlap
from quirelake.operators import trees
from quirelake.operators.ordered import per_group

# Where a marker may move to, in pixels, in order of preference.
OFFSETS = [
    (0, 0), (18, -10), (18, 10), (-18, -10), (-18, 10), (30, 0), (0, -20), (0, 20), (30, -18), (30, 18), (-30, 0),
    (42, 0), (-42, 0), (52, -14), (52, 14), (-52, -14), (-52, 14),
]
APART = 24.0


def _iou(a, b) -> float:
    w = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


# Overlap, distance of centres and ratio of areas at which two marks are one.
SAME_IOU, SAME_CENTRE, SAME_AREA = 0.46, 0.045, 2.8


def _alike(a, b) -> bool:
    """Whether two rectangles can be one mark: they overlap well, or lie close with like areas."""
    if _iou(a, b) >= SAME_IOU:
        return True
    sizes = sorted(((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1])))
    off = hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2)
    return off <= SAME_CENTRE and sizes[1] / max(1e-6, sizes[0]) <= SAME_AREA


def resolve(comments: DataFrame) -> DataFrame:
    """``(page, id, entity)``: comments that are one logical comment get its first row's id.

    ``comments`` has ``page, place, id, ann_id, uid, text, markup, left, top, right, bottom``;
    ``place`` is the order of merging, ``markup`` whether it marks text (others are never one
    by their rectangles). A comment joins the first earlier entity that is the same: by
    annotation id where both have one, else by uid where both have one, else by texts that do
    not contradict and rectangles that are alike. The order decides, so a page's comments are
    worked on together; a page holds what one page shows.
    """

    def walk(key, rows):
        kept: list[tuple] = []
        for _, i, ann, uid, text, markup, l, t, r, b in rows:
            text, box, entity = (text or "").strip(), (l, t, r, b), None
            for k_id, k_ann, k_uid, k_text, k_markup, k_box in kept:
                if ann and k_ann:
                    same = ann == k_ann
                elif uid and k_uid:
                    same = uid == k_uid
                else:
                    agree = not (ann or uid or k_ann or k_uid) or not text or not k_text or text == k_text
                    same = agree and markup and k_markup and _alike(box, k_box)
                if same:
                    entity = k_id
                    break
            if entity is None:
                entity = i
                kept.append((i, ann, uid, text, markup, box))
            yield (*key, i, entity)

    kind = comments.schema["page"].dataType.simpleString()
    return per_group(comments, ["page"], ["place", "id"], ["ann_id", "uid", "text", "markup", "left", "top", "right", "bottom"], walk, f"page {kind}, id long, entity long")


def assign(marks: DataFrame, hints: DataFrame, least: float = 0.2) -> DataFrame:
    """``(page, id, hint)``: each mark, in order, takes the free hint with the best IoU, at least ``least``."""
    columns = ["page", "id", "left", "top", "right", "bottom"]
    both = hints.select(*columns).withColumn("side", F.lit(0)).unionByName(marks.select(*columns).withColumn("side", F.lit(1)))

    def walk(key, rows):
        free: list[tuple] = []
        for side, i, *box in rows:
            if side == 0:
                free.append((i, box))
                continue
            best = max(((_iou(box, h[1]), -k) for k, h in enumerate(free)), default=(0.0, 0))
            if best[0] >= least:
                yield (*key, i, free.pop(-best[1])[0])

    kind = marks.schema["page"].dataType.simpleString()
    return per_group(both, ["page"], ["side", "id"], ["left", "top", "right", "bottom"], walk, f"page {kind}, id long, hint long")


def place_markers(anchors: DataFrame) -> DataFrame:
    """``(page, id, x, y)``: markers moved so that they do not cover earlier ones.

    The first offset at least ``APART`` from all placed markers is taken, else the one that
    is farthest from its nearest.
    """

    def walk(key, rows):
        placed: list[tuple[float, float]] = []
        for i, x, y in rows:
            spots = [(x + a, y + b) for a, b in OFFSETS]
            room = [min((hypot(p - u, q - v) for u, v in placed), default=float("inf")) for p, q in spots]
            at = next((k for k, r in enumerate(room) if r >= APART), None)
            spot = spots[at if at is not None else max(range(len(spots)), key=lambda k: room[k])]
            placed.append(spot)
            yield (*key, i, *spot)

    kind = anchors.schema["page"].dataType.simpleString()
    return per_group(anchors, ["page"], ["id"], ["x", "y"], walk, f"page {kind}, id long, x double, y double")


def layout_rects(nodes: DataFrame) -> DataFrame:
    """``(id, x, y, width, height)`` in the unit square of a layout's nodes.

    ``nodes`` has ``id, parent, second`` (whether it is its parent's second part) and, for
    splits, ``horizontal, ratio``; ratios are clamped to [0.1, 0.9]. Every node's rectangle
    is folded along its path from the root, so there is no recursion.
    """
    ratio = F.greatest(F.lit(0.1), F.least(F.lit(0.9), F.col("ratio")))
    splits = nodes.select(F.col("id").alias("_parent"), F.col("horizontal").alias("h"), ratio.alias("r"))
    steps = nodes.select(F.col("id").alias("ancestor"), F.col("parent").alias("_parent"), "second").join(splits, "_parent").drop("_parent")
    path = trees.closure(nodes).join(steps, "ancestor", "left").groupBy("id").agg(
        F.sort_array(F.collect_list(F.when(F.col("h").isNotNull(), F.struct("distance", "second", "h", "r"))), asc=False).alias("path")
    )
    unit = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("width"), F.lit(1.0).alias("height"))

    def step(acc, s):
        part = F.when(s["second"], 1 - s["r"]).otherwise(s["r"])
        move = F.when(s["second"], s["r"]).otherwise(F.lit(0.0))
        return F.struct(
            F.when(s["h"], acc["x"] + acc["width"] * move).otherwise(acc["x"]).alias("x"),
            F.when(s["h"], acc["y"]).otherwise(acc["y"] + acc["height"] * move).alias("y"),
            F.when(s["h"], acc["width"] * part).otherwise(acc["width"]).alias("width"),
            F.when(s["h"], acc["height"]).otherwise(acc["height"] * part).alias("height"),
        )

    return path.select("id", F.aggregate("path", unit, step).alias("b")).select("id", "b.*")


def directional_neighbour(boxes: DataFrame, keys: list[str], direction: str = "right", wrap: bool = True) -> DataFrame:
    """``(keys, id, next)``: of the panes of a window wholly on that side, the nearest, then the one
    that overlaps most across, then the most recently used, then the smaller id.

    ``boxes`` has ``id, left, top, right, bottom`` and, where there is one, ``mru`` (0 the latest,
    null never). Where no pane lies on that side and ``wrap`` holds, the one farthest on the other
    side follows, by the same order. A window alone has no neighbour. The panes of one window
    are few; its pairs are compared.
    """
    if direction not in ("right", "left", "down", "up"):
        raise ValueError(direction)
    along, across = (("left", "right"), ("top", "bottom"))
    if direction in ("down", "up"):
        along, across = across, along
    lo, hi = (F.col(along[0]), F.col(along[1])) if direction in ("right", "down") else (-F.col(along[1]), -F.col(along[0]))
    flat = boxes.select(*keys, "id", lo.alias("lo"), hi.alias("hi"), F.col(across[0]).alias("x0"), F.col(across[1]).alias("x1"), (F.coalesce("mru", F.lit(1 << 30)) if "mru" in boxes.columns else F.lit(0)).alias("mru"))
    other = flat.select(*keys, *[F.col(c).alias(f"b_{c}") for c in ("id", "lo", "hi", "x0", "x1", "mru")])
    met = flat.join(other, keys).where(F.col("id") != F.col("b_id"))
    beyond = F.col("b_lo") >= F.col("hi") - 1e-6
    shared = overlap(F.col("x0"), F.col("x1"), F.col("b_x0"), F.col("b_x1"))
    distance = F.when(beyond, F.col("b_lo") - F.col("hi")).otherwise(F.col("b_lo"))
    if not wrap:
        met = met.where(beyond)
    best = F.min(F.struct((~beyond).alias("w"), distance.alias("d"), (-shared).alias("o"), F.col("b_mru").alias("m"), F.col("b_id").alias("id"))).alias("best")
    return met.groupBy(*keys, "id").agg(best).select(*keys, "id", F.col("best.id").alias("next"))
