"""Greedy matchings, layouts and offsets within texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions import comments as cm
from quirelake.functions import text as fx
from quirelake.operators import greedy
from quirelake.plans.annotations import comments
from quirelake.plans.registry import query
from quirelake.runtime import table


def _boxed(spark: SparkSession, folder: str) -> DataFrame:
    c = comments(spark, folder)
    return c.select("page", "id", "ann_id", "uid", "text", "source", "at_us", F.col("l").alias("left"), F.col("t").alias("top"), (F.col("l") + F.col("w")).alias("right"), (F.col("t") + F.col("h")).alias("bottom"))


_CROSS = "greatest(0, least(z.r, r) - greatest(z.l, l)) * greatest(0, least(z.bo, bo) - greatest(z.t, t))"
_AREAS = "(r - l) * (bo - t), (z.r - z.l) * (z.bo - z.t)"


@query(
    "WITH RECURSIVE c AS (SELECT doc_id AS id, doc_id // 25 + 1 AS page, CASE WHEN doc_id % 3 = 0 THEN doc_id || 'R' END AS ann, coalesce(source, '') AS uid, doc_id % 2 = 0 AS editor, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS txt, trim(coalesce(text, '')) <> '' AS said, coalesce(epoch_us(added_at), 0) AS at_us, doc_id % 3 <> 1 AS markup, "
    "CAST(doc_id * 37 % 800 AS DOUBLE) / 1000 AS l, CAST(doc_id * 53 % 700 AS DOUBLE) / 1000 AS t, CAST(doc_id * 37 % 800 AS DOUBLE) / 1000 + CAST(doc_id * 7 % 90 AS DOUBLE) / 1000 AS r, CAST(doc_id * 53 % 700 AS DOUBLE) / 1000 + CAST(doc_id * 11 % 60 AS DOUBLE) / 1000 AS bo FROM documents), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN ann IS NOT NULL THEN 110 ELSE 0 END + CASE WHEN uid <> '' THEN 55 ELSE 0 END + CASE WHEN editor THEN 22 ELSE 0 END + CASE WHEN said THEN 12 ELSE 0 END + CASE WHEN at_us <> 0 THEN 5 ELSE 0 END DESC, at_us DESC, id) AS n FROM c), "
    "w AS (SELECT page, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS entity, CAST([] AS STRUCT(id BIGINT, ann VARCHAR, uid VARCHAR, txt VARCHAR, markup BOOLEAN, l DOUBLE, t DOUBLE, r DOUBLE, bo DOUBLE)[]) AS kept FROM (SELECT DISTINCT page FROM o) UNION ALL "
    "SELECT page, n, id, coalesce(same, id), CASE WHEN same IS NULL THEN list_append(kept, struct_pack(id := id, ann := ann, uid := uid, txt := txt, markup := markup, l := l, t := t, r := r, bo := bo)) ELSE kept END FROM ("
    "SELECT o.*, w.kept, list_filter(w.kept, lambda z: CASE WHEN ann IS NOT NULL AND z.ann IS NOT NULL THEN ann = z.ann WHEN uid <> '' AND z.uid <> '' THEN uid = z.uid ELSE "
    "((ann IS NULL AND z.ann IS NULL AND uid = '' AND z.uid = '') OR txt = '' OR z.txt = '' OR txt = z.txt) AND markup AND z.markup AND "
    f"(coalesce({_CROSS} / nullif((r - l) * (bo - t) + (z.r - z.l) * (z.bo - z.t) - {_CROSS}, 0), 0) >= 0.46 OR sqrt(pow((l + r - z.l - z.r) / 2, 2) + pow((t + bo - z.t - z.bo) / 2, 2)) <= 0.045 AND greatest({_AREAS}) / greatest(1e-6, least({_AREAS})) <= 2.8) END)[1].id AS same "
    "FROM w JOIN o ON o.page = w.page AND o.n = w.n + 1)) SELECT page, id, entity FROM w WHERE id IS NOT NULL"
)
def u06_resolved_comments(spark: SparkSession, folder: str) -> DataFrame:
    c = _boxed(spark, folder)
    points = cm.merge_points(F.col("ann_id"), F.col("uid"), F.col("source"), F.col("text"), F.lit(False), F.col("at_us"), F.col("left"))
    # by points, then the latest
    place = F.struct(-points, -F.coalesce("at_us", F.lit(0)))
    # every third comment is no mark on text
    return greedy.resolve(c.withColumn("place", place).withColumn("markup", F.col("id") % 3 != 1))


_IOU = "greatest(0, least(h.r, o.r) - greatest(h.l, o.l)) * greatest(0, least(h.bo, o.bo) - greatest(h.t, o.t))"


@query(
    "WITH RECURSIVE b AS (SELECT vec_id AS id, label AS page, CAST(floor(abs(embedding[1]) * 1000) AS DOUBLE) AS l, CAST(floor(abs(embedding[2]) * 1000) AS DOUBLE) AS t, CAST(floor(abs(embedding[3]) * 300) + 1 AS DOUBLE) AS w, CAST(floor(abs(embedding[4]) * 300) + 1 AS DOUBLE) AS hh FROM embeddings), "
    "x AS (SELECT id, page, l, t, l + w AS r, t + hh AS bo FROM b), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY id) AS n FROM x WHERE id % 2 = 0), "
    f"g AS (SELECT o.page, o.n, o.id, h.id AS hint, {_IOU} / ((o.r - o.l) * (o.bo - o.t) + (h.r - h.l) * (h.bo - h.t) - {_IOU}) AS iou FROM o JOIN x h ON h.page = o.page AND h.id % 2 = 1), "
    "c AS (SELECT page, n, id, array_agg(struct_pack(hint := hint, iou := iou) ORDER BY iou DESC, hint) FILTER (WHERE iou >= 0.2) AS cs FROM g GROUP BY 1, 2, 3), "
    "w AS (SELECT page, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS hint, CAST([] AS BIGINT[]) AS used FROM (SELECT DISTINCT page FROM o) UNION ALL "
    "SELECT page, n, id, hint, CASE WHEN hint IS NULL THEN used ELSE list_append(used, hint) END FROM (SELECT c.page, c.n, c.id, list_filter(c.cs, lambda z: NOT list_contains(w.used, z.hint))[1].hint AS hint, w.used FROM w JOIN c ON c.page = w.page AND c.n = w.n + 1)) "
    "SELECT page, id, hint FROM w WHERE hint IS NOT NULL"
)
def j08_assigned_hints(spark: SparkSession, folder: str) -> DataFrame:
    from quirelake.plans.layout import _boxes

    b = _boxes(spark, folder)
    return greedy.assign(b.where("id % 2 = 0"), b.where("id % 2 = 1"))


_SPOTS = "[" + ", ".join(f"[{a}.0, {b}.0]" for a, b in greedy.OFFSETS) + "]"


@query(
    "WITH RECURSIVE c AS (SELECT doc_id AS id, doc_id // 25 + 1 AS page, CAST(doc_id * 37 % 800 AS DOUBLE) / 1000 * 600 AS x, CAST(doc_id * 53 % 700 AS DOUBLE) / 1000 * 800 AS y FROM documents), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY id) AS n FROM c), "
    "w AS (SELECT page, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(NULL AS DOUBLE[]) AS spot, CAST([] AS DOUBLE[][]) AS placed FROM (SELECT DISTINCT page FROM o) UNION ALL "
    "SELECT page, n, id, spot, list_append(placed, spot) FROM (SELECT page, n, id, placed, spots[coalesce(nullif(list_position(list_transform(room, lambda m: m >= 24), true), 0), list_position(room, list_max(room)))] AS spot FROM ("
    "SELECT page, n, id, placed, spots, list_transform(spots, lambda s: coalesce(list_min(list_transform(placed, lambda p: sqrt((p[1] - s[1]) * (p[1] - s[1]) + (p[2] - s[2]) * (p[2] - s[2])))), 1e18)) AS room FROM ("
    f"SELECT o.page, o.n, o.id, w.placed, list_transform({_SPOTS}, lambda f: [o.x + f[1], o.y + f[2]]) AS spots FROM w JOIN o ON o.page = w.page AND o.n = w.n + 1)))) "
    "SELECT page, id, spot[1] AS x, spot[2] AS y FROM w WHERE id IS NOT NULL"
)
def o13_placed_markers(spark: SparkSession, folder: str) -> DataFrame:
    b = _boxed(spark, folder)
    return greedy.place_markers(b.select("page", "id", (F.col("left") * 600).alias("x"), (F.col("top") * 800).alias("y")))


_LAYOUT = (
    "WITH RECURSIVE n AS (SELECT s_suppkey AS id, s_suppkey // 2 AS parent, s_suppkey % 2 = 1 AS second, s_suppkey % 3 = 0 AS hor, CAST(greatest(0.1, least(0.9, (s_suppkey % 11) / 10.0)) AS DOUBLE) AS r FROM supplier WHERE s_suppkey >= 1), "
    "b AS (SELECT id, CAST(0 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y, CAST(1 AS DOUBLE) AS w, CAST(1 AS DOUBLE) AS h FROM n WHERE id = 1 UNION ALL "
    "SELECT c.id, CASE WHEN p.hor AND c.second THEN b.x + b.w * p.r ELSE b.x END, CASE WHEN NOT p.hor AND c.second THEN b.y + b.h * p.r ELSE b.y END, "
    "CASE WHEN NOT p.hor THEN b.w WHEN c.second THEN b.w * (1 - p.r) ELSE b.w * p.r END, CASE WHEN p.hor THEN b.h WHEN c.second THEN b.h * (1 - p.r) ELSE b.h * p.r END FROM b JOIN n p ON p.id = b.id JOIN n c ON c.parent = p.id) "
)


def _layout(spark: SparkSession, folder: str) -> DataFrame:
    # a binary tree from supplier 1 (0 lies outside of it)
    k = F.col("s_suppkey")
    s = table(spark, folder, "supplier").where("s_suppkey >= 1")
    return s.select(k.alias("id"), F.when(k > 1, F.floor(k / 2)).alias("parent"), (k % 2 == 1).alias("second"), (k % 3 == 0).alias("horizontal"), ((k % 11) / 10.0).alias("ratio"))


@query(_LAYOUT + "SELECT id, round(x, 9) AS x, round(y, 9) AS y, round(w, 9) AS width, round(h, 9) AS height FROM b")
def proj_p08_layout_rects(spark: SparkSession, folder: str) -> DataFrame:
    r = greedy.layout_rects(_layout(spark, folder))
    return r.select("id", *[F.round(c, 9).alias(c) for c in ("x", "y", "width", "height")])


# panes of windows: eight boxes of the embeddings each, most recently used by a rule
_PANES = (
    "WITH b AS (SELECT vec_id AS id, vec_id // 8 AS page, CAST(floor(abs(embedding[1]) * 1000) AS DOUBLE) AS l, CAST(floor(abs(embedding[2]) * 1000) AS DOUBLE) AS t, CASE WHEN vec_id % 5 <> 0 THEN vec_id * 7 % 11 END AS mru FROM embeddings), x AS (SELECT id, page, l, t, l + 20 AS r, t + 30 AS bo, coalesce(mru, 1073741824) AS mru FROM b), "
)
_SIDES = {
    "right": ("b.l >= a.r - 1e-6", "b.l - a.r", "b.l", "t", "bo"),
    "left": ("b.r <= a.l + 1e-6", "a.l - b.r", "-b.r", "t", "bo"),
    "down": ("b.t >= a.bo - 1e-6", "b.t - a.bo", "b.t", "l", "r"),
    "up": ("b.bo <= a.t + 1e-6", "a.t - b.bo", "-b.bo", "l", "r"),
}


def _neighbour_sql() -> str:
    parts = [
        f"SELECT '{side}' AS side, a.page, a.id, b.id AS next, row_number() OVER (PARTITION BY a.page, a.id ORDER BY NOT ({beyond}), CASE WHEN {beyond} THEN {d} ELSE {far} END, -greatest(0, least(a.{y1}, b.{y1}) - greatest(a.{y0}, b.{y0})), b.mru, b.id) AS k FROM x a JOIN x b ON a.page = b.page AND a.id <> b.id"
        for side, (beyond, d, far, y0, y1) in _SIDES.items()
    ]
    return _PANES + "m AS (" + " UNION ALL ".join(parts) + ") SELECT side, page, id, next FROM m WHERE k = 1"


@query(_neighbour_sql())
def j14_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    part = lambda i: F.floor(F.abs(F.col("embedding")[i]) * 1000).cast("double")
    v = F.col("vec_id")
    e = table(spark, folder, "embeddings").select(v.alias("id"), F.floor(v / 8).alias("page"), part(0).alias("left"), part(1).alias("top"), F.when(v % 5 != 0, v * 7 % 11).alias("mru"))
    e = e.select("*", (F.col("left") + 20).alias("right"), (F.col("top") + 30).alias("bottom"))
    out = None
    for side in _SIDES:
        one = greedy.directional_neighbour(e, ["page"], side).withColumn("side", F.lit(side))
        out = one if out is None else out.unionByName(one)
    return out


_WHITE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


@query(
    "WITH d AS (SELECT doc_id, text, CAST(doc_id * 7919 % length(text) AS INT) AS off, length(text) AS n FROM documents WHERE length(text) > 0), "
    f"s AS (SELECT *, off - length(regexp_extract(text[1:off], '[{_WHITE}]*$', 0)) - 1 AS lo, off + length(regexp_extract(text[off + 1:], '^[{_WHITE}]*', 0)) AS hi FROM d), "
    "w AS (SELECT *, CASE WHEN hi = off THEN off WHEN lo >= 0 AND (hi >= n OR off - lo <= hi - off) THEN lo WHEN hi < n THEN hi END AS at_c FROM s) "
    f"SELECT doc_id, CAST(coalesce(at_c - length(regexp_extract(text[1:at_c], '[^{_WHITE}]*$', 0)), off) AS INT) AS start, CAST(coalesce(at_c + length(regexp_extract(text[at_c + 1:], '^[^{_WHITE}]*', 0)), off + 1) AS INT) AS stop FROM w"
)
def x33_word_bounds(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where(F.length("text") > 0)
    d = d.select("doc_id", "text", (F.col("doc_id") * 7919 % F.length("text")).cast("int").alias("off"))
    return d.select("doc_id", fx.word_bounds(F.col("text"), F.col("off")).alias("w")).select("doc_id", "w.start", "w.stop")
