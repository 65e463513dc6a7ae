"""Page sets, page labels, outline trees and rectangle queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.functions import geometry, labels
from quirelake.operators import boxes, pages, trees
from quirelake.plans.registry import query
from quirelake.runtime import table

# ---- page sets --------------------------------------------------------------------------


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "page_text").select("page_id", "pdf_path", "page_number")


_RUNS = "WITH d AS (SELECT DISTINCT pdf_path, page_number AS p FROM page_text), r AS (SELECT pdf_path, min(p) AS a, max(p) AS b FROM (SELECT pdf_path, p, p - row_number() OVER (PARTITION BY pdf_path ORDER BY p) AS g FROM d) GROUP BY pdf_path, g) "


@query(_RUNS + "SELECT pdf_path, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS pages FROM r GROUP BY 1")
def w04_page_runs(spark: SparkSession, folder: str) -> DataFrame:
    return pages.compact(_pages(spark, folder), ["pdf_path"], "page_number")


@query("SELECT pdf_path, max(page_number) - min(page_number) + 1 = count(DISTINCT page_number) AS whole FROM page_text GROUP BY 1")
def w06_contiguous(spark: SparkSession, folder: str) -> DataFrame:
    p = _pages(spark, folder)
    return p.groupBy("pdf_path").agg((F.max("page_number") - F.min("page_number") + 1 == F.count_distinct("page_number")).alias("whole"))


@query("WITH n AS (SELECT pdf_path, max(page_number) AS n FROM page_text GROUP BY 1) SELECT pdf_path, CAST(p AS INT) AS page_number FROM (SELECT pdf_path, unnest(range(1, n + 1)) AS p FROM n) g WHERE NOT EXISTS (SELECT 1 FROM page_text t WHERE t.pdf_path = g.pdf_path AND t.page_number = g.p)")
def u03_missing_pages(spark: SparkSession, folder: str) -> DataFrame:
    p = _pages(spark, folder)
    every = p.groupBy("pdf_path").agg(F.max("page_number").alias("n")).select("pdf_path", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("page_number"))
    return every.join(p.select("pdf_path", "page_number"), ["pdf_path", "page_number"], "left_anti")


@query("SELECT page_id FROM page_text WHERE page_number NOT IN (SELECT DISTINCT page_number FROM search_match)")
def j16_unmatched_numbers(spark: SparkSession, folder: str) -> DataFrame:
    hit = table(spark, folder, "search_match").select("page_number").distinct()
    return _pages(spark, folder).join(hit, "page_number", "left_anti").select("page_id")


@query("SELECT page_id FROM page_text WHERE pdf_path IN (SELECT pdf_path FROM search_request)")
def j17_requested_pages(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "search_request").select("pdf_path").distinct()
    return _pages(spark, folder).join(asked, "pdf_path", "left_semi").select("page_id")


@query("SELECT page_id, CASE WHEN page_number % 3 = 0 THEN (page_number * 90 + 270) % 360 ELSE page_number * 90 % 360 END AS angle FROM page_text")
def u09_rotated(spark: SparkSession, folder: str) -> DataFrame:
    turn = F.col("page_number") * 90
    return _pages(spark, folder).select("page_id", F.when(F.col("page_number") % 3 == 0, F.pmod(turn + 270, F.lit(360))).otherwise(F.pmod(turn, F.lit(360))).alias("angle"))


@query("SELECT pdf_path, page_id, CAST(row_number() OVER (PARTITION BY pdf_path ORDER BY page_number % 2, page_number DESC, page_id) AS INT) AS place FROM page_text")
def u08_reordered(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("pdf_path").orderBy(F.col("page_number") % 2, F.col("page_number").desc(), "page_id")
    return _pages(spark, folder).select("pdf_path", "page_id", F.row_number().over(w).alias("place"))


@query("SELECT pdf_path, min(created_at) AS first_at FROM page_text GROUP BY 1")
def u04_first_occurrence(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "page_text").groupBy("pdf_path").agg(F.min("created_at").alias("first_at"))


@query("SELECT pdf_path, page_number, page_id FROM (SELECT *, row_number() OVER (PARTITION BY pdf_path, page_number ORDER BY page_id DESC) AS k FROM page_text) WHERE k = 1")
def u05_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).groupBy("pdf_path", "page_number").agg(F.max("page_id").alias("page_id"))


@query("SELECT pdf_path, CAST(at_s AS BIGINT) AS at_s FROM (SELECT pdf_path, max(epoch_us(requested_at)) // 1000000 AS at_s FROM search_request GROUP BY 1) ORDER BY at_s DESC, pdf_path LIMIT 10")
def o05_recent_files(spark: SparkSession, folder: str) -> DataFrame:
    from quirelake.runtime import micros

    last = table(spark, folder, "search_request").groupBy("pdf_path").agg(F.max(micros(F.col("requested_at"))).alias("m"))
    return last.select("pdf_path", F.floor(F.col("m") / 1000000).alias("at_s")).orderBy(F.col("at_s").desc(), "pdf_path").limit(10)


@query(
    "WITH o AS (SELECT o_orderkey, CAST(o_orderkey % 40 AS INT) AS a, CAST(o_custkey % 50 AS INT) AS b FROM orders) "
    "SELECT o_orderkey, coalesce(list_aggregate(list_sort(list_distinct(list_concat(CASE WHEN a BETWEEN 1 AND 30 THEN [a] ELSE [] END, CASE WHEN greatest(a, 1) <= least(b, 30) THEN range(greatest(a, 1), least(b, 30) + 1) ELSE [] END))), 'string_agg', ','), '') AS chosen FROM o"
)
def u02_page_sets(spark: SparkSession, folder: str) -> DataFrame:
    a, b = (F.col("o_orderkey") % 40).cast("string"), (F.col("o_custkey") % 50).cast("string")
    text = F.concat(a, F.lit(", x, "), a, F.lit(" - "), b)
    o = table(spark, folder, "orders")
    return o.select("o_orderkey", F.array_join(labels.pages_of(text, F.lit(30)), ",").alias("chosen"))


@query(
    "WITH o AS (SELECT o_orderkey, o_orderkey % 60 AS a, o_custkey % 60 AS b FROM orders) SELECT o_orderkey, CASE WHEN a BETWEEN 1 AND 50 AND b BETWEEN 1 AND 50 THEN least(a, b) || '-' || greatest(a, b) ELSE 'none' END AS span FROM o"
)
def x12_page_ranges(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat(F.lit(" "), (F.col("o_orderkey") % 60).cast("string"), F.lit(" – "), (F.col("o_custkey") % 60).cast("string"))
    o = table(spark, folder, "orders").select("o_orderkey", labels.page_range(text, F.lit(50)).alias("r"))
    return o.select("o_orderkey", F.coalesce(F.concat_ws("-", F.col("r.first").cast("string"), F.col("r.last").cast("string")), F.lit("none")).alias("span")).withColumn(
        "span", F.when(F.col("span") == "", "none").otherwise(F.col("span"))
    )


_ROMAN = "(['','M','MM','MMM','MMMM','MMMMM'])[{0} // 1000 + 1] || (['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'])[{0} // 100 % 10 + 1] || (['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'])[{0} // 10 % 10 + 1] || (['','I','II','III','IV','V','VI','VII','VIII','IX'])[{0} % 10 + 1]"


@query("SELECT p_partkey, " + _ROMAN.format("(p_partkey % 4000)") + " AS roman, CAST(p_partkey % 4000 AS INT) AS back FROM part WHERE p_partkey % 4000 > 0")
def x07_roman(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part").where("p_partkey % 4000 > 0")
    r = p.select("p_partkey", labels.roman((F.col("p_partkey") % 4000).cast("int")).alias("roman"))
    return r.select("p_partkey", "roman", labels.from_roman(F.col("roman")).alias("back"))


@query("SELECT p_partkey, repeat(chr(CAST(65 + (p_partkey % 200) % 26 AS INT)), CAST((p_partkey % 200) // 26 + 1 AS INT)) AS letters, CAST(p_partkey % 200 + 1 AS INT) AS back FROM part")
def x08_alphabetic(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part").select("p_partkey", labels.alphabetic((F.col("p_partkey") % 200 + 1).cast("int")).alias("letters"))
    return p.select("p_partkey", "letters", labels.from_alphabetic(F.col("letters")).cast("int").alias("back"))


@query(
    "SELECT page_id, CASE WHEN page_number >= 30 THEN 'B-' || (page_number - 30 + 7) WHEN page_number >= 12 THEN 'A' WHEN page_number >= 5 THEN (page_number - 4)::VARCHAR ELSE "
    "(['i','ii','iii','iv'])[page_number] END AS label FROM page_text WHERE page_number >= 1"
)
def j03_page_labels(spark: SparkSession, folder: str) -> DataFrame:
    ranges = [(1, "r", "", 1), (5, "D", "", 1), (12, None, "A", 1), (30, "D", "B-", 7)]
    return pages.with_labels(_pages(spark, folder).where("page_number >= 1"), "page_number", ranges).select("page_id", "label")


@query(
    "WITH n AS (SELECT pdf_path, CAST(max(page_number) AS INT) AS n FROM page_text GROUP BY 1), p AS (SELECT page_id, least(page_number, n) AS p, n FROM page_text JOIN n USING (pdf_path)) "
    "SELECT page_id, CASE WHEN n <= 1 THEN p WHEN p % 2 = 0 THEN p - 1 ELSE p END AS facing, CASE WHEN n <= 1 THEN p WHEN p = 1 THEN 1 WHEN n % 2 = 0 AND p = n THEN n WHEN p % 2 = 0 THEN p ELSE p - 1 END AS first_single FROM p"
)
def x13_spreads(spark: SparkSession, folder: str) -> DataFrame:
    p = _pages(spark, folder)
    sized = p.join(p.groupBy("pdf_path").agg(F.max("page_number").alias("n")), "pdf_path")
    start = lambda mode: labels.spread_start(F.col("page_number"), F.lit(mode), F.col("n"))
    return sized.select("page_id", start("facing").alias("facing"), start("facing-first-single").alias("first_single"))


@query("SELECT page_id, CAST(regexp_extract(pdf_path, '(\\d+)\\.[^.]*$', 1) AS BIGINT) AS file_no FROM page_text")
def o09_numeric_suffix(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select("page_id", F.regexp_extract("pdf_path", r"(\d+)\.[^.]*$", 1).cast("long").alias("file_no"))


# ---- trees: suppliers as nodes, each under number // 4 -------------------------------------

_TREE = "WITH RECURSIVE t AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey >= 4 THEN s_suppkey // 4 END AS parent FROM supplier), c AS (SELECT id, id AS ancestor, parent, 0 AS distance FROM t UNION ALL SELECT c.id, t.id, t.parent, c.distance + 1 FROM c JOIN t ON t.id = c.parent) "


def _tree(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(key.alias("id"), F.when(key >= 4, F.floor(key / 4)).alias("parent"))


@query(_TREE + "SELECT ancestor AS id, count(*) AS n FROM c GROUP BY 1")
def a10_visible_counts(spark: SparkSession, folder: str) -> DataFrame:
    return trees.visible_counts(_tree(spark, folder))


@query(_TREE + "SELECT id, CAST(max(distance) AS INT) AS depth, string_agg(ancestor::VARCHAR, '/' ORDER BY distance DESC) AS path FROM c GROUP BY id")
def proj_p16_preorder(spark: SparkSession, folder: str) -> DataFrame:
    flat = trees.preorder(_tree(spark, folder))
    return flat.select("id", F.col("depth").cast("int").alias("depth"), F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


@query(_TREE + "SELECT id, ancestor, CAST(distance AS INT) AS distance FROM c WHERE id % 10 = 7")
def j25_active_paths(spark: SparkSession, folder: str) -> DataFrame:
    t = _tree(spark, folder)
    return trees.closure(t, asked=t.where("id % 10 = 7")).withColumn("distance", F.col("distance").cast("int"))


@query(_TREE + "SELECT id FROM t WHERE id % 5 IN (1, 2) AND NOT EXISTS (SELECT 1 FROM c WHERE c.id = t.id AND c.distance > 0 AND c.ancestor % 5 IN (1, 2))")
def j18_top_selected(spark: SparkSession, folder: str) -> DataFrame:
    t = _tree(spark, folder)
    return trees.top_selected(t, t.where("id % 5 IN (1, 2)"))


@query(_TREE + "SELECT id FROM t WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.id = t.id AND c.ancestor % 9 = 2)")
def u13_deleted_branches(spark: SparkSession, folder: str) -> DataFrame:
    t = _tree(spark, folder)
    return trees.delete_with_branches(t, t.where("id % 9 = 2")).select("id")


# ---- rectangles: embeddings' first components in thousandths -------------------------------

_BOX = (
    "WITH b AS (SELECT vec_id AS id, label AS page, CAST(floor(abs(embedding[1]) * 1000) AS DOUBLE) AS l, CAST(floor(abs(embedding[2]) * 1000) AS DOUBLE) AS t, "
    "CAST(floor(abs(embedding[3]) * 300) + 1 AS DOUBLE) AS w, CAST(floor(abs(embedding[4]) * 300) + 1 AS DOUBLE) AS h FROM embeddings), "
    "x AS (SELECT id, page, l, t, l + w AS r, t + h AS bo FROM b) "
)


def _boxes(spark: SparkSession, folder: str) -> DataFrame:
    part = lambda i, k: F.floor(F.abs(F.col("embedding")[i]) * k).cast("double")
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("page"), part(0, 1000).alias("left"), part(1, 1000).alias("top"), (part(2, 300) + 1).alias("w"), (part(3, 300) + 1).alias("h"))
    return e.select("id", "page", "left", "top", (F.col("left") + F.col("w")).alias("right"), (F.col("top") + F.col("h")).alias("bottom"))


@query(_BOX + "SELECT a.page, a.id AS a_id, b.id AS b_id FROM x a JOIN x b ON a.page = b.page AND a.id < b.id AND a.l <= b.r AND b.l <= a.r AND a.t <= b.bo AND b.t <= a.bo")
def j05_touching_boxes(spark: SparkSession, folder: str) -> DataFrame:
    return boxes.neighbours(_boxes(spark, folder), cell=40.0)


@query(_BOX + "SELECT page, id, greatest(l, 50.0) AS left_, greatest(t, 60.0) AS top_, least(r, 160.0) AS right_, least(bo, 200.0) AS bottom_ FROM x WHERE l < 160 AND r > 50 AND t < 200 AND bo > 60")
def j06_fragments(spark: SparkSession, folder: str) -> DataFrame:
    f = boxes.fragments(_boxes(spark, folder), (50, 60, 160, 200))
    return f.select("page", "id", *[F.col(c).alias(c + "_") for c in ("left", "top", "right", "bottom")])


@query(_BOX + "SELECT page, min(l) AS l, min(t) AS t, max(r) AS r, max(bo) AS b FROM x GROUP BY page")
def a07_union_boxes(spark: SparkSession, folder: str) -> DataFrame:
    return boxes.union_box(_boxes(spark, folder), ["page"]).toDF("page", "l", "t", "r", "b")


@query(
    _BOX
    + ", p AS (SELECT page, unnest([1, 2, 3, 4, 5]) AS point FROM (SELECT DISTINCT page FROM x)), m AS (SELECT p.page, p.point, x.id, greatest(l - 30.0 * point, 0, 30.0 * point - r) AS dx, greatest(t - 25.0 * point, 0, 25.0 * point - bo) AS dy, (r - l) * (bo - t) AS a "
    "FROM x JOIN p ON x.page = p.page WHERE 30.0 * point BETWEEN l - 6 AND r + 6 AND 25.0 * point BETWEEN t - 6 AND bo + 6) "
    "SELECT page, point, id FROM (SELECT *, row_number() OVER (PARTITION BY page, point ORDER BY (dx * dx + dy * dy) * 10000 + a, id) AS k FROM m) WHERE k = 1"
)
def j07_point_hits(spark: SparkSession, folder: str) -> DataFrame:
    b = _boxes(spark, folder)
    points = b.select("page").distinct().select("page", F.explode(F.array(*map(F.lit, range(1, 6)))).alias("id"))
    points = points.select("page", "id", (F.col("id") * 30.0).alias("x"), (F.col("id") * 25.0).alias("y"))
    return boxes.hit(b, points, 6.0)


@query(
    _BOX
    + ", m AS (SELECT x.page, 1 AS mark, x.id, greatest(0, least(r, 120) - greatest(l, 40)) * greatest(0, least(bo, 150) - greatest(t, 50)) AS i, (r - l) * (bo - t) AS a, sqrt(pow((l + r) / 2 - 80, 2) + pow((t + bo) / 2 - 100, 2)) AS d FROM x), "
    "s AS (SELECT *, i / (a + 8000 - i) AS score FROM m) SELECT page, mark, id FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score > 0 DESC, CASE WHEN score > 0 THEN -score ELSE d END, id) AS k FROM s WHERE score > 0 OR d <= 40) WHERE k = 1"
)
def j09_best_overlap(spark: SparkSession, folder: str) -> DataFrame:
    b = _boxes(spark, folder)
    lits = {"left": 40.0, "top": 50.0, "right": 120.0, "bottom": 150.0}
    marks = b.select("page").distinct().select("page", F.lit(1).alias("id"), *[F.lit(v).alias(c) for c, v in lits.items()])
    return boxes.best_overlap(b, marks).select("page", "mark", "id")


@query()
def u07_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return boxes.clusters(_boxes(spark, folder), near=12.0)


@query(_BOX + "SELECT id, least(1.0, greatest(0.0, l / 400)) AS l, least(1.0, greatest(0.0, 1 - bo / 400)) AS t, least(1.0, (r - l) / 400) AS w, least(1.0, (bo - t) / 400) AS h FROM x")
def proj_p05_marker_rects(spark: SparkSession, folder: str) -> DataFrame:
    part = lambda a, b: F.least(F.lit(1.0), (F.col(a) - F.col(b)) / 400)
    return _boxes(spark, folder).select(
        "id", geometry.clamp01(F.col("left") / 400).alias("l"), geometry.clamp01(1 - F.col("bottom") / 400).alias("t"), part("right", "left").alias("w"), part("bottom", "top").alias("h")
    )


@query(_BOX + "SELECT id, l * s AS px, 842.0 - bo * s AS py, (r - l) * s AS pw, (bo - t) * s AS ph FROM x, (SELECT least(595.0 / 1000, 842.0 / 1000) AS s)")
def proj_p06_word_boxes(spark: SparkSession, folder: str) -> DataFrame:
    s = F.lit(min(595.0 / 1000, 842.0 / 1000))
    c = F.col
    return _boxes(spark, folder).select("id", (c("left") * s).alias("px"), (842.0 - c("bottom") * s).alias("py"), ((c("right") - c("left")) * s).alias("pw"), ((c("bottom") - c("top")) * s).alias("ph"))


@query(_BOX + "SELECT id, page, CAST(row_number() OVER (PARTITION BY page ORDER BY t, r DESC, l, id) AS INT) AS place FROM x")
def o11_anchor_order(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("page").orderBy("top", F.col("right").desc(), "left", "id")
    return _boxes(spark, folder).select("id", "page", F.row_number().over(w).alias("place"))


@query(_BOX + "SELECT page, id FROM (SELECT page, id, greatest(0, least(bo, 180) - greatest(t, 40)) AS v, row_number() OVER (PARTITION BY page ORDER BY greatest(0, least(bo, 180) - greatest(t, 40)) DESC, id) AS k FROM x) WHERE k = 1")
def o10_most_visible(spark: SparkSession, folder: str) -> DataFrame:
    shown = geometry.overlap(F.col("top"), F.col("bottom"), F.lit(40.0), F.lit(180.0))
    best = F.max(F.struct(shown.alias("v"), (-F.col("id")).alias("k"))).alias("m")
    return _boxes(spark, folder).groupBy("page").agg(best).select("page", (-F.col("m.k")).alias("id"))
