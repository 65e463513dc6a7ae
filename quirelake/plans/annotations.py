"""Annotation comments, render plans and small scalar rules.

Comments are read from the documents: a document is a comment of its source on page
``doc_id // 25 + 1``, with a rectangle, an author and a subtype that follow from its row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.functions import text as tx
from quirelake.functions.geometry import clamp01, overlap
from quirelake.plans.registry import query
from quirelake.runtime import micros, table

_C = (
    "WITH c AS (SELECT doc_id AS id, doc_id // 25 + 1 AS page, CASE WHEN doc_id % 3 = 0 THEN doc_id || 'R' END AS ann_id, coalesce(source, '') AS uid, "
    "CASE WHEN doc_id % 2 = 0 THEN 'editor' ELSE 'pdf' END AS source, kind AS subtype, coalesce(text, '') AS text, epoch_us(added_at) AS at_us, "
    "CAST(doc_id * 37 % 800 AS DOUBLE) / 1000 AS l, CAST(doc_id * 53 % 700 AS DOUBLE) / 1000 AS t, CAST(doc_id * 7 % 90 AS DOUBLE) / 1000 AS w, CAST(doc_id * 11 % 60 AS DOUBLE) / 1000 AS h FROM documents) "
)


def comments(spark: SparkSession, folder: str) -> DataFrame:
    part = lambda a, m: (F.col("doc_id") * a % m).cast("double") / 1000
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), (F.floor(F.col("doc_id") / 25) + 1).alias("page"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("doc_id").cast("string"), F.lit("R"))).alias("ann_id"),
        F.coalesce("source", F.lit("")).alias("uid"), F.when(F.col("doc_id") % 2 == 0, "editor").otherwise("pdf").alias("source"), F.col("kind").alias("subtype"),
        F.coalesce("text", F.lit("")).alias("text"), micros(F.col("added_at")).alias("at_us"), part(37, 800).alias("l"), part(53, 700).alias("t"), part(7, 90).alias("w"), part(11, 60).alias("h"),
    )


@query(_C + "SELECT id, CAST(trunc(l * 1240) AS INT) AS x, CAST(trunc(t * 1754) AS INT) AS y, CAST(trunc((l + w) * 1240) AS INT) AS x1 FROM c")
def proj_p07_pixels(spark: SparkSession, folder: str) -> DataFrame:
    px = lambda e, n: (e * n).cast("int")
    return comments(spark, folder).select("id", px(F.col("l"), 1240).alias("x"), px(F.col("t"), 1754).alias("y"), px(F.col("l") + F.col("w"), 1240).alias("x1"))


@query(_C + "SELECT id FROM c WHERE source = 'editor' AND subtype IN ('note', 'outline') AND w > 0 AND h > 0")
def f09_subtype_hints(spark: SparkSession, folder: str) -> DataFrame:
    return comments(spark, folder).where("source = 'editor' AND subtype IN ('note', 'outline') AND w > 0 AND h > 0").select("id")


@query(_C + "SELECT page, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM c WHERE source = 'editor' GROUP BY page")
def a08_hints_by_page(spark: SparkSession, folder: str) -> DataFrame:
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",")
    return comments(spark, folder).where("source = 'editor'").groupBy("page").agg(F.count(F.lit(1)).alias("n"), ids.alias("ids"))


@query(_C + "SELECT id FROM c WHERE page + t < 12.5 + 3 AND page + t + h > 8.25 - 3")
def f14_visible(spark: SparkSession, folder: str) -> DataFrame:
    top = F.col("page") + F.col("t")
    return comments(spark, folder).where((top < 15.5) & (top + F.col("h") > 5.25)).select("id")


@query(_C + "SELECT a.id, p.id AS popup FROM c a LEFT JOIN c p ON p.id = a.id + 3 AND p.page = a.page AND p.source = 'pdf'")
def j01_popups(spark: SparkSession, folder: str) -> DataFrame:
    c = comments(spark, folder)
    p = c.where("source = 'pdf'").select(F.col("id").alias("popup"), "page")
    return c.select("id", "page").join(p.withColumn("id", F.col("popup") - 3), ["id", "page"], "left").select("id", "popup")


@query(
    _C
    + ", e AS (SELECT page, uid, max(at_us) AS at_us, min(id) AS id FROM c WHERE source = 'editor' GROUP BY 1, 2), p AS (SELECT page, uid, max(at_us) AS at_us, min(id) AS id FROM c WHERE source = 'pdf' GROUP BY 1, 2) "
    "SELECT coalesce(e.page, p.page) AS page, coalesce(e.uid, p.uid) AS uid, coalesce(e.id, p.id) AS id, greatest(e.at_us, p.at_us) AS at_us, e.id IS NOT NULL AND p.id IS NOT NULL AS merged FROM e FULL JOIN p ON e.page = p.page AND e.uid = p.uid"
)
def j10_merged_sources(spark: SparkSession, folder: str) -> DataFrame:
    # both sources in one aggregation: the outer join needs no second shuffle
    own = lambda s, c: F.when(F.col("source") == s, F.col(c))
    g = comments(spark, folder).groupBy("page", "uid").agg(F.min(own("editor", "id")).alias("e"), F.min(own("pdf", "id")).alias("p"), F.max("at_us").alias("at_us"))
    return g.select("page", "uid", F.coalesce("e", "p").alias("id"), "at_us", (F.col("e").isNotNull() & F.col("p").isNotNull()).alias("merged"))


@query(_C + ", g AS (SELECT page, max(id) AS id FROM c GROUP BY 1) SELECT page, max(id) OVER (ORDER BY page) AS active FROM g")
def j23_active_bookmark(spark: SparkSession, folder: str) -> DataFrame:
    # a page's last node; over the pages up to it by prefix maxima of blocks, so no window holds all pages
    last = comments(spark, folder).groupBy("page").agg(F.max("id").alias("id")).withColumn("block", F.floor(F.col("page") / 1000))
    heads = last.groupBy("block").agg(F.max("id").alias("top"))
    # one row for each thousand pages
    before = heads.select("block", F.max("top").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    w = Window.partitionBy("block").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    own = last.select("block", "page", F.max("id").over(w).alias("own"))
    return own.join(before, "block").select("page", F.greatest("own", "before").alias("active"))


@query(
    _C
    + ", d AS (SELECT page, id, greatest(l - 0.4, 0, 0.4 - l - w) AS dx, greatest(t - 0.3, 0, 0.3 - t - h) AS dy FROM c) SELECT page, id FROM (SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY dx * dx + dy * dy, id) AS k FROM d) WHERE k = 1"
)
def j24_closest_span(spark: SparkSession, folder: str) -> DataFrame:
    dx = F.greatest(F.col("l") - 0.4, F.lit(0.0), 0.4 - F.col("l") - F.col("w"))
    dy = F.greatest(F.col("t") - 0.3, F.lit(0.0), 0.3 - F.col("t") - F.col("h"))
    best = F.min(F.struct((dx * dx + dy * dy).alias("d"), "id")).alias("m")
    return comments(spark, folder).groupBy("page").agg(best).select("page", F.col("m.id").alias("id"))


@query(_C + "SELECT page, least(1.0, greatest(0.0, min(l) - 0.032)) AS l, least(1.0, greatest(0.0, max(l + w) + 0.032)) AS r FROM c GROUP BY page")
def a06_padded_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return comments(spark, folder).groupBy("page").agg(clamp01(F.min("l") - 0.032).alias("l"), clamp01(F.max(F.col("l") + F.col("w")) + 0.032).alias("r"))


@query("SELECT pdf_path, CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS bytes FROM page_text GROUP BY 1")
def a11_history_bytes(spark: SparkSession, folder: str) -> DataFrame:
    # what the extracted states of a file take together
    return table(spark, folder, "page_text").groupBy("pdf_path").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).cast("long").alias("bytes"))


@query("WITH n AS (SELECT pdf_path, max(page_number) AS n FROM page_text GROUP BY 1) SELECT pdf_path, preset, CAST(greatest(1, floor(n * 0.33)) AS BIGINT) AS sample_page, n * kb AS kb FROM n, (VALUES ('small', 40), ('medium', 90), ('large', 250)) p(preset, kb)")
def a13_size_estimates(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "page_text").groupBy("pdf_path").agg(F.max("page_number").alias("n"))
    presets = F.array(*[F.struct(F.lit(a).alias("preset"), F.lit(b).alias("kb")) for a, b in (("small", 40), ("medium", 90), ("large", 250))])
    p = n.select("pdf_path", "n", F.explode(presets).alias("p"))
    return p.select("pdf_path", "p.preset", F.greatest(F.lit(1), F.floor(F.col("n") * 0.33)).cast("long").alias("sample_page"), (F.col("n") * F.col("p.kb")).alias("kb"))


@query("SELECT source, string_agg(DISTINCT kind, '; ' ORDER BY kind) AS kinds FROM documents WHERE source IS NOT NULL GROUP BY 1")
def a20_distinct_lists(spark: SparkSession, folder: str) -> DataFrame:
    kinds = F.array_join(F.array_sort(F.collect_set("kind")), "; ")
    return table(spark, folder, "documents").where("source IS NOT NULL").groupBy("source").agg(kinds.alias("kinds"))


@query("WITH n AS (SELECT request_id, match_index, row_number() OVER (PARTITION BY request_id ORDER BY match_index) - 1 AS i, count(*) OVER (PARTITION BY request_id) AS n FROM search_match) SELECT request_id, match_index, (i + 1) % n AS next_i, (i - 1 + n) % n AS prev_i FROM n")
def o15_match_cursor(spark: SparkSession, folder: str) -> DataFrame:
    by = Window.partitionBy("request_id")
    m = table(spark, folder, "search_match").select("request_id", "match_index", (F.row_number().over(by.orderBy("match_index")) - 1).alias("i"), F.count(F.lit(1)).over(by).alias("n"))
    return m.select("request_id", "match_index", F.pmod(F.col("i") + 1, F.col("n")).alias("next_i"), F.pmod(F.col("i") - 1, F.col("n")).alias("prev_i"))


@query("WITH a AS (SELECT DISTINCT page_number AS p FROM search_match), b AS (SELECT DISTINCT page_number AS p FROM page_text WHERE page_number % 2 = 0) SELECT p FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a))")
def u10_toggled_pages(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "search_match").select(F.col("page_number").alias("p")).distinct()
    b = table(spark, folder, "page_text").where("page_number % 2 = 0").select(F.col("page_number").alias("p")).distinct()
    # in exactly one of the two
    return a.unionAll(b).groupBy("p").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("p")


@query("SELECT s_suppkey, CASE WHEN s_suppkey BETWEEN 20 AND 45 THEN (SELECT s_nationkey FROM supplier WHERE s_suppkey = 20) ELSE s_nationkey END AS colour FROM supplier")
def u16_ranged_update(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    model = s.where("s_suppkey = 20").agg(F.first("s_nationkey").alias("m"))
    # one row
    return s.crossJoin(F.broadcast(model)).select("s_suppkey", F.when(F.col("s_suppkey").between(20, 45), F.col("m")).otherwise(F.col("s_nationkey")).alias("colour"))


@query("WITH m AS (SELECT max(epoch_us(requested_at)) AS now FROM search_request), d AS (SELECT request_id, (now - epoch_us(requested_at)) // 60000000 AS mins FROM search_request, m) SELECT DISTINCT request_id, CASE WHEN mins >= 2880 THEN (mins // 1440) || ' days ago' WHEN mins >= 1440 THEN 'yesterday' WHEN mins >= 120 THEN (mins // 60) || ' hours ago' WHEN mins >= 60 THEN 'an hour ago' WHEN mins >= 2 THEN mins || ' minutes ago' WHEN mins >= 1 THEN 'a minute ago' ELSE 'just now' END AS age FROM d")
def x05_relative_times(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "search_request").select("request_id", micros(F.col("requested_at")).alias("t"))
    now = r.agg(F.max("t").alias("now"))
    # one row
    m = r.crossJoin(F.broadcast(now)).select("request_id", F.floor((F.col("now") - F.col("t")) / 60000000).alias("m"))
    part = lambda n, unit: F.concat(F.floor(F.col("m") / n).cast("string"), F.lit(f" {unit} ago"))
    age = F.when(F.col("m") >= 2880, part(1440, "days")).when(F.col("m") >= 1440, "yesterday").when(F.col("m") >= 120, part(60, "hours")).when(F.col("m") >= 60, "an hour ago")
    return m.select("request_id", age.when(F.col("m") >= 2, part(1, "minutes")).when(F.col("m") >= 1, "a minute ago").otherwise("just now").alias("age")).distinct()


@query(_C + "SELECT id, greatest(0.0, least(l + w, 0.5) - greatest(l, 0.2)) AS shared FROM c")
def x18_overlap_amounts(spark: SparkSession, folder: str) -> DataFrame:
    return comments(spark, folder).select("id", overlap(F.col("l"), F.col("l") + F.col("w"), F.lit(0.2), F.lit(0.5)).alias("shared"))


@query("SELECT page_id, replace(text, 'µ', 'μ') AS text FROM page_text")
def x24_greek_mu(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "page_text").select("page_id", F.translate("text", "µ", "μ").alias("text"))


@query(_C + "SELECT id, CAST(regexp_extract(ann_id, '^(\\d+)R', 1) AS INT) AS object_no FROM c WHERE ann_id IS NOT NULL")
def x26_object_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return comments(spark, folder).where("ann_id IS NOT NULL").select("id", F.regexp_extract("ann_id", r"^(\d+)R", 1).try_cast("int").alias("object_no"))


@query(_C + "SELECT id, round(atan2(h, w + 0.001), 9) AS angle, round((l + w) * 1000 - 12 * cos(atan2(h, w + 0.001) - 0.5), 6) AS x1 FROM c")
def x35_arrow_heads(spark: SparkSession, folder: str) -> DataFrame:
    a = F.atan2(F.col("h"), F.col("w") + 0.001)
    return comments(spark, folder).select("id", F.round(a, 9).alias("angle"), F.round((F.col("l") + F.col("w")) * 1000 - 12 * F.cos(a - 0.5), 6).alias("x1"))


@query("SELECT doc_id, lower(trim(regexp_replace(coalesce(source, ''), '\\s+', ' ', 'g'))) AS plain FROM documents")
def x01_comparable(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", tx.comparable(F.col("source")).alias("plain"))
