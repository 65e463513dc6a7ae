"""Search and text-source queries over page texts and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.functions import text as fx
from quirelake.operators import search as ops
from quirelake.plans.registry import query
from quirelake.runtime import table

_FIND = """
WITH s AS (SELECT doc_id, text, string_split(lower(text), 'the ') AS p FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, text, p, unnest(range(len(p) - 1)) AS i FROM s),
m AS (SELECT doc_id, text, i AS page_match_index,
      CAST(list_sum(list_transform(p[1:i+1], lambda x: length(x))) + 4 * i AS BIGINT) AS start_offset FROM e)
"""
_WORD = "the "


@query(_FIND + "SELECT doc_id, CAST(page_match_index AS INT) AS page_match_index, CAST(start_offset AS INT) AS start_offset, CAST(start_offset + 4 AS INT) AS end_offset FROM m")
def f01_search(spark: SparkSession, folder: str) -> DataFrame:
    return ops.search(table(spark, folder, "documents"), "doc_id", "text", _WORD).drop("excerpt")


@query(
    _FIND
    + """SELECT doc_id, CAST(start_offset AS INT) AS start_offset, start_offset > 40 AS cut_before, start_offset + 44 < length(text) AS cut_after,
regexp_replace(regexp_replace(text[greatest(start_offset - 40, 0) + 1 : start_offset], '[\\t\\n\\x0B\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+', ' ', 'g'), '^ ', '') AS before_text,
regexp_replace(text[start_offset + 1 : start_offset + 4], '[\\t\\n\\x0B\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+', ' ', 'g') AS match_text,
regexp_replace(regexp_replace(text[start_offset + 5 : start_offset + 44], '[\\t\\n\\x0B\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+', ' ', 'g'), ' $', '') AS after_text FROM m
"""
)
def proj_p02_excerpts(spark: SparkSession, folder: str) -> DataFrame:
    e = ops.search(table(spark, folder, "documents"), "doc_id", "text", _WORD)
    return e.select(
        "doc_id", "start_offset", F.col("excerpt.prefix").alias("cut_before"), F.col("excerpt.suffix").alias("cut_after"),
        F.col("excerpt.before").alias("before_text"), F.col("excerpt.match").alias("match_text"), F.col("excerpt.after").alias("after_text"),
    )


@query(_FIND + "SELECT doc_id, CAST(start_offset AS INT) AS start_offset, CAST(row_number() OVER (ORDER BY doc_id, start_offset) - 1 AS INT) AS match_index FROM m ORDER BY doc_id, start_offset LIMIT 500")
def o01_first_matches(spark: SparkSession, folder: str) -> DataFrame:
    found = ops.search(table(spark, folder, "documents"), "doc_id", "text", _WORD)
    return ops.ordered(found, "doc_id").select("doc_id", "start_offset", "match_index")


@query(_FIND + "SELECT count(*) AS n_matches, count(*) >= 500 AS truncated FROM m")
def o01_truncated(spark: SparkSession, folder: str) -> DataFrame:
    found = ops.search(table(spark, folder, "documents"), "doc_id", "text", _WORD)
    return found.agg(F.count(F.lit(1)).alias("n_matches"), (F.count(F.lit(1)) >= ops.LIMIT).alias("truncated"))


@query(_FIND + "SELECT doc_id, count(*) AS n_matches, string_agg(CAST(start_offset AS VARCHAR), ',' ORDER BY start_offset) AS starts FROM m GROUP BY doc_id")
def a01_matches_by_page(spark: SparkSession, folder: str) -> DataFrame:
    # a page's matches are one array from the start: grouping needs no shuffle
    docs = table(spark, folder, "documents").select("doc_id", fx.match_starts(F.col("text"), _WORD).alias("s"))
    return docs.where(F.size("s") > 0).select("doc_id", F.size("s").cast("long").alias("n_matches"), F.array_join("s", ",").alias("starts"))


@query(
    """
WITH q AS (SELECT DISTINCT request_id, pdf_path, query FROM search_request WHERE trim(query) <> '' AND length(trim(query)) >= 2)
SELECT q.request_id, p.page_id, CAST((length(lower(p.text)) - length(replace(lower(p.text), lower(q.query), ''))) / length(lower(q.query)) AS BIGINT) AS n_matches
FROM q JOIN page_text p USING (pdf_path) WHERE contains(lower(p.text), lower(q.query))
"""
)
def f02_requests_on_pages(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "search_request").where(F.length(F.trim("query")) >= 2).select("request_id", "pdf_path", "query").distinct()
    pages = table(spark, folder, "page_text").select("page_id", "pdf_path", "text")
    hits = asked.join(pages, "pdf_path").where(F.contains(F.lower("text"), F.lower("query")))
    return hits.select("request_id", "page_id", ops.occurrences(F.col("text"), F.col("query")).alias("n_matches"))


@query(
    """
SELECT m.request_id, CAST(count(*) AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE m.page_number BETWEEN 1 AND r.page_count) AS BIGINT) AS in_range
FROM search_match m JOIN (SELECT DISTINCT request_id, page_count FROM search_request) r USING (request_id) GROUP BY 1
"""
)
def f03_page_bounds(spark: SparkSession, folder: str) -> DataFrame:
    sizes = table(spark, folder, "search_request").select("request_id", "page_count").distinct()
    m = table(spark, folder, "search_match").join(sizes, "request_id")
    return m.groupBy("request_id").agg(F.count(F.lit(1)).alias("kept"), F.count_if(F.col("page_number").between(1, F.col("page_count"))).alias("in_range"))


@query(
    """
SELECT request_id, page_number, CAST(row_number() OVER (PARTITION BY request_id ORDER BY page_number, start_offset, match_index) - 1 AS INT) AS ordinal,
CAST(row_number() OVER (PARTITION BY request_id, page_number ORDER BY start_offset, match_index) - 1 AS INT) AS page_ordinal, match_index
FROM search_match
"""
)
def w01_match_ordinals(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "search_match")
    whole = Window.partitionBy("request_id").orderBy("page_number", "start_offset", "match_index")
    page = Window.partitionBy("request_id", "page_number").orderBy("start_offset", "match_index")
    return m.select("request_id", "page_number", (F.row_number().over(whole) - 1).alias("ordinal"), (F.row_number().over(page) - 1).alias("page_ordinal"), "match_index")


@query("SELECT request_id, match_index, page_number - 1 AS page_index, start_offset, end_offset, excerpt.match AS match_text, excerpt.prefix AS cut_before FROM search_match")
def proj_p01_zero_based(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "search_match")
    return m.select("request_id", "match_index", (F.col("page_number") - 1).alias("page_index"), "start_offset", "end_offset", F.col("excerpt.match").alias("match_text"), F.col("excerpt.prefix").alias("cut_before"))


@query(
    """
SELECT m.request_id, m.match_index, p.page_id, substring(p.text, m.start_offset + 1, m.end_offset - m.start_offset) = m.excerpt.match AS agrees
FROM search_match m JOIN (SELECT DISTINCT request_id, pdf_path FROM search_request) r USING (request_id)
JOIN page_text p ON p.pdf_path = r.pdf_path AND p.page_number = m.page_number WHERE p.text IS NOT NULL
"""
)
def j04_matches_on_texts(spark: SparkSession, folder: str) -> DataFrame:
    paths = table(spark, folder, "search_request").select("request_id", "pdf_path").distinct()
    pages = table(spark, folder, "page_text").where(F.col("text").isNotNull()).select("page_id", "pdf_path", "page_number", "text")
    m = table(spark, folder, "search_match").join(paths, "request_id").join(pages, ["pdf_path", "page_number"])
    piece = F.substring(F.col("text"), F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset"))
    return m.select("request_id", "match_index", "page_id", (piece == F.col("excerpt.match")).alias("agrees"))


@query(
    """
SELECT pdf_path, string_agg(trim(text, ' ' || chr(10)), chr(10) || chr(10) ORDER BY page_number, page_id) AS whole FROM page_text
WHERE trim(text, ' ' || chr(10)) <> '' GROUP BY pdf_path
"""
)
def s05_export_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "page_text").select("pdf_path", "page_number", "page_id", F.trim("text", F.lit(" \n")).alias("t")).where("t <> ''")
    listed = F.array_sort(F.collect_list(F.struct("page_number", "page_id", "t")))
    return pages.groupBy("pdf_path").agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n\n").alias("whole"))


@query("SELECT doc_id, lower(trim(regexp_replace(coalesce(text, ''), '[ \\n\\r\\t]+', ' ', 'g'))) AS flat FROM documents")
def s06_flat_text(spark: SparkSession, folder: str) -> DataFrame:
    flat = F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \n\r\t]+", " ")))
    return table(spark, folder, "documents").select("doc_id", flat.alias("flat"))


@query(
    """
SELECT pdf_path, page_number, page_id, coalesce(text, '') AS text FROM (SELECT *, row_number() OVER (PARTITION BY pdf_path, page_number
ORDER BY CASE WHEN coalesce(text, '') <> '' THEN 0 ELSE 1 END, created_at DESC, page_id DESC) AS k FROM page_text) WHERE k = 1
"""
)
def u11_coalesced_sources(spark: SparkSession, folder: str) -> DataFrame:
    best = ops.newest_text(table(spark, folder, "page_text"), ["pdf_path", "page_number"], "text", ["created_at", "page_id"])
    return best.select("pdf_path", "page_number", "page_id", F.coalesce("text", F.lit("")).alias("text"))


@query(
    """
SELECT DISTINCT pdf_path, CASE lower(regexp_extract(pdf_path, '\\.([^./]*)$', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'djvu' THEN 'djvu' WHEN 'djv' THEN 'djvu'
WHEN 'png' THEN 'image' WHEN 'jpg' THEN 'image' WHEN 'jpeg' THEN 'image' WHEN 'tif' THEN 'image' WHEN 'tiff' THEN 'image' ELSE 'other' END AS kind FROM page_text
"""
)
def s17_file_kinds(spark: SparkSession, folder: str) -> DataFrame:
    ext = F.lower(F.regexp_extract("pdf_path", r"\.([^./]*)$", 1))
    kind = F.when(ext == "pdf", "pdf").when(ext.isin("djvu", "djv"), "djvu").when(ext.isin("png", "jpg", "jpeg", "tif", "tiff"), "image").otherwise("other")
    return table(spark, folder, "page_text").select("pdf_path").distinct().select("pdf_path", kind.alias("kind"))


@query(
    """
SELECT pdf_path, bool_or(coalesce(text, '') <> '') AS has_text, CAST(count(DISTINCT page_number) AS BIGINT) AS n_pages, CAST(max(page_number) AS INT) AS last_page,
coalesce(string_agg(DISTINCT nullif(lang, ''), ',' ORDER BY nullif(lang, '')), '') AS langs FROM page_text GROUP BY pdf_path
"""
)
def a05_file_summary(spark: SparkSession, folder: str) -> DataFrame:
    langs = F.array_join(F.array_sort(F.collect_set(F.nullif("lang", F.lit("")))), ",")
    return table(spark, folder, "page_text").groupBy("pdf_path").agg(
        F.bool_or(F.coalesce("text", F.lit("")) != "").alias("has_text"), F.count_distinct("page_number").alias("n_pages"), F.max("page_number").alias("last_page"), langs.alias("langs")
    )


@query("SELECT p.page_id, coalesce(l.name, 'none') AS name, coalesce(l.script, 'none') AS script FROM page_text p LEFT JOIN ocr_language l ON p.lang = l.code")
def j02_page_languages(spark: SparkSession, folder: str) -> DataFrame:
    # a fixed dimension of ten rows
    langs = F.broadcast(table(spark, folder, "ocr_language"))
    pages = table(spark, folder, "page_text").select("page_id", F.col("lang").alias("code"))
    return pages.join(langs, "code", "left").select("page_id", F.coalesce("name", F.lit("none")).alias("name"), F.coalesce("script", F.lit("none")).alias("script"))


@query("SELECT page_id, lang FROM page_text p WHERE lang IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ocr_language l WHERE l.code = p.lang)")
def j21_missing_models(spark: SparkSession, folder: str) -> DataFrame:
    langs = table(spark, folder, "ocr_language").select(F.col("code").alias("lang"))
    return table(spark, folder, "page_text").where(F.col("lang").isNotNull()).join(langs, "lang", "left_anti").select("page_id", "lang")


# notes: documents read as comments of their source, 25 a page
_NOTES = "WITH n AS (SELECT doc_id, doc_id // 25 + 1 AS page, coalesce(text, '') AS text, coalesce(source, '') AS author, kind, epoch_us(added_at) AS at_us FROM documents) "


def _notes(spark: SparkSession, folder: str) -> DataFrame:
    from quirelake.runtime import micros

    return table(spark, folder, "documents").select(
        "doc_id", (F.floor(F.col("doc_id") / 25) + 1).alias("page"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("author"), "kind", micros(F.col("added_at")).alias("at_us")
    )


@query(_NOTES + "SELECT doc_id FROM n WHERE contains(lower(text), 'record') OR contains(lower(kind), 'record') OR contains(lower(author), 'record') OR 'p' || page = 'record'")
def f04_comment_query(spark: SparkSession, folder: str) -> DataFrame:
    n, q = _notes(spark, folder), "record"
    hit = F.contains(F.lower("text"), F.lit(q)) | F.contains(F.lower("kind"), F.lit(q)) | F.contains(F.lower("author"), F.lit(q)) | (F.concat(F.lit("p"), F.col("page").cast("string")) == q)
    return n.where(hit).select("doc_id")


@query(_NOTES + "SELECT page, doc_id, CAST(row_number() OVER (PARTITION BY page ORDER BY at_us DESC NULLS LAST, doc_id) AS INT) AS place FROM n")
def o02_comment_order(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("page").orderBy(F.col("at_us").desc_nulls_last(), "doc_id")
    return _notes(spark, folder).select("page", "doc_id", F.row_number().over(w).alias("place"))


@query(_NOTES + "SELECT author, max(at_us) AS at_us, arg_max(doc_id, CAST(at_us AS HUGEINT) * 100000000 - doc_id) AS doc_id FROM n WHERE at_us IS NOT NULL GROUP BY author")
def o04_best_comment(spark: SparkSession, folder: str) -> DataFrame:
    best = F.max(F.struct("at_us", (-F.col("doc_id")).alias("k"))).alias("b")
    return _notes(spark, folder).where("at_us IS NOT NULL").groupBy("author").agg(best).select("author", F.col("b.at_us").alias("at_us"), (-F.col("b.k")).alias("doc_id"))


@query(_NOTES + "SELECT page, count(*) AS n FROM n WHERE kind = 'note' GROUP BY page")
def a24_notes_by_page(spark: SparkSession, folder: str) -> DataFrame:
    return _notes(spark, folder).where("kind = 'note'").groupBy("page").agg(F.count(F.lit(1)).alias("n"))


@query(_NOTES + "SELECT doc_id, CASE WHEN length(text) > 120 THEN text[1:117] || '...' ELSE text END AS preview FROM n")
def x16_preview(spark: SparkSession, folder: str) -> DataFrame:
    return _notes(spark, folder).select("doc_id", fx.shorten(F.col("text"), 120).alias("preview"))


@query(
    _NOTES
    + ", k AS (SELECT author || ':' || page || ':' || text AS key, * FROM n) SELECT md5(key) AS key_hash, min(doc_id) AS doc_id, max(at_us) AS at_us, count(*) AS n FROM k GROUP BY key"
)
def u18_folded_comments(spark: SparkSession, folder: str) -> DataFrame:
    n = _notes(spark, folder).withColumn("key", F.concat_ws(":", "author", F.col("page").cast("string"), "text"))
    return n.groupBy(F.md5("key").alias("key_hash")).agg(F.min("doc_id").alias("doc_id"), F.max("at_us").alias("at_us"), F.count(F.lit(1)).alias("n"))


@query(
    _NOTES
    + """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ann:' || page || ':' || doc_id WHEN doc_id % 3 = 1 AND author <> '' THEN 'uid:' || page || ':' || author
ELSE 'src:' || kind || ':' || page || ':' || doc_id END AS stable_key FROM n"""
)
def proj_p03_stable_keys(spark: SparkSession, folder: str) -> DataFrame:
    page, id_ = F.col("page").cast("string"), F.col("doc_id").cast("string")
    key = (
        F.when(F.col("doc_id") % 3 == 0, F.concat_ws(":", F.lit("ann"), page, id_))
        .when((F.col("doc_id") % 3 == 1) & (F.col("author") != ""), F.concat_ws(":", F.lit("uid"), page, "author"))
        .otherwise(F.concat_ws(":", F.lit("src"), "kind", page, id_))
    )
    return _notes(spark, folder).select("doc_id", key.alias("stable_key"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS xml FROM documents")
def x23_escaped_xml(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", fx.escape_xml(F.col("text")).alias("xml"))


@query("SELECT doc_id, CASE WHEN n_chars IS NULL OR n_chars <= 0 THEN 'Unknown size' WHEN n_chars < 10 THEN printf('%.1f', CAST(n_chars AS DOUBLE)) || ' B' WHEN n_chars < 1024 THEN printf('%.0f', CAST(n_chars AS DOUBLE)) || ' B' WHEN CAST(n_chars AS DOUBLE) / 1024 >= 10 THEN printf('%.0f', floor(CAST(n_chars AS DOUBLE) / 1024 + 0.5)) || ' KB' ELSE printf('%.1f', floor(CAST(n_chars AS DOUBLE) / 1024 * 10 + 0.5) / 10) || ' KB' END AS size FROM documents WHERE n_chars IS NULL OR n_chars < 1048576")
def x04_document_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", fx.file_size_label(F.col("n_chars")).alias("size"))


@query("SELECT doc_id, 'D:' || strftime(added_at, '%Y%m%d%H%M%S') || '+00''00''' AS pdf_date, CAST(epoch_us(date_trunc('second', added_at)) // 1000000 AS BIGINT) AS at_s FROM documents WHERE added_at IS NOT NULL")
def x06_pdf_dates(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where("added_at IS NOT NULL").select("doc_id", fx.pdf_date(F.col("added_at")).alias("pdf_date"))
    return d.select("doc_id", "pdf_date", fx.parse_pdf_date(F.col("pdf_date")).alias("at_s"))


@query("SELECT DISTINCT CASE WHEN path = '' OR path = '/' THEN '/' ELSE regexp_replace(path, '/+$', '') END AS path FROM landing_page_view WHERE path IS NOT NULL")
def x21_canonical_paths(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "landing_page_view").where("path IS NOT NULL").select(fx.canonical_path(F.col("path")).alias("path")).distinct()


def _page_pairs(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("pdf_path").orderBy("page_number", "page_id")
    p = table(spark, folder, "page_text").where("text IS NOT NULL").select("page_id", F.col("text").alias("a"), F.lead("text").over(w).alias("b"))
    return p.where("b IS NOT NULL")


_AGREE = (
    "WITH p AS (SELECT page_id, text AS a, lead(text) OVER (PARTITION BY pdf_path ORDER BY page_number, page_id) AS b FROM page_text WHERE text IS NOT NULL), "
    "c AS (SELECT page_id, list_transform(range(1, length(a) + 1), lambda i: a[i:i]) AS a, list_transform(range(1, length(b) + 1), lambda i: b[i:i]) AS b FROM p WHERE b IS NOT NULL), "
    "m AS (SELECT *, least(len(a), len(b)) AS n FROM c) "
)


@query(_AGREE + "SELECT page_id, CAST(coalesce(nullif(list_position(list_transform(range(1, n + 1), lambda i: a[i] <> b[i]), true), 0), n + 1) - 1 AS BIGINT) AS agree FROM m")
def x27_common_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    return _page_pairs(spark, folder).select("page_id", fx.common_prefix(F.col("a"), F.col("b")).cast("long").alias("agree"))


@query(_AGREE + "SELECT page_id, CAST(coalesce(nullif(list_position(list_transform(range(0, n), lambda i: a[len(a) - i] <> b[len(b) - i]), true), 0), n + 1) - 1 AS BIGINT) AS agree FROM m")
def x27_common_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return _page_pairs(spark, folder).select("page_id", fx.common_suffix(F.col("a"), F.col("b")).cast("long").alias("agree"))
