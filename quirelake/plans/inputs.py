"""Queries over parsed source formats; their lines are written from the tables first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.plans.registry import query
from quirelake.sources import formats, sinks
from quirelake.runtime import table


def _tsv(spark: SparkSession, folder: str) -> DataFrame:
    c = lambda e: F.expr(e).cast("string")
    parts = ["4 + l_linenumber % 2", "1", "l_suppkey % 5", "1", "l_orderkey % 7", "l_linenumber", "CAST(l_quantity AS INT)", "l_partkey % 900", "l_linenumber * 3 - 3", "12", "l_orderkey % 100", "concat(l_linestatus, l_returnflag)"]
    return table(spark, folder, "lineitem").select("l_orderkey", F.concat_ws("\t", *[c(p) for p in parts]).alias("line"))


_TSV = "WITH w AS (SELECT l_orderkey, l_suppkey % 5 AS block, l_orderkey % 7 AS line_no, l_linenumber AS word_no, CAST(l_quantity AS INT) AS x, l_orderkey % 100 AS conf, concat(l_linestatus, l_returnflag) AS text FROM lineitem WHERE l_linenumber % 2 = 1 AND l_orderkey % 100 >= 20 AND l_linenumber * 3 - 3 > 0) "


@query(_TSV + "SELECT l_orderkey, CAST(block AS INT) AS block, CAST(word_no AS INT) AS word_no, x, CAST(conf AS INT) AS conf, text FROM w")
def s07_tsv_words(spark: SparkSession, folder: str) -> DataFrame:
    w = formats.tsv_words(_tsv(spark, folder), "line")
    return w.select("l_orderkey", "block", "word_no", F.col("left").alias("x"), F.col("conf").cast("int").alias("conf"), "text")


@query(_TSV + "SELECT l_orderkey, CAST(block AS INT) AS block, CAST(line_no AS INT) AS line_no, string_agg(text, ' ' ORDER BY word_no, text) AS line FROM w GROUP BY 1, 2, 3")
def a03_recognised_lines(spark: SparkSession, folder: str) -> DataFrame:
    return formats.words_to_lines(formats.tsv_words(_tsv(spark, folder), "line"), ["l_orderkey"]).drop("par")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN 'k' || o_orderkey % 3 END AS key, CASE WHEN o_orderkey % 5 > 0 THEN 'say \"' || o_orderpriority || '\"' END AS value FROM orders")
def s10_metadata_lines(spark: SparkSession, folder: str) -> DataFrame:
    key = F.concat(F.lit("k"), (F.col("o_orderkey") % 3).cast("string"))
    line = F.when(F.col("o_orderkey") % 5 > 0, F.concat(key, F.lit(' "say \\"'), "o_orderpriority", F.lit('\\""'))).otherwise(F.lit("no metadata"))
    o = table(spark, folder, "orders").select("o_orderkey", formats.metadata(line).alias("m"))
    return o.select("o_orderkey", "m.key", "m.value")


@query("SELECT l_suppkey, CAST(greatest(72, least(1200, max(greatest(l_partkey % 1500, CAST(l_quantity AS INT) * 10)))) AS INT) AS dpi FROM lineitem GROUP BY 1")
def a04_source_dpi(spark: SparkSession, folder: str) -> DataFrame:
    x, y = (F.col("l_partkey") % 1500).cast("string"), (F.col("l_quantity").cast("int") * 10).cast("string")
    line = F.concat_ws(" ", F.lit("1 0 image 10 10 rgb 3 8 jpeg no 5 0"), x, y, F.lit("12K 3%"))
    return formats.source_dpi(table(spark, folder, "lineitem").select("l_suppkey", line.alias("line")), ["l_suppkey"], "line")


@query("SELECT r.r_regionkey, CAST(n.n_nationkey AS INT) AS page_index, n.n_name AS title FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey")
def s09_outlines(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "nation")
    entry = F.concat(F.lit('("'), "n_name", F.lit('" "#'), (F.col("n_nationkey") + 1).cast("string"), F.lit('")'))
    text = F.concat(F.lit("(bookmarks "), F.array_join(F.collect_list(entry), " "), F.lit(")"))
    flat = formats.outlines(n.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(text.alias("t")), "r_regionkey", "t")
    return flat.select("r_regionkey", "page_index", "title")


@query("SELECT doc_id, CASE WHEN strlen(text) >= 4 THEN CAST(4 AS INT) END AS width, CASE WHEN strlen(text) >= 4 THEN CAST(strlen(text) // 4 AS INT) END AS height FROM documents")
def s12_grey_maps(spark: SparkSession, folder: str) -> DataFrame:
    # texts of fewer than four bytes are no image
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    head = F.concat(F.lit("P5\n# made of text\n4 "), F.floor(F.octet_length(data) / 4).cast("string"), F.lit("\n255\n"))
    d = table(spark, folder, "documents").select("doc_id", F.concat(F.encode(head, "UTF-8"), data).alias("content"))
    return formats.netpbm(d, "doc_id").select("doc_id", "width", "height")


@query("SELECT doc_id, true AS sound, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS paragraphs, doc_id % 3 = 0 AS rtl, md5(regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) AS digest FROM documents")
def k04_docx(spark: SparkSession, folder: str) -> DataFrame:
    # written and read again: checksums, paragraphs, direction and text
    d = table(spark, folder, "documents").select("doc_id", "text", (F.col("doc_id") % 3 == 0).alias("from_right"))
    read = sinks.read_docx(sinks.to_docx(d, "doc_id", "text", "from_right"), "doc_id")
    return read.select("doc_id", "sound", "paragraphs", "rtl", F.md5("text").alias("digest"))
