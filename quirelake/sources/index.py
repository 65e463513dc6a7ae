"""Page indexes on disk: a manifest and a file for each page, written whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 2
_PAGE = "text string"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def write_index_dir(pages: DataFrame, path: str) -> None:
    """Write ``(document, page_number, text)`` as one folder a page and a manifest of them.

    Everything goes to a folder beside ``path`` first, which takes its place when all is
    written: a reader sees the old index or the new one. Pages below 1 and null documents are
    left out; of a page given twice the one with the smaller text stays.
    """
    spark = pages.sparkSession
    fs, at = _files(spark, path)
    temporary = f"{path}.{uuid.uuid4().hex}"
    once = pages.where("page_number > 0 AND document IS NOT NULL").groupBy("document", "page_number").agg(F.min("text").alias("text"))
    body = F.concat(F.lit("document="), F.xxhash64("document").cast("string"), F.lit("/page="), F.col("page_number").cast("string"))
    full = once.withColumn("file", body)
    full.select(F.xxhash64("document").cast("string").alias("document"), F.col("page_number").alias("page"), "text").write.partitionBy("document", "page").json(f"{temporary}/pages")
    full.select(F.lit(VERSION).alias("version"), "document", "page_number", "file").write.json(f"{temporary}/manifest")
    fs.delete(at(path), True)
    if not fs.rename(at(temporary), at(path)):
        raise OSError(f"cannot put the index in place: {path}")


def read_index_dir(spark: SparkSession, path: str) -> DataFrame | None:
    """``(document, page_number, text)`` of an index; None where it cannot be read or is of an older version.

    Pages the manifest names but that have no file have no row, as have files it does not name.
    """
    try:
        manifest = spark.read.schema("version int, document string, page_number int, file string").json(f"{path}/manifest")
        if manifest.where(F.coalesce(F.col("version"), F.lit(0)) < VERSION).limit(1).count():
            return None
        pages = spark.read.schema(f"{_PAGE}, document string, page int").option("mode", "DROPMALFORMED").json(f"{path}/pages")
    except AnalysisException:
        return None
    named = manifest.select(F.xxhash64("document").cast("string").alias("d"), "document", "page_number")
    texts = pages.select(F.col("document").alias("d"), F.col("page").alias("page_number"), F.coalesce("text", F.lit("")).alias("text"))
    return named.join(texts, ["d", "page_number"]).drop("d").select("document", "page_number", "text")
