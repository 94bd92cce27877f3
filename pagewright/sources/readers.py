"""Readers of captured data.  Schemas are given, columns are pruned by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.urls import file_ext


def read_pages(spark: SparkSession, path: str, with_meta: bool = False) -> DataFrame:
    """Captured documents: ``page_id, url, html`` and, with ``with_meta``,
    ``content_type, status_code, headers``.

    Splits follow the file layout and ``spark.sql.files.*``; a caller with one
    small file repartitions."""
    return spark.read.schema(schemas.PAGES_WITH_META if with_meta else schemas.PAGES).parquet(path)


def stream_pages(
    spark: SparkSession, path: str, files_per_batch: int | None = None, with_meta: bool = False
) -> DataFrame:
    """Captured documents as they arrive in a folder of parquet files."""
    reader = spark.readStream.schema(schemas.PAGES_WITH_META if with_meta else schemas.PAGES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _texts(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))
    )


def read_robots(spark: SparkSession, path: str, text_files: bool = False) -> DataFrame:
    """``host, status_code, body``: a parquet table, or ``<host>.txt`` files."""
    if not text_files:
        return spark.read.schema(schemas.ROBOTS).parquet(path)
    return _texts(spark, path, "*.txt").select(
        F.url_decode(F.regexp_extract("file", r"([^/]+)\.txt$", 1)).alias("host"),
        F.lit(200).alias("status_code"),
        "body",
    )


def read_sitemaps(spark: SparkSession, path: str, base_url: str | None = None) -> DataFrame:
    """``sitemap_url, body``: a parquet table, or XML files below ``base_url``."""
    if base_url is None:
        return spark.read.schema(schemas.SITEMAPS).parquet(path)
    return _texts(spark, path, "*.xml").select(
        F.concat(F.lit(base_url.rstrip("/") + "/"), _below(spark, path, "file")).alias("sitemap_url"), "body"
    )


def _below(spark: SparkSession, path: str, column: str) -> Column:
    """The part of a file's place below the folder ``path``."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().rstrip("/")
    # file places are percent-encoded URIs; '+' stands for itself in them
    place = F.url_decode(F.replace(F.col(column), F.lit("+"), F.lit("%2B"))) if column == "file" else F.col(column)
    bare = F.regexp_replace(place, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    return F.when(F.startswith(bare, F.lit(root + "/")), F.substring(bare, F.lit(len(root) + 2), F.length(bare)))


def _text(url: str) -> Column:
    """Bytes as text: style sheets always (broken bytes replaced), other
    assets only where they are text, else NULL."""
    raw = "cast(content as string)"
    return F.when(file_ext(url) == ".css", F.expr(f"make_valid_utf8({raw})")).otherwise(
        F.expr(f"try_validate_utf8({raw})")
    )


def read_resources(spark: SparkSession, path: str, base_url: str | None = None) -> DataFrame:
    """``url, content_type, content``: a parquet table whose content is text or
    bytes, or a folder of files that mirrors ``base_url``."""
    if base_url is None:
        df = spark.read.parquet(path)
        if isinstance(df.schema["content"].dataType, T.BinaryType):
            df = df.withColumn("content", _text("url"))
        return df.select("url", "content_type", "content")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    place = _below(spark, path, "path")
    kind = F.when(F.lower("path").endswith(".css"), F.lit("text/css")).otherwise(F.lit("application/octet-stream"))
    named = files.select(
        F.concat(F.lit(base_url.rstrip("/") + "/"), place).alias("url"), kind.alias("content_type"), "content"
    )
    return named.withColumn("content", _text("url"))
