"""Breadth-first crawl levels over a link table."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.urls import canonical_url, is_excluded, same_domain
from ..sources.workdir import delete_tree, work_dir

_LEVELS = "url string, parent string, level int"
_EDGES = "src string, dst string"


def next_level(edges: DataFrame, every: DataFrame, level: int) -> DataFrame:
    """``(url, parent, level)`` of the targets of the URLs at ``level`` in
    ``every(url, parent, level)`` that ``every`` does not hold yet.  With both
    tables bucketed by their first column, only the new targets are shuffled."""
    frontier = every.where(F.col("level") == level).select("url")
    return (
        # a page is found by its canonical form, whatever form its URL was given in
        edges.join(frontier.select("url", canonical_url("url").alias("src")), "src")
        .groupBy(F.col("dst").alias("url"))
        .agg(F.min(frontier["url"]).alias("parent"))
        .join(every.select("url"), "url", "left_anti")
        .withColumn("level", F.lit(level + 1))
    )


def crawl_levels(
    links: DataFrame,
    roots: DataFrame,
    root: str | None = None,
    exclude: Iterable[str] = (),
    verdicts: DataFrame | None = None,
    max_depth: int | None = None,
    mode: str = "suffix",
    buckets: int | None = None,
) -> DataFrame:
    """``(url, level, parent)`` of every URL reachable from ``roots(url)``.

    ``links(src_url, dst_url)`` is restricted to ``root`` and freed of excluded
    targets.  URLs that ``verdicts(url, allowed)`` denies are reached but their
    links are not followed.  ``parent`` is the smallest URL of the level before
    that links to the page.  URLs are reported as given; links and verdicts are
    matched by their canonical form.

    The edges are written once, bucketed by source, so no level shuffles them:
    a level moves only its frontier (broadcast while it is small) and the new
    targets, which are merged before they are shuffled.  Levels are written as
    they are found; that cuts the lineage and survives lost executors.
    ``buckets`` defaults to ``spark.sql.shuffle.partitions``; with 0 the edges
    are a plain table, for catalogs in which no table may be created.
    """
    spark = links.sparkSession
    folder = work_dir(spark, "crawl-levels")
    if buckets is None:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    kept = links if root is None else links.filter(same_domain(root, "dst_url", mode))
    edges = (
        kept.filter(~is_excluded("dst_url", exclude))
        .select(canonical_url("src_url").alias("src"), F.col("dst_url").alias("dst"))
        .filter(F.col("src") != F.col("dst"))
    )
    if verdicts is not None:
        denied = verdicts.filter(~F.col("allowed")).select(canonical_url("url").alias("src")).distinct()
        edges = edges.join(denied, "src", "left_anti")

    table = f"crawl_edges_{uuid.uuid4().hex}"
    known = f"crawl_levels_{uuid.uuid4().hex}"
    levels = f"{folder}/levels"
    start = roots.select("url", F.lit(None).cast("string").alias("parent")).distinct().withColumn("level", F.lit(0))
    if buckets:
        (
            # rows of one source lie together, so removing repeats moves nothing
            edges.repartition(buckets, "src").distinct()
            .write.bucketBy(buckets, "src")
            .option("path", f"{folder}/edges").saveAsTable(table)
        )
        # reached URLs: one folder per level, bucketed by url like the shuffle
        # of the new targets, so the anti join against all of them moves only
        # the new targets
        start.repartition(buckets, "url").write.partitionBy("level").bucketBy(buckets, "url").option("path", levels).saveAsTable(known)
    else:
        edges.distinct().write.parquet(f"{folder}/edges")
        start.write.partitionBy("level").parquet(levels)
    try:
        stored = spark.table(table) if buckets else spark.read.schema(_EDGES).parquet(f"{folder}/edges")
        level, fresh = 0, 1
        while fresh and (max_depth is None or level < max_depth):
            every = spark.table(known) if buckets else spark.read.schema(_LEVELS).parquet(levels)
            reached = next_level(stored, every, level)
            count = Observation()
            level += 1
            written = reached.observe(count, F.count(F.lit(1)).alias("n")).write.partitionBy("level")
            if buckets:
                written.bucketBy(buckets, "url").mode("append").saveAsTable(known)
            else:
                written.mode("append").parquet(levels)
            fresh = count.get["n"]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        spark.sql(f"DROP TABLE IF EXISTS {known}")
        delete_tree(spark, f"{folder}/edges")
    return spark.read.schema(_LEVELS).parquet(levels).select("url", "level", "parent")
