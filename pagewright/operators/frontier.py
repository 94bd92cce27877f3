"""The URL state table: enqueue, mark, pick, count, report."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import netloc_of
from ..schemas import URL_STATE
from ..sources.workdir import written

OUTCOMES = ("saved", "denied", "failed", "empty", "non_html")


def _state_columns(df: DataFrame) -> DataFrame:
    """``df`` in the layout of the state table, absent columns NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in URL_STATE.fields
        ]
    )


def enqueue(url_state: DataFrame, candidates: DataFrame) -> DataFrame:
    """State plus the candidates it does not hold yet, as pending.

    Candidates are reduced to distinct URLs before they meet the state, so a
    URL linked from everywhere is one row in the join.
    """
    level = F.min("level") if "level" in candidates.columns else F.lit(None).cast("int")
    fresh = (
        candidates.groupBy("url")
        .agg(level.alias("level"))
        .join(url_state.select("url"), "url", "left_anti")
        .withColumn("status", F.lit("pending"))
    )
    return _state_columns(url_state).unionByName(_state_columns(fresh))


def mark_visited(url_state: DataFrame, done: DataFrame, at: dt.datetime | Column) -> DataFrame:
    """State with the URLs of ``done(url[, outcome])`` set to visited at ``at``.
    URLs the state does not hold are not added."""
    stamp = at if isinstance(at, Column) else F.lit(at)
    outcome = F.max("outcome") if "outcome" in done.columns else F.lit(None).cast("string")
    marks = done.groupBy("url").agg(outcome.alias("__outcome"), F.lit(True).alias("__done"))
    joined = url_state.join(marks, "url", "left")
    hit = F.col("__done").isNotNull()
    return _state_columns(
        joined.withColumn("status", F.when(hit, F.lit("visited")).otherwise(F.col("status")))
        .withColumn("last_fetched", F.when(hit, stamp).otherwise(F.col("last_fetched")))
        .withColumn("outcome", F.when(hit, F.coalesce("__outcome", "outcome")).otherwise(F.col("outcome")))
    )


#: Batches up to this size are taken by one ordered take; larger ones by a distributed cut.
TAKE = 10_000


def next_batch(url_state: DataFrame, n: int, take: int = TAKE) -> DataFrame:
    """The ``n`` pending URLs that come first by level (nulls first), then URL;
    among equal (level, URL) rows any may come first.  A batch of more than
    ``take`` rows is cut without any task holding it: counts per level find
    the level at the border, range partitions of its URLs with their counts
    find the partition at the border, and only that one is cut by position."""
    pending = url_state.filter(F.col("status") == "pending")
    if n <= take:
        return pending.orderBy("level", "url").limit(n)
    counts = sorted(
        ((r.level, r["count"]) for r in pending.groupBy("level").count().collect()),  # one row per level
        key=lambda r: (r[0] is not None, r[0] or 0),
    )
    before, border = 0, None
    for level, count in counts:
        if before + count >= n:
            border = (level, count)
            break
        before += count
    if border is None:
        return pending
    level = F.col("level")
    at = level.isNull() if border[0] is None else level == border[0]
    earlier = F.lit(False) if border[0] is None else (level.isNull() | (level < border[0]))
    return pending.where(earlier).unionByName(_first_urls(pending.where(at), n - before))


def _first_urls(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of ``rows`` that come first by URL."""
    spark = rows.sparkSession
    parts = max(1, spark.sparkContext.defaultParallelism)
    ordered = rows.repartitionByRange(parts, "url").sortWithinPartitions("url")
    schema = T.StructType(ordered.schema.fields + [T.StructField("__part", T.IntegerType()), T.StructField("__at", T.LongType())])

    def number(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(size, part, dtype=np.int32)), pa.array(np.arange(seen, seen + size, dtype=np.int64))],
                names=schema.fieldNames(),
            )
            seen += size

    placed = written(ordered.mapInArrow(number, schema), "next-batch")
    sizes = sorted((r["__part"], r["count"]) for r in placed.groupBy("__part").count().collect())  # one row per partition
    taken, cut = 0, None
    for part, count in sizes:
        if taken + count >= k:
            cut = (part, k - taken)
            break
        taken += count
    keep = (F.col("__part") < cut[0]) | ((F.col("__part") == cut[0]) & (F.col("__at") < cut[1]))
    return placed.where(keep).drop("__part", "__at")


def frontier_counts(url_state: DataFrame) -> DataFrame:
    """``(status, n)``."""
    return url_state.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def crawl_report(url_state: DataFrame) -> DataFrame:
    """Visited URLs per host and outcome, one column per outcome."""
    visited = url_state.filter(F.col("status") == "visited").select(netloc_of("url").alias("host"), "outcome")
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    return visited.groupBy("host").agg(F.count(F.lit(1)).alias("visited"), *counts)


def merge_state(changes: DataFrame) -> DataFrame:
    """One state row per URL from any number of change rows.

    Visited wins over pending, the lowest level wins, time and outcome come
    from the latest visit: the result does not depend on order or repeats.
    """
    latest = F.max(F.struct("last_fetched", "outcome"))
    merged = changes.groupBy("url").agg(
        F.max("status").alias("status"), F.min("level").alias("level"), latest.alias("__m")
    )
    return _state_columns(
        merged.withColumn("last_fetched", F.col("__m.last_fetched")).withColumn("outcome", F.col("__m.outcome"))
    )
