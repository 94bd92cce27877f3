"""The crawl loop as streams over arriving pages."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.urls import canonical_url
from ..operators.links import is_html, link_set
from ..operators.rewrite import rewrite_pages
from ..sources.state import append_changes


def stream_links(
    pages: DataFrame, root: str | None = None, exclude: Iterable[str] = (), mode: str = "suffix"
) -> DataFrame:
    """Internal, not excluded targets of arriving pages; keeps no state."""
    return link_set(pages, root, exclude, mode)


def stream_frontier(
    pages: DataFrame,
    root: str | None = None,
    exclude: Iterable[str] = (),
    mode: str = "suffix",
    event_time: str | None = None,
    window: str | None = None,
) -> DataFrame:
    """Each new URL once.

    "Once, ever" needs every URL in the state store (RocksDB keeps it off the
    heap).  With ``event_time`` and ``window`` a URL is new again after the
    watermark has passed it, which bounds the state.
    """
    if (event_time is None) != (window is None):
        raise ValueError("event_time and window go together")
    if event_time is None:
        return link_set(pages, root, exclude, mode).select(F.col("dst_url").alias("url")).dropDuplicates(["url"])
    # link_set keeps the page key, so carry the time as part of it
    timed = pages.withColumn("page_id", F.struct("page_id", F.col(event_time).alias("ts")))
    links = link_set(timed, root, exclude, mode)
    return (
        links.select(F.col("dst_url").alias("url"), F.col("page_id.ts").alias(event_time))
        .withWatermark(event_time, window)
        .dropDuplicatesWithinWatermark(["url"])
    )


def page_changes(
    pages: DataFrame, root: str | None, exclude: Iterable[str], at: dt.datetime | None, mode: str = "suffix"
) -> DataFrame:
    """State changes a set of captured pages amounts to: the pages themselves
    as visited, what they link to as pending.

    A page is marked under the URL it was captured by and, where that differs,
    under its canonical form.  With ``content_type`` and ``status_code`` at hand
    a capture that is no HTML becomes ``non_html`` and one that failed
    ``failed``; neither adds links."""
    stamp = F.lit(at) if at is not None else F.current_timestamp()
    empty = F.coalesce(F.length("html"), F.lit(0)) == 0
    failed = F.col("status_code") >= 400 if "status_code" in pages.columns else F.lit(False)
    other = ~is_html() if "content_type" in pages.columns else F.lit(False)
    failed, other = F.coalesce(failed, F.lit(False)), F.coalesce(other, F.lit(False))
    names = F.array_compact(F.array_distinct(F.array("url", canonical_url("url"))))
    visited = pages.select(
        F.explode(names).alias("url"),
        F.lit("visited").alias("status"),
        stamp.cast("timestamp").alias("last_fetched"),
        F.lit(None).cast("int").alias("level"),
        F.when(failed, F.lit("failed")).when(empty, F.lit("empty")).when(other, F.lit("non_html"))
        .otherwise(F.lit("saved")).alias("outcome"),
    )
    pending = link_set(pages.where(~failed & ~other), root, exclude, mode).select(
        F.col("dst_url").alias("url"),
        F.lit("pending").alias("status"),
        F.lit(None).cast("timestamp").alias("last_fetched"),
        F.lit(None).cast("int").alias("level"),
        F.lit(None).cast("string").alias("outcome"),
    )
    return visited.unionByName(pending)


def stream_state(
    pages: DataFrame,
    state_path: str,
    checkpoint: str,
    root: str | None = None,
    exclude: Iterable[str] = (),
    at: dt.datetime | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Fold arriving pages into the change log at ``state_path``.

    A micro-batch writes only its own changes, into the folder of its batch
    id: the state is never rewritten, and a replayed batch adds nothing.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        append_changes(page_changes(batch, root, exclude, at), state_path, batch_id)

    return (
        pages.writeStream.foreachBatch(fold)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_rewrite(
    pages: DataFrame,
    resource_map: DataFrame,
    root: str,
    out_path: str,
    checkpoint: str,
    root_dir: str = "",
    mode: str = "suffix",
    trigger: dict | None = None,
    **switches: bool,
) -> StreamingQuery:
    """Rewrite arriving pages against a fixed table of captured assets, one
    folder per batch under ``out_path``.  ``switches`` go to ``rewrite_pages``;
    ``trigger`` is the stream's trigger, by default all that is there."""

    def rewrite(batch: DataFrame, batch_id: int) -> None:
        done = rewrite_pages(batch, resource_map, root, root_dir, mode, **switches)
        done.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return (
        pages.writeStream.foreachBatch(rewrite)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
