"""Persistent crawl state.

Two layouts, both append-only:

* ``write_state`` / ``read_state``: complete versions ``v=N``.  A version counts
  once its ``_COMMITTED`` marker exists, which is created last, so a reader
  never sees a half-written version and nothing read is ever overwritten;
  writers claim versions by an exclusive create, so several may write at once.
* ``append_changes`` / ``read_changes``: a log of change rows, one folder per
  batch, merged on read.  A replayed batch replaces its own folder, so it adds
  nothing; ``compact_changes`` folds old batches into one base.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frontier import merge_state
from ..schemas import RESOURCE_MAP, SEEN_SITEMAPS, URL_STATE
from .workdir import child_numbers, file_system

_MARKER = "_COMMITTED"
_CLAIM = "_CLAIM"
#: A committed version names the folder of its tables in a file ``_DATA=<folder>``.
_DATA = "_DATA="


class CrawlState(NamedTuple):
    url_state: DataFrame
    resource_map: DataFrame
    seen_sitemaps: DataFrame


_SCHEMAS = CrawlState(URL_STATE, RESOURCE_MAP, SEEN_SITEMAPS)


def state_versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions, oldest first."""
    return child_numbers(spark, path, "v=", _MARKER)


def write_state(path: str, state: CrawlState) -> int:
    """Write a new version and return its number.

    Any number of writers may write at once: each writes its tables under a
    folder of its own name, then claims the next free version by creating
    ``v=N/_CLAIM`` without overwriting (the file system lets one creator win;
    a loser tries N + 1), names its folder there and commits.  Nothing that
    another writer wrote is overwritten."""
    spark = state.url_state.sparkSession
    own = f"data-{uuid.uuid4().hex}"
    for name, table in state._asdict().items():
        table.write.parquet(f"{path}/{own}/{name}")
    version = max([0, *state_versions(spark, path), *child_numbers(spark, path, "v=", _CLAIM)]) + 1
    while True:
        fs, claim = file_system(spark, f"{path}/v={version}/{_CLAIM}")
        try:
            fs.create(claim, False).close()
            break
        except Exception as error:  # another writer holds this version
            if not fs.exists(claim):
                raise error
            version += 1
    fs.create(file_system(spark, f"{path}/v={version}/{_DATA}{own}")[1], False).close()
    fs.create(file_system(spark, f"{path}/v={version}/{_MARKER}")[1], False).close()
    return version


def _folder(spark: SparkSession, path: str, version: int) -> str:
    """Where the tables of a committed version lie."""
    fs, root = file_system(spark, f"{path}/v={version}")
    named = [s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().startswith(_DATA)]
    return f"{path}/{named[0][len(_DATA):]}" if named else f"{path}/v={version}"


def read_state(spark: SparkSession, path: str, version: int | None = None) -> CrawlState:
    """A committed version (the latest by default); empty tables before the first."""
    versions = state_versions(spark, path)
    if version is not None and version not in versions:
        raise ValueError(f"no committed version {version} in {path}")
    if not versions:
        return CrawlState(*[spark.createDataFrame([], s) for s in _SCHEMAS])
    folder = _folder(spark, path, version or versions[-1])
    return CrawlState(
        *[spark.read.schema(s).parquet(f"{folder}/{n}") for n, s in _SCHEMAS._asdict().items()]
    )


def append_changes(changes: DataFrame, path: str, batch: int) -> None:
    """Write the change rows of one batch, in place of an earlier try."""
    merge_state(changes).write.mode("overwrite").parquet(f"{path}/log/batch={batch}")


def _log(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """Newest folded batch number (-1: none) and all change rows that count."""
    bases = child_numbers(spark, path, "upto=", "_SUCCESS")
    folded = bases[-1] if bases else -1
    rows = spark.createDataFrame([], URL_STATE)
    if bases:
        rows = spark.read.schema(URL_STATE).parquet(f"{path}/upto={folded}")
    fresh = [b for b in child_numbers(spark, f"{path}/log", "batch=", "_SUCCESS") if b > folded]
    if fresh:
        logged = spark.read.schema(URL_STATE).parquet(*[f"{path}/log/batch={b}" for b in fresh])
        rows = rows.unionByName(logged)
    return folded, rows


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """The URL state that the log amounts to."""
    return merge_state(_log(spark, path)[1])


def compact_changes(spark: SparkSession, path: str) -> int:
    """Fold every batch written so far into one base; returns the last batch."""
    batches = child_numbers(spark, f"{path}/log", "batch=", "_SUCCESS")
    folded, rows = _log(spark, path)
    last = max(batches, default=folded)
    if last > folded:
        merge_state(rows).write.mode("overwrite").parquet(f"{path}/upto={last}")
    return last


def mark_seen(seen: DataFrame, parsed: DataFrame, column: str = "sitemap_url") -> DataFrame:
    """``seen(url)`` plus the sitemaps just parsed."""
    return seen.unionByName(parsed.select(F.col(column).alias("url"))).distinct()
