"""The mirror as a table keyed by ``local_path``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import netloc_of


def write_mirror(rewritten: DataFrame, path: str, by: str | None = "bucket", buckets: int = 256) -> None:
    """Write rewritten documents.

    ``by="bucket"`` groups hosts into a fixed number of folders, ``by="host"``
    makes one folder per host (for few hosts), ``None`` writes documents where
    they were rewritten, without a shuffle.  Documents are rebalanced, not
    hashed to one task per folder: Spark splits a host too large for one file.
    """
    placed = rewritten.withColumn("host", netloc_of("url"))
    if by is None:
        placed.write.mode("errorifexists").parquet(path)
        return
    if by not in ("bucket", "host"):
        raise ValueError("by must be 'bucket', 'host' or None")
    if by == "bucket":
        placed = placed.withColumn("bucket", F.pmod(F.xxhash64("host"), F.lit(buckets)))
    placed.hint("rebalance", by).write.mode("errorifexists").partitionBy(by).parquet(path)


def read_mirror(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
