"""Shared folders for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder under the session's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of this machine;
    executors of a cluster could not read it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="pagewright-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once under the shared work folder and read back: later
    jobs see the same rows, and a lost executor costs only its tasks."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, purpose: str) -> DataFrame:
    """``df`` written once under the shared work folder, bucketed by ``key``
    into as many buckets as a shuffle has partitions, and read back: a later
    join on ``key`` moves only its other side."""
    spark = df.sparkSession
    name = f"{purpose.replace('-', '_')}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("path", work_dir(spark, purpose)).saveAsTable(name)
    return spark.table(name)


def file_system(spark: SparkSession, path: str):
    """Hadoop file system and path object of ``path``."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def delete_tree(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table this package wrote itself."""
    fs, hadoop_path = file_system(spark, path)
    fs.delete(hadoop_path, True)


def child_numbers(spark: SparkSession, path: str, prefix: str, marker: str) -> list[int]:
    """Numbers N of the folders ``<path>/<prefix>N`` that hold ``marker``."""
    fs, root = file_system(spark, path)
    if not fs.exists(root):
        return []
    make = spark._jvm.org.apache.hadoop.fs.Path
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    found = [n for n in names if n.startswith(prefix) and fs.exists(make(f"{path}/{n}/{marker}"))]
    return sorted(int(n[len(prefix):]) for n in found)
