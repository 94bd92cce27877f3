"""When to capture: per-host spacing and retries, as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import netloc_of

_BUCKET_DIGITS = 3


def crawl_schedule(batch: DataFrame, policy: DataFrame | None, delay: float = 1.0) -> DataFrame:
    """``batch(url, level)`` with ``host``, ``seq`` and ``offset_seconds``: the
    earliest start of each URL when a host is asked once per crawl delay.

    Within a host the order is level, then the hash of the URL.  The hash cuts
    a host into equal buckets that follow this order, so a host with any share
    of the rows is ranked by many tasks: rank inside the bucket plus the number
    of URLs in the buckets before it.
    """
    hashed = batch.select(
        "url", "level", netloc_of("url").alias("host"), F.sha2("url", 256).alias("__h")
    ).withColumn("__b", F.substring("__h", 1, _BUCKET_DIGITS))
    bucket = ["host", "level", "__b"]
    sizes = hashed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("host").orderBy("level", "__b").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    starts = sizes.withColumn("__start", F.sum("__n").over(before) - F.col("__n")).drop("__n")
    if policy is not None:
        starts = starts.join(policy.select("host", "crawl_delay"), "host", "left")
    else:
        starts = starts.withColumn("crawl_delay", F.lit(None).cast("int"))
    inside = F.row_number().over(Window.partitionBy(*bucket).orderBy("__h", "url"))
    # level may be NULL, so the keys are compared null-safe
    left, right = hashed.withColumn("__rn", inside).alias("l"), starts.alias("r")
    match = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in bucket]
    seq = F.col("l.__rn") + F.col("r.__start") - 1
    spacing = F.coalesce(F.col("r.crawl_delay").cast("double"), F.lit(float(delay)))
    return left.join(right, match[0] & match[1] & match[2]).select(
        "l.url", "l.level", "l.host", seq.alias("seq"), (seq * spacing).alias("offset_seconds")
    )


def retry_plan(
    attempts: DataFrame, delay: float = 1.0, max_retries: int = 5, jitter_seed: int | None = None
) -> DataFrame:
    """``(url, failures, done, exhausted, next_wait, total_wait)``.

    ``attempts(url, attempt, ok)`` numbers the tries of a URL from 1.  Tries
    after the first success or beyond ``max_retries`` do not count.  After the
    k-th failure the wait is ``delay * 2^(k-1)``; ``jitter_seed`` adds a
    reproducible 0 to 0.5 s to it.
    """
    if max_retries < 1:
        raise ValueError("max_retries must be at least 1")
    counted = attempts.filter(F.col("attempt").between(1, max_retries))
    folded = counted.groupBy("url").agg(
        F.min(F.when(F.col("ok"), F.col("attempt"))).alias("first_ok"),
        # at most max_retries numbers
        F.collect_set(F.when(~F.col("ok"), F.col("attempt"))).alias("failed"),
    )
    before = F.filter("failed", lambda a: F.col("first_ok").isNull() | (a < F.col("first_ok")))
    planned = folded.select(
        "url", F.size(before).alias("failures"), F.col("first_ok").isNotNull().alias("done")
    ).withColumn("exhausted", ~F.col("done") & (F.col("failures") >= max_retries))

    def jitter(k: Column) -> Column:
        if jitter_seed is None:
            return F.lit(0.0)
        return F.pmod(F.xxhash64("url", k, F.lit(jitter_seed)), F.lit(1_000_000)) / 2_000_000.0

    failures = F.col("failures")
    wait = F.lit(float(delay)) * F.pow(F.lit(2.0), failures - 1) + jitter(failures)
    total = F.lit(float(delay)) * (F.pow(F.lit(2.0), failures) - 1)
    if jitter_seed is not None:
        total = total + F.when(
            failures > 0, F.aggregate(F.sequence(F.lit(1), failures), F.lit(0.0), lambda acc, k: acc + jitter(k))
        ).otherwise(0.0)
    return planned.withColumn("next_wait", F.when(~F.col("done") & (failures > 0), wait)).withColumn("total_wait", total)
