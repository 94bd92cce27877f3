"""Does the mirror hold what its pages point at?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import parent_folder, resolve_path
from ..functions.refs import LINK_KINDS, STATIC_KINDS, page_refs_sql, split_ref_sql

_REWRITTEN = tuple(
    k for k in LINK_KINDS + STATIC_KINDS if k not in ("meta_refresh", "js_href", "js_open", "js_fetch", "data_attr")
)
_NOT_RELATIVE = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*+:|/|#|\z)"


def relative_targets(rewritten: DataFrame) -> DataFrame:
    """``(page_id, local_path, target_path)`` for the relative references of
    rewritten pages, distinct within a page."""
    raw = F.expr(f"transform({page_refs_sql('html', _REWRITTEN)}, r -> {split_ref_sql('r')[1]})")
    refs = rewritten.select("page_id", "local_path", F.explode(F.array_distinct(raw)).alias("raw"))
    return refs.filter(~F.col("raw").rlike(_NOT_RELATIVE)).select(
        "page_id", "local_path", resolve_path(parent_folder("local_path"), "raw").alias("target_path")
    )


def mirror_integrity(rewritten: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(target_path, n_refs, first_source)``: relative targets that the
    mirror ``manifest(local_path)`` does not hold.

    Targets are counted before they meet the manifest, so one target missing
    everywhere is one row in the join.
    """
    counted = relative_targets(rewritten).groupBy("target_path").agg(
        F.count(F.lit(1)).alias("n_refs"), F.min("local_path").alias("first_source")
    )
    held = manifest.select(F.col("local_path").alias("target_path")).distinct()
    return counted.join(held, "target_path", "left_anti")
