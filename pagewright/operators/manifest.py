"""Asset manifests, cache lookups and name clashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import local_path
from ..functions.urls import canonical_url, is_http, same_domain, url_parts
from .lookup import lookup


def canonicalize(urls: DataFrame, root: str | None = None, column: str = "url") -> DataFrame:
    """URLs with their canonical form, host and tests, one row per input row."""
    canon = urls.select(F.col(column).alias("url"), canonical_url(column).alias("canonical"))
    out = canon.withColumn("parts", url_parts("canonical")).select(
        "url", "canonical", F.col("parts.scheme").alias("scheme"), F.col("parts.netloc").alias("host"),
        F.col("parts.path").alias("path"), F.col("parts.query").alias("query"),
        is_http("canonical").alias("is_http"),
    )
    return out if root is None else out.withColumn("internal", same_domain(root, "canonical"))


def canonical_duplicates(urls: DataFrame, column: str = "url") -> DataFrame:
    """``(canonical, n_forms, first_form, last_form)``: canonical URLs reached
    from several raw forms.  ``canonical_forms`` lists the forms."""
    forms = urls.select(canonical_url(column).alias("canonical"), F.col(column).alias("form")).distinct()
    return (
        forms.filter(F.col("canonical").isNotNull())
        .groupBy("canonical")
        .agg(F.count(F.lit(1)).alias("n_forms"), F.min("form").alias("first_form"), F.max("form").alias("last_form"))
        .filter(F.col("n_forms") > 1)
    )


def canonical_forms(urls: DataFrame, column: str = "url") -> DataFrame:
    """``(canonical, form)``: every raw form of the duplicates, one per row."""
    forms = urls.select(canonical_url(column).alias("canonical"), F.col(column).alias("form")).distinct()
    several = canonical_duplicates(urls, column).select("canonical")
    return lookup(forms, several, "canonical", "left_semi")


def path_manifest(urls: DataFrame, root_dir: str, column: str = "url") -> DataFrame:
    """``(url, local_path)`` for every distinct URL."""
    return (
        urls.select(F.col(column).alias("url")).distinct().select("url", local_path(root_dir, "url").alias("local_path"))
    )


def path_collisions(urls: DataFrame, root_dir: str, column: str = "url") -> DataFrame:
    """``(local_path, n_urls, first_url, last_url)``: paths that several URLs
    would be written to.  ``colliding_urls`` lists the URLs."""
    return (
        path_manifest(urls, root_dir, column)
        .groupBy("local_path")
        .agg(F.count(F.lit(1)).alias("n_urls"), F.min("url").alias("first_url"), F.max("url").alias("last_url"))
        .filter((F.col("n_urls") > 1) & F.col("local_path").isNotNull())
    )


def colliding_urls(urls: DataFrame, root_dir: str, column: str = "url") -> DataFrame:
    """``(local_path, url)``: every URL of the collisions, one per row."""
    paths = path_collisions(urls, root_dir, column).select("local_path")
    manifest = path_manifest(urls, root_dir, column)
    return lookup(manifest, paths, "local_path", "left_semi").select("local_path", "url")


def resource_manifest(refs: DataFrame, root_dir: str, column: str = "dst_url") -> DataFrame:
    """``(url, local_path)``: one row per referenced asset.  An asset that
    already carries a local path keeps the smallest one it was given."""
    given = F.min("local_path") if "local_path" in refs.columns else F.lit(None).cast("string")
    one = refs.groupBy(F.col(column).alias("url")).agg(given.alias("given"))
    return one.select("url", F.coalesce("given", local_path(root_dir, "url")).alias("local_path"))


def resolve_cached(refs: DataFrame, resource_map: DataFrame, column: str = "dst_url") -> DataFrame:
    """``refs`` with the ``local_path`` of captured assets, NULL for others."""
    known = resource_map.groupBy(F.col("url").alias(column)).agg(F.min("local_path").alias("local_path"))
    return lookup(refs, known, column)


def pending_resources(
    page_refs: DataFrame, sheet_refs: DataFrame, resource_map: DataFrame, root: str, mode: str = "suffix"
) -> DataFrame:
    """``(url)``: assets still to capture.  Assets of pages must be inside the
    root domain, those of style sheets may be anywhere."""
    from_pages = page_refs.filter(same_domain(root, "dst_url", mode)).select(F.col("dst_url").alias("url"))
    wanted = from_pages.unionByName(sheet_refs.select(F.col("dst_url").alias("url")))
    # both sides distinct: neither an asset nor its captures can be a hot key
    held = resource_map.select("url").distinct()
    return wanted.filter(is_http("url")).distinct().join(held, "url", "left_anti")


def missing_resources(refs: DataFrame, resources: DataFrame, column: str = "dst_url") -> DataFrame:
    """``(url, n_refs)``: assets referenced but not captured."""
    counted = refs.groupBy(F.col(column).alias("url")).agg(F.count(F.lit(1)).alias("n_refs"))
    return counted.join(resources.select("url").distinct(), "url", "left_anti")
