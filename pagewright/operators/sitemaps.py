"""Sitemaps and the seed of a crawl."""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import urljoin, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import is_excluded, same_domain
from .lookup import lookup
from .robots import robots_sitemaps

# Fixed value: the sitemap namespace.
NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"
_BLANKS = " \t\n\r\u000b\f"
_SCHEMA = "_xmlns string, url array<struct<loc array<string>>>"


def parse_sitemaps(sitemaps: DataFrame) -> DataFrame:
    """``(sitemap_url, loc)``: trimmed ``url/loc`` texts in the sitemap
    namespace.  Malformed bodies and sitemap indexes give no rows; an empty
    ``loc`` is left out."""
    body = F.col("body")
    # a prefix bound to the namespace is dropped, so one schema reads both
    prefix = F.regexp_extract(body, r"<([A-Za-z_][\w.\-]*):urlset[\s>]", 1)
    bound = F.when(prefix == "", F.lit(" xmlns=")).otherwise(F.concat(F.lit(" xmlns:"), prefix, F.lit("=")))
    root = F.regexp_replace(F.regexp_extract(body, r"<(?:[A-Za-z_][\w.\-]*:)?urlset\b[^>]*+>", 0), r"\s*+=\s*+|\s++", " ")
    flat_bound = F.replace(bound, F.lit("="), F.lit(" "))
    named = F.contains(root, F.concat(flat_bound, F.lit(f'"{NAMESPACE}"'))) | F.contains(
        root, F.concat(flat_bound, F.lit(f"'{NAMESPACE}'"))
    )
    plain = F.when(prefix == "", body).otherwise(
        F.replace(
            F.replace(body, F.concat(F.lit("<"), prefix, F.lit(":")), F.lit("<")),
            F.concat(F.lit("</"), prefix, F.lit(":")),
            F.lit("</"),
        )
    )
    read = sitemaps.filter(named).select("sitemap_url", F.from_xml(plain, _SCHEMA).alias("x"))
    locs = read.select("sitemap_url", F.explode("x.url.loc").alias("locs")).select(
        "sitemap_url", F.explode("locs").alias("loc")
    )
    return locs.select("sitemap_url", F.trim("loc", F.lit(_BLANKS)).alias("loc")).filter(F.col("loc") != "")


def sitemap_counts(sitemap_locs: DataFrame) -> DataFrame:
    """``(sitemap_url, n_urls)``."""
    return sitemap_locs.groupBy("sitemap_url").agg(F.count(F.lit(1)).alias("n_urls"))


def new_sitemaps(found: DataFrame, seen: DataFrame, column: str = "sitemap_url") -> DataFrame:
    """Distinct sitemap URLs that were not parsed before."""
    fresh = found.select(F.col(column).alias("sitemap_url")).distinct()
    known = seen.select(F.col("url").alias("sitemap_url")).distinct()
    return fresh.join(known, "sitemap_url", "left_anti")


def seed_frontier(
    root: str,
    robots: DataFrame,
    sitemaps: DataFrame,
    seen: DataFrame | None = None,
    exclude: Iterable[str] = (),
    mode: str = "suffix",
    fallback_only: bool = False,
) -> DataFrame:
    """``(url)``: the root, plus the URLs of the sitemaps its robots file lists
    and of ``/sitemap.xml``.

    Sitemap URLs pass the domain and exclusion filters but stay as written.
    ``fallback_only`` reads ``/sitemap.xml`` only when no sitemap is listed.
    """
    spark = robots.sparkSession
    host = urlsplit(root).netloc
    listed = robots_sitemaps(robots.filter(F.col("host") == host)).select("sitemap_url")
    default = spark.range(1).select(F.lit(urljoin(root, "/sitemap.xml")).alias("sitemap_url"))
    if fallback_only:
        # left_anti on a constant: any listed sitemap removes the fallback row
        default = default.withColumn("k", F.lit(1)).join(
            listed.select(F.lit(1).alias("k")).distinct(), "k", "left_anti"
        ).drop("k")
    wanted = listed.unionByName(default).distinct()
    if seen is not None:
        wanted = new_sitemaps(wanted, seen)
    locs = parse_sitemaps(lookup(sitemaps, wanted, "sitemap_url", "left_semi")).select(F.col("loc").alias("url"))
    kept = locs.filter(same_domain(host, "url", mode) & ~is_excluded("url", exclude))
    return spark.range(1).select(F.lit(root).alias("url")).unionByName(kept).distinct()
