"""Links of captured pages.

Everything here is one pass over the pages without a shuffle: a page is parsed
where it is read and only the narrow link rows leave the task.  Links are
distinct within a page because the page itself removes its repeats.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let, q
from ..functions.css import piece_refs_sql, with_sheet_pieces
from ..functions.html import title_sql, tokens_sql
from ..functions.refs import LINK_KINDS, STATIC_KINDS, page_links_sql
from ..functions.urls import base_sql, file_ext, is_excluded, is_http, normalize_sql, same_domain, same_domain_sql

# Titles of pages that stand in for content not yet served.
INTERSTITIAL_TITLES = ("Just a moment", "Checking your browser")


def tokenize(pages: DataFrame) -> DataFrame:
    """``(page_id, pos, token)``: the lossless pieces of every page."""
    return pages.select("page_id", F.posexplode(F.expr(tokens_sql("html"))).alias("pos", "token"))


def html_pages(pages: DataFrame) -> DataFrame:
    """The pages whose links are read: all of them, or, where ``pages`` says
    what it holds in ``content_type``, those served as HTML; a missing type
    counts as HTML, as it does for the outcome of a capture."""
    return pages.where(served_as_html()) if "content_type" in pages.columns else pages


def served_as_html(column: str = "content_type") -> Column:
    """True unless the content type names something other than HTML."""
    return F.coalesce(is_html(column), F.lit(True))


def extract_links(pages: DataFrame, kinds: Sequence[str] = LINK_KINDS) -> DataFrame:
    """``(page_id, src_url, kind, raw, dst_url)``, distinct within a page;
    pages typed as other than HTML give none."""
    found = html_pages(pages).select(
        "page_id",
        F.col("url").alias("src_url"),
        F.explode(F.expr(page_links_sql("url", "html", kinds))).alias("link"),
    )
    return found.select("page_id", "src_url", "link.kind", "link.raw", "link.dst_url")


def link_set(
    pages: DataFrame,
    root: str | None = None,
    exclude: Iterable[str] = (),
    mode: str = "suffix",
    kinds: Sequence[str] = LINK_KINDS,
) -> DataFrame:
    """``(page_id, src_url, dst_url)``: the distinct targets of each page, of
    any kind, inside the root domain and not excluded; pages typed as other
    than HTML give none."""
    targets = f"array_distinct(transform({page_links_sql('url', 'html', kinds)}, l -> l.dst_url))"
    keep = same_domain_sql(root, "d", mode)
    for text in exclude:
        keep += f" and not contains(d, {q(text)})"
    return html_pages(pages).select(
        "page_id",
        F.col("url").alias("src_url"),
        F.explode(F.expr(f"filter({targets}, d -> {keep})")).alias("dst_url"),
    )


def page_link_counts(pages: DataFrame, root: str | None = None, mode: str = "suffix") -> DataFrame:
    """``(page_id, url, n_links)``: distinct internal targets per page."""
    targets = f"array_distinct(transform({page_links_sql('url', 'html', LINK_KINDS)}, l -> l.dst_url))"
    inside = f"size(filter({targets}, d -> {same_domain_sql(root, 'd', mode)}))"
    return pages.select("page_id", "url", F.expr(inside).cast("bigint").alias("n_links"))


def static_refs(pages: DataFrame) -> DataFrame:
    """Images, scripts and linked files of pages: resources, not crawl links."""
    return extract_links(pages, STATIC_KINDS)


def asset_refs(pages: DataFrame) -> DataFrame:
    """All references of pages to assets: static ones and those of styles."""
    return extract_links(pages, (*STATIC_KINDS, "style_attr", "style_block"))


def css_resources(resources: DataFrame) -> DataFrame:
    """The style sheets among the resources."""
    return resources.filter(file_ext("url") == ".css")


def css_refs(resources: DataFrame, nested: bool = False) -> DataFrame:
    """``(css_url, raw, dst_url)`` of the rules of style sheets, any domain.

    ``nested`` also covers rules inside ``@media`` and the like.
    """
    raws = f"array_distinct({piece_refs_sql('pieces')})"
    links = let(
        base_sql("url"),
        lambda b: f"transform({raws}, r -> named_struct('raw', r, 'dst_url', {normalize_sql(b, 'r')}))",
    )
    return (
        with_sheet_pieces(css_resources(resources).select("url", "content"), "content", nested)
        .select(F.col("url").alias("css_url"), F.explode(F.expr(links)).alias("ref"))
        .select("css_url", "ref.raw", "ref.dst_url")
        .filter(F.col("dst_url").isNotNull() & ~F.col("dst_url").startswith("data:"))
    )


def page_title(pages: DataFrame) -> DataFrame:
    """``(page_id, url, title)``; NULL for a page without title."""
    return pages.select("page_id", "url", F.expr(let(tokens_sql("html"), title_sql)).alias("title"))


def flag_interstitial(pages: DataFrame) -> DataFrame:
    """``page_title`` plus ``interstitial``: the capture is no real content."""
    flag = F.lit(False)
    for text in INTERSTITIAL_TITLES:
        flag = flag | F.coalesce(F.contains("title", F.lit(text)), F.lit(False))
    return page_title(pages).withColumn("interstitial", flag)


def internal_links(links: DataFrame, root: str, mode: str = "suffix") -> DataFrame:
    return links.filter(same_domain(root, "dst_url", mode))


def external_links(links: DataFrame, root: str, mode: str = "suffix") -> DataFrame:
    return links.filter(~same_domain(root, "dst_url", mode))


def exclude_links(links: DataFrame, substrings: Iterable[str], column: str = "dst_url") -> DataFrame:
    """Drop rows whose URL contains one of the substrings."""
    return links.filter(~is_excluded(column, substrings))


def is_html(column: str = "content_type") -> Column:
    """Whether a content type says HTML."""
    return F.contains(F.lower(column), F.lit("text/html"))


def classify_pages(pages: DataFrame) -> DataFrame:
    """``(page_id, url, class)``: ``page``, ``resource`` or ``empty``."""
    kind = (
        F.when(F.coalesce(F.length("html"), F.lit(0)) == 0, F.lit("empty"))
        .when(is_html(), F.lit("page"))
        .otherwise(F.lit("resource"))
    )
    return pages.select("page_id", "url", kind.alias("class"))


def http_only(refs: DataFrame, column: str = "dst_url") -> DataFrame:
    return refs.filter(is_http(column))
