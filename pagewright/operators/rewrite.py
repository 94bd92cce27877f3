"""Rewriting pages and style sheets for offline use.

Links between pages need no table: a page is rewritten where it is read.
Assets need the table of captured ones; the open references travel to it as
narrow rows, and documents meet their answers in one join on the document key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.css import with_sheet_pieces
from ..functions.paths import local_path, parent_folder, relative_path
from ..functions.rewriting import (
    fill_sql,
    joined_pieces_sql,
    open_urls_sql,
    page_parts_sql,
    page_pieces_sql,
    sheet_parts_sql,
    sheet_pieces_sql,
)
from ..sources.workdir import bucketed
from .links import css_resources, served_as_html
from .lookup import lookup


def _answers(open_refs: DataFrame, resource_map: DataFrame) -> DataFrame:
    """``(key, paths)``: per document the relative path of every open
    reference in order, NULL where the asset is not captured.

    ``open_refs(key, k, url, folder)``.  A document's group holds the
    references of that document only.  Asset URLs repeat across documents (a
    logo may be in a third of all pages); the map has one row per URL, so Spark
    either broadcasts it, when its size allows, or splits the hot side.
    """
    known = resource_map.groupBy("url").agg(F.min("local_path").alias("local_path"))
    met = lookup(open_refs, known, "url").select(
        "key", "k", F.when(F.col("local_path").isNotNull(), relative_path("local_path", "folder")).alias("path")
    )
    ordered = F.sort_array(F.collect_list(F.struct("k", "path")))
    return met.groupBy("key").agg(F.transform(ordered, lambda r: r["path"]).alias("paths"))


def rewrite_pages(
    pages: DataFrame,
    resource_map: DataFrame | None,
    root: str,
    root_dir: str = "",
    mode: str = "suffix",
    links: bool = True,
    rewrite_static: bool = True,
    rewrite_styles: bool = True,
) -> DataFrame:
    """``(page_id, url, local_path, html)``: pages with links inside the root
    domain made relative, other links made absolute, and captured assets
    pointing at their files.  Bytes outside rewritten values stay as they are.

    ``page_id`` identifies a page.  With ``resource_map=None``, or assets
    switched off, there is no shuffle at all.  Where ``pages`` has a
    ``content_type``, pages served as something other than HTML keep their
    bytes as they are (a missing type counts as HTML).
    """
    if "content_type" in pages.columns:
        served = pages.where(served_as_html())
        kept = pages.where(~served_as_html())
        placed = local_path(root_dir, "url").alias("local_path")
        done = rewrite_pages(served.drop("content_type"), resource_map, root, root_dir, mode, links, rewrite_static, rewrite_styles)
        return done.unionByName(kept.select("page_id", "url", placed, "html"))
    assets = resource_map is not None and (rewrite_static or rewrite_styles)

    def joined(with_links: bool) -> DataFrame:
        pieces = page_pieces_sql("html", with_links, assets and rewrite_static, assets and rewrite_styles)
        cut = pages.select("page_id", "url", "html", F.expr(pieces).alias("pieces"))
        return cut.select("page_id", "url", "html", F.expr(joined_pieces_sql("pieces", "url")).alias("pieces"))

    placed = local_path(root_dir, "url").alias("local_path")
    if not (assets or links):
        return pages.select("page_id", "url", placed, "html")
    text = page_parts_sql("pieces", "url", "html", root_dir, root, mode)
    parts = joined(links).select("page_id", "url", F.expr(text).alias("parts"))
    if not assets:
        return parts.select("page_id", "url", placed, F.array_join("parts", "").alias("html"))
    # each page is cut once and written bucketed by page; its open references
    # are a narrow column of that table, and their answers alone move to it
    held = bucketed(parts.withColumn("refs", F.expr(open_urls_sql("parts"))), "page_id", "rewrite-cut")
    refs = held.select(
        F.col("page_id").alias("key"),
        parent_folder(local_path(root_dir, "url")).alias("folder"),
        F.posexplode("refs").alias("k", "url"),
    )
    answers = _answers(refs, resource_map).withColumnRenamed("key", "page_id")
    return held.join(answers, "page_id", "left").select(
        "page_id", "url", placed, F.expr(fill_sql("parts", "paths")).alias("html")
    )


def rewrite_links(pages: DataFrame, root: str, root_dir: str = "", mode: str = "suffix") -> DataFrame:
    """Page links only (anchors, forms, buttons, media)."""
    return rewrite_pages(pages, None, root, root_dir, mode)


def rewrite_static(
    pages: DataFrame, resource_map: DataFrame, root: str, root_dir: str = "", mode: str = "suffix"
) -> DataFrame:
    """Images, scripts and linked files only."""
    return rewrite_pages(pages, resource_map, root, root_dir, mode, links=False, rewrite_styles=False)


def rewrite_styles(
    pages: DataFrame, resource_map: DataFrame, root: str, root_dir: str = "", mode: str = "suffix"
) -> DataFrame:
    """References in style blocks and style attributes only."""
    return rewrite_pages(pages, resource_map, root, root_dir, mode, links=False, rewrite_static=False)


def rewrite_css(
    resources: DataFrame, resource_map: DataFrame, root_dir: str = "", nested: bool = False
) -> DataFrame:
    """``(url, local_path, content)`` of the style sheets, references to
    captured assets made relative to the sheet's folder."""
    cut = with_sheet_pieces(css_resources(resources).select("url", "content"), "content", nested, "cut").select(
        "url", "content", F.expr(sheet_pieces_sql("cut")).alias("pieces")
    )
    joined = cut.select("url", "content", F.expr(joined_pieces_sql("pieces", "url")).alias("pieces"))
    sheets = joined.select(
        "url",
        F.sha2(F.concat_ws("\n", "url", "content"), 256).alias("key"),
        F.expr(sheet_parts_sql("pieces", "content")).alias("parts"),
    )
    refs = sheets.select(
        "key",
        parent_folder(local_path(root_dir, "url")).alias("folder"),
        F.posexplode(F.expr(open_urls_sql("parts"))).alias("k", "url"),
    )
    # copies of one sheet share their key and their answers
    one = refs.groupBy("key", "k").agg(F.first("url").alias("url"), F.first("folder").alias("folder"))
    answers = _answers(one, resource_map)
    return lookup(sheets, answers, "key").select(
        "url",
        local_path(root_dir, "url").alias("local_path"),
        F.expr(fill_sql("parts", "paths")).alias("content"),
    )
