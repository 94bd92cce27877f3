"""Catalogued queries: every operator over whole tables.

Each entry maps ``(spark, folder of parquet tables)`` to a DataFrame.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import entities, paths, urls
from ..functions.refs import LINK_KINDS
from ..operators import frontier, graph, integrity, links, manifest, rewrite, schedule, sitemaps
from ..operators import robots as robots_ops
from ..sources import mirror, state
from ..sources.readers import read_resources, read_robots, read_sitemaps, stream_pages
from ..sources.workdir import work_dir
from ..streaming import jobs
from . import inputs as i

Query = Callable[[SparkSession, str], DataFrame]
OUT = "out"
AT = dt.datetime(2024, 6, 1, tzinfo=dt.timezone.utc)


def _kinds(*kinds: str) -> Query:
    def run(spark, d):
        return links.extract_links(i.pages(spark, d), kinds).select("page_id", "kind", "raw", "dst_url")

    return run


def u_normalize_pages(spark, d):
    return i.page_urls(spark, d).select("page_id", urls.canonical_url("url").alias("canonical"))


def u_url_parts(spark, d):
    return i.page_urls(spark, d).select("page_id", urls.url_parts("url").alias("p")).select("page_id", "p.*")


def u_resolve(spark, d):
    link = F.concat(F.lit("../r/./"), F.col("page_id").cast("string"), F.lit("/?q#f"))
    return i.page_urls(spark, d).select("page_id", urls.resolve_url("url", link).alias("resolved"))


def u_predicates(spark, d):
    u = i.page_urls(spark, d)
    return u.select(
        "page_id",
        urls.strip_fragment("url").alias("no_fragment"),
        urls.same_domain("tion.example.com", "url").alias("suffix"),
        urls.same_domain("example.com", "url", "label").alias("label"),
        urls.is_excluded("url", ["/fr/", "utm_"]).alias("excluded"),
        urls.is_http("url").alias("http"),
        urls.file_ext("url").alias("ext"),
    )


def u_sanitize(spark, d):
    return i.page_urls(spark, d).select("page_id", paths.sanitize_name("url", "url").alias("name"))


def u_query_name(spark, d):
    query = F.expr("'a=' || (page_id % 5) || '&b=%C3%A9+x&a=' || (page_id % 7) || '&' || 'c'")
    u = i.page_urls(spark, d)
    return u.select("page_id", paths.query_to_name(query, "url").alias("name"))


def u_local_path(spark, d):
    return i.page_urls(spark, d).select("page_id", paths.local_path(OUT, urls.canonical_url("url")).alias("local_path"))


def u_relative_path(spark, d):
    u = i.page_urls(spark, d).select("page_id", "url", paths.local_path("", urls.canonical_url("url")).alias("own"))
    target = F.concat(urls.netloc_of("url"), F.lit("/en/img/"), F.col("page_id").cast("string"), F.lit(".png"))
    return u.select("page_id", paths.relative_path(target, paths.parent_folder("own")).alias("rel"))


def u_entities(spark, d):
    p = i.raw_pages(spark, d)
    return p.select("page_id", F.md5(entities.unescape_entities("html")).alias("text_md5"))


def u_canonicalize(spark, d):
    return manifest.canonicalize(i.page_urls(spark, d), i.ROOT)


def x_tokens(spark, d):
    return links.tokenize(i.pages(spark, d)).select("page_id", F.col("pos").cast("bigint").alias("pos"), "token")


def x_all_links(spark, d):
    return _kinds(*LINK_KINDS)(spark, d)


def _served(spark, d):
    """Pages with the type each is served with."""
    return i.pages(spark, d).withColumn("content_type", F.expr(i.CONTENT_TYPE))


def x_typed_link_set(spark, d):
    """Only pages served as HTML give links."""
    return links.link_set(_served(spark, d), i.ROOT, ["/go/"]).select("page_id", "dst_url")


def r_typed_pages(spark, d):
    """Pages served as HTML are rewritten; the others keep their bytes."""
    return _hashed(rewrite.rewrite_pages(_served(spark, d), i.resource_map(spark, d), i.ROOT, OUT))


def x_link_set(spark, d):
    return links.link_set(i.pages(spark, d), i.ROOT, ["/go/"]).select("page_id", "dst_url")


def x_static(spark, d):
    return links.static_refs(i.pages(spark, d)).select("page_id", "kind", "raw", "dst_url")


def x_css(spark, d):
    return links.css_refs(i.resources(spark, d))


def x_css_nested(spark, d):
    return links.css_refs(i.resources(spark, d), nested=True)


def x_css_sheets(spark, d):
    """Sheets that differ from page to page, by number of each reference."""
    return _sheet_refs(spark, d, False)


def x_css_sheets_nested(spark, d):
    return _sheet_refs(spark, d, True)


def _sheet_refs(spark, d, nested):
    return links.css_refs(i.page_sheets(spark, d), nested).select("css_url", "raw")


def x_title(spark, d):
    return links.page_title(i.raw_pages(spark, d)).select("page_id", "title")


def x_interstitial(spark, d):
    """Every seventh page gets a waiting page's title."""
    p = i.raw_pages(spark, d)
    waiting = F.expr("case page_id % 7 when 2 then '<title>Just a moment...</title>' || html else html end")
    return links.flag_interstitial(p.select("page_id", "url", waiting.alias("html"))).select("page_id", "interstitial")


def x_sitemap(spark, d):
    return sitemaps.parse_sitemaps(i.sitemaps(spark, d))


def x_robots_sitemaps(spark, d):
    return robots_ops.robots_sitemaps(i.robots(spark, d))


def x_robots_rules(spark, d):
    rules = robots_ops.parse_robots(i.robots(spark, d))
    return rules.withColumn("agents", F.array_join("agents", ","))


def j_internal(spark, d):
    return links.internal_links(links.extract_links(i.pages(spark, d)), i.ROOT).select("page_id", "kind", "dst_url")


def j_external(spark, d):
    return links.external_links(links.extract_links(i.pages(spark, d)), i.ROOT).select("page_id", "kind", "dst_url")


def j_excluded(spark, d):
    kept = links.exclude_links(links.extract_links(i.pages(spark, d)), ["/api/", "/go/"])
    return kept.select("page_id", "kind", "dst_url")


def j_robots_verdict(spark, d):
    targets = links.link_set(i.pages(spark, d), i.ROOT).select(F.col("dst_url").alias("url")).distinct()
    return robots_ops.robots_verdict(targets, i.robots(spark, d), i.AGENT)


def j_new_sitemaps(spark, d):
    return sitemaps.new_sitemaps(i.sitemaps(spark, d), i.seen_sitemaps(spark, d))


def j_seed(spark, d):
    """A root whose robots file, line by line, lists every sitemap."""
    maps = i.sitemaps(spark, d)
    listing = maps.select(
        F.lit(i.ROOT).alias("host"), F.lit(200).alias("status_code"),
        F.concat(F.lit("Sitemap: "), "sitemap_url").alias("body"),
    )
    return sitemaps.seed_frontier(f"https://{i.ROOT}", listing, maps, i.seen_sitemaps(spark, d), ["utm_"])


def _text_time(state_rows):
    """Times as text, the same in every session time zone."""
    return state_rows.withColumn("last_fetched", F.date_format("last_fetched", "yyyy-MM-dd HH:mm:ss"))


def j_enqueue(spark, d):
    found = links.link_set(i.pages(spark, d), i.ROOT).select(F.col("dst_url").alias("url"))
    return _text_time(frontier.enqueue(i.url_state(spark, d), found))


def j_classify(spark, d):
    return links.classify_pages(i.typed_pages(spark, d)).select("page_id", "class")


def j_resolve_cached(spark, d):
    refs = links.static_refs(i.pages(spark, d))
    return manifest.resolve_cached(refs, i.resource_map(spark, d)).select("page_id", "dst_url", "local_path")


def j_pending_res(spark, d):
    """Assets of pages (static and style references) and of style sheets."""
    return manifest.pending_resources(
        links.asset_refs(i.pages(spark, d)), links.css_refs(i.resources(spark, d)), i.resource_map(spark, d), i.ROOT
    )


def j_missing_res(spark, d):
    """References of pages (static and style) and of style sheets to assets not captured."""
    refs = links.asset_refs(i.pages(spark, d)).select("dst_url").unionByName(
        links.css_refs(i.resources(spark, d)).select("dst_url")
    )
    return manifest.missing_resources(refs, i.resources(spark, d))


def j_integrity(spark, d):
    done = rewrite.rewrite_pages(i.pages(spark, d), i.resource_map(spark, d), i.ROOT, OUT)
    held = manifest.path_manifest(i.page_urls(spark, d), OUT).select("local_path").unionByName(
        i.resource_map(spark, d).select("local_path")
    )
    return integrity.mirror_integrity(done, held)


def a_levels(spark, d):
    """Crawl as the scheduler runs it: from the seed frontier (the root and the
    addresses its sitemaps list), inside the root domain, never into /api/.
    Pages served as something other than HTML, or with an empty body, are
    reached but their links are not followed; neither are those of pages the
    robots files deny.  Links are those found in the pages and between pages."""
    typed = i.typed_pages(spark, d)
    html = typed.where(links.is_html("content_type") & (F.length("html") > 0)).select("page_id")
    found = links.link_set(i.pages(spark, d).join(html, "page_id", "left_semi")).select("src_url", "dst_url")
    between = i.page_edges(spark, d, html)
    addresses = i.page_urls(spark, d).select(urls.canonical_url("url").alias("url")).distinct()
    verdicts = robots_ops.robots_verdict(addresses, i.robots(spark, d), i.AGENT)
    return graph.crawl_levels(
        found.unionByName(between), j_seed(spark, d), root=i.ROOT, exclude=["/api/"], verdicts=verdicts
    ).select("url", "level", "parent")


def a_link_counts(spark, d):
    return links.page_link_counts(i.pages(spark, d), i.ROOT).select("page_id", "n_links")


def a_frontier_counts(spark, d):
    return frontier.frontier_counts(i.url_state(spark, d))


def a_sitemap_counts(spark, d):
    return sitemaps.sitemap_counts(x_sitemap(spark, d))


def a_manifest(spark, d):
    return manifest.resource_manifest(links.asset_refs(i.pages(spark, d)), OUT)


def _raw_forms(spark, d):
    """Three spellings of every page address."""
    plain = F.regexp_replace("url", r"[?#].*$", "")
    forms = F.array("url", plain, F.concat(F.rtrim(plain, F.lit("/")), F.lit("/#x")))
    return i.page_urls(spark, d).select(F.explode(forms).alias("url"))


def a_collisions(spark, d):
    return manifest.path_collisions(_raw_forms(spark, d), OUT)


def a_collision_members(spark, d):
    return manifest.colliding_urls(_raw_forms(spark, d), OUT)


def a_canon_dups(spark, d):
    return manifest.canonical_duplicates(_raw_forms(spark, d))


def a_canon_forms(spark, d):
    return manifest.canonical_forms(_raw_forms(spark, d))


def a_mark_visited(spark, d):
    done = i.page_urls(spark, d).filter(F.col("url").contains("/en/")).select(
        urls.canonical_url("url").alias("url"), F.lit("saved").alias("outcome")
    )
    at = F.lit(i.FETCHED).cast("timestamp")
    return _text_time(frontier.mark_visited(i.url_state(spark, d), done, at))


def a_next_batch(spark, d):
    return frontier.next_batch(i.url_state(spark, d), 50).select("url", "level")


def a_next_batch_large(spark, d):
    """A batch of a third of the pending URLs, cut without one task holding it."""
    state = i.url_state(spark, d)
    n = state.filter(F.col("status") == "pending").count() // 3
    return frontier.next_batch(state, n, take=0).select("url", "level")


def a_schedule(spark, d):
    policy = robots_ops.robots_policy(i.robots(spark, d), i.AGENT)
    return schedule.crawl_schedule(i.url_state(spark, d).filter("status = 'pending'"), policy, 0.5)


def a_retry(spark, d):
    return schedule.retry_plan(i.attempts(spark, d), 1.0, 5)


def a_report(spark, d):
    return frontier.crawl_report(i.url_state(spark, d))


def _hashed(df, column="html"):
    return df.select("page_id", "local_path", F.md5(column).alias("html_md5"))


def r_links(spark, d):
    return _hashed(rewrite.rewrite_links(i.pages(spark, d), i.ROOT, OUT))


def r_static(spark, d):
    return _hashed(rewrite.rewrite_static(i.pages(spark, d), i.resource_map(spark, d), i.ROOT, OUT))


def r_styles(spark, d):
    return _hashed(rewrite.rewrite_styles(i.pages(spark, d), i.resource_map(spark, d), i.ROOT, OUT))


def r_css(spark, d):
    return rewrite.rewrite_css(i.resources(spark, d), i.resource_map(spark, d), OUT)


def r_pages(spark, d):
    return _hashed(rewrite.rewrite_pages(i.pages(spark, d), i.resource_map(spark, d), i.ROOT, OUT))


def s_mirror(spark, d):
    """Written by host bucket and read back."""
    folder = work_dir(spark, "mirror")
    mirror.write_mirror(rewrite.rewrite_links(i.pages(spark, d), i.ROOT, OUT), folder, buckets=8)
    return _hashed(mirror.read_mirror(spark, folder))


def s_state(spark, d):
    """A second version of the state, read back."""
    folder = work_dir(spark, "state")
    first = state.CrawlState(
        i.url_state(spark, d), i.resource_map(spark, d), i.seen_sitemaps(spark, d)
    )
    state.write_state(folder, first)
    held = state.read_state(spark, folder)
    parsed = state.mark_seen(held.seen_sitemaps, i.sitemaps(spark, d))
    state.write_state(folder, held._replace(seen_sitemaps=parsed))
    held = state.read_state(spark, folder)
    kept = lambda table, kind, url, value: table.select(F.lit(kind).alias("kind"), F.col(url).alias("url"), value.alias("value"))
    return (
        kept(held.seen_sitemaps, "sitemap", "url", F.lit(""))
        .unionByName(kept(held.url_state, "page", "url", F.concat_ws(" ", "status", "outcome", F.col("level").cast("string"))))
        .unionByName(kept(held.resource_map, "asset", "url", F.col("local_path")))
    )


def _written(df, purpose):
    """A table written and known by its place only."""
    folder = work_dir(df.sparkSession, purpose)
    df.write.parquet(folder)
    return folder


def s_robots(spark, d):
    return read_robots(spark, _written(i.robots(spark, d), "robots"))


def s_sitemaps(spark, d):
    return read_sitemaps(spark, _written(i.sitemaps(spark, d), "sitemaps"))


def s_resources(spark, d):
    """Bytes read back as text."""
    raw = i.resources(spark, d).withColumn("content", F.encode("content", "UTF-8"))
    return read_resources(spark, _written(raw, "resources"))


def _page_stream(spark, d):
    return stream_pages(spark, f"{d}/pages*.parquet").select("page_id", "url", F.expr(i.AUGMENTED).alias("html"))


def _drain(stream, folder):
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start(f"{folder}/out")
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def t_links(spark, d):
    return _drain(jobs.stream_links(_page_stream(spark, d), i.ROOT), work_dir(spark, "t-links")).select("page_id", "dst_url")


def t_frontier(spark, d):
    return _drain(jobs.stream_frontier(_page_stream(spark, d), i.ROOT), work_dir(spark, "t-frontier"))


def t_state(spark, d):
    folder = work_dir(spark, "t-state")
    query = jobs.stream_state(_page_stream(spark, d), folder, f"{folder}/checkpoint", i.ROOT, at=AT)
    query.awaitTermination()
    return state.read_changes(spark, folder).select("url", "status", "outcome")


def t_state_typed(spark, d):
    """Captures with type and status: failed, empty and non-HTML ones are
    visited with their outcome and add no links."""
    folder = work_dir(spark, "t-state-typed")
    body = F.expr(i.BODY.replace(" html ", f" {i.AUGMENTED} "))
    typed = stream_pages(spark, f"{d}/pages*.parquet").select(
        "page_id", "url", body.alias("html"), F.expr(i.CONTENT_TYPE).alias("content_type"), F.expr(i.STATUS).alias("status_code")
    )
    query = jobs.stream_state(typed, folder, f"{folder}/checkpoint", i.ROOT, at=AT)
    query.awaitTermination()
    return state.read_changes(spark, folder).select("url", "status", "outcome")


def t_rewrite(spark, d):
    folder = work_dir(spark, "t-rewrite")
    query = jobs.stream_rewrite(
        _page_stream(spark, d), i.resource_map(spark, d), i.ROOT, f"{folder}/out", f"{folder}/checkpoint", OUT
    )
    query.awaitTermination()
    return _hashed(spark.read.parquet(f"{folder}/out"))


def internal_link_targets(spark, d):
    """How often each internal address is linked from distinct pages."""
    found = links.link_set(i.pages(spark, d), i.ROOT, kinds=("a_href", "form_action"))
    return found.groupBy("dst_url").agg(F.count(F.lit(1)).alias("n_pages"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        u_normalize_pages, u_url_parts, u_resolve, u_predicates, u_sanitize, u_query_name, u_local_path,
        u_relative_path, u_entities, u_canonicalize, x_tokens, x_all_links, x_link_set, x_static, x_css, x_css_nested, x_css_sheets,
        x_css_sheets_nested, s_robots, s_sitemaps, s_resources,
        x_title, x_interstitial, x_sitemap, x_robots_sitemaps, x_robots_rules, j_internal, j_external, j_excluded,
        j_robots_verdict, j_new_sitemaps, j_seed, j_enqueue, j_classify, j_resolve_cached, j_pending_res, j_missing_res,
        j_integrity, a_levels, a_link_counts, a_frontier_counts, a_sitemap_counts, a_manifest, a_collisions,
        a_collision_members, a_canon_dups, a_canon_forms, a_mark_visited, a_next_batch, a_next_batch_large, a_schedule, a_retry, a_report,
        r_links, r_static, r_styles, r_css, r_pages, r_typed_pages, x_typed_link_set, s_mirror, s_state, t_links, t_frontier, t_state, t_state_typed, t_rewrite,
        internal_link_targets,
    )
}
QUERIES.update(
    x_a_href=_kinds("a_href"), x_form=_kinds("form_action"), x_button=_kinds("button_onclick"),
    x_media=_kinds("media_src"), x_style_attr=_kinds("style_attr"), x_style_block=_kinds("style_block"),
    x_meta=_kinds("meta_refresh"), x_js=_kinds("js_href", "js_open", "js_fetch"), x_data=_kinds("data_attr"),
)
