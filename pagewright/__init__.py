"""Captured web pages as tables: links, canonical addresses, crawl frontiers,
robots verdicts, local paths and rewriting, as Spark DataFrame operators."""

from .functions.entities import unescape_entities
from .functions.html import tag_attributes, tokenize_html
from .functions.paths import local_path, parent_folder, query_to_name, relative_path, resolve_path, sanitize_name
from .functions.urls import (
    canonical_url,
    clean_root,
    file_ext,
    is_excluded,
    is_http,
    netloc_of,
    normalize_url,
    resolve_url,
    same_domain,
    strip_fragment,
    url_parts,
)
from .operators.frontier import crawl_report, enqueue, frontier_counts, mark_visited, merge_state, next_batch
from .operators.graph import crawl_levels
from .operators.integrity import mirror_integrity, relative_targets
from .operators.links import (
    asset_refs,
    classify_pages,
    css_refs,
    exclude_links,
    external_links,
    extract_links,
    flag_interstitial,
    internal_links,
    link_set,
    page_link_counts,
    page_title,
    static_refs,
    tokenize,
)
from .operators.manifest import (
    canonical_duplicates,
    canonical_forms,
    canonicalize,
    colliding_urls,
    missing_resources,
    path_collisions,
    path_manifest,
    pending_resources,
    resolve_cached,
    resource_manifest,
)
from .operators.rewrite import rewrite_css, rewrite_links, rewrite_pages, rewrite_static, rewrite_styles
from .operators.robots import parse_robots, robots_policy, robots_sitemaps, robots_verdict
from .operators.schedule import crawl_schedule, retry_plan
from .operators.sitemaps import new_sitemaps, parse_sitemaps, seed_frontier, sitemap_counts
from .sources.mirror import read_mirror, write_mirror
from .sources.readers import read_pages, read_resources, read_robots, read_sitemaps, stream_pages
from .sources.state import (
    CrawlState,
    append_changes,
    compact_changes,
    mark_seen,
    read_changes,
    read_state,
    write_state,
)
from .streaming.jobs import stream_frontier, stream_links, stream_rewrite, stream_state

__all__ = [name for name in dir() if not name.startswith("_")]
