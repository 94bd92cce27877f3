"""State table, sitemaps, schedule, retries, manifests and crawl levels."""

import datetime as dt
import random
import xml.etree.ElementTree as ET
from collections import deque

import pytest
from pyspark.sql import functions as F

from pagewright.operators import frontier, graph, manifest, schedule, sitemaps
from pagewright.operators.robots import robots_policy

STATE = "url string, status string, last_fetched timestamp, level int, outcome string"
T1, T2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)


def state(spark):
    return spark.createDataFrame(
        [("a", "visited", T1, 0, "saved"), ("b", "pending", None, 1, None), ("c", "pending", None, 1, None)], STATE)


def table(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_enqueue_ignores_known_and_repeated_urls(spark):
    found = spark.createDataFrame([("a", 5), ("d", 3), ("d", 2), ("e", 9)], "url string, level int")
    out = frontier.enqueue(state(spark), found)
    assert table(out, "url", "status", "level") == [
        ("a", "visited", 0), ("b", "pending", 1), ("c", "pending", 1), ("d", "pending", 2), ("e", "pending", 9)]
    assert frontier.enqueue(out, found).count() == 5


def test_mark_visited(spark):
    done = spark.createDataFrame([("b", "denied"), ("b", "denied"), ("zz", "saved")], "url string, outcome string")
    out = frontier.mark_visited(state(spark), done, T2)
    assert table(out, "url", "status", "outcome")[:2] == [("a", "visited", "saved"), ("b", "visited", "denied")]
    assert out.count() == 3 and out.filter("url = 'b'").first().last_fetched == T2
    assert out.filter("url = 'a'").first().last_fetched == T1


def test_next_batch_counts_and_report(spark):
    assert [r.url for r in frontier.next_batch(state(spark), 1).collect()] == ["b"]
    assert table(frontier.frontier_counts(state(spark)), "status", "n") == [("pending", 2), ("visited", 1)]
    rows = spark.createDataFrame([(f"http://h/{i}", "visited", T1, 0, o) for i, o in enumerate(frontier.OUTCOMES * 2)], STATE)
    r = frontier.crawl_report(rows).first()
    assert r.host == "h" and r.visited == 10 and all(r[o] == 2 for o in frontier.OUTCOMES)


def test_merge_state_does_not_depend_on_order_or_repeats(spark):
    rows = [("u", "pending", None, 3, None), ("u", "visited", T1, None, "failed"), ("u", "visited", T2, 7, "saved"), ("u", "pending", None, 1, None)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        out = frontier.merge_state(spark.createDataFrame(rows * 2, STATE)).collect()
        assert [(r.url, r.status, r.last_fetched, r.level, r.outcome) for r in out] == [("u", "visited", T2, 1, "saved")]


NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
BODIES = {
    "two": f"<?xml version='1.0'?><urlset {NS}><url><loc> http://h/a?x=1&amp;y=2 </loc></url><url><loc>http://h/b</loc></url></urlset>",
    "both": f"<urlset {NS}><url><loc>http://h/a</loc><loc>http://h/b</loc></url></urlset>",
    "cut": f"<urlset {NS}><url><loc>http://h/a</loc></url>", "junk": "not xml", "nons": "<urlset><url><loc>x</loc></url></urlset>",
    "index": f"<sitemapindex {NS}><sitemap><loc>http://h/s</loc></sitemap></sitemapindex>",
    "prefix": f"<s:urlset {NS.replace('xmlns', 'xmlns:s')}><s:url><s:loc>http://h/p</s:loc></s:url></s:urlset>",
    "other": "<urlset xmlns='http://o/'><url><loc>x</loc></url></urlset>",
    "image": f"<urlset {NS} xmlns:image='http://i/'><url><loc>http://h/a</loc><image:image><image:loc>no</image:loc></image:image></url></urlset>",
    "one": f"<urlset {NS}><url><loc>http://h/only</loc></url></urlset>", "none": f"<urlset {NS}></urlset>",
}


def xml_locs(body):
    try:
        found = ET.fromstring(body).findall("n:url/n:loc", {"n": "http://www.sitemaps.org/schemas/sitemap/0.9"})
    except ET.ParseError:
        return []
    return [e.text.strip() for e in found]


def test_sitemaps_match_an_xml_parser(spark):
    df = spark.createDataFrame(list(BODIES.items()), "sitemap_url string, body string")
    want = sorted((n, loc) for n, b in BODIES.items() for loc in xml_locs(b))
    assert table(sitemaps.parse_sitemaps(df), "sitemap_url", "loc") == want
    assert ("two", 2) in table(sitemaps.sitemap_counts(sitemaps.parse_sitemaps(df)), "sitemap_url", "n_urls")
    empty = spark.createDataFrame([("e", BODIES["two"].replace("<url>", "<url><loc/></url><url>", 1))], "sitemap_url string, body string")
    assert sitemaps.parse_sitemaps(empty).count() == 2


def test_seed(spark):
    robots = spark.createDataFrame([("h.com", 200, "Sitemap: http://h.com/a.xml\nsitemap:http://h.com/seen.xml"), ("o.com", 200, "Sitemap: http://o.com/b.xml")],
                                   "host string, status_code int, body string")
    def body(u):
        return f"<urlset {NS}><url><loc>{u}</loc></url></urlset>"
    maps = spark.createDataFrame(
        [("http://h.com/a.xml", body("http://h.com/x/")), ("http://h.com/seen.xml", body("http://h.com/no")), ("http://o.com/b.xml", body("http://h.com/no2")),
         ("http://h.com/sitemap.xml", f"<urlset {NS}><url><loc>http://h.com/d</loc><loc>http://o.com/z</loc><loc>http://h.com/skip</loc></url></urlset>")],
        "sitemap_url string, body string")
    seen = spark.createDataFrame([("http://h.com/seen.xml",)], "url string")
    out = sitemaps.seed_frontier("http://h.com", robots, maps, seen, ["skip"])
    assert table(out, "url") == [("http://h.com",), ("http://h.com/d",), ("http://h.com/x/",)]
    only = sitemaps.seed_frontier("http://h.com", robots, maps, seen, fallback_only=True)
    assert table(only, "url") == [("http://h.com",), ("http://h.com/x/",)]
    lone = sitemaps.seed_frontier("http://h.com", robots.filter("host = 'o.com'"), maps, None, fallback_only=True)
    assert ("http://h.com/d",) in table(lone, "url")


def test_schedule_ranks_every_url_of_a_hot_host_once(spark):
    urls = [("http://hot.com/%d" % i, i % 3) for i in range(3000)] + [("http://h%d.com/" % i, None) for i in range(50)]
    robots = spark.createDataFrame([("hot.com", 200, "User-agent: *\nCrawl-delay: 4")], "host string, status_code int, body string")
    out = schedule.crawl_schedule(spark.createDataFrame(urls, "url string, level int"), robots_policy(robots, "z"), 0.5).collect()
    hot = sorted((r.seq, r.level, r.offset_seconds) for r in out if r.host == "hot.com")
    assert [h[0] for h in hot] == list(range(3000)) and [h[1] for h in hot] == sorted(h[1] for h in hot)
    assert all(o == 4.0 * s for s, _, o in hot) and len(out) == 3050
    assert all(r.seq == 0 and r.offset_seconds == 0 for r in out if r.host != "hot.com")
    assert schedule.crawl_schedule(spark.createDataFrame(urls, "url string, level int"), None).count() == 3050


def test_retry_plan(spark):
    tries = [("five", n, False) for n in range(1, 6)] + [("won", 1, False), ("won", 2, False), ("won", 3, True), ("won", 4, False)]
    tries += [("first", 1, True), ("late", 6, True), ("late", 5, False), ("dup", 1, False), ("dup", 1, False)]
    out = {r.url: r for r in schedule.retry_plan(spark.createDataFrame(tries, "url string, attempt int, ok boolean")).collect()}
    assert (out["five"].failures, out["five"].exhausted, out["five"].next_wait, out["five"].total_wait) == (5, True, 16.0, 31.0)
    assert (out["won"].failures, out["won"].done, out["won"].next_wait, out["won"].total_wait) == (2, True, None, 3.0)
    assert (out["first"].failures, out["first"].done, out["late"].failures, out["dup"].failures) == (0, True, 1, 1)
    for k, wait in enumerate([1.0, 2.0, 4.0, 8.0, 16.0], 1):
        rows = spark.createDataFrame([("u", n, False) for n in range(1, k + 1)], "url string, attempt int, ok boolean")
        assert schedule.retry_plan(rows).first().next_wait == wait
        assert wait <= schedule.retry_plan(rows, jitter_seed=1).first().next_wait < wait + 0.5
    with pytest.raises(ValueError):
        schedule.retry_plan(rows, max_retries=0)


def test_collisions_and_duplicates_list_every_member(spark):
    urls = ["http://h.com/a", "http://h.com/a/index.html", "http://h.com/a?x=1&y=2", "http://h.com/a?x_1=y_2", "http://h.com/b", "http://h.com/b"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert table(manifest.path_collisions(df, "out"), "local_path", "n_urls") == [
        ("out/h.com/a/index.html", 2), ("out/h.com/a/index__x_1_y_2.html", 2)]
    assert manifest.colliding_urls(df, "out").count() == 4
    forms = spark.createDataFrame([("http://h/a#x",), ("http://h/a/",), ("http://h/a/?q=1",), ("http://h/c",)], "url string")
    assert table(manifest.canonical_duplicates(forms), "canonical", "n_forms", "first_form") == [("http://h/a", 3, "http://h/a#x")]
    assert manifest.canonical_forms(forms).count() == 3


def test_resource_tables(spark):
    refs = spark.createDataFrame([("http://h.com/a.png",), ("http://h.com/a.png",), ("http://o.com/b.png",), ("data:x",)], "dst_url string")
    known = spark.createDataFrame([("http://h.com/a.png", "p1")], "url string, local_path string")
    assert table(manifest.resolve_cached(refs.filter("dst_url like 'http%'"), known), "dst_url")[0] == ("http://h.com/a.png",)
    assert manifest.resolve_cached(refs, known).filter("local_path is not null").count() == 2
    sheet = spark.createDataFrame([("http://cdn.com/f.woff",), ("data:y",)], "dst_url string")
    assert table(manifest.pending_resources(refs, sheet, known, "h.com"), "url") == [("http://cdn.com/f.woff",)]
    assert table(manifest.missing_resources(refs, known), "url", "n_refs") == [("data:x", 1), ("http://o.com/b.png", 1)]
    assert table(manifest.resource_manifest(refs.limit(3), "out"), "url", "local_path") == [
        ("http://h.com/a.png", "out/h.com/a.png"), ("http://o.com/b.png", "out/o.com/b.png")]


def bfs(edges, roots, denied=(), depth=None):
    out, queue = {r: 0 for r in roots}, deque(roots)
    while queue:
        u = queue.popleft()
        if u in denied or (depth is not None and out[u] == depth):
            continue
        for s, d in edges:
            if s == u and d not in out:
                out[d] = out[u] + 1
                queue.append(d)
    return out


def test_crawl_levels_match_brute_force(spark):
    rng = random.Random(4)
    nodes = [f"http://h.com/{i}" for i in range(40)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(70)] + [(nodes[0], nodes[1]), (nodes[1], nodes[0])]
    links = spark.createDataFrame(edges * 2, "src_url string, dst_url string")
    roots = spark.createDataFrame([(nodes[0],)], "url string")
    got = {r.url: (r.level, r.parent) for r in graph.crawl_levels(links, roots).collect()}
    want = bfs(edges, [nodes[0]])
    assert {u: l for u, (l, _) in got.items()} == want
    for u, (level, parent) in got.items():
        assert parent == min((s for s, d in edges if d == u and want.get(s) == level - 1), default=None)
    denied = spark.createDataFrame([(nodes[1], False), (nodes[2], True)], "url string, allowed boolean")
    got = {r.url: r.level for r in graph.crawl_levels(links, roots, "h.com", verdicts=denied, max_depth=3).collect()}
    assert got == bfs(edges, [nodes[0]], {nodes[1]}, 3)
    assert {r.url: r.level for r in graph.crawl_levels(links, roots, buckets=0).collect()} == want
    assert graph.crawl_levels(links, roots, exclude=["h.com"]).count() == 1
    assert graph.crawl_levels(links, roots, root="other.org").count() == 1


def test_crawl_follows_links_of_pages_spelled_otherwise(spark):
    links = spark.createDataFrame([("http://h.com/a/#x", "http://h.com/b"), ("http://h.com/r", "http://h.com/a")], "src_url string, dst_url string")
    roots = spark.createDataFrame([("http://h.com/r",)], "url string")
    assert graph.crawl_levels(links, roots).select(F.max("level")).first()[0] == 2
