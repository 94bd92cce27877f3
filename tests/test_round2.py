"""Cases that earlier catalogued data did not hold."""

import time

import pytest
from pyspark.sql import functions as F

from pagewright.functions.css import split_sheet
from pagewright.functions.paths import query_to_name
from pagewright.functions.urls import resolve_url
from pagewright.operators.graph import crawl_levels
from pagewright.operators.links import css_refs, extract_links
from pagewright.operators.rewrite import rewrite_css
from pagewright.operators.schedule import retry_plan
from pagewright.sources.readers import read_resources, read_sitemaps
from pagewright.streaming.jobs import page_changes

SHEETS = {
    "@media a{x{y{z{w{b:url(q.png)}}}}} k{b:url(top.png)}": ["top.png"],
    "@media a{p{content:\"}\";} r{x:url(in.png)}} q{y:url(top.png)}": ["top.png"],
    "@media a{/* } */ p{x:url(in.png)}} q{y:url(top.png)}": ["top.png"],
    "q{y:url(top.png)} @media a{p{x:url(in.png)}": ["top.png"],
    "@import url(a.css); @charset \"x\"; @font-face{src:url(f.woff)} @page{b:url(p.png)}": ["f.woff", "p.png"],
    "a{b:'\\'}' url(n.png)} c{d:\"url(s.png)\"} /* url(c.png) */ e{f:url(": ["n.png", "s.png"],
    "@import url(end.css)": [], "": [],
}


def test_sheets_of_any_depth(spark):
    rows = [(f"http://h/{k}.css", s) for k, s in enumerate(SHEETS)]
    sheets = spark.createDataFrame(rows, "url string, content string")
    got = {u: [] for u, _ in rows}
    for r in css_refs(sheets).collect():
        got[r.css_url].append(r.raw)
    assert [sorted(got[u]) for u, _ in rows] == [sorted(x) for x in SHEETS.values()]
    nested = {r.raw for r in css_refs(sheets, nested=True).collect()}
    assert {"q.png", "in.png", "top.png", "f.woff"} <= nested and not {"a.css", "end.css", "c.png"} & nested
    for sheet in SHEETS:
        assert "".join(split_sheet(sheet, False)) == "".join(split_sheet(sheet, True)) == sheet


def test_rewriting_leaves_skipped_blocks_alone(spark):
    sheet = "@media a{p{content:\"}\";} r{x:url(in.png)}} q{y:url(in.png)}"
    sheets = spark.createDataFrame([("http://h/c/s.css", sheet)], "url string, content string")
    assets = spark.createDataFrame([("http://h/c/in.png", "h/c/in.png")], "url string, local_path string")
    assert rewrite_css(sheets, assets).first().content == sheet  # already beside the sheet
    moved = assets.withColumn("local_path", F.lit("h/i/in.png"))
    assert rewrite_css(sheets, moved).first().content == sheet[:-len("url(in.png)}")] + "url(../i/in.png)}"


def test_sheet_splitter_is_linear():
    start = time.perf_counter()
    split_sheet("@a" * 500_000, False)
    split_sheet("@a{" * 300_000, False)
    split_sheet("a{b:url(x)}" * 100_000, True)
    assert time.perf_counter() - start < 20


def seconds(df):
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


@pytest.mark.parametrize("make, small", [
    (lambda spark, n: spark.range(1).select(resolve_url(F.lit("http://h/"), F.concat(F.lit("./"), F.repeat(F.lit("a/"), n), F.lit("b")))), 10_000),
    (lambda spark, n: spark.range(1).select(query_to_name(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.concat(F.lit("k"), k % (n // 2))), "&"), F.lit("s"))), 5_000),
    (lambda spark, n: extract_links(spark.range(1).select(F.lit(1).alias("page_id"), F.lit("http://h/").alias("url"), F.concat(
        F.lit("<p "), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.concat(F.lit("data-a"), k, F.lit("=/x"))), " "), F.lit(">")).alias("html"))), 5_000),
])
def test_long_inputs_take_linear_time(spark, make, small):
    seconds(make(spark, 100))  # compiles
    before, after = seconds(make(spark, small)), seconds(make(spark, 4 * small))
    assert after < 9 * max(before, 0.3)


def test_dots_fold_as_before(spark):
    from urllib.parse import urljoin

    links = ["../../x", "a/./b/../c", "..", ".", "./", "a/..", "../..", "/../a/./", "a/b/../../../c/..", "/a/b/../..", "....//a/.."]
    rows = spark.createDataFrame([(x,) for x in links], "x string")
    got = {r[0]: r[1] for r in rows.select("x", resolve_url(F.lit("http://h/p/q/r"), "x")).collect()}
    assert got == {x: urljoin("http://h/p/q/r", x) for x in links}


def test_last_data_attribute_counts(spark):
    page = spark.createDataFrame([(1, "http://h/", "<p data-b=/1 data-a=/2 data-b=x data-c=/3 data-c=/4>")], "page_id long, url string, html string")
    assert [r.raw for r in extract_links(page, ["data_attr"]).collect()] == ["/2", "/4"]


@pytest.mark.parametrize("start", ["http://h/a", "http://h/a/"])
def test_levels_follow_roots_in_any_form(spark, start):
    links = spark.createDataFrame([("http://h/a/", "http://h/b"), ("http://h/b", "http://h/c"), ("http://h/b", "http://h/d/")], "src_url string, dst_url string")
    roots = spark.createDataFrame([(start,)], "url string")
    verdicts = spark.createDataFrame([("http://h/b/", False)], "url string, allowed boolean")
    got = {(r.url, r.level, r.parent) for r in crawl_levels(links, roots, buckets=0).collect()}
    assert got == {(start, 0, None), ("http://h/b", 1, start), ("http://h/c", 2, "http://h/b"), ("http://h/d/", 2, "http://h/b")}
    got = {r.url for r in crawl_levels(links, roots, verdicts=verdicts).collect()}
    assert got == {start, "http://h/b"}


def test_a_hundred_retries(spark):
    rows = [("u", k, False) for k in range(1, 100)] + [("u", 100, True), ("v", 3, True), ("v", 1, False), ("v", 4, False), ("v", 1, False)]
    tries = spark.createDataFrame(rows, "url string, attempt int, ok boolean")
    got = {r.url: r for r in retry_plan(tries, max_retries=100).collect()}
    assert (got["u"].failures, got["u"].done, got["u"].exhausted) == (99, True, False)
    assert (got["v"].failures, got["v"].done, got["v"].total_wait) == (1, True, 1.0)
    odd = {r.url: r for r in retry_plan(tries, max_retries=5, jitter_seed=3).collect()}
    assert odd["u"].exhausted and 31 < odd["u"].total_wait <= 33.5 and 16 <= odd["u"].next_wait <= 16.5


def test_latest_robots_file_counts(spark):
    from pagewright.operators.robots import robots_policy

    rows = [("h", 503, None, 1), ("h", 200, "User-agent: *\nDisallow: /x", 2), ("g", 503, None, 2), ("g", 200, "", 1)]
    robots = spark.createDataFrame(rows, "host string, status_code int, body string, captured_at int")
    assert {r.host: r["read"] for r in robots_policy(robots, "a").collect()} == {"h": "rules", "g": "deny"}
    assert {r["read"] for r in robots_policy(robots.drop("captured_at"), "a").collect()} == {"deny"}


def test_files_in_sub_folders_keep_their_place(spark, tmp_path):
    for place in ("x/map.xml", "y/ma p+1.xml", "top.xml"):
        (tmp_path / place).parent.mkdir(exist_ok=True)
        (tmp_path / place).write_text("<urlset/>")
    got = {r.sitemap_url for r in read_sitemaps(spark, str(tmp_path), "http://h/").collect()}
    assert got == {"http://h/x/map.xml", "http://h/y/ma p+1.xml", "http://h/top.xml"}
    folder = tmp_path / "r"
    (folder / "r").mkdir(parents=True)
    (folder / "r" / "a.css").write_text("p{}")
    assert [r.url for r in read_resources(spark, str(folder), "http://h").collect()] == ["http://h/r/a.css"]


def test_captures_keep_every_outcome(spark):
    link = '<a href="/n">'
    rows = [("http://h/a/", link, "text/html; charset=x", 200), ("http://h/b", link, "image/png", 200), ("http://h/c", link, "text/html", 503),
            ("http://h/d", "", "text/html", 200), ("http://h/e", link, None, None)]
    pages = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string, content_type string, status_code int")
    changes = page_changes(pages, "h", (), None)
    got = {(r.url, r.outcome) for r in changes.where("status = 'visited'").collect()}
    assert got == {("http://h/a/", "saved"), ("http://h/a", "saved"), ("http://h/b", "non_html"), ("http://h/c", "failed"), ("http://h/d", "empty"), ("http://h/e", "saved")}
    assert {r.url for r in changes.where("status = 'pending'").collect()} == {"http://h/n"}
    assert changes.where("status = 'pending'").count() == 2
