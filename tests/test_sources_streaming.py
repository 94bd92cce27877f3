"""Readers, state, mirror and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagewright import schemas
from pagewright.operators.frontier import enqueue
from pagewright.operators.links import link_set
from pagewright.operators.rewrite import rewrite_links, rewrite_pages
from pagewright.sources import mirror, readers, state
from pagewright.streaming import jobs

AT = dt.datetime(2024, 1, 1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_read_pages_prunes_and_moves_nothing(spark, sf_dir):
    df = readers.read_pages(spark, f"{sf_dir}/pages.parquet")
    assert df.schema == schemas.PAGES and "Exchange" not in df._jdf.queryExecution().toString()
    plan = df.select("url")._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan.split("ReadSchema")[1]


def test_text_sources(spark, tmp_path):
    (tmp_path / "h.com.txt").write_text("User-agent: *\nDisallow: /x\n")
    (tmp_path / "map.xml").write_text("<urlset/>")
    (tmp_path / "css").mkdir()
    (tmp_path / "css" / "s.css").write_text("a{b:url(x)}")
    r = readers.read_robots(spark, str(tmp_path), text_files=True).first()
    assert (r.host, r.status_code, r.body) == ("h.com", 200, "User-agent: *\nDisallow: /x\n")
    assert readers.read_sitemaps(spark, str(tmp_path), "http://h.com").first().sitemap_url == "http://h.com/map.xml"
    found = {x.url: x.content_type for x in readers.read_resources(spark, str(tmp_path), "http://h.com").collect()}
    assert found["http://h.com/css/s.css"] == "text/css" and len(found) == 3
    out = str(tmp_path / "r.parquet")
    spark.createDataFrame([("u", "image/png", bytearray(b"\xff\xfe")), ("v.css", "text/css", bytearray(b"a\xff"))],
                          "url string, content_type string, content binary").write.parquet(out)
    assert rows(readers.read_resources(spark, out)) == [("u", "image/png", None), ("v.css", "text/css", "a\ufffd")]


def test_versions_are_seen_only_once_committed(spark, tmp_path):
    path = str(tmp_path / "state")
    empty = state.read_state(spark, path)
    assert empty.url_state.count() == 0
    urls = spark.createDataFrame([("a",)], "url string")
    first = empty._replace(url_state=enqueue(empty.url_state, urls))
    assert state.write_state(path, first) == 1
    held = state.read_state(spark, path)
    grown = held._replace(url_state=enqueue(held.url_state, spark.createDataFrame([("b",)], "url string")))
    assert state.write_state(path, grown) == 2 and state.read_state(spark, path).url_state.count() == 2
    assert state.read_state(spark, path, 1).url_state.count() == 1
    (tmp_path / "state" / "v=3").mkdir()
    assert state.state_versions(spark, path) == [1, 2]
    with pytest.raises(ValueError):
        state.read_state(spark, path, 3)


def test_mirror_layouts(spark, sf_dir, tmp_path):
    df = rewrite_links(readers.read_pages(spark, f"{sf_dir}/pages.parquet"), "example.com", "out")
    want = rows(df.select("page_id", "local_path", F.md5("html")))
    for by in ("bucket", "host", None):
        path = str(tmp_path / f"m-{by}")
        mirror.write_mirror(df, path, by, buckets=4)
        assert rows(mirror.read_mirror(spark, path).select("page_id", "local_path", F.md5("html"))) == want
    with pytest.raises(ValueError):
        mirror.write_mirror(df, str(tmp_path / "x"), "size")


def drop(pages, folder, part):
    """Hand over half of the pages as one file."""
    pages.filter(F.col("page_id") % 2 == part).coalesce(1).write.mode("append").parquet(folder)


def run(stream, out, checkpoint):
    q = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    q.awaitTermination()


def test_stream_frontier_emits_each_url_once_over_restarts(spark, sf_dir, tmp_path):
    pages = spark.read.schema(schemas.PAGES).parquet(f"{sf_dir}/pages.parquet")
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for part in (0, 1):
        drop(pages, src, part)
        run(jobs.stream_frontier(readers.stream_pages(spark, src), "example.com"), out, ck)
    run(jobs.stream_frontier(readers.stream_pages(spark, src), "example.com"), out, ck)
    got = rows(spark.read.parquet(out))
    assert got == rows(link_set(pages, "example.com").select("dst_url").distinct())


def test_stream_links_and_bounded_frontier(spark, sf_dir, tmp_path):
    pages = spark.read.schema(schemas.PAGES).parquet(f"{sf_dir}/pages.parquet")
    src = str(tmp_path / "in")
    drop(pages, src, 0)
    stream = readers.stream_pages(spark, src, files_per_batch=1)
    run(jobs.stream_links(stream, "example.com", ["/the"]), str(tmp_path / "o1"), str(tmp_path / "c1"))
    even = pages.filter("page_id % 2 = 0")
    assert rows(spark.read.parquet(str(tmp_path / "o1"))) == rows(link_set(even, "example.com", ["/the"]))
    timed = stream.withColumn("at", F.lit(AT).cast("timestamp"))
    run(jobs.stream_frontier(timed, "example.com", event_time="at", window="1 hour").select("url"), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert rows(spark.read.parquet(str(tmp_path / "o2"))) == rows(link_set(even, "example.com").select("dst_url").distinct())
    with pytest.raises(ValueError):
        jobs.stream_frontier(stream, event_time="at")


def test_state_log_is_idempotent_and_compacts(spark, sf_dir, tmp_path):
    pages = spark.read.schema(schemas.PAGES).parquet(f"{sf_dir}/pages.parquet")
    src, log, ck = (str(tmp_path / n) for n in ("in", "log", "ck"))
    for part in (0, 1):
        drop(pages, src, part)
        jobs.stream_state(readers.stream_pages(spark, src), log, ck, "example.com", at=AT).awaitTermination()
    got = rows(state.read_changes(spark, log))
    whole = jobs.page_changes(pages, "example.com", [], AT)
    from pagewright.operators.frontier import merge_state
    assert got == rows(merge_state(whole))
    # a replay of the last batch changes nothing
    state.append_changes(jobs.page_changes(pages.filter("page_id % 2 = 1"), "example.com", [], AT), log, 1)
    assert rows(state.read_changes(spark, log)) == got
    assert state.compact_changes(spark, log) == 1 and rows(state.read_changes(spark, log)) == got
    extra = spark.createDataFrame([("http://new/", "pending", None, None, None)], schemas.URL_STATE)
    state.append_changes(extra, log, 2)
    assert state.read_changes(spark, log).count() == len(got) + 1
    assert state.compact_changes(spark, log) == 2 and state.read_changes(spark, log).count() == len(got) + 1


def test_stream_rewrite_equals_batch(spark, sf_dir, tmp_path):
    pages = spark.read.schema(schemas.PAGES).parquet(f"{sf_dir}/pages.parquet")
    assets = spark.createDataFrame([("http://example.com/a.png", "out/example.com/a.png")], schemas.RESOURCE_MAP)
    src = str(tmp_path / "in")
    drop(pages, src, 0)
    jobs.stream_rewrite(readers.stream_pages(spark, src), assets, "example.com", str(tmp_path / "o"), str(tmp_path / "c"), "out").awaitTermination()
    even = rewrite_pages(pages.filter("page_id % 2 = 0"), assets, "example.com", "out")
    cols = ["page_id", "url", "local_path", "html"]
    assert rows(spark.read.parquet(str(tmp_path / "o")).select(*cols)) == rows(even.select(*cols))
