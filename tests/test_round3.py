"""Crawl levels as the scheduler runs them."""

import uuid

from pyspark.sql import functions as F

from pagewright.functions.urls import canonical_url
from pagewright.operators.graph import next_level
from pagewright.plans import inputs as i
from pagewright.plans.catalog import QUERIES


def test_level_moves_only_new_targets(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    edges, levels = f"e_{uuid.uuid4().hex}", f"l_{uuid.uuid4().hex}"
    try:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        pairs = spark.range(50).select(F.concat(F.lit("http://h/"), F.col("id")).alias("src"), F.concat(F.lit("http://h/"), F.col("id") + 1).alias("dst"))
        pairs.write.bucketBy(n, "src").option("path", str(tmp_path / "e")).saveAsTable(edges)
        start = spark.createDataFrame([("http://h/0", None, 0)], "url string, parent string, level int")
        start.write.partitionBy("level").bucketBy(n, "url").option("path", str(tmp_path / "l")).saveAsTable(levels)
        reached = next_level(spark.table(edges), spark.table(levels), 0)
        plan = reached._jdf.queryExecution().executedPlan().toString()
        # the new targets and the frontier move; the reached URLs do not
        moves = [line.strip() for line in plan.splitlines() if "Exchange" in line]
        assert len(moves) == 2 and "hashpartitioning(dst" in moves[0] and "hashpartitioning(src" in moves[1]
        assert [tuple(r) for r in reached.collect()] == [("http://h/1", "http://h/0", 1)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"drop table if exists {edges}")
        spark.sql(f"drop table if exists {levels}")


def test_levels_follow_only_html_pages(spark, sf_dir):
    got = QUERIES["a_levels"](spark, sf_dir).collect()
    assert got and {r.level for r in got if r.parent is None} == {0}
    typed = i.typed_pages(spark, sf_dir).select(canonical_url("url").alias("c"), "content_type", "html").collect()
    stops = {r.c for r in typed if "text/html" not in r.content_type.lower() or not r.html}
    follows = {r.c for r in typed} - stops
    parents = spark.createDataFrame([(r.parent,) for r in got if r.parent is not None], "url string")
    forms = {r.c for r in parents.select(canonical_url("url").alias("c")).distinct().collect()}
    # every parent is a page that is served as HTML with a body; some pages are not
    assert forms and stops and forms <= follows


def test_pages_are_cut_once_and_parts_do_not_move(spark, sf_dir):
    from pagewright.operators.rewrite import rewrite_pages

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = rewrite_pages(i.pages(spark, sf_dir), i.resource_map(spark, sf_dir), i.ROOT, "out")
        plan = done._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.splitlines() if "FileScan" in line]
        # the html was read and cut once, when the cut table was written; the
        # result reads its parts and its narrow column of references
        assert not any("html" in line for line in scans)
        assert sum("parts" in line for line in scans) == 1 and sum("refs" in line for line in scans) == 1
        parts_scan = next(n for n, line in enumerate(plan.splitlines()) if "FileScan" in line and "parts" in line)
        above = plan.splitlines()[parts_scan - 1]
        assert "Exchange" not in above
        assert done.count() == i.pages(spark, sf_dir).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _random_sheet(rng):
    parts = ["@media print", "@import url(a.css)", "@import 'b.css';", "@font-face", "@page", "@Page :first", "{", "}", "{", "}",
             "a", " ", "h1", ":", ";", "url(/x.png)", "url( 'y.png' )", '"url(z.png) s"', "'q'", "/* { */", "/* open", "'open",
             "@supports (x: {y})", "@x", "@", "\n", "u", "url(", "b{c:url(d)}", "@media screen{p{x:url(/m.png)}}"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(0, 25)))


def test_sheet_pieces_in_the_jvm_equal_the_reader(spark):
    import random

    from pagewright.functions.css import split_sheet, with_sheet_pieces

    rng = random.Random(11)
    sheets = [_random_sheet(rng) for _ in range(400)] + ["", None, "@media a{" * 5 + "}" * 3, "}}{{@m{x}}", "@a{b}c{d}@e{"]
    rows = [(n, s, "x") for n, s in enumerate(sheets)] + [(len(sheets), sheets[0], "x")]
    df = spark.createDataFrame(rows, "n long, content string, pieces string").drop("pieces").repartition(3)
    for nested in (False, True):
        got = {r.n: r.pieces for r in with_sheet_pieces(df, "content", nested).collect()}
        for n, s, _ in rows:
            assert got[n] == (None if s is None else split_sheet(s, nested)), (s, nested)


def test_style_sheet_queries_stay_in_the_jvm(spark, sf_dir):
    for name in ("x_css", "x_css_nested", "x_css_sheets", "r_css"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not any(n in plan for n in ("ArrowEvalPython", "BatchEvalPython", "PythonUDF", "MapInArrow")), name


def test_parent_segments_fold_like_a_stack_and_in_one_pass(spark):
    import random
    import time

    from pagewright.functions.urls import fold_parents_sql, resolve_url

    def stack(path):
        out = []
        for s in path.split("/"):
            if s == "..":
                if out:
                    out.pop()
            else:
                out.append(s)
        return out

    rng = random.Random(5)
    paths = ["/".join(rng.choice(["a", "b", "..", "", ".."]) for _ in range(rng.randrange(0, 14))) for _ in range(2000)]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for r in df.select("p", F.expr(fold_parents_sql("split(p, '/')")).alias("n")).collect():
        assert r.n == stack(r.p), r.p
    n = 100_000
    deep = spark.createDataFrame([("a/" * n + "../" * n + "x",)], "p string")
    start = time.time()
    assert deep.select(resolve_url(F.lit("http://h/b/"), "p")).first()[0] == "http://h/b/x"
    assert time.time() - start < 20


def test_large_batches_are_cut_without_one_task_holding_them(spark):
    import random

    from pagewright.operators import frontier

    rng = random.Random(2)
    rows = [(f"http://h/{rng.randrange(400):04d}", rng.choice([None, 0, 1, 1, 2]), rng.choice(["pending", "pending", "visited"]))
            for _ in range(900)]
    state = spark.createDataFrame(rows, "url string, level int, status string").repartition(4)
    pending = sorted(((lv is not None, lv or 0), u) for u, lv, s in rows if s == "pending")
    for n in (0, 1, 37, 150, 300, len(pending), len(pending) + 5):
        got = sorted(((r.level is not None, r.level or 0), r.url) for r in frontier.next_batch(state, n, take=-1).collect())
        assert got == pending[:n]
        small = sorted(((r.level is not None, r.level or 0), r.url) for r in frontier.next_batch(state, n).collect())
        assert small == got


def test_two_state_writers_get_two_versions(spark, tmp_path):
    import threading

    from pagewright.sources import state

    path = str(tmp_path / "state")
    base = state.read_state(spark, path)
    made = [base._replace(url_state=spark.createDataFrame([(f"http://h/{k}", "pending", None, 0, None)], base.url_state.schema))
            for k in range(4)]
    got = []
    threads = [threading.Thread(target=lambda m=m: got.append(state.write_state(path, m))) for m in made]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == [1, 2, 3, 4] == state.state_versions(spark, path)
    urls = {state.read_state(spark, path, v).url_state.first().url for v in got}
    assert urls == {f"http://h/{k}" for k in range(4)}


def test_pages_not_served_as_html_give_no_links_and_keep_their_bytes(spark):
    from pagewright.operators import links
    from pagewright.operators.rewrite import rewrite_pages

    html = '<a href="/b">b</a><img src="/i.png">'
    pages = spark.createDataFrame(
        [(1, "http://h.com/a", html, "image/png"), (2, "http://h.com/c", html, "Text/HTML; charset=utf-8"), (3, "http://h.com/d", html, None)],
        "page_id long, url string, html string, content_type string",
    )
    # a missing type counts as HTML, as for the outcome of a capture
    assert {r.page_id for r in links.extract_links(pages).collect()} == {2, 3}
    assert {r.page_id for r in links.link_set(pages, "h.com").collect()} == {2, 3}
    done = {r.page_id: r.html for r in rewrite_pages(pages, None, "h.com", "out").collect()}
    assert done[1] == html and done[2] != html and done[3] != html
