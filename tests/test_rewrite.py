"""Rewriting: exact values, untouched bytes, and closure of the mirror."""

from pyspark.sql import functions as F

from pagewright.operators import integrity, rewrite
from pagewright.operators.manifest import resource_manifest
from pagewright.operators.links import static_refs

MAP = [("http://h.com/img/a.png", "h.com/img/a.png"), ("http://h.com/s.css?v=3", "h.com/s__v_3.css"),
       ("http://h.com/js/x.js", "h.com/js/x.js"), ("http://cdn.com/f.woff", "cdn.com/f.woff"),
       ("http://h.com/img/q'\"&.png", "h.com/img/q'\"&.png")]


def pages(spark, *htmls, url="http://h.com/en/25"):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], "page_id bigint, url string, html string")


def rmap(spark):
    return spark.createDataFrame(MAP, "url string, local_path string")


def out(df):
    return [r.html for r in df.orderBy("page_id").collect()]


def test_page_links(spark):
    cases = {
        '<a href="/The">t</a>': '<a href="../../The/index.html">t</a>',
        "<A class=x HREF=/The/ id='y'>": "<A class=x HREF=\"../../The/index.html\" id='y'>",
        '<a href="//o.com/x/#f">': '<a href="http://o.com/x">',
        "<a href='?a=1&amp;b=2'>": '<a href="index__a_1_b_2.html">',
        "<a href=mailto:x@y>": '<a href="mailto:x@y">',
        "<a href>": '<a href="index.html">',
        "<form action='/f?q=1'>": '<form action="../../f/index__q_1.html">',
        "<button onclick=\"location.href='/go'\">": "<button onclick=\"location.href='../../go/index.html'\">",
        "<button onclick='go()'>": "<button onclick='go()'>",
        "<video src=/v.mp4></video><source src=http://o.com/s.ogg>": '<video src="../../v.mp4"></video><source src="http://o.com/s.ogg">',
        "<a href='http://o.com/?a=1&amp;b=\"2\"'>": '<a href="http://o.com/?a=1&amp;b=&quot;2&quot;">',
        "<a href='http://[bad'>": "<a href='http://[bad'>",
        "<!-- <a href=/x> --><script>'<a href=/x>'</script>": "<!-- <a href=/x> --><script>'<a href=/x>'</script>",
        "plain < text & <b>": "plain < text & <b>", "": "", "<a href=/x": "<a href=/x",
    }
    assert out(rewrite.rewrite_links(pages(spark, *cases), "h.com")) == list(cases.values())


def test_static_and_styles(spark):
    cases = {
        '<img src="/img/a.png" alt=x><img src=/img/ba.png>': '<img src="../../img/a.png" alt=x><img src=/img/ba.png>',
        "<link rel=stylesheet href='/s.css?v=3#z'>": '<link rel=stylesheet href="../../s__v_3.css">',
        "<script src=/js/x.js>url(/img/a.png)</script>": '<script src="../../js/x.js">url(/img/a.png)</script>',
        "<img src=http://cdn.com/f.woff>": "<img src=http://cdn.com/f.woff>",
        "<style>a{b:url( '/img/a.png' )} c{d:url(/img/ba.png)} e{f:url()}</style>":
            "<style>a{b:url( '../../img/a.png' )} c{d:url(/img/ba.png)} e{f:url()}</style>",
        "<p style='a:url(\"/img/a.png\");b:url(/no)'>": "<p style='a:url(\"../../img/a.png\");b:url(/no)'>",
        '<p style="a:url(&quot;/img/a.png&quot;)">': '<p style="a:url(&quot;../../img/a.png&quot;)">',
        "<p style=a:url(/img/a.png)>": '<p style="a:url(../../img/a.png)">',
        "<img src=\"/img/q'&quot;&amp;.png\">": "<img src=\"../../img/q'&quot;&amp;.png\">",
        "<img src=/no1><img src=/img/a.png><img src=/no2><p style='x:url(/img/a.png)'>":
            "<img src=/no1><img src=\"../../img/a.png\"><img src=/no2><p style='x:url(../../img/a.png)'>",
        "<a href=/keep>": "<a href=/keep>",
    }
    df = rewrite.rewrite_pages(pages(spark, *cases), rmap(spark), "h.com", links=False)
    assert out(df) == list(cases.values())


def test_whole_page_and_switches(spark):
    html = '<a href="/a"><img src="/img/a.png"><p style="x:url(/img/a.png)">'
    full = '<a href="../../a/index.html"><img src="../../img/a.png"><p style="x:url(../../img/a.png)">'
    df, m = pages(spark, html), rmap(spark)
    assert out(rewrite.rewrite_pages(df, m, "h.com")) == [full]
    assert out(rewrite.rewrite_static(df, m, "h.com")) == [html.replace('"/img/a.png"', '"../../img/a.png"')]
    assert out(rewrite.rewrite_styles(df, m, "h.com")) == [html.replace("(/img/a.png)", "(../../img/a.png)")]
    inside = m.withColumn("local_path", F.concat(F.lit("out/"), "local_path"))
    row = rewrite.rewrite_pages(df, inside, "h.com", root_dir="out").first()
    assert row.local_path == "out/h.com/en/25/index.html" and row.html == full


def test_untouched_pages_keep_every_byte(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    same = df.join(rewrite.rewrite_static(df, rmap(spark), "nowhere.test").withColumnRenamed("html", "new"), "page_id")
    assert same.count() == df.count() and same.filter("html <> new").count() == 0


def test_css(spark):
    body = ("@font-face{src:url(//cdn.com/f.woff)} h1{a:url(\"/img/a.png\")} h2{a:url(/img/ba.png)} "
            "@media print{p{b:url(/img/a.png)}} i{b:url(data:x)}")
    res = spark.createDataFrame([("http://h.com/css/s.css", "text/css", body)] * 3 + [("http://h.com/i.png", "x", "url(/img/a.png)")],
                                "url string, content_type string, content string")
    rows = rewrite.rewrite_css(res, rmap(spark)).collect()
    want = body.replace("//cdn.com/f.woff", "../../cdn.com/f.woff").replace('"/img/a.png"', '"../img/a.png"')
    assert [r.content for r in rows] == [want] * 3 and rows[0].local_path == "h.com/css/s.css"
    nested = rewrite.rewrite_css(res, rmap(spark), nested=True).first().content
    assert nested == want.replace("(/img/a.png)", "(../img/a.png)")


def test_integrity(spark):
    html = "<a href=/a><a href=/b><a href=http://o.com/><img src=/img/a.png><a href=#x>"
    done = rewrite.rewrite_pages(pages(spark, html, html), rmap(spark), "h.com")
    manifest = spark.createDataFrame([("h.com/a/index.html",), ("h.com/img/a.png",), ("h.com/en/25/index.html",)], "local_path string")
    rows = integrity.mirror_integrity(done, manifest).collect()
    assert [(r.target_path, r.n_refs, r.first_source) for r in rows] == [("h.com/b/index.html", 2, "h.com/en/25/index.html")]


def test_assets_of_a_page_resolve_in_the_mirror(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn(
        "html", F.concat("html", F.lit("<img src='/i/x.png'>")))
    m = resource_manifest(static_refs(df), "out")
    done = rewrite.rewrite_pages(df, m, "example.com", "out", links=False)
    assert done.filter(F.col("html").contains("/i/x.png'")).count() == df.filter(~F.col("url").contains("example.com")).count()
    assert integrity.mirror_integrity(done.filter(F.col("url").contains("example.com")), m).filter(
        F.col("target_path").endswith(".png")).count() == 0


def test_plans_stay_in_the_jvm_and_links_need_no_shuffle(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(rewrite.rewrite_links(df, "example.com"))
    full = plan(rewrite.rewrite_pages(df, rmap(spark), "example.com"))
    assert "EvalPython" not in full and "CartesianProduct" not in full and "NestedLoop" not in full


def test_a_hot_asset_is_split_and_every_page_answered(spark):
    """A third of all references name one asset; with broadcasts off adaptive
    execution cuts its partition, and the result stays whole."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(20000).repartition(8).select(
            F.col("id").alias("page_id"), F.concat(F.lit("http://h.com/p/"), "id").alias("url"),
            F.when(F.col("id") % 3 == 0, F.lit("<img src='/logo.png'>")).otherwise(
                F.concat(F.lit("<img src='/i/"), F.md5(F.col("id").cast("string")), F.lit(".png'>"))).alias("html"))
        assets = resource_manifest(static_refs(df), "out")
        done = rewrite.rewrite_pages(df, assets, "h.com", "out")
        rows = done.collect()
        assert "skew=true" in done._jdf.queryExecution().executedPlan().toString()
        assert len(rows) == 20000 and all('<img src="../../' in r.html for r in rows)
        assert sum("logo" in r.html for r in rows) == len([n for n in range(20000) if n % 3 == 0])
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
