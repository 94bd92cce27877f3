"""Robots grammar and verdicts against golden values and the standard library."""

import random
from urllib.robotparser import RobotFileParser

from pagewright.operators import robots as R
from pagewright.operators.links import exclude_links

GOLDEN = [
    ("User-agent: a\n\nDisallow: /x\nUser-agent: *\nDisallow: /y", "a", {"/x": True, "/y": False}),
    ("User-agent: a\n# c\nDisallow: /x", "a", {"/x": False, "/y": True}),
    ("User-agent: a\n \nDisallow: /x", "a", {"/x": False}),
    ("User-agent: *\nDisallow: /p\nAllow: /p/ok", "z", {"/p/ok": False, "/p?x=1": False}),
    ("User-agent: *\nDisallow: /p?x=", "z", {"/p?x=1": False, "/p": True}),
    ("User-agent: moz\nDisallow: /q\nUser-agent: *\nDisallow: /", "Mozilla/5.0 (X)", {"/q": False, "/z": True}),
    ("User-agent: *\nDisallow: /1\n\nUser-agent: *\nDisallow: /2", "z", {"/1": False, "/2": True}),
    ("User-agent: *\nDisallow: /a%20b\nDisallow: /c+d\nCrawl-delay: 4", "z", {"/a b": False, "/c+d": False, "/c d": True}),
    ("User-agent: a\nUser-agent: b\nDisallow: /s\nDisallow:", "b", {"/s": False, "/t": True}),
    ("", "z", {"/": True}),
    ("Disallow: /x\nUser-agent: *\nCrawl-delay: 2\nSitemap: http://h/s.xml", "z", {"/x": True}),
    ("User-agent: *\nDisallow: UserU\nDisallow: *", "z", {"/UserU": True, "/*": True}),
]


def py_verdict(body, agent, url):
    rp = RobotFileParser()
    rp.parse(body.splitlines())
    return rp.can_fetch(agent, url)


def verdicts(spark, cases, agent, **kw):
    """cases: (host, status, body, [urls]) -> {url: allowed}"""
    robots = spark.createDataFrame([c[:3] for c in cases], "host string, status_code int, body string")
    urls = spark.createDataFrame([(u,) for c in cases for u in c[3]], "url string")
    return {r.url: r.allowed for r in R.robots_verdict(urls, robots, agent, **kw).collect()}


def test_golden_verdicts(spark):
    for i, (body, agent, wanted) in enumerate(GOLDEN):
        urls = {f"http://h{i}.com{p}": v for p, v in wanted.items()}
        assert verdicts(spark, [(f"h{i}.com", 200, body, list(urls))], agent) == urls, body
        for u, v in urls.items():
            assert py_verdict(body, agent, u) == v, (body, u)


def test_random_files_match_stdlib(spark):
    rng = random.Random(2)
    lines = ["User-agent: *", "user-agent: bot", "User-Agent: other # c", "Disallow: /a", "Allow: /a/b", "Disallow:", "Disallow: /a?b=",
             "Crawl-delay: 3", "Request-rate: 1/2", "", "", "# note", "  ", "Sitemap: http://x/s", "junk", "Disallow: /%61/c", "Allow: /"]
    paths = ["/", "/a", "/a/b", "/a?b=1", "/a/c?", "/x#f", "", "/a;p"]
    cases = []
    for i in range(400):
        body = "\n".join(rng.choices(lines, k=rng.randint(0, 12)))
        cases.append((f"h{i}.com", 200, body, [f"http://h{i}.com{p}" for p in paths]))
    got = verdicts(spark, cases, "MyBot/2.1")
    bad = [(c[2], u, got[u]) for c in cases for u in c[3] if got[u] != py_verdict(c[2], "MyBot/2.1", u)]
    assert not bad, bad[:5]


def test_status_codes_and_missing_hosts(spark):
    rows = [("a", 401, "", ["http://a/x"]), ("b", 403, None, ["http://b/x"]), ("c", 404, None, ["http://c/x"]),
            ("d", 503, None, ["http://d/x"]), ("e", None, None, ["http://e/x"]), ("f", 200, "", ["http://f/x", "http://zz/x"])]
    got = verdicts(spark, rows, "z")
    assert got == {"http://a/x": False, "http://b/x": False, "http://c/x": True, "http://d/x": False, "http://e/x": False,
                   "http://f/x": True, "http://zz/x": True}
    assert verdicts(spark, rows, "z", on_missing="deny")["http://zz/x"] is False
    assert all(verdicts(spark, rows, "z", ignore_robots=True).values())
    assert not any(verdicts(spark, rows, "z", robots_host="a").values())


def test_rules_table(spark):
    body = "User-agent: a\nUser-agent: b\nAllow: /1\nDisallow: /2\nCrawl-delay: 7\nSiteMap: http://h/s.xml\n\nUser-agent: *\nCrawl-delay: 1\rSITEMAP:http://h/t.xml"
    df = spark.createDataFrame([("h", 200, body)], "host string, status_code int, body string")
    rows = {(r.group_no, tuple(r.agents), r.rule_no, r.allow, r.path, r.crawl_delay) for r in R.parse_robots(df).collect()}
    assert rows == {(1, ("a", "b"), 1, True, "/1", 7), (1, ("a", "b"), 2, False, "/2", 7), (2, ("*",), None, None, None, 1)}
    assert {r.sitemap_url for r in R.robots_sitemaps(df).collect()} == {"http://h/s.xml", "http://h/t.xml"}


def test_several_captures_of_a_host_do_not_multiply_urls(spark):
    cases = [("h", 200, "User-agent: *\nDisallow: /a", []), ("h", 200, "User-agent: *\nDisallow: /b", ["http://h/a", "http://h/b"])]
    robots = spark.createDataFrame([c[:3] for c in cases], "host string, status_code int, body string")
    urls = spark.createDataFrame([("http://h/a",), ("http://h/b",)], "url string")
    out = R.robots_verdict(urls, robots, "z").collect()
    assert len(out) == 2 and exclude_links(urls, ["/a"], "url").count() == 1


def test_hot_host_is_split(spark):
    """With broadcasts off, adaptive execution cuts the partition of a hot host."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        from pyspark.sql import functions as F
        urls = spark.range(40000).repartition(8).select(F.concat(
            F.when(F.col("id") % 3 == 0, F.lit("http://hot.com/")).otherwise(
                F.concat(F.lit("http://h"), F.col("id") % 5000, F.lit(".com/"))), F.sha2(F.col("id").cast("string"), 256)).alias("url"))
        robots = spark.range(5000).select(F.concat(F.lit("h"), F.col("id"), F.lit(".com")).alias("host"), F.lit(200).alias("status_code"),
                                          F.lit("User-agent: *\nDisallow: /a").alias("body")).unionByName(
            spark.createDataFrame([("hot.com", 200, "User-agent: *\nDisallow: /b")], "host string, status_code int, body string"))
        out = R.robots_verdict(urls, robots, "z")
        assert out.count() == 40000
        out.write.format("noop").mode("overwrite").save()
        rows = out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
        assert sum(not r.allowed for r in rows) == sum(
            r.url.split("/")[3].startswith("b" if "hot" in r.url else "a") for r in rows)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
