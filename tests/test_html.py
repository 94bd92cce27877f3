"""Tokens, attributes and links against a standard-library HTML walk."""

import html as stdhtml
import random
import re
import time
from html.parser import HTMLParser

from pyspark.sql import functions as F

from pagewright.functions.entities import unescape_entities
from pagewright.functions.html import tokenize_html
from pagewright.operators import links as L

TRICKY = (
    '<!-- <a href="/no"> --><SCRIPT>var a=\'<a href="/no2">\';</SCRIPT><A HREF=\'/y es\' title="x > y href=/z">t</a>'
    '<a href=/un>u</a> 1 < 2 <style>a{b:url(x)}</style><br/><a href="/b">unterminated <'
)
PAGES = [
    TRICKY,
    "<a href=1 href=2 HREF='/last'>x</a><a href>y</a><a name=x>z</a><a href = '/sp'>",
    "<a title='it > is' href=/q data-u='/d'>x</a><p data-u=nope data-v='http://h/v'></p>",
    '<form action="/f?a=1&amp;b=2&copy=3"></form><video src=/v.mp4></video><audio src=/a></audio><source src="/s">',
    "<button onclick=\"x(); window.location.href = '/go'; location.href='/no'\">b</button><button onclick='none()'>",
    '<meta http-equiv="REFRESH" content="3; URL=\'/moved\'"><meta name=x content="url=/no">',
    '<script>window.location.href="/h"; window.open( \'/o\' ); fetch("/f?a=1&b=2"); fetch(x)</script>',
    '<div style="a:url( \'x.png\' );b:url(y)"><p style=\'c:url("z")\'>',
    "<style>@media print{a{b:url(m.png)}} c{d:url()}</style>",
    "<p data-a='/1' data-a='/2' data-b=//x.com/y>",
    "<scripty><a href=/in></scripty><script src=/s.js/></script><a href=/after>",
    "a<b<c<a href=/x>", "<![CDATA[ <a href=/no> ]]><a href=/yes>", "<!DOCTYPE html><?php <a href=/no ?><a href=/z>",
    "", "<", "<a", "</a href=/no><a href='/y'/>", "<a\nhref='/nl'\n>",
]


class Walk(HTMLParser):
    """Reads start tags, attributes and script/style text."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.tags, self.blocks, self.inside = [], [], None

    def handle_starttag(self, tag, attrs):
        self.tags.append((tag, {k: v or "" for k, v in attrs}))
        self.inside = tag if tag in ("script", "style") else None

    def handle_startendtag(self, tag, attrs):
        self.tags.append((tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        self.inside = None

    def handle_data(self, data):
        if self.inside:
            self.blocks.append((self.inside, data))


def expected(html):
    w = Walk()
    w.feed(html)
    w.close()
    out = set()
    url_re = re.compile(r"url\(\s*['\"]?(.*?)['\"]?\s*\)")
    for tag, at in w.tags:
        for tags, attr, kind in ((["a"], "href", "a_href"), (["form"], "action", "form_action"),
                                 (["video", "audio", "source"], "src", "media_src")):
            if tag in tags and attr in at:
                out.add((kind, at[attr]))
        if tag == "button" and "onclick" in at:
            m = re.search(r"location\.href\s*=\s*['\"](.*?)['\"]", at["onclick"])
            if m:
                out.add(("button_onclick", m.group(1)))
        if tag == "meta" and "refresh" in at.get("http-equiv", "").lower():
            m = re.search(r"url=(.+)", at.get("content", ""), re.I)
            if m:
                out.add(("meta_refresh", m.group(1).strip().strip("'\"")))
        out |= {("style_attr", r) for r in url_re.findall(at.get("style", "")) if r}
        out |= {("data_attr", v) for k, v in at.items()
                if k.startswith("data-") and v.startswith(("/", "http://", "https://"))}
    for tag, text in w.blocks:
        if tag == "style":
            out |= {("style_block", r) for r in url_re.findall(text) if r}
        else:
            for kind, pat in (("js_href", r"window\.location\.href\s*=\s*['\"](.*?)['\"]"),
                              ("js_open", r"window\.open\s*\(\s*['\"](.*?)['\"]"),
                              ("js_fetch", r"fetch\s*\(\s*['\"](.*?)['\"]")):
                out |= {(kind, r) for r in re.findall(pat, text)}
    return out


def frame(spark, htmls):
    return spark.createDataFrame(
        [(i, "http://h.com/d/p", h) for i, h in enumerate(htmls)], "page_id bigint, url string, html string"
    )


def found(spark, htmls):
    rows = L.extract_links(frame(spark, htmls)).collect()
    got = {i: set() for i in range(len(htmls))}
    for r in rows:
        got[r.page_id].add((r.kind, r.raw))
    return [got[i] for i in range(len(htmls))]


def test_tokens_of_tricky_page(spark):
    rows = L.tokenize(frame(spark, [TRICKY])).collect()
    assert len(rows) == 16
    assert "".join(r.token for r in sorted(rows, key=lambda r: r.pos)) == TRICKY


def test_links_match_parser_walk(spark):
    for html, got in zip(PAGES, found(spark, PAGES)):
        assert got == expected(html), html


def test_links_of_test_pages_match_parser_walk(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    for page, got in zip(pages, found(spark, [p.html for p in pages])):
        assert got == expected(page.html)


def test_tokens_are_lossless_on_random_markup(spark):
    rng = random.Random(11)
    bits = ["<a ", "<", ">", "href=", '"', "'", "/", "<!--", "-->", "<script>", "</script>", "<style", "x", " ", "=", "</a>", "\n"]
    htmls = ["".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(2000)]
    df = frame(spark, htmls).select(
        (F.array_join(tokenize_html("html"), "") == F.col("html")).alias("same"))
    assert df.filter(~F.col("same")).count() == 0


def test_hostile_markup_is_linear(spark):
    htmls = [
        "<a " + " ".join(f'x{i}="{i}"' for i in range(20000)) + " href=/end>",
        "<script>" + "x" * 5_000_000 + "</script>",
        '<a href="' * 50000, "<a b='" * 50000, "<!--" * 50000, "<script>" * 50000, "<a " * 50000,
        "<style>a{b:url(" + " " * 200000 + "}</style>" + "url(" * 50000,
        '<p style="' + "url(" * 50000 + '">', "<title>" * 50000,
    ]
    start = time.time()
    counts = {r.page_id: r.n for r in frame(spark, htmls).select(
        "page_id", F.size(tokenize_html("html")).alias("n")).collect()}
    links = found(spark, htmls)
    titles = L.page_title(frame(spark, htmls)).count()
    assert time.time() - start < 60
    assert counts[0] == 1 and counts[1] == 1 and titles == len(htmls)
    assert links[0] == {("a_href", "/end")}


def test_unescape_matches_stdlib(spark):
    texts = [
        "a&amp;b", "&lt;&GT;", "&copy=1", "&copyx;", "&notit;", "&nosuch;", "&#65;&#x41;", "&#0;&#128;&#x80;&#159;", "&#1;&#xFFFE;",
        "&#1114112;", "&#99999999999999999999;", "&#xD800;", "&", "&&amp;", "&#", "&#x", "&#x;", "&eacute;t&eacute", "&#13;x", "&NotEqualTilde;",
        "&#00065", "?a=1&b=2&lang=en&reg=1", "&ampamp;", "&#129;",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.r for r in df.select("i", unescape_entities("t").alias("r")).collect()}
    assert [got[i] for i in range(len(texts))] == [stdhtml.unescape(t) for t in texts]


def test_titles(spark):
    htmls = ["<title> A &amp;\n b </title>", "<script>'<title>x</title>'</script><TITLE>Just a moment...</TITLE>",
             "<p>none", "<title>open", "<title>Checking your browser</title>"]
    rows = {r.page_id: (r.title, r.interstitial) for r in L.flag_interstitial(frame(spark, htmls)).collect()}
    assert rows == {0: ("A & b", False), 1: ("Just a moment...", True), 2: (None, False), 3: ("open", False),
                    4: ("Checking your browser", True)}


def test_static_refs(spark):
    html = "<img src=/i.png><script src='/s.js'></script><link rel=x href='/c.css'><img alt=x><link rel=y>"
    rows = L.static_refs(frame(spark, [html])).collect()
    assert {(r.kind, r.dst_url) for r in rows} == {
        ("img_src", "http://h.com/i.png"), ("script_src", "http://h.com/s.js"), ("link_href", "http://h.com/c.css")}


def test_css_refs(spark):
    sheet = ("@import url(imp.css); /* url(no) */ @font-face{src:url( 'x.woff' )} a{b:url(y.woff),url(\"z.woff\")} "
             "c{d:url()} @media print{p{e:url(m.png)}} i{j:url(data:x)} k{l:url(http://o.com/a)}")
    df = spark.createDataFrame(
        [("http://h.com/css/s.css?v=1", "text/css", sheet), ("http://h.com/x.png", "image/png", "url(no)")],
        "url string, content_type string, content string")
    flat = {r.raw for r in L.css_refs(df).collect()}
    assert flat == {"x.woff", "y.woff", "z.woff", "http://o.com/a"}
    assert {r.raw for r in L.css_refs(df, nested=True).collect()} == flat | {"m.png"}
    assert {r.dst_url for r in L.css_refs(df).collect()} >= {"http://h.com/css/x.woff"}


def test_domain_and_exclusion_filters(spark):
    df = spark.createDataFrame([("http://example.com/a",), ("http://o.com/a",), ("http://www.example.com/b",)], "dst_url string")
    inside = L.internal_links(df, "example.com")
    assert inside.count() == 2 and L.external_links(df, "example.com").count() == 1
    assert L.exclude_links(inside, ["/b"]).collect()[0].dst_url == "http://example.com/a"


def test_link_set_and_counts(spark):
    html = "<a href=/a><a href='/a#x'><a href=//o.com/><form action=/b>"
    df = frame(spark, [html, "none"])
    assert {r.dst_url for r in L.link_set(df).collect()} == {"http://h.com/a", "http://h.com/b", "http://o.com/"}
    assert {r.dst_url for r in L.link_set(df, "h.com", ["/b"]).collect()} == {"http://h.com/a"}
    assert {(r.page_id, r.n_links) for r in L.page_link_counts(df, "h.com").collect()} == {(0, 2), (1, 0)}


def test_classify_pages(spark):
    df = spark.createDataFrame([(0, "u", "x", "Text/HTML; q"), (1, "u", "x", "image/png"), (2, "u", "", "text/html"), (3, "u", None, None)],
                               "page_id bigint, url string, html string, content_type string")
    assert [r["class"] for r in L.classify_pages(df).orderBy("page_id").collect()] == ["page", "resource", "empty", "empty"]


def test_no_python_workers_in_plans(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for df in (L.extract_links(pages), L.link_set(pages, "example.com"), L.static_refs(pages)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan and "Exchange" not in plan
