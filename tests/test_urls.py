"""URL expressions against golden values and the standard library."""

import itertools
import random
from urllib.parse import urldefrag, urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from pagewright.functions import urls as U

GOLDEN = [
    ("http://h.com/a/b", "../c/?q=1#f", "http://h.com/c"),
    ("http://h.com/a/b", "../c?q=1#f", "http://h.com/c?q=1"),
    ("http://h.com/a/b", "?p=2", "http://h.com/a/b?p=2"),
    ("http://h.com/a/b/", "", "http://h.com/a/b"),
    ("http://h.com/a", "#top", "http://h.com/a"),
    ("http://h.com/a", "//cdn.com/x.js", "http://cdn.com/x.js"),
    ("http://h.com/a", "HTTP://H.com/Q/", "http://H.com/Q"),
    ("http://h.com", "x", "http://h.com/x"),
    ("http://h.com/a", "../../../z", "http://h.com/z"),
    ("http://h.com/a/b", " /sp ", "http://h.com/sp "),
    ("http://h.com", "/a/b;v/", "http://h.com/a/b;v"),
    ("http://h.com/a/b;p=1/?x=1", "c;v=2", "http://h.com/a/b;p=1/c;v=2"),
    ("http://h.com/a", "mailto:x@h.com", "mailto:x@h.com"),
    ("http://h.com/a", "javascript:void(0)/", "javascript://void(0)"),
    ("http://h.com/a", "/", "http://h.com/"),
    ("http://h.com/a", "http://[bad", None),
    ("https://m.t.example.net/en/25#top", "/für", "https://m.t.example.net/für"),
]

BASES = [
    "http://h.com", "http://h.com/", "http://h.com/a/b", "http://h.com/a/b/", "http://h.com/a//b/c",
    "https://u@h.com:80/x/y;p=1?q=2#f", "http://h.com/a/./b/../c", "http://h.com/a;x", "http://h.com?z=1",
]
LINKS = [
    "", "x", "./x", "../x", "../../x/", "..", ".", "/..", "/../x/", "/a/./b/../c", "a//b", "//o.com", "//o.com/",
    "//o.com/a/../b", "?q", "?", "#", "#f", "x#", "x?#y", ";p", "x;p=1", "/x;p/y", "x;", "http:", "http:x", "http:/x",
    "https://o.com/p/?q=1", "HTTPS://o.com/P", "mailto:a@b.c", "mailto:a#b", "javascript:void(0)", "data:image/png;base64,AA//",
    "tel:+1", "ftp://f.com/a/", " /lead", "/trail ", "\n/nl\tx", "  https://o.com/s", "/a/b?x=/../y/", "/a/b#x/", "http://o.com",
    "http://o.com?x", "http://o.com#x", "http://o.com/a?", "///x", "////x//", "/a//", "//", "http://[::1]/x", "http://[bad",
    "http://bad]/", "http://[zz]/", "http://a／b/", "1:2", "a:b", "x:", ":x", "/é/ü?ß", "%2e%2e/x", "a/b/c/../../d/", "../a;p/./b;q",
]


def py_normalize(base, link):
    try:
        url = urldefrag(urljoin(base, link)).url
        p = urlparse(url)
    except ValueError:
        return None
    if p.path.endswith("/") and p.path != "/":
        return f"{p.scheme}://{p.netloc}{p.path.rstrip('/')}"
    return url


def py_join(base, link):
    try:
        return urljoin(base, link)
    except ValueError:
        return None


def run(spark, pairs, expr):
    df = spark.createDataFrame(
        [(i, b, l) for i, (b, l) in enumerate(pairs)], "i int, base string, link string"
    )
    rows = df.select("i", expr.alias("r")).collect()
    got = {r.i: r.r for r in rows}
    return [got[i] for i in range(len(pairs))]


def test_normalize_golden(spark):
    got = run(spark, [(b, l) for b, l, _ in GOLDEN], U.normalize_url("base", "link"))
    assert got == [r for _, _, r in GOLDEN]


def test_normalize_matches_stdlib(spark):
    pairs = list(itertools.product(BASES, LINKS))
    got = run(spark, pairs, U.normalize_url("base", "link"))
    bad = [(p, g, py_normalize(*p)) for p, g in zip(pairs, got) if g != py_normalize(*p)]
    assert not bad, bad[:20]


def test_resolve_matches_stdlib(spark):
    pairs = [(b, l) for b, l in itertools.product(BASES, LINKS) if "#" not in b or l]
    got = run(spark, pairs, U.resolve_url("base", "link"))
    bad = [(p, g, py_join(*p)) for p, g in zip(pairs, got) if g != py_join(*p)]
    assert not bad, bad[:20]


def test_normalize_random_against_stdlib(spark):
    rng = random.Random(7)
    alphabet = ["a", "b", "/", "/", "..", ".", "?", "#", ";", ":", "=", "&", "//", "é", " ", "%20"]
    pairs = [
        ("http://h.com/" + "".join(rng.choices(alphabet, k=rng.randint(0, 6))),
         "".join(rng.choices(alphabet, k=rng.randint(0, 9))))
        for _ in range(3000)
    ]
    got = run(spark, pairs, U.normalize_url("base", "link"))
    bad = [(p, g, py_normalize(*p)) for p, g in zip(pairs, got) if g != py_normalize(*p)]
    assert not bad, bad[:20]


def test_normalize_is_idempotent(spark):
    base = "http://h.com/a/b"
    links = [l for l in LINKS if (py_normalize(base, l) or "").startswith("http")]
    once = run(spark, [(base, l) for l in links], U.normalize_url("base", "link"))
    twice = run(spark, [(base, l) for l in once], U.normalize_url("base", "link"))
    assert once == twice


def test_url_parts_matches_stdlib(spark):
    urls = [b for b in BASES] + [l for l in LINKS if py_join("", l) is not None]
    urls = [u for u in urls if py_normalize("http://h/", u) is not None]
    got = run(spark, [("", u) for u in urls], U.url_parts("link"))
    for u, g in zip(urls, got):
        assert tuple(g) == tuple(urlparse(u)), u


def test_same_domain(spark):
    cases = [
        ("http://example.com/", True, True), ("http://www.example.com/", True, True),
        ("http://notexample.com/", True, False), ("http://example.com:8080/", False, False),
        ("http://EXAMPLE.com/", False, False), ("mailto:a@example.com", False, False),
    ]
    pairs = [("", u) for u, _, _ in cases]
    assert run(spark, pairs, U.same_domain("example.com", "link")) == [s for _, s, _ in cases]
    assert run(spark, pairs, U.same_domain("example.com", "link", "label")) == [l for _, _, l in cases]
    with pytest.raises(ValueError):
        U.same_domain("example.com", "link", "other")


def test_small_predicates(spark):
    pairs = [("", u) for u in ["http://h/a.CSS?x=1", "https://h/b", "ftp://h/c.tar.gz", "http://h/.css"]]
    assert run(spark, pairs, U.file_ext("link")) == [".css", "", ".gz", ""]
    assert run(spark, pairs, U.is_http("link")) == [True, True, False, True]
    assert run(spark, pairs, U.is_excluded("link", ["a.C", "tar"])) == [True, False, True, False]
    assert run(spark, pairs, U.is_excluded("link", [])) == [False] * 4
    assert run(spark, [("", "http://h/a#x#y"), ("", "h")], U.strip_fragment("link")) == ["http://h/a", "h"]


def test_clean_root():
    assert U.clean_root("https://h.com//") == "https://h.com"
    with pytest.raises(ValueError):
        U.clean_root("h.com")


def test_bad_input_is_null_not_an_error(spark):
    assert run(spark, [("http://[bad", "/x"), (None, "/x"), ("http://h", None)], U.normalize_url("base", "link")) == [
        None, None, None]
    df = spark.range(1).select(U.same_domain("h", F.lit("http://[bad")).alias("r"))
    assert df.first().r is False
