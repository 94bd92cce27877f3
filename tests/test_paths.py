"""Names and local paths against golden values and the standard library."""

import hashlib
import os.path
import random
import re
from urllib.parse import parse_qs, unquote, urlparse

from pagewright.functions import paths as P

from .test_urls import run


def six(seed):
    return hashlib.sha256(seed.encode()).hexdigest()[:6]


def py_name(name, seed):
    if name.strip() == "":
        return six(seed) + ".html"
    return re.sub(P.UNSAFE_NAME, "_", name).strip().replace(" ", "_")


def py_query(query, seed):
    pairs = parse_qs(query, keep_blank_values=True)
    text = "_".join(py_name(k, seed) + "_" + py_name(v, seed) for k, vs in pairs.items() for v in vs)
    return text or six(seed)


def py_local(root, url):
    p = urlparse(url)
    base, path = os.path.join(root, p.netloc), p.path.lstrip("/")
    joined = os.path.join(base, path)
    last = os.path.split(joined)[1]
    if path and not path.endswith("/") and os.path.splitext(last)[1]:
        folder, name = os.path.split(joined)
    else:
        folder, name = joined, "index.html"
    if p.query:
        stem, ext = os.path.splitext(name)
        name = f"{stem}__{py_query(p.query, url)}{ext or '.html'}"
    return os.path.join(folder, name)


LOCAL = [
    ("http://h.com/", "out/h.com/index.html"), ("http://h.com", "out/h.com/index.html"),
    ("http://h.com/about", "out/h.com/about/index.html"), ("http://h.com/css/s.css", "out/h.com/css/s.css"),
    ("http://h.com/?page=2", "out/h.com/index__page_2.html"), ("http://h.com/s.css?v=3", "out/h.com/s__v_3.css"),
    ("http://h.com/a;v=1", "out/h.com/a/index.html"), ("http://h.com/v1.2", "out/h.com/v1.2"),
    ("http://h.com/a.", "out/h.com/a."), ("http://h.com/.htaccess", "out/h.com/.htaccess/index.html"),
]


def test_local_path_golden(spark):
    got = run(spark, [("", u) for u, _ in LOCAL], P.local_path("out", "link"))
    assert got == [p for _, p in LOCAL]
    blank = "http://h.com/x?a="
    assert run(spark, [("", blank)], P.local_path("out", "link")) == [
        f"out/h.com/x/index__a_{six(blank)}.html.html"]


def test_local_path_matches_stdlib(spark):
    rng = random.Random(3)
    bits = ["a", "b.css", "/", "//", ".", "..x", "?", "&", "=", "a=1", ";", "%20", "+", "é", "%", "%zz", "a=", ":", "*"]
    urls = ["http://h.com/" + "".join(rng.choices(bits, k=rng.randint(0, 9))) for _ in range(2500)]
    got = run(spark, [("", u) for u in urls], P.local_path("out", "link"))
    bad = [(u, g, py_local("out", u)) for u, g in zip(urls, got) if g != py_local("out", u)]
    assert not bad, bad[:10]


def test_query_names(spark):
    cases = {"page=2&sort=asc": "page_2_sort_asc", "a=1&b=2&a=3": "a_1_a_3_b_2", "x=a+b%2Fc": "x_a_b_c",
             "foo": f"foo_{six('s')}.html", "a=1;b=2": "a_1;b=2", "&&": six("s"), "a=%C3%A9&b=%zz": "a_é_b_%zz"}
    got = run(spark, [("s", q) for q in cases], P.query_to_name("link", "base"))
    assert got == list(cases.values())
    assert [py_query(q, "s") for q in cases] == list(cases.values())


def test_relative_path(spark):
    cases = [
        ("h.com/en/25", "h.com/The/index.html", "../../The/index.html"),
        ("h.com/en", "h.com/The/index.html", "../The/index.html"),
        ("h.com/en/25", "m.h.com/x/index.html", "../../../m.h.com/x/index.html"),
        ("h.com/en/25", "h.com/en/25/index.html", "index.html"),
        ("h.com/css", "h.com/img/a.png", "../img/a.png"),
        ("h.com/a//b", "h.com/a/./c/../d.x", "../d.x"),
        ("h.com/a/b", "h.com/a/b", "."), ("h.com/a/b/c", "h.com/a", "../.."),
    ]
    pairs = [(s, t) for s, t, _ in cases]
    assert run(spark, pairs, P.relative_path("link", "base")) == [r for _, _, r in cases]
    assert [os.path.relpath(t, s) for s, t in pairs] == [r for _, _, r in cases]


def test_relative_path_resolves_back(spark):
    rng = random.Random(5)
    pairs = [tuple("/".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(2)) for _ in range(500)]
    got = run(spark, pairs, P.resolve_path("base", P.relative_path("link", "base")))
    assert got == [t for _, t in pairs]


def test_percent_decode_matches_stdlib(spark):
    texts = ["a%20b", "%", "%4", "%zz%41", "+", "%2B+", "é%C3%A9", "%25%32%30"]
    assert run(spark, [("", t) for t in texts], P.percent_decode("link")) == [unquote(t) for t in texts]


def test_parent_folder(spark):
    pairs = [("", p) for p in ["a/b/c.x", "c.x", "a//b", ""]]
    assert run(spark, pairs, P.parent_folder("link")) == [os.path.dirname(p) for _, p in pairs]
