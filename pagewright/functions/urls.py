"""URL expressions: split, join, canonical form, domain and exclusion tests.

Each ``*_sql`` builder maps SQL text to SQL text; the functions without suffix
are their Column forms.  A URL is cut once, by a single regular expression,
into an array of six strings.  Jobs that resolve many links against one page
cut the page's URL once (``base_sql``) and resolve the usual shapes of link
without cutting the link at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import apply_text, as_col, let, let_struct, q, struct

# Schemes the standard URL join treats as hierarchical, and those
# whose last path segment may carry ";params".
RELATIVE_SCHEMES = (
    "", "file", "ftp", "gopher", "http", "https", "imap", "mms", "nntp",
    "prospero", "rtsp", "rtsps", "rtspu", "sftp", "shttp", "svn", "svn+ssh",
    "wais", "ws", "wss",
)
PARAMS_SCHEMES = (
    "", "ftp", "hdl", "http", "https", "imap", "mms", "prospero", "rtsp",
    "rtsps", "rtspu", "sftp", "shttp", "sip", "sips", "tel",
)
# Characters whose compatibility form holds one of / ? # : @
CONFUSABLE = "⁇⁈⁉℀℁℅℆⩴︓︖﹕﹖﹟﹫＃／：？＠"

_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*+"
# RFC 3986 appendix B, with ";params" of the last segment as a group of its own.
_SPLIT = (
    rf"(?s)^(?:({_SCHEME}):)?+(?://([^/?#]*+))?+"
    r"((?:[^?#]*/)?[^;/?#]*+)(;[^/?#]*+)?+(?:\?([^#]*+))?+(?:#(.*+))?+\z"
)
# Line breaks are removed from a URL before it is cut, so they can delimit.
_JOINED = "$1\n$2\n$3\n$4\n$5\n$6"
_DROPPED = r"^[\x00-\x20]++|[\t\r\n]++"
_NETLOC = rf"^[\x00-\x20]*+(?:{_SCHEME}:)?+//([^/?#]*+)"
_ODD_NETLOC = rf"^(?:{_SCHEME}:)?+//[^/?#]*?[\[\]{CONFUSABLE}]"
_IP_LITERAL = (
    rf"^(?:{_SCHEME}:)?+//[^/?#\[\]{CONFUSABLE}]*+"
    r"\[(?:[vV][0-9a-fA-F]++\.[^\]/?#]++|(?=[^\]]*:)[0-9A-Fa-f:.]++(?:%[^\]/?#]++)?)\]"
    rf"[^/?#\[\]{CONFUSABLE}]*+(?:[/?#]|\z)"
)
_DOTTED = r"(?:^|/)\.\.?(?:/|\z)"

# The usual shapes of link, resolved without cutting them up: "/path?query#f"
# and "http(s)://host/path?query#f" without dot segments, ";", blanks or an
# empty query.
_TAIL = r"[^?#;\x00-\x20]*+(?:\?[^#\x00-\x20]++)?(?:#.*)?\z"
_PLAIN_PATH = r"(?s)^/(?!/)" + _TAIL
_PLAIN_URL = r"(?s)^https?://[A-Za-z0-9.\-_~%!$&'()*+,=:@]++(?:/(?!/)" + _TAIL + r"|(?:\?[^#\x00-\x20]++)?(?:#.*)?\z)"
_SLASHED = r"(?s)^((?:https?://[^/?]++)?/[^?]*[^/?])/++(?:\?.*+)?\z"
_PLAIN_BASE = r"^https?\z"


class UrlParts(NamedTuple):
    """SQL text of the parts of one URL; ``params`` keeps its semicolon."""

    scheme: str
    netloc: str
    path: str
    params: str
    query: str
    fragment: str


def _among(value: str, options: Iterable[str]) -> str:
    return f"{value} in ({', '.join(q(o) for o in options)})"


def parts_sql(url: str) -> str:
    """``array(scheme, netloc, path, ;params, query, fragment)``, NULL if the
    network location is not valid."""

    def cut(clean: str) -> str:
        return (
            f"case when not rlike({clean}, {q(_ODD_NETLOC)}) or rlike({clean}, {q(_IP_LITERAL)}) "
            f"then split(regexp_replace({clean}, {q(_SPLIT)}, {q(_JOINED)}), {q(chr(10))}) end"
        )

    def settle(raw: str) -> str:
        # ";params" exists for some schemes only; elsewhere it is path text
        plain = f"({raw}[3] = '' or {_among(f'lower({raw}[0])', PARAMS_SCHEMES)})"
        return (
            f"case when {raw} is not null then array(lower({raw}[0]), {raw}[1], "
            f"if({plain}, {raw}[2], concat({raw}[2], {raw}[3])), if({plain}, {raw}[3], ''), "
            f"{raw}[4], {raw}[5]) end"
        )

    return let(let(f"regexp_replace({url}, {q(_DROPPED)}, '')", cut), settle)


def parts_of(array: str) -> UrlParts:
    """Read a bound ``parts_sql`` value as named parts."""
    return UrlParts(*[f"{array}[{i}]" for i in range(6)])


def with_parts(url: str, body: Callable[[UrlParts], str]) -> str:
    return let(parts_sql(url), lambda a: f"case when {a} is not null then {body(parts_of(a))} end")


def _unsplit(scheme: str, netloc: str, path: str, params: str, query: str) -> str:
    def build(hier: str) -> str:
        hierarchical = _among(scheme, [s for s in RELATIVE_SCHEMES if s])
        return (
            f"concat(if({scheme} <> '', concat({scheme}, ':'), ''), "
            f"case when {netloc} <> '' then concat('//', {netloc}, "
            f"if({hier} <> '' and not startswith({hier}, '/'), '/', ''), {hier}) "
            f"when startswith({hier}, '//') or ({hierarchical} and ({hier} = '' or startswith({hier}, '/'))) "
            f"then concat('//', {hier}) else {hier} end, "
            f"if({query} <> '', concat('?', {query}), ''))"
        )

    return let(f"concat({path}, if({params} = ';', '', {params}))", build)


def fold_parents_sql(segs: str) -> str:
    """Resolve ``..`` in an array of segments.  A run of d ``..`` takes away
    the d segments before it (as far as there are any) and brings in the run
    of other segments up to the next; the runs are read off one string of
    flags, so a path is scanned once and each run costs one step."""
    flags = f"array_join(transform({segs}, s -> if(s = '..', 'D', 'S')), '')"

    def runs(f: str) -> str:
        lead = f"length(regexp_extract({f}, '^S*', 0))"
        steps = (
            f"transform(regexp_extract_all({f}, 'D+S*', 0), r -> "
            "struct(length(regexp_extract(r, '^D+', 0)) as d, length(r) - length(regexp_extract(r, '^D+', 0)) as s))"
        )
        step = (
            "struct(concat(slice(st.acc, 1, greatest(size(st.acc) - r.d, 0)), "
            f"slice({segs}, st.at + r.d + 1, r.s)) as acc, st.at + r.d + r.s as at)"
        )
        return f"aggregate({steps}, struct(slice({segs}, 1, {lead}) as acc, {lead} as at), (st, r) -> {step}).acc"

    return f"if(array_contains({segs}, '..'), {let(flags, runs)}, {segs})"


def _fold_dots(path: str) -> str:
    """Resolve '.' and '..' segments; '' becomes '/'."""

    def fold(segs: str) -> str:
        kept = let(f"filter({segs}, s -> s <> '.')", fold_parents_sql)
        last = f"element_at({segs}, -1) in ('.', '..')"
        return f"concat(array_join({kept}, '/'), if({last} and size({segs}) > 1, '/', ''))"

    folded = f"if(rlike({path}, {q(_DOTTED)}), {let(f'''split({path}, '/')''', fold)}, {path})"
    return let(folded, lambda p: f"if({p} = '', '/', {p})")


def _merge_paths(base_path: str, path: str) -> str:
    folder = f"if({base_path} = '', '/', regexp_extract({base_path}, {q('(?s)^(?:.*/)?')}, 0))"
    relative = f"regexp_replace(concat({folder}, {path}), '/{{2,}}', '/')"
    return let(f"if(startswith({path}, '/'), {path}, {relative})", _fold_dots)


def _joined(base: UrlParts, link: UrlParts, body: Callable[..., str]) -> str:
    own_host = f"{link.netloc} <> ''"
    same_doc = f"({link.path} = '' and {link.params} in ('', ';'))"

    def rooted(v: str) -> str:
        path = (
            f"if({v}.netloc <> '' and {v}.path <> '' and not startswith({v}.path, '/'), "
            f"concat('/', {v}.path), {v}.path)"
        )
        return let(path, lambda p: body(base.scheme, f"{v}.netloc", p, f"{v}.params", f"{v}.query"))

    return let_struct(
        rooted,
        netloc=f"if({own_host}, {link.netloc}, {base.netloc})",
        path=f"case when {own_host} then {link.path} when {same_doc} then {base.path} "
        f"else {_merge_paths(base.path, link.path)} end",
        params=f"if({own_host} or not {same_doc}, {link.params}, {base.params})",
        query=f"if(not ({own_host}) and {same_doc} and {link.query} = '', {base.query}, {link.query})",
    )


def _hierarchical(base: UrlParts, link: UrlParts) -> str:
    return f"({link.scheme} in ('', {base.scheme}) and {_among(base.scheme, RELATIVE_SCHEMES)})"


def _without_slash(scheme: str, netloc: str, path: str) -> str:
    return f"concat({scheme}, '://', {netloc}, rtrim('/', {path}))"


def _trailing(path: str) -> str:
    return f"endswith({path}, '/') and {path} <> '/'"


def _canonical_alone(url: str, p: UrlParts) -> str:
    return (
        f"case when {_trailing(p.path)} then {_without_slash(p.scheme, p.netloc, p.path)} "
        f"when contains({url}, '#') then {_unsplit(p.scheme, p.netloc, p.path, p.params, p.query)} "
        f"else {url} end"
    )


def base_sql(url: str) -> str:
    """What ``normalize_sql`` needs to know of a page: its URL, its parts, and
    ``scheme://host`` when the page is an ordinary web page."""
    return let(
        parts_sql(url),
        lambda a: struct(
            url=url,
            parts=a,
            origin=f"if(rlike({a}[0], {q(_PLAIN_BASE)}) and {a}[1] <> '', concat({a}[0], '://', {a}[1]), null)",
        ),
    )


def normalize_sql(base: str, link: str) -> str:
    """Canonical form of ``link`` found on a page described by ``base_sql``."""
    b = parts_of(f"{base}.parts")

    def canonical(scheme, netloc, path, params, query):
        return (
            f"if({_trailing(path)}, {_without_slash(scheme, netloc, path)}, "
            f"{_unsplit(scheme, netloc, path, params, query)})"
        )

    def general(p: UrlParts) -> str:
        return (
            f"case when {_hierarchical(b, p)} then {_joined(b, p, canonical)} "
            f"else {_canonical_alone(link, p)} end"
        )

    bare = f"if(contains({link}, '#'), regexp_replace({link}, '(?s)#.*', ''), {link})"
    trimmed = let(bare, lambda s: f"if(contains({s}, '/?') or endswith({s}, '/'), "
                                  f"regexp_replace({s}, {q(_SLASHED)}, '$1'), {s})")
    page = let(f"{base}.url", lambda u: with_parts(u, lambda p: _canonical_alone(u, p)))
    usual = f"{base}.origin is not null and not contains({link}, '/.')"
    return (
        f"case when {base}.parts is null then null "
        f"when {usual} and rlike({link}, {q(_PLAIN_PATH)}) then concat({base}.origin, {trimmed}) "
        f"when {usual} and rlike({link}, {q(_PLAIN_URL)}) then {trimmed} "
        f"when {link} = '' then {page} "
        f"else {with_parts(link, general)} end"
    )


def _no_breaks(url: str) -> str:
    found = " or ".join(f"contains({url}, {q(c)})" for c in "\t\r\n")
    return f"if({found}, translate({url}, {q(chr(9) + chr(13) + chr(10))}, ''), {url})"


def netloc_sql(url: str) -> str:
    """Network location of a URL ('' when it has none)."""
    return f"regexp_extract({_no_breaks(url)}, {q(_NETLOC)}, 1)"


def same_domain_sql(root: str | None, url: str, mode: str = "suffix") -> str:
    if mode not in ("suffix", "label"):
        raise ValueError(f"mode must be 'suffix' or 'label', not {mode!r}")
    if root is None:
        return "true"
    if mode == "suffix":
        return f"endswith({netloc_sql(url)}, {q(root)})"
    return let(netloc_sql(url), lambda n: f"({n} = {q(root)} or endswith({n}, {q('.' + root)}))")


def is_http_sql(url: str) -> str:
    usual = f"startswith({url}, 'http://') or startswith({url}, 'https://')"
    return f"({usual} or rlike({url}, {q(r'^[\x00-\x20]*+[hH][tT][tT][pP][sS]?:')}))"


# --- Column forms ---------------------------------------------------------


def url_parts(url: Column | str) -> Column:
    """``struct<scheme, netloc, path, params, query, fragment>`` of a URL."""

    def build(p: UrlParts) -> str:
        return struct(**{**p._asdict(), "params": f"substring({p.params}, 2)"})

    return apply_text(lambda u: with_parts(u, build), url)


def netloc_of(url: Column | str) -> Column:
    """Network location of a URL ('' when it has none)."""
    return F.regexp_extract(F.translate(as_col(url), "\t\r\n", ""), _NETLOC, 1)


def normalize_url(base: Column | str, link: Column | str) -> Column:
    """Absolute canonical URL: join, drop the fragment, drop trailing slashes
    (and with them the query).  NULL when either side cannot be parsed."""
    return apply_text(lambda b, l: let(base_sql(b), lambda v: normalize_sql(v, l)), base, link)


def canonical_url(url: Column | str) -> Column:
    """Canonical form of an absolute URL."""
    return apply_text(lambda u: let(base_sql(u), lambda v: normalize_sql(v, u)), url)


def resolve_url(base: Column | str, link: Column | str) -> Column:
    """RFC 3986 join of ``link`` with ``base``, fragment kept."""

    def build(b: str, l: str) -> str:
        def join(bp: UrlParts) -> str:
            def general(p: UrlParts) -> str:
                def whole(*parts):
                    return f"concat({_unsplit(*parts)}, if({p.fragment} <> '', concat('#', {p.fragment}), ''))"

                return f"if({_hierarchical(bp, p)}, {_joined(bp, p, whole)}, {l})"

            return with_parts(l, general)

        return f"case when {l} = '' then {b} when {b} = '' then {l} else {with_parts(b, join)} end"

    return apply_text(build, base, link)


def strip_fragment(url: Column | str) -> Column:
    return F.regexp_replace(as_col(url), r"(?s)#.*+\z", "")


def same_domain(root: str, url: Column | str, mode: str = "suffix") -> Column:
    """Does the URL belong to ``root``?

    ``suffix`` is a plain text suffix of the network location (so
    ``notexample.com`` belongs to ``example.com``); ``label`` requires equality
    or a dot before the root.
    """
    netloc = netloc_of(url)
    if mode == "suffix":
        return netloc.endswith(root)
    if mode == "label":
        return (netloc == root) | netloc.endswith("." + root)
    raise ValueError(f"mode must be 'suffix' or 'label', not {mode!r}")


def is_excluded(url: Column | str, substrings: Iterable[str]) -> Column:
    """True when the URL contains any of the substrings."""
    hit = F.lit(False)
    for text in substrings:
        hit = hit | F.contains(as_col(url), F.lit(text))
    return hit


def is_http(url: Column | str) -> Column:
    return as_col(url).rlike(r"^[\x00-\x20]*+[hH][tT][tT][pP][sS]?:")


def file_ext(url: Column | str) -> Column:
    """Lower-cased extension of the URL's path, with its dot, or ''."""
    from .paths import extension_sql

    return apply_text(
        lambda u: with_parts(
            u, lambda p: f"lower({extension_sql(f'regexp_extract({p.path}, {q('[^/]*+\\z')}, 0)')})"
        ),
        url,
    )


def clean_root(url: str) -> str:
    """Checked root URL without trailing slash."""
    root = url.rstrip("/")
    if not root.startswith(("http://", "https://")):
        raise ValueError("root URL must start with http:// or https://")
    return root
