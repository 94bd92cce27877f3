"""References of a page: which tags, attributes and texts hold a URL.

``page_refs_sql`` turns a document into ``array<string>`` of ``kind\\nraw``,
without repeats.  Strings rather than structs, because Spark removes repeats
from string arrays by hashing.
"""

from __future__ import annotations

from collections.abc import Sequence

from .binding import let, let_struct, q, struct
from .css import refs_sql
from .html import attr_sql, attrs_sql, body_sql, closed_sql, head_sql, sparse_re, tag_name_sql
from .urls import base_sql, normalize_sql

LINK_KINDS = (
    "a_href", "form_action", "button_onclick", "media_src", "style_attr", "style_block",
    "meta_refresh", "js_href", "js_open", "js_fetch", "data_attr",
)
STATIC_KINDS = ("img_src", "script_src", "link_href")

# The script forms that hold a link, and the button form.
JS_PATTERNS = {
    "js_href": r"window\.location\.href\s*+=\s*+['\"]([^'\"\n]*+)['\"]",
    "js_open": r"window\.open\s*+\(\s*+['\"]([^'\"\n]*+)['\"]",
    "js_fetch": r"fetch\s*+\(\s*+['\"]([^'\"\n]*+)['\"]",
}
BUTTON_PATTERN = r"location\.href\s*+=\s*+['\"]([^'\"\n]*+)['\"]"
REFRESH_PATTERN = r"(?id)url=(.+)"
_QUOTES = "'\""
_BLANKS = " \t\n\r\u000b\f"

_PLAIN_TAGS = {
    "a_href": (("a",), "href"),
    "form_action": (("form",), "action"),
    "media_src": (("video", "audio", "source"), "src"),
    "img_src": (("img",), "src"),
    "script_src": (("script",), "src"),
    "link_href": (("link",), "href"),
}


def button_target_sql(onclick: str) -> str:
    """Target of the first location assignment of a button; NULL if none."""
    return f"try_element_at(regexp_extract_all({onclick}, {q(BUTTON_PATTERN)}, 1), 1)"


def _interest(kinds: Sequence[str]) -> tuple[set[str], set[str], set[str], bool]:
    """(tags, attributes any tag may have, attributes to read, whether script
    and style blocks matter) for the kinds."""
    tags: set[str] = set()
    anywhere: set[str] = set()
    read: set[str] = set()
    blocks = False
    for kind in kinds:
        if kind in _PLAIN_TAGS:
            names, attr = _PLAIN_TAGS[kind]
            tags.update(names)
            read.add(attr)
        elif kind == "button_onclick":
            tags.add("button")
            read.add("onclick")
        elif kind == "meta_refresh":
            tags.add("meta")
            read.update({"http-equiv", "content"})
        elif kind in ("style_attr", "data_attr"):
            # scripts and styles may carry these too
            anywhere.add("style" if kind == "style_attr" else "data-")
            blocks = True
        elif kind in JS_PATTERNS or kind == "style_block":
            blocks = True
        else:
            raise ValueError(f"unknown kind of link: {kind!r}")
    blocks = blocks or "script" in tags
    return tags - {"script"}, anywhere, read | anywhere, blocks


def _candidates(t: str, kinds: Sequence[str]) -> str:
    """Strings ``kind\\nraw`` of one bound token ``t(name, attrs, body)``."""
    empty = "cast(array() as array<string>)"

    def tagged(kind: str, value: str) -> str:
        return f"concat({q(kind + chr(10))}, {value})"

    def one(kind: str, value: str) -> str:
        return let(value, lambda v: f"if({v} is null, {empty}, array({tagged(kind, v)}))")

    def each(kind: str, values: str) -> str:
        return f"transform({values}, r -> {tagged(kind, 'r')})"

    def guarded(cond: str, values: str) -> str:
        return f"if({cond}, {values}, {empty})"

    cases: dict[str, list[str]] = {}
    lists = []
    for kind in kinds:
        if kind in _PLAIN_TAGS:
            tags, attr = _PLAIN_TAGS[kind]
            for tag in tags:
                cases.setdefault(tag, []).append(one(kind, attr_sql(f"{t}.attrs", attr)))
        elif kind == "button_onclick":
            cases.setdefault("button", []).append(one(kind, button_target_sql(attr_sql(f"{t}.attrs", "onclick"))))
        elif kind == "meta_refresh":
            content = attr_sql(f"{t}.attrs", "content")
            raw = f"try_element_at(regexp_extract_all({content}, {q(REFRESH_PATTERN)}, 1), 1)"
            clean = f"trim(BOTH {q(_QUOTES)} FROM trim(BOTH {q(_BLANKS)} FROM {raw}))"
            equiv = attr_sql(f"{t}.attrs", "http-equiv")
            refresh = f"coalesce(rlike({equiv}, '(?i)refresh'), false)"
            cases.setdefault("meta", []).append(guarded(refresh, one(kind, clean)))
        elif kind in JS_PATTERNS:
            found = f"regexp_extract_all({t}.body, {q(JS_PATTERNS[kind])}, 1)"
            cases.setdefault("script", []).append(each(kind, found))
        elif kind == "style_block":
            cases.setdefault("style", []).append(each(kind, refs_sql(f"{t}.body")))
        elif kind == "style_attr":
            style = attr_sql(f"{t}.attrs", "style")
            lists.append(let(style, lambda s: guarded(f"contains({s}, 'url(')", each("style_attr", refs_sql(s)))))
        elif kind == "data_attr":
            # of attributes with one name the last counts: sorted by name and
            # place it is the one whose neighbour has another name
            named = f"filter(transform({t}.attrs, (a, i) -> struct(a.name as name, i as i, a.value as value)), a -> startswith(a.name, 'data-'))"

            def held_sql(by_name: str) -> str:
                last = f"i + 1 = size({by_name}) or {by_name}[i + 1].name <> a.name"
                kept = f"filter({by_name}, (a, i) -> ({last}) and rlike(a.value, '^(?:/|https?://)'))"
                return f"array_sort(transform({kept}, a -> struct(a.i as i, a.value as value)))"

            held = let(f"array_sort({named})", held_sql)
            lists.append(f"transform({held}, a -> {tagged(kind, 'a.value')})")

    def joined(parts: list[str]) -> str:
        return parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"

    if lists:
        # most tokens have neither style nor data attributes
        lists = [guarded(f"exists({t}.attrs, a -> a.name = 'style' or startswith(a.name, 'data-'))", joined(lists))]
    if cases:
        whens = " ".join(f"when {q(tag)} then {joined(found)}" for tag, found in cases.items())
        lists.insert(0, f"case {t}.name {whens} else {empty} end")
    return joined(lists)


def page_refs_sql(html: str, kinds: Sequence[str]) -> str:
    """``array<string>`` of ``kind\\nraw`` found in a document, no repeats."""
    tags, anywhere, read, blocks = _interest(kinds)

    def token(t: str) -> str:
        def parsed(v: str) -> str:
            return let_struct(
                lambda w: _candidates(w, kinds),
                name=f"{v}.name",
                attrs=attrs_sql(f"{v}.head", read) if read else "cast(array() as array<struct<name string, value string>>)",
                body=body_sql(t, f"{v}.head") if blocks else "''",
            )

        return let_struct(parsed, name=tag_name_sql(t), head=head_sql(t) if blocks else t)

    found = f"regexp_extract_all({html}, {q(sparse_re(tags, anywhere, blocks))}, 1)"
    wanted = f"filter({found}, t -> t <> '' and {closed_sql('t')})"
    return f"array_distinct(flatten(transform({wanted}, t -> {token('t')})))"


def split_ref_sql(ref: str) -> tuple[str, str]:
    """(kind, raw) of a ``kind\\nraw`` string."""
    return (
        f"substring_index({ref}, {q(chr(10))}, 1)",
        f"substring({ref}, position({q(chr(10))}, {ref}) + 1)",
    )


def page_links_sql(url: str, html: str, kinds: Sequence[str]) -> str:
    """``array<struct<kind, raw, dst_url>>`` of a document; links that cannot
    be parsed are left out."""

    def one(base: str, ref: str) -> str:
        kind, raw = split_ref_sql(ref)
        return let_struct(
            lambda v: struct(kind=f"{v}.kind", raw=f"{v}.raw", dst_url=normalize_sql(base, f"{v}.raw")),
            kind=kind,
            raw=raw,
        )

    return let(
        base_sql(url),
        lambda b: f"filter(transform({page_refs_sql(html, kinds)}, r -> {one(b, 'r')}), l -> l.dst_url is not null)",
    )
