"""Lossless HTML tokens and tag attributes as regular expressions.

The grammar follows the HTML tokenizer: an attribute value may hold '>' only in
quotes, script and style bodies are opaque, and anything unterminated runs to
the end of the document.  Every alternative consumes what it scans and uses
possessive quantifiers, so one pass over a document is linear in its length and
uses constant stack.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column

from .binding import apply_text, let, q, struct
from .entities import unescape_sql

_NAME = r"[^\s/>][^\s/=>]*+"
_VALUE = r"(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)"
_ATTR = rf"{_NAME}(?:\s*+=++\s*+{_VALUE}?+)?+"
_ATTRS = rf"(?:[\s/]++|{_ATTR})*+"
_OPEN = rf"(?:[\s/]{_ATTRS})?+"

_COMMENT = r"<!--.*?(?:--(?:!|\s*+)>|\z)"
_SCRIPT = rf"<script{_OPEN}(?<!/)>.*?(?:</script[^>]*+>|\z)"
_STYLE = rf"<style{_OPEN}(?<!/)>.*?(?:</style[^>]*+>|\z)"
_TAG = rf"<[a-z][^\s/>]*+{_OPEN}(?:>|\z)"
_CDATA = r"<!\[cdata\[.*?(?:\]\]>|\z)"
_OTHER = r"<[/!?][^>]*+(?:>|\z)"

TOKEN_RE = "(?is)" + "|".join([_COMMENT, _SCRIPT, _STYLE, _TAG, _CDATA, _OTHER, r"[^<]++", "<"])
ATTR_RE = rf"(?s){_ATTR}"
_ATTR_NAME = rf"(?s)^({_NAME})"
_ATTR_RAW = rf"(?s)^{_NAME}\s*+=++\s*+(.*+)"
_TAG_NAME = r"(?s)^<([a-zA-Z][^\s/>]*+)"
_HEAD = rf"(?is)^<(?:script|style){_OPEN}>"
_RAW_TEXT = r"(?i)^<(?:script|style)(?:[\s/]|>)"
_RAW_CLOSE = r"(?i)</(?:script|style)[^>]*+>?\z"


def _kept(attrs: Iterable[str]) -> str:
    """Lookahead for one of the attributes; a name ending in '-' is a prefix."""
    return "(?:" + "|".join(sorted(a if a.endswith("-") else rf"{a}[\s=/>]" for a in attrs)) + ")"


def sparse_re(tags: Iterable[str], attrs: Iterable[str], blocks: bool) -> str:
    """Lossless split into tokens of interest (group 1) and runs of all others.

    Of interest are tags called one of ``tags``, tags with one of ``attrs``
    and, with ``blocks``, scripts and style sheets.  Far fewer strings leave
    the matcher than from ``TOKEN_RE``.
    """
    tags, attrs = sorted(tags), sorted(attrs)
    named = "|".join([*tags, *(["script", "style"] if blocks else [])])
    skip_tag = rf"(?!(?:{named})[\s/>])" if named else ""
    skip_attr = f"(?!{_kept(attrs)})" if attrs else ""
    plain = rf"<{skip_tag}[a-z][^\s/>]*+(?:[\s/]++|{skip_attr}{_ATTR})*+(?:>|\z)"
    runs = [r"[^<]++", *([] if blocks else [_SCRIPT, _STYLE]), plain, _COMMENT, _CDATA, _OTHER, "<(?![a-z/!?])"]
    wanted = [*([_SCRIPT, _STYLE] if blocks else []), _TAG]
    return f"(?is)(?:{'|'.join(runs)})++|({'|'.join(wanted)})"


def is_sparse_token(token: str, tags: Iterable[str], attrs: Iterable[str], blocks: bool) -> str:
    """Is a piece of the ``sparse_re`` split a token of interest?"""
    named = "|".join([*sorted(tags), *(["script", "style"] if blocks else [])])
    tests = [rf"^<(?:{named})[\s/>]"] if named else []
    if attrs:
        tests.append(rf"^<[a-z][^\s/>]*+(?:[\s/]++|(?!{_kept(attrs)}){_ATTR})*+{_kept(attrs)}")
    return f"rlike({token}, {q('(?is)' + '|'.join(tests))})"


def sparse_attrs_re(attrs: Iterable[str]) -> str:
    """Lossless split of what follows a tag name into the attributes of
    interest (group 1) and runs of everything else."""
    return rf"(?is)(?:[\s/>]++|(?!{_kept(attrs)}){_ATTR})++|({_ATTR})"


def closed_sql(token: str) -> str:
    """A tag that ends; script and style bodies may run to the end."""
    return f"(endswith({token}, '>') or rlike({token}, {q(_RAW_TEXT)}))"


def tokens_sql(html: str) -> str:
    return f"regexp_extract_all({html}, {q(TOKEN_RE)}, 0)"


def head_sql(token: str) -> str:
    """The start tag of a token (the token itself unless it has a body)."""
    return f"if(rlike({token}, {q(_RAW_TEXT)}), regexp_extract({token}, {q(_HEAD)}, 0), {token})"


def body_sql(token: str, head: str) -> str:
    """Text between a script or style start tag and its end tag."""
    return (
        f"if({head} <> '' and length({head}) < length({token}), "
        f"regexp_replace(substring({token}, length({head}) + 1), {q(_RAW_CLOSE)}, ''), '')"
    )


def tag_name_sql(token: str) -> str:
    return f"lower(regexp_extract({token}, {q(_TAG_NAME)}, 1))"


def after_name_sql(head: str) -> str:
    """What follows ``<name`` in a start tag."""
    return f"substring({head}, length(regexp_extract({head}, {q(_TAG_NAME)}, 1)) + 2)"


def attr_name_sql(piece: str) -> str:
    return f"lower(regexp_extract({piece}, {q(_ATTR_NAME)}, 1))"


def attr_raw_sql(piece: str) -> str:
    """Value text of an attribute with its quotes, '' if it has none."""
    return f"regexp_extract({piece}, {q(_ATTR_RAW)}, 1)"


def unquote_sql(raw: str) -> str:
    quoted = f"(startswith({raw}, '\"') or startswith({raw}, '\\''))"
    return f"if({quoted}, substring({raw}, 2, length({raw}) - 2), {raw})"


def attrs_sql(head: str, names: Iterable[str] = ()) -> str:
    """``array<struct<name, value>>`` of a start tag, values decoded; only of
    the attributes ``names``, if given."""

    def one(piece: str) -> str:
        value = let(attr_raw_sql(piece), lambda r: let(unquote_sql(r), unescape_sql))
        return struct(name=attr_name_sql(piece), value=value)

    rest = after_name_sql(head)
    found = f"regexp_extract_all({rest}, {q(ATTR_RE)}, 0)"
    if names:
        found = f"filter(regexp_extract_all({rest}, {q(sparse_attrs_re(names))}, 1), a -> a <> '')"
    return f"transform({found}, a -> {one('a')})"


def attr_sql(attrs: str, name: str) -> str:
    """Value of the last attribute called ``name``; NULL if there is none."""
    return f"try_element_at(filter({attrs}, a -> a.name = {q(name)}), -1).value"


def title_sql(tokens: str) -> str:
    """Text of the first title element, decoded, blanks folded."""
    start = let(
        f"transform({tokens}, t -> rlike(t, '(?i)^<title(?:[\\\\s/]|>)'))",
        lambda f: f"cast(array_position({f}, true) as int)",
    )

    def text(i: str) -> str:
        rest = f"slice({tokens}, {i} + 1, size({tokens}))"

        def upto(r: str) -> str:
            end = let(
                f"transform({r}, t -> rlike(t, '(?i)^</title(?:[\\\\s/]|>)'))",
                lambda f: f"cast(array_position({f}, true) as int)",
            )
            return let(end, lambda e: f"array_join(slice({r}, 1, if({e} = 0, size({r}), {e} - 1)), '')")

        raw = let(let(rest, upto), unescape_sql)
        return f"if({i} = 0, null, trim(regexp_replace({raw}, '\\\\s+', ' ')))"

    return let(start, text)


def tokenize_html(html: Column | str) -> Column:
    """Tokens of a document; joined together they are the document."""
    return apply_text(tokens_sql, html)


def tag_attributes(tag: Column | str) -> Column:
    return apply_text(attrs_sql, tag)
