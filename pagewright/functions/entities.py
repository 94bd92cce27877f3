"""Character references in attribute values."""

from __future__ import annotations

import json
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column

from .binding import apply_text, let, let_struct, q

_PIECE = r"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[^\t\n\f <&#;]{1,32};?)|[^&]++|&"
# Names that also count without a final semicolon, longest first.
_BARE = r"^&(" + "|".join(
    sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
) + ")"


# Most references are one of these; they need no search among all names.
_COMMON = ("amp", "lt", "gt", "quot", "apos", "nbsp")


@lru_cache(maxsize=1)
def _names_sql() -> str:
    # folded to one map literal by the optimizer
    return f"from_json({q(json.dumps(html5, ensure_ascii=False))}, 'map<string,string>')"


@lru_cache(maxsize=1)
def _c1_sql() -> str:
    # code points 128-159 stand for their Windows-1252 characters
    chars = [bytes([n]).decode("cp1252", errors="replace") for n in range(128, 160)]
    return "array(" + ", ".join(q(chr(128 + i) if c == "�" else c) for i, c in enumerate(chars)) + ")"


def _code_point_sql(n: str) -> str:
    dropped = (
        f"{n} between 1 and 8 or {n} = 11 or {n} between 14 and 31 or {n} = 127 "
        f"or {n} between 64976 and 65007 or ({n} & 65534) = 65534"
    )
    return (
        f"case when {n} = 0 or {n} between 55296 and 57343 or {n} > 1114111 then {q('�')} "
        f"when {n} = 13 then {q(chr(13))} "
        f"when {n} between 128 and 159 then element_at({_c1_sql()}, cast({n} - 127 as int)) "
        f"when {dropped} then '' "
        f"else decode(unhex(lpad(hex({n}), 8, '0')), 'UTF-32') end"
    )


def unescape_sql(text: str) -> str:
    """Decode character references the way HTML attribute values are decoded."""

    def piece(names: str, p: str) -> str:
        bare = let(
            f"regexp_extract({p}, {q(_BARE)}, 1)",
            lambda n: f"if({n} = '', {p}, concat({names}[{n}], substring({p}, length({n}) + 2)))",
        )
        digits = f"regexp_extract({p}, '^&#[xX]?([0-9a-fA-F]+)', 1)"
        value = let_struct(
            lambda v: let(
                # more than eight significant digits are beyond Unicode in any base
                f"if(length({v}.digits) > 8, 4294967295L, cast(conv(concat('0', {v}.digits), {v}.base, 10) as bigint))",
                _code_point_sql,
            ),
            digits=f"ltrim('0', {digits})",
            base=f"if(rlike({p}, '^&#[xX]'), 16, 10)",
        )
        return (
            f"case when not startswith({p}, '&') or {p} = '&' then {p} "
            + "".join(f"when {p} = {q(f'&{n};')} then {q(html5[f'{n};'])} " for n in _COMMON)
            + f"when rlike({p}, '^&#(?:[0-9]|[xX][0-9a-fA-F])') then {value} "
            f"else coalesce({names}[substring({p}, 2)], {bare}) end"
        )

    decoded = let(
        _names_sql(),
        lambda names: f"array_join(transform(regexp_extract_all({text}, {q(_PIECE)}, 0), p -> {piece(names, 'p')}), '')",
    )
    return f"if(contains({text}, '&'), {decoded}, {text})"


def escape_attr_sql(text: str) -> str:
    """Text made safe for a double-quoted attribute."""
    out = text
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = f"replace({out}, {q(char)}, {q(name)})"
    return out


def unescape_entities(text: Column | str) -> Column:
    return apply_text(unescape_sql, text)
