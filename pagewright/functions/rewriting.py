"""Rewriting of one document, in three steps.

1. ``page_pieces_sql`` cuts a document into pieces ``(pre, kind, raw, ref,
   post)``.  Plain text has kind '' and sits in ``raw``.  For a reference,
   ``raw`` is its original text and ``pre + new value + post`` its replacement.
2. ``joined_pieces_sql`` adds the canonical URL of every reference.
3. ``parts_sql`` replaces page links, which are functions of the page alone,
   and leaves assets open, because whether one is replaced depends on a table
   of captured assets.  The result is an array that repeats ``text, raw, pre,
   post, url``; ``fill_sql`` closes the gaps once the answers are known.

The steps are separate projections, which keeps each expression shallow.
"""

from __future__ import annotations

from .binding import let, let_struct, q, struct
from .css import URL_PIECES, is_ref_sql, ref_parts_sql
from .entities import escape_attr_sql, unescape_sql
from .html import (
    after_name_sql,
    attr_name_sql,
    attr_raw_sql,
    closed_sql,
    head_sql,
    is_sparse_token,
    sparse_attrs_re,
    sparse_re,
    tag_name_sql,
    unquote_sql,
)
from .paths import local_path_sql, parent_folder_sql, relative_sql, start_sql
from .refs import button_target_sql
from .urls import base_sql, is_http_sql, normalize_sql, same_domain_sql

_RAW_NAME = r"(?s)^[^\s/>][^\s/=>]*+"
# Kinds: L link attribute, B button, A asset attribute, C style text, E style
# text inside an attribute.
_PIECE_TYPE = "array<struct<pre string, kind string, raw string, ref string, post string>>"
CYCLE = 5


def _piece(raw: str, kind: str = "''", ref: str = "''", pre: str = "''", post: str = "''") -> str:
    return struct(pre=pre, kind=kind, raw=raw, ref=ref, post=post)


def _css_pieces(text: str, kind: str) -> str:
    """Pieces of style text."""
    return _ref_pieces(f"regexp_extract_all({text}, {q(URL_PIECES)}, 0)", kind)


def _ref_pieces(pieces: str, kind: str) -> str:
    """References and text of lossless pieces."""

    def piece(c: str) -> str:
        def ref(v: str) -> str:
            decoded = unescape_sql(f"{v}.ref") if kind == "E" else f"{v}.ref"
            held = f"if({v}.ref = '' or contains({v}.ref, {q(chr(10))}), '', {q(kind)})"
            return _piece(c, held, decoded, f"{v}.lead", f"{v}.trail")

        return f"if({is_ref_sql(c)}, {let(ref_parts_sql(c, kind == 'E'), ref)}, {_piece(c)})"

    return f"transform({pieces}, c -> {piece('c')})"


def page_pieces_sql(html: str, links: bool, static: bool, styles: bool) -> str:
    def attribute(name: str, p: str) -> str:
        def named(v: str) -> str:
            decoded = f"{v}.value"
            opening = f"concat({v}.name, '=\"')"
            cases = []
            if links:
                spot = (
                    f"({name} = 'a' and {v}.attr = 'href') or ({name} = 'form' and {v}.attr = 'action') "
                    f"or ({name} in ('video', 'audio', 'source') and {v}.attr = 'src')"
                )
                one = _piece(p, "'L'", decoded, opening, "'\"'")
                cases.append(f"when {spot} then array({one})")
                target = let(decoded, button_target_sql)
                button = let(
                    target,
                    lambda x: f"if({x} is null, {_piece(p)}, "
                    + _piece(p, "'B'", x, f"concat({opening}, 'location.href=\\'')", "'\\'\"'")
                    + ")",
                )
                cases.append(f"when {name} = 'button' and {v}.attr = 'onclick' then array({button})")
            if static:
                spot = (
                    f"(({name} in ('img', 'script') and {v}.attr = 'src') or ({name} = 'link' and {v}.attr = 'href')) "
                    f"and {v}.raw <> ''"
                )
                one = _piece(p, "'A'", decoded, opening, "'\"'")
                cases.append(f"when {spot} then array({one})")
            if styles:
                quote = f"if(rlike({v}.raw, '^[\"\\']'), '', '\"')"
                text = _css_pieces(f"{v}.raw", "E")
                cases.append(
                    f"when {v}.attr = 'style' and contains({v}.raw, 'url(') then "
                    f"concat(array({_piece(f'concat({v}.name, {q("=")}, {quote})')}), {text}, array({_piece(quote)}))"
                )
            return f"case {' '.join(cases)} else array({_piece(p)}) end" if cases else f"array({_piece(p)})"

        return let(
            attr_raw_sql(p),
            lambda raw: let_struct(
                named,
                attr=attr_name_sql(p),
                name=f"regexp_extract({p}, {q(_RAW_NAME)}, 0)",
                raw=raw,
                value=let(unquote_sql(raw), unescape_sql),
            ),
        )

    tags = {"a", "form", "button", "video", "audio", "source"} if links else set()
    read = {"href", "action", "src", "onclick"} if links else set()
    if static:
        tags |= {"img", "link"}
        read |= {"src", "href"}
    anywhere = {"style"} if styles else set()
    read |= anywhere
    blocks = static or styles
    relevant = f"rlike(p, {q('(?i)^(?:' + '|'.join(sorted(read)) + r')(?:[\s=]|\z)')})"

    def token(t: str) -> str:
        def cut(v: str) -> str:
            opening = f"substring({v}.head, 1, length({v}.head) - length({v}.rest))"
            pieces = (
                f"flatten(transform(regexp_extract_all({v}.rest, {q(sparse_attrs_re(read))}, 0), "
                f"p -> if({relevant}, {attribute(f'{v}.name', 'p')}, array({_piece('p')}))))"
            )
            tail = f"substring({t}, length({v}.head) + 1)"
            end = f"array({_piece(tail)})"
            if styles:
                block = f"{v}.name = 'style' and contains({t}, 'url(')"
                end = f"if({block}, {_css_pieces(tail, 'C')}, {end})"
            whole = f"concat(array({_piece(opening)}), {pieces}" + (f", {end})" if blocks else ")")
            return f"if({v}.head = '', array({_piece(t)}), {whole})"

        def parsed(v: str) -> str:
            return let_struct(cut, name=f"{v}.name", head=f"{v}.head", rest=after_name_sql(f"{v}.head"))

        whole = let_struct(parsed, name=tag_name_sql(t), head=head_sql(t) if blocks else t)
        touched = f"{is_sparse_token(t, tags, anywhere, blocks)} and {closed_sql(t)}"
        return f"if({touched}, {whole}, array({_piece(t)}))"

    tokens = f"regexp_extract_all({html}, {q(sparse_re(tags, anywhere, blocks))}, 0)"
    return f"cast(flatten(transform({tokens}, t -> {token('t')})) as {_PIECE_TYPE})"


def sheet_pieces_sql(pieces: str) -> str:
    """The pieces of a style sheet, references taken apart."""
    return f"cast({_ref_pieces(pieces, 'C')} as {_PIECE_TYPE})"


def joined_pieces_sql(pieces: str, url: str) -> str:
    """Pieces with ``url``, the canonical form of ``ref`` (NULL for text)."""

    def one(base: str) -> str:
        target = f"if(p.kind = '', null, {let('p.ref', lambda r: normalize_sql(base, r))})"
        moved = ", ".join(f"{q(n)}, p.{n}" for n in ("pre", "kind", "raw", "post"))
        return f"transform({pieces}, p -> named_struct({moved}, 'url', {target}))"

    return let(base_sql(url), one)


def _open(mark: str) -> str:
    return f"concat({mark}, p.kind, p.raw, {mark}, p.pre, {mark}, p.post, {mark}, p.url, {mark})"


def _asset_sql(root: str, mode: str) -> str:
    """Is piece ``p`` an asset reference that may be replaced?"""
    return (
        f"p.url is not null and p.kind in ('A', 'C', 'E') and {is_http_sql('p.url')} "
        f"and {same_domain_sql(root, 'p.url', mode)}"
    )


def page_open_urls_sql(pieces: str, root: str, mode: str) -> str:
    """URLs of the open references of a page, in the order of its parts."""
    return f"transform(filter({pieces}, p -> {_asset_sql(root, mode)}), p -> p.url)"


def page_parts_sql(pieces: str, url: str, html: str, root_dir: str, root: str, mode: str) -> str:
    def text(ctx: str) -> str:
        local = let(local_path_sql(root_dir, "p.url"), lambda t: relative_sql(f"{ctx}.start", t))
        value = let(f"if({same_domain_sql(root, 'p.url', mode)}, {local}, p.url)", escape_attr_sql)
        one = (
            "case when p.url is null then p.raw "
            f"when p.kind in ('L', 'B') then concat(p.pre, {value}, p.post) "
            f"when {_asset_sql(root, mode)} then {_open(f'{ctx}.mark')} else p.raw end"
        )
        return f"split(array_join(transform({pieces}, p -> {one}), ''), {ctx}.mark)"

    own = let(local_path_sql(root_dir, url), lambda p: start_sql(parent_folder_sql(p)))
    return let_struct(text, start=own, mark=mark_sql(html))


def sheet_parts_sql(pieces: str, content: str) -> str:
    def text(mark: str) -> str:
        one = f"if(p.url is null or startswith(p.url, 'data:'), p.raw, {_open(mark)})"
        return f"split(array_join(transform({pieces}, p -> {one}), ''), {mark})"

    return let(mark_sql(content), text)


def mark_sql(document: str) -> str:
    """Separator of parts: a hash of the document cannot occur in it by
    accident."""
    return f"concat({q(chr(0))}, sha2({document}, 256))"


def open_urls_sql(parts: str) -> str:
    """URLs of the open references, in order."""
    return f"filter(transform({parts}, (p, i) -> if(i % {CYCLE} = {CYCLE - 1}, p, null)), p -> p is not null)"


def fill_sql(parts: str, paths: str) -> str:
    """The document, each open reference replaced where ``paths`` has an
    answer."""

    def one(n: str) -> str:
        attr = escape_attr_sql(n)
        value = (
            f"case when startswith(p, 'A') then {attr} "
            f"when startswith(p, 'E') then replace({attr}, '\\'', '&#39;') else {n} end"
        )
        after = f"concat({{0}}[i + 1], {value}, {{0}}[i + 2])"
        return f"if({n} is null, substring(p, 2), {after})"

    def joined(ps: str) -> str:
        answer = let(f"get({paths}, cast(i div {CYCLE} as int))", lambda n: one(n).replace("{0}", ps))
        return f"array_join(transform({ps}, (p, i) -> case i % {CYCLE} when 0 then p when 1 then {answer} else '' end), '')"

    return let(parts, joined)
