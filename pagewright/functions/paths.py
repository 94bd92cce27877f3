"""Names and local paths derived from URLs."""

from __future__ import annotations

from pyspark.sql import Column

from .binding import apply_text, let, let_struct, q, struct
from .urls import UrlParts, fold_parents_sql, with_parts

# Fixed value: characters that may not appear in a file name.
UNSAFE_NAME = r'[<>:"/\\|?*\x00-\x1F]'
_BLANKS = " \t\n\r\u000b\f\u001c\u001d\u001e\u001f\u0085   　"
_EXTENSION = r"(?s)^\.*+[^.].*(\.[^.]*+)\z"
_FOLDER = r"(?s)^(?:.*/)?"
_LAST = r"[^/]*+\z"
_END_SLASHES = r"(?<!/)/++\z"
# A canonical web URL without query, params, empty or dotted segments.
_PLAIN_PAGE = r"^https?://[^/?#;\x00-\x20]++(?:(?:/[^/?#;\x00-\x20]++)++|/)?+\z"
_PLAIN_FILE = r"^https?://.*/[^/]*[^./][^/]*\.[^/]*+\z"


def short_hash_sql(seed: str) -> str:
    """Six reproducible characters standing where a random name would."""
    return f"substring(sha2({seed}, 256), 1, 6)"


def sanitize_sql(name: str, seed: str) -> str:
    safe = f"replace(trim(BOTH {q(_BLANKS)} FROM regexp_replace({name}, {q(UNSAFE_NAME)}, '_')), ' ', '_')"
    blank = f"coalesce(trim(BOTH {q(_BLANKS)} FROM {name}), '') = ''"
    return f"if({blank}, concat({short_hash_sql(seed)}, '.html'), {safe})"


def percent_decode_sql(text: str, plus_as_space: bool = False) -> str:
    """Percent-decoding that leaves malformed escapes as they are."""
    guarded = f"regexp_replace({text}, '%(?![0-9A-Fa-f]{{2}})', '%25')"
    if not plus_as_space:
        guarded = f"replace({guarded}, '+', '%2B')"
    return f"if(rlike({text}, '[%+]'), url_decode({guarded}), {text})"


def query_to_name_sql(query: str, seed: str) -> str:
    def pair(item: str) -> str:
        return struct(
            k=percent_decode_sql(f"regexp_extract({item}, '(?s)^([^=]*+)', 1)", True),
            v=percent_decode_sql(f"regexp_extract({item}, '(?s)^[^=]*+=(.*+)', 1)", True),
        )

    def name(pairs: str) -> str:
        def joined(ordered: str) -> str:
            text = f"concat({sanitize_sql('t.k', seed)}, '_', {sanitize_sql('t.v', seed)})"
            return f"array_join(transform({ordered}, t -> {text}), '_')"

        def regrouped(by_key: str) -> str:
            # runs of one key, each cut out once, in the order of their first pair
            def runs(starts: str) -> str:
                stop = f"coalesce(get({starts}, j + 1), size({by_key}) + 1)"
                cut = f"struct({by_key}[s - 1].i as first, slice({by_key}, s, {stop} - s) as items)"
                return f"flatten(transform(array_sort(transform({starts}, (s, j) -> {cut})), r -> r.items))"

            begins = f"if(i = 0 or {by_key}[i - 1].k <> x.k, i + 1, 0)"
            starts = f"filter(transform({by_key}, (x, i) -> {begins}), s -> s > 0)"
            return let(let(starts, runs), joined)

        by_key = f"array_sort(transform({pairs}, (p, i) -> struct(p.k as k, i as i, p.v as v)))"
        return f"if(size({pairs}) = 0, {short_hash_sql(seed)}, {let(by_key, regrouped)})"

    items = f"filter(split({query}, '&'), s -> s <> '')"
    return let(f"transform({items}, i -> {pair('i')})", name)


def extension_sql(filename: str) -> str:
    """Extension with its dot: the last dot, unless only dots stand before it."""
    return f"regexp_extract({filename}, {q(_EXTENSION)}, 1)"


def _path_from_parts(prefix: str, p: UrlParts, url: str) -> str:
    def place(v: str) -> str:
        # v.folder ends with '/', v.file is the bare name
        def named(ext: str) -> str:
            stem = f"substring({v}.file, 1, length({v}.file) - length({ext}))"
            return (
                f"concat({v}.folder, {stem}, '__', {query_to_name_sql(p.query, url)}, "
                f"if({ext} = '', '.html', {ext}))"
            )

        return f"if({p.query} = '', concat({v}.folder, {v}.file), {let(extension_sql(f'{v}.file'), named)})"

    def locate(path: str) -> str:
        # no leading '/'
        last = f"regexp_extract({path}, {q(_LAST)}, 0)"
        parent = f"regexp_replace(regexp_extract({path}, {q(_FOLDER)}, 0), {q(_END_SLASHES)}, '/')"

        def settle(w: str) -> str:
            folder = (
                f"case when {w}.ext <> '' then {parent} "
                f"when {path} = '' or endswith({path}, '/') then {path} else concat({path}, '/') end"
            )
            return let_struct(
                place,
                folder=f"concat({q(prefix)}, if({p.netloc} = '', '', concat({p.netloc}, '/')), {folder})",
                file=f"if({w}.ext <> '', {w}.last, 'index.html')",
            )

        return let_struct(settle, last=last, ext=extension_sql(last))

    return let(f"ltrim('/', {p.path})", locate)


def local_path_sql(root_dir: str, url: str) -> str:
    prefix = root_dir.rstrip("/") + "/" if root_dir else ""
    rest = f"concat({q(prefix)}, substring({url}, position('://', {url}) + 3))"
    usual = (
        f"concat({rest}, case when endswith({url}, '/') then 'index.html' "
        f"when rlike({url}, {q(_PLAIN_FILE)}) then '' else '/index.html' end)"
    )
    general = with_parts(url, lambda p: _path_from_parts(prefix, p, url))
    return f"if(rlike({url}, {q(_PLAIN_PAGE)}) and not contains({url}, '/.'), {usual}, {general})"


def parent_folder_sql(path: str) -> str:
    return f"regexp_replace(regexp_extract({path}, {q(_FOLDER)}, 0), {q(_END_SLASHES)}, '')"


def segments_sql(path: str) -> str:
    """Segments of a path with '', '.' removed and '..' folded."""

    return let(f"filter(split({path}, '/'), s -> s not in ('', '.'))", fold_parents_sql)


def start_sql(folder: str) -> str:
    """What ``relative_sql`` needs to know of the start folder: its segments and
    each of its ancestors (itself last) with a final '/'."""
    return let(
        segments_sql(folder),
        lambda s: struct(
            segs=s,
            dirs=f"transform({s}, (x, i) -> concat(array_join(slice({s}, 1, i + 1), '/'), '/'))",
        ),
    )


def relative_sql(start: str, target: str) -> str:
    """Path of ``target`` as seen from a folder described by ``start_sql``."""

    def short(n: str) -> str:
        # n ancestors of the start folder also hold the target
        skip = f"if({n} = 0, 0, length({start}.dirs[{n} - 1]))"
        return f"concat(repeat('../', size({start}.dirs) - {n}), substring({target}, {skip} + 1))"

    def general(segs: str) -> str:
        def build(n: str) -> str:
            ups = f"array_repeat('..', size({start}.segs) - {n})"
            rest = f"slice({segs}, {n} + 1, greatest(size({segs}) - {n}, 0))"
            return let(f"array_join(concat({ups}, {rest}), '/')", lambda s: f"if({s} = '', '.', {s})")

        # zip pads the shorter side with NULL: the first unequal pair ends the
        # shared prefix
        equal = f"zip_with({segs}, {start}.segs, (a, b) -> a <=> b)"
        first = let(equal, lambda e: f"coalesce(nullif(cast(array_position({e}, false) as int), 0), size({e}) + 1) - 1")
        return let(first, build)

    usual = f"not rlike({target}, {q(r'^/|//|/\.|/\z|^\.')}) and {target} <> ''"
    inside = f"not exists({start}.dirs, d -> d = concat({target}, '/'))"
    return (
        f"if({usual} and {inside}, "
        f"{let(f'size(filter({start}.dirs, d -> startswith({target}, d)))', short)}, "
        f"{let(segments_sql(target), general)})"
    )


# --- Column forms ---------------------------------------------------------


def sanitize_name(name: Column | str, seed: Column | str) -> Column:
    """File-name-safe text; blank input takes a name derived from ``seed``."""
    return apply_text(sanitize_sql, name, seed)


def percent_decode(text: Column | str) -> Column:
    return apply_text(percent_decode_sql, text)


def query_to_name(query: Column | str, seed: Column | str) -> Column:
    """``a=1&b=2&a=3`` -> ``a_1_a_3_b_2``: decoded, name-safe, repeated keys
    grouped where the key is first seen."""
    return apply_text(query_to_name_sql, query, seed)


def local_path(root_dir: str, url: Column | str) -> Column:
    """Path of the file that holds ``url`` in the mirror under ``root_dir``."""
    return apply_text(lambda u: local_path_sql(root_dir, u), url)


def parent_folder(path: Column | str) -> Column:
    """Folder part of a path, without the final slash."""
    return apply_text(parent_folder_sql, path)


def relative_path(target: Column | str, start_dir: Column | str) -> Column:
    """Path of ``target`` as seen from folder ``start_dir``."""
    return apply_text(lambda t, s: let(start_sql(s), lambda v: relative_sql(v, t)), target, start_dir)


def resolve_path(start_dir: Column | str, relative: Column | str) -> Column:
    """Inverse of ``relative_path``: the path ``relative`` points at."""
    return apply_text(
        lambda s, r: f"array_join({segments_sql(f'''concat({s}, '/', {r})''')}, '/')", start_dir, relative
    )
