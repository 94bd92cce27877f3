"""The catalogued queries in plain SQL for a second engine.

Written for the shapes of address and markup the inputs hold, and on purpose
not by the means the Spark jobs use: tokens come from another regular
expression, joins and windows stand where the jobs use array functions.
"""

from __future__ import annotations

from . import inputs as i

ROOT = i.ROOT

_TOKEN = (
    r"""(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"""
    r"""|</?[a-z][^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>|<![^>]*>|[^<]+|<"""
).replace("'", "''")

_AUG = f"aug as (select page_id, url, {i.AUGMENTED} as html from pages)"
_TOK = (
    _AUG + f", toks as (select page_id, url, regexp_extract_all(html, '{_TOKEN}', 0) as ts from aug)"
    ", tok as (select page_id, url, unnest(ts) as token, unnest(range(0, len(ts))) as pos from toks)"
)


def _decoded(text: str) -> str:
    """The character references the pages hold, decoded; some are cut short."""
    named = f"replace(replace(replace({text}, '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34))"
    return f"regexp_replace({named}, '&amp;?', '&', 'g')"


def _attr(name: str, column: str = "token") -> str:
    return f"""regexp_extract({column}, '\\s{name}="([^"]*)"', 1)"""


# kind -> SELECT page_id, url, kind, raw
_KINDS = {
    "a_href": f"select page_id, url, 'a_href' as kind, replace({_attr('href')}, '&amp;', '&') as raw from tok where token like '<a %'",
    "form_action": f"select page_id, url, 'form_action', {_attr('action')} from tok where token like '<form %'",
    "button_onclick": f"select page_id, url, 'button_onclick', regexp_extract({_attr('onclick')}, 'location.href=''([^'']*)''', 1) from tok where token like '<button %'",
    "media_src": f"select page_id, url, 'media_src', {_attr('src')} from tok where token like '<video %'",
    "style_attr": "select page_id, url, 'style_attr', regexp_extract(token, 'url\\(''([^'']*)''\\)', 1) from tok where token like '<div style=%'",
    "style_block": "select page_id, url, 'style_block', regexp_extract(token, 'url\\(([^)]*)\\)', 1) from tok where token like '<style>%url(%'",
    "meta_refresh": "select page_id, url, 'meta_refresh', regexp_extract(token, 'url=([^\"]*)\"', 1) from tok where token like '<meta http-equiv=%'",
    "js_href": "select page_id, url, 'js_href', regexp_extract(token, 'window.location.href=\"([^\"]*)\"', 1) from tok where token like '<script>window.location%'",
    "js_open": "select page_id, url, 'js_open', regexp_extract(token, 'window.open\\(\"([^\"]*)\"', 1) from tok where token like '<script>window.location%'",
    "js_fetch": "select page_id, url, 'js_fetch', regexp_extract(token, 'fetch\\(\"([^\"]*)\"', 1) from tok where token like '<script>window.location%'",
    "data_attr": f"select page_id, url, 'data_attr', {_attr('data-url')} from tok where token like '<p data-url=%'",
}
_STATIC = {
    "img_src": f"select page_id, url, 'img_src' as kind, {_attr('src')} as raw from tok where token like '<img src=%'",
    "script_src": f"select page_id, url, 'script_src', {_attr('src')} from tok where token like '<script src=%'",
    "link_href": f"select page_id, url, 'link_href', {_attr('href')} from tok where token like '<link %'",
}


def _absolute(raw: str = "raw", url: str = "url") -> str:
    """Join of the shapes of link in the data with a page address."""
    scheme = f"regexp_extract({url}, '^([a-z]+):', 1)"
    origin = f"regexp_extract({url}, '^([a-z]+://[^/?#]*)', 1)"
    folder = f"regexp_replace(regexp_extract({url}, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$', '')"
    return (
        f"case when {raw} like 'http://%' or {raw} like 'https://%' then {raw} "
        f"when {raw} like '//%' then {scheme} || ':' || {raw} "
        f"when {raw} like '/%' then {origin} || {raw} "
        f"when {raw} like '../%' then {origin} || regexp_replace({folder}, '[^/]+/$', '') || substr({raw}, 4) end"
    )


def _canon(url: str) -> str:
    """Canonical form of an absolute address."""
    bare = f"regexp_replace({url}, '#.*$', '')"
    path = f"regexp_extract({bare}, '^([^?]*)', 1)"
    return (
        f"case when regexp_matches({path}, '^[a-z]+://[^/]+/.*/$') or regexp_matches({path}, '^[a-z]+://[^/]+/[^/]+/$') "
        f"then rtrim({path}, '/') else {bare} end"
    )


def _links(kinds=None) -> str:
    parts = [_KINDS[k] for k in (kinds or _KINDS)]
    return (
        f"{_TOK}, refs as ({' union all '.join(parts)})"
        f", joined as (select distinct page_id, url, kind, raw, {_absolute()} as abs from refs)"
        f", links as (select page_id, url, kind, raw, {_canon('abs')} as dst_url from joined)"
    )


def _static() -> str:
    return (
        f"{_TOK}, srefs as ({' union all '.join(_STATIC.values())})"
        f", statics as (select distinct page_id, url, kind, raw, {_absolute()} as dst_url from srefs)"
    )


def _assets() -> str:
    """Static and style references of pages, as ``asset_refs``."""
    parts = [*_STATIC.values(), _KINDS["style_attr"], _KINDS["style_block"]]
    return (
        f"{_TOK}, arefs as ({' union all '.join(parts)})"
        f", assets as (select distinct page_id, url, kind, raw, {_absolute()} as dst_url from arefs)"
    )


def _host(url: str) -> str:
    return f"regexp_extract({url}, '^[a-z]+://([^/?#]*)', 1)"


def _local(url: str, root: str = "out/") -> str:
    """Local path of a canonical address of the data."""
    bare = f"regexp_extract({url}, '^[a-z]+://([^?]*)', 1)"
    query = f"regexp_extract({url}, '\\?(.*)$', 1)"
    named = f"replace(replace(replace({query}, '&amp;', '&'), '&', '_'), '=', '_')"
    last = f"regexp_extract({bare}, '([^/]*)$', 1)"
    has_ext = f"({bare} like '%/%' and regexp_matches({last}, '^\\.*[^.].*\\.[^.]*$'))"
    file = (
        f"case when {bare} like '%/' then {bare} || 'index.html' when {has_ext} then {bare} "
        f"else {bare} || '/index.html' end"
    )
    return (
        f"'{root}' || case when {query} = '' then {file} "
        f"else regexp_replace({file}, '\\.([^./]*)$', '') || '__' || {named} || '.' || regexp_extract({file}, '\\.([^./]*)$', 1) end"
    )


def _relative(target: str, folder: str) -> str:
    t, s = f"string_split({target}, '/')", f"string_split({folder}, '/')"
    common = f"len(list_filter(range(1, least(len({t}), len({s})) + 1), lambda n: {t}[1:n] = {s}[1:n]))"
    return f"repeat('../', len({s}) - {common}) || array_to_string({t}[{common} + 1:], '/')"


def _folder(path: str) -> str:
    return f"regexp_replace({path}, '/[^/]*$', '')"


_PAGES = f"own as (select page_id, url, {_canon('url')} as canonical from pages)"
_MANIFEST_PATHS = [*i.SHEETS, *i.IMAGES]


def _origin_rows(paths) -> str:
    values = ", ".join(f"'{p}'" for p in paths)
    return (
        "select o.origin || p.path as url, p.path as path from "
        "(select distinct regexp_extract(url, '^(https?://[^/?#]+)', 1) as origin from pages) o, "
        f"(select unnest([{values}]) as path) p"
    )


_RESOURCES = (
    f"resources as (select url, path, case when path like '%.css' then {i.SHEET_BODY} else 'x' end as content "
    f"from ({_origin_rows(_MANIFEST_PATHS)}))"
)
_RMAP = f"rmap as (select url, 'out/' || regexp_replace(url, '^https?://', '') as local_path from ({_origin_rows(_MANIFEST_PATHS)}))"

_ROBOTS = (
    f"hosts as (select distinct {_host('url')} as host from pages), "
    f"robots as (select host, {i.ROBOTS_STATUS} as status_code, {i.ROBOTS_BODY} as body from hosts)"
)
# One row per line, then the state machine as windows.
_RULES = (
    _ROBOTS + ", ls as (select host, string_split(body, chr(10)) as l from robots)"
    ", raw_lines as (select host, unnest(l) as line, unnest(range(0, len(l))) as line_no from ls)"
    ", keyed as (select host, line_no, line, trim(regexp_replace(line, '#.*$', '')) as c from raw_lines)"
    ", kv as (select host, line_no, line, c, lower(trim(split_part(c, ':', 1))) as k, "
    "trim(substr(c, strpos(c, ':') + 1)) as v from keyed)"
    ", ev as (select *, case when line = '' then 'B' when k = 'user-agent' then 'U' "
    "when k in ('disallow', 'allow', 'crawl-delay', 'request-rate') then 'R' end as e from kv)"
    ", st as (select *, last_value(case when e in ('B', 'U') then e end ignore nulls) over (partition by host order by line_no "
    "rows between unbounded preceding and 1 preceding) as state, "
    "lag(e) over (partition by host order by line_no) as prev from (select * from ev where e is not null))"
    ", mk as (select *, sum(case when e = 'U' and coalesce(prev, 'B') <> 'U' then 1 else 0 end) over "
    "(partition by host order by line_no) as g from st where e = 'U' or (e = 'R' and state = 'U'))"
    ", ag as (select host, g, string_agg(v, ',' order by line_no) as agents from mk where e = 'U' group by host, g)"
    ", dl as (select host, g, max(cast(v as int)) as crawl_delay from mk where k = 'crawl-delay' group by host, g)"
    ", rl as (select host, g, line_no, k, v, cast(row_number() over (partition by host, g order by line_no) as int) as rule_no "
    "from mk where k in ('allow', 'disallow'))"
    ", gs as (select ag.host, ag.g, cast(row_number() over (partition by ag.host order by ag.g) as int) as group_no, agents, "
    "crawl_delay from ag left join dl on dl.host = ag.host and dl.g = ag.g "
    "where exists (select 1 from mk where mk.host = ag.host and mk.g = ag.g and mk.e = 'R'))"
    ", rules as (select gs.host, group_no, agents, rule_no, (k = 'allow' or v = '') as allow, v as path, crawl_delay "
    "from gs left join rl on rl.host = gs.host and rl.g = gs.g)"
    # the group that speaks to the agent 'archivebot'
    ", pick as (select host, min_by(group_no, case when agents = '*' then 1000 else 0 end + group_no) as group_no from "
    "(select distinct host, group_no, agents from rules) where agents = '*' or contains('archivebot', lower(agents)) group by host)"
)

_STATE_ROWS = (
    f"srows as (select {_canon('url')} as url, case when page_id % 3 = 0 then 'visited' else 'pending' end as status, "
    f"case when page_id % 3 = 0 then timestamp '{i.STAMP}' end as last_fetched, cast(page_id % 4 as int) as level, "
    "case when page_id % 3 = 0 then (['saved', 'denied', 'failed', 'empty', 'non_html'])[(page_id % 5) + 1] end as outcome from pages)"
    ", state as (select url, max(status) as status, max(last_fetched) as last_fetched, min(level) as level, "
    "max(outcome) as outcome from srows group by url)"
)

# verdicts (url, allowed) of the addresses in ``urls``, after _RULES
_VERDICTS = (
    f"u as (select url, {_host('url')} as host, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/]*(.*)$', 1), ''), '/') as target from urls)"
    ", first_rule as (select u.url, min_by(r.allow, r.rule_no) as allow from u join pick using (host) "
    "join rules r on r.host = pick.host and r.group_no = pick.group_no where starts_with(u.target, r.path) group by u.url)"
    ", by_host as (select u.url, s.status_code, f.allow from u left join robots s on s.host = u.host left join first_rule f on f.url = u.url)"
    ", verdicts as (select url, case when status_code is null or status_code = 404 then true when status_code = 503 then false "
    "else coalesce(allow, true) end as allowed from by_host)"
)

_MAPS = (
    "maps as (select page_id, url, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/map' || page_id || '.xml' as sitemap_url from pages)"
    ", locs as (select sitemap_url, unnest([url, url]) as loc from maps where page_id % 10 <> 9)"
)

_FORMS = (
    "plain as (select url, regexp_replace(url, '[?#].*$', '') as p from pages)"
    ", raw_forms as (select unnest([url, p, rtrim(p, '/') || '/#x']) as url from plain)"
    f", forms as (select distinct {_canon('url')} as canonical, url as form from raw_forms)"
    ", dups as (select canonical, count(*) as n_forms, min(form) as first_form, max(form) as last_form from forms "
    "group by canonical having count(*) > 1)"
    # raw forms may still hold '#' and a final '/': their path is that of the parts
    ", placed as (select distinct url, regexp_replace(url, '#.*$', '') as u from raw_forms)"
    f", paths as (select url, {_local('u')} as local_path from placed)"
    ", clash as (select local_path, count(*) as n_urls, min(url) as first_url, max(url) as last_url from paths "
    "group by local_path having count(*) > 1)"
)

# --- rewriting: one new token per touched token ----------------------------


def _esc(text: str) -> str:
    return f"replace({text}, '&', '&amp;')"


_INSIDE = f"ends_with({_host('dst')}, '{ROOT}')"


def _rewritten(links: bool, static: bool, styles: bool) -> str:
    """``done(page_id, local_path, html)``."""
    kinds = []
    if links:
        kinds += ["a_href", "form_action", "button_onclick", "media_src"]
    if styles:
        kinds += ["style_attr", "style_block"]
    sources = [_KINDS[k] for k in kinds] + (list(_STATIC.values()) if static else [])
    # carry the position so that the token can be replaced
    sources = [
        s.replace(" as kind", "").replace(" as raw", "").replace("select page_id, url, ", "select page_id, url, pos, token, ", 1)
        for s in sources
    ]
    sources[0] = sources[0].replace(" from tok", " from tok", 1)
    refs = "select * from (" + " union all ".join(sources) + ") as r(page_id, url, pos, token, kind, raw)"
    asset = "kind in ('style_attr', 'style_block', 'img_src', 'script_src', 'link_href')"
    rel_page = _relative(_local("dst"), "folder")
    rel_asset = _relative("local_path", "folder")
    return (
        f"{_TOK}, {_RMAP}, {_PAGES}, placed_pages as (select page_id, {_local('canonical')} as own from own)"
        f", refs as ({refs})"
        f", targets as (select refs.*, {_canon(_absolute())} as dst, own, {_folder('own')} as folder from refs "
        "join placed_pages using (page_id))"
        f", answers as (select t.*, m.local_path, case when {asset} then case when {_INSIDE} and m.local_path is not null then {rel_asset} end "
        f"when {_INSIDE} then {rel_page} else dst end as value from targets t left join rmap m on m.url = t.dst)"
        ", edits as (select page_id, pos, case when value is null then token "
        "when kind in ('style_attr', 'style_block', 'button_onclick') then replace(token, raw, value) "
        f"else replace(token, '\"' || {_esc('raw')} || '\"', '\"' || {_esc('value')} || '\"') end as token from answers)"
        ", done as (select tok.page_id, string_agg(coalesce(edits.token, tok.token), '' order by tok.pos) as html "
        "from tok left join edits on edits.page_id = tok.page_id and edits.pos = tok.pos group by tok.page_id)"
        ", final as (select done.page_id, own as local_path, html from done join placed_pages using (page_id))"
    )


def _rewrite_query(links: bool, static: bool, styles: bool) -> str:
    return f"with {_rewritten(links, static, styles)} select page_id, local_path, md5(html) as html_md5 from final"


def _kind_query(*kinds: str) -> str:
    return f"with {_links(kinds)} select page_id, kind, raw, dst_url from links"


def _link_set(where: str = "") -> str:
    inside = f"ends_with({_host('dst_url')}, '{ROOT}')"
    return f"{_links()}, targets as (select distinct page_id, url, dst_url from links where {inside}{where})"


_CSS_BASE = "regexp_extract(url, '^(.*/)', 1)"
_FETCHED = f"timestamp '{i.FETCHED}'"
_TEXT_TIME = "strftime(last_fetched, '%Y-%m-%d %H:%M:%S') as last_fetched"


def oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    o["u_normalize_pages"] = f"with {_PAGES} select page_id, canonical from own"
    o["u_url_parts"] = (
        f"select page_id, regexp_extract(url, '^([a-z]+):', 1) as scheme, {_host('url')} as netloc, "
        "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path, '' as params, "
        "regexp_extract(url, '\\?([^#]*)', 1) as query, regexp_extract(url, '#(.*)$', 1) as fragment from pages"
    )
    link = "'../r/./' || page_id || '/?q#f'"
    o["u_resolve"] = f"select page_id, replace({_absolute(f'({link})')}, '/./', '/') as resolved from pages"
    o["u_predicates"] = (
        f"select page_id, regexp_replace(url, '#.*$', '') as no_fragment, ends_with({_host('url')}, 'tion.example.com') as suffix, "
        f"({_host('url')} = 'example.com' or ends_with({_host('url')}, '.example.com')) as label, "
        "(contains(url, '/fr/') or contains(url, 'utm_')) as excluded, regexp_matches(url, '^https?:') as http, "
        "regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/.](\\.[^./]*)$', 1) as ext from pages"
    )
    o["u_sanitize"] = "select page_id, replace(regexp_replace(url, '[<>:\"/\\\\|?*]', '_', 'g'), ' ', '_') as name from pages"
    o["u_query_name"] = (
        "select page_id, 'a_' || (page_id % 5) || '_a_' || (page_id % 7) || '_b_é_x_c_' || substr(sha256(url), 1, 6) || '.html' as name from pages"
    )
    o["u_local_path"] = f"with {_PAGES} select page_id, {_local('canonical')} as local_path from own"
    o["u_relative_path"] = (
        f"with {_PAGES}, p as (select page_id, {_folder(_local('canonical', ''))} as folder, "
        f"{_host('url')} || '/en/img/' || page_id || '.png' as target from own) "
        f"select page_id, {_relative('target', 'folder')} as rel from p"
    )
    o["u_entities"] = f"select page_id, md5({_decoded('html')}) as text_md5 from pages"
    o["u_canonicalize"] = (
        f"with {_PAGES} select url, canonical, regexp_extract(canonical, '^([a-z]+):', 1) as scheme, {_host('canonical')} as host, "
        "regexp_extract(canonical, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path, regexp_extract(canonical, '\\?(.*)$', 1) as query, "
        f"true as is_http, ends_with({_host('canonical')}, '{ROOT}') as internal from own"
    )
    o["x_tokens"] = f"with {_TOK} select page_id, pos, token from tok"
    for name, kinds in {
        "x_a_href": ["a_href"], "x_form": ["form_action"], "x_button": ["button_onclick"], "x_media": ["media_src"],
        "x_style_attr": ["style_attr"], "x_style_block": ["style_block"], "x_meta": ["meta_refresh"],
        "x_js": ["js_href", "js_open", "js_fetch"], "x_data": ["data_attr"], "x_all_links": list(_KINDS),
    }.items():
        # the first branch of a union names the columns
        o[name] = _kind_query(*kinds).replace(
            f"'{kinds[0]}', ", f"'{kinds[0]}' as kind, ", 1
        ).replace(" from tok where", " as raw from tok where", 1) if kinds[0] != "a_href" else _kind_query(*kinds)
    o["x_link_set"] = f"with {_link_set(' and not contains(dst_url, ' + chr(39) + '/go/' + chr(39) + ')')} select page_id, dst_url from targets"
    o["x_static"] = f"with {_static()} select page_id, kind, raw, dst_url from statics"
    flat = "'../f/a.woff', '/img/i1.png', '/img/i11.png'"
    for name, refs in {"x_css": flat, "x_css_nested": flat + ", '/img/i2.png'"}.items():
        o[name] = (
            f"with {_RESOURCES}, r as (select url, unnest([{refs}]) as raw from resources where path like '%.css') "
            f"select url as css_url, raw, {_absolute()} as dst_url from r"
        )
    for name, parts in {"x_css_sheets": i.SHEET_RULES, "x_css_sheets_nested": i.SHEET_RULES + i.SHEET_NESTED}.items():
        place = "regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/css/p' || page_id || '.css'"
        found = "regexp_extract_all(" + " || ".join(parts) + ", 'url\\(\\s*[''\"]?(.*?)[''\"]?\\s*\\)', 1)"
        o[name] = f"select {place} as css_url, unnest({found}) as raw from pages"
    o["s_robots"] = f"with {_ROBOTS} select host, status_code, body from robots"
    o["s_sitemaps"] = f"with {_MAPS} select sitemap_url, {i.SITEMAP_BODY} as body from maps"
    o["s_resources"] = (
        f"with {_RESOURCES} select url, case when path like '%.css' then 'text/css' else 'image/png' end as content_type, content from resources"
    )
    title = _decoded("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")
    o["x_title"] = f"select page_id, trim(regexp_replace({title}, '\\s+', ' ', 'g')) as title from pages"
    o["x_interstitial"] = "select page_id, page_id % 7 = 2 as interstitial from pages"
    o["x_sitemap"] = f"with {_MAPS} select sitemap_url, loc from locs"
    o["a_sitemap_counts"] = f"with {_MAPS} select sitemap_url, count(*) as n_urls from locs group by sitemap_url"
    o["x_robots_sitemaps"] = f"with {_ROBOTS} select host, 'https://' || host || '/map.xml' as sitemap_url from robots"
    o["x_robots_rules"] = f"with {_RULES} select host, group_no, agents, rule_no, allow, path, crawl_delay from rules"
    inside = f"ends_with({_host('dst_url')}, '{ROOT}')"
    o["j_internal"] = f"with {_links()} select page_id, kind, dst_url from links where {inside}"
    o["j_external"] = f"with {_links()} select page_id, kind, dst_url from links where not {inside}"
    o["j_excluded"] = (
        f"with {_links()} select page_id, kind, dst_url from links where not contains(dst_url, '/api/') and not contains(dst_url, '/go/')"
    )
    o["j_robots_verdict"] = (
        f"with {_link_set()}, {_RULES}, urls as (select distinct dst_url as url from targets), {_VERDICTS} select url, allowed from verdicts"
    )
    o["j_new_sitemaps"] = f"with {_MAPS} select sitemap_url from maps where page_id % 2 = 1"
    o["j_seed"] = (
        f"with {_MAPS} select 'https://{ROOT}' as url union select url from maps where page_id % 2 = 1 and page_id % 10 <> 9 "
        f"and ends_with({_host('url')}, '{ROOT}') and not contains(url, 'utm_')"
    )
    o["j_enqueue"] = (
        f"with {_link_set()}, {_STATE_ROWS} select url, status, {_TEXT_TIME}, level, outcome from state union all "
        "select dst_url, 'pending', null, null, null from (select distinct dst_url from targets) where dst_url not in (select url from state)"
    )
    o["j_classify"] = (
        "select page_id, case when page_id % 11 = 3 then 'empty' when page_id % 5 = 0 then 'resource' else 'page' end as class from pages"
    )
    o["j_resolve_cached"] = (
        f"with {_static()}, {_RMAP} select s.page_id, s.dst_url, m.local_path from statics s left join rmap m on m.url = s.dst_url"
    )
    _css = "css as (select url, unnest(['../f/a.woff', '/img/i1.png', '/img/i11.png']) as raw from resources where path like '%.css')"
    o["j_pending_res"] = (
        f"with {_assets()}, {_RMAP}, {_RESOURCES}, {_css}"
        f", wanted as (select dst_url as url from assets where {inside} union select {_absolute()} from css) "
        "select url from wanted where url not in (select url from rmap)"
    )
    o["j_missing_res"] = (
        f"with {_assets()}, {_RMAP}, {_RESOURCES}, {_css}"
        f", refs as (select dst_url as url from assets union all select {_absolute()} from css) "
        "select url, count(*) as n_refs from refs where url not in (select url from rmap) group by url"
    )
    o["j_integrity"] = (
        f"with {_rewritten(True, True, True)}"
        ", out_refs as (select distinct page_id, value, own, folder from answers where value is not null and not regexp_matches(value, '^[a-z]+:'))"
        # '../' steps remove one folder each
        ", walked as (select page_id, own, string_split(folder, '/') as f, (length(value) - length(replace(value, '../', ''))) // 3 as ups, replace(value, '../', '') as rest from out_refs)"
        ", hit as (select page_id, own, array_to_string(f[1:len(f) - ups] || [rest], '/') as target_path from walked)"
        # assets that are not captured keep their address, which is not relative
        f", held as (select {_local('url')} as local_path from (select distinct regexp_replace(url, '#.*$', '') as url from pages) union select local_path from rmap) "
        "select target_path, count(*) as n_refs, min(own) as first_source from hit where target_path not in (select local_path from held) group by target_path"
    )
    o["a_levels"] = (
        f"with recursive {_links()}, {_PAGES}, {_RULES}, {_MAPS}, total as (select count(*) as n from pages)"
        f", html as (select page_id from pages where contains(lower({i.CONTENT_TYPE}), 'text/html') and length({i.BODY}) > 0)"
        f", found as (select distinct {_canon('url')} as src, dst_url as dst from links where page_id in (select page_id from html))"
        ", hops as (select canonical as src, unnest([page_id * 2, page_id * 2 + 1]) % (select n from total) as to_id from own "
        "where page_id in (select page_id from html))"
        f", urls as (select distinct canonical as url from own), {_VERDICTS}"
        ", denied as (select url from verdicts where not allowed)"
        ", all_edges as (select src, dst from found union select h.src, o.canonical from hops h join own o on o.page_id = h.to_id)"
        f", edges as (select distinct src, dst from all_edges where ends_with({_host('dst')}, '{ROOT}') and not contains(dst, '/api/') "
        "and src <> dst and src not in (select url from denied))"
        f", seeds as (select 'https://{ROOT}' as url union select url from maps where page_id % 2 = 1 and page_id % 10 <> 9 "
        f"and ends_with({_host('url')}, '{ROOT}') and not contains(url, 'utm_'))"
        # breadth first until no address is new: the key keeps each address once, at its first level
        ", walk(url, level) using key (url) as (select url, 0 from seeds union "
        f"select distinct e.dst, w.level + 1 from walk w join edges e on e.src = {_canon('w.url')} "
        "where e.dst not in (select url from recurring.walk))"
        f", parents as (select t.url, min(w.url) as parent from walk t join edges e on e.dst = t.url join walk w on e.src = {_canon('w.url')} "
        "and w.level = t.level - 1 where t.level > 0 group by t.url) "
        "select w.url, cast(w.level as int) as level, p.parent from walk w left join parents p on p.url = w.url"
    )
    o["a_link_counts"] = (
        f"with {_link_set()} select p.page_id, count(t.dst_url) as n_links from pages p left join targets t on t.page_id = p.page_id group by p.page_id"
    )
    o["internal_link_targets"] = (
        f"with {_links(['a_href', 'form_action'])}, t as (select distinct page_id, dst_url from links where {inside}) "
        "select dst_url, count(*) as n_pages from t group by dst_url"
    )
    o["a_frontier_counts"] = f"with {_STATE_ROWS} select status, count(*) as n from state group by status"
    o["a_manifest"] = f"with {_assets()}, u as (select distinct dst_url as url from assets) select url, {_local('url')} as local_path from u"
    o["a_collisions"] = f"with {_FORMS} select local_path, n_urls, first_url, last_url from clash"
    o["a_collision_members"] = f"with {_FORMS} select local_path, url from paths where local_path in (select local_path from clash)"
    o["a_canon_dups"] = f"with {_FORMS} select canonical, n_forms, first_form, last_form from dups"
    o["a_canon_forms"] = f"with {_FORMS} select canonical, form from forms where canonical in (select canonical from dups)"
    o["a_mark_visited"] = (
        f"with {_STATE_ROWS}, done as (select distinct {_canon('url')} as url from pages where contains(url, '/en/')) "
        f", m as (select s.url, case when d.url is not null then 'visited' else status end as status, "
        f"case when d.url is not null then {_FETCHED} else last_fetched end as last_fetched, level, "
        "case when d.url is not null then 'saved' else outcome end as outcome from state s left join done d on d.url = s.url) "
        f"select url, status, {_TEXT_TIME}, level, outcome from m"
    )
    o["a_next_batch"] = f"with {_STATE_ROWS} select url, level from state where status = 'pending' order by level, url limit 50"
    o["a_next_batch_large"] = (
        f"with {_STATE_ROWS} select url, level from state where status = 'pending' order by level nulls first, url "
        "limit (select count(*) // 3 from state where status = 'pending')"
    )
    o["a_schedule"] = (
        f"with {_STATE_ROWS}, {_RULES}, delays as (select pick.host, max(crawl_delay) as crawl_delay from pick "
        "join rules r on r.host = pick.host and r.group_no = pick.group_no group by pick.host)"
        f", p as (select url, level, {_host('url')} as host from state where status = 'pending')"
        ", q as (select url, level, host, row_number() over (partition by host order by level, sha256(url)) - 1 as seq from p) "
        "select url, level, q.host, seq, seq * coalesce(cast(d.crawl_delay as double), 0.5) as offset_seconds from q left join delays d on d.host = q.host"
    )
    o["a_retry"] = (
        "with total as (select count(*) as n from pages)"
        ", dealt as (select event_id % (select n from total) as page_id, event_type <> 'error' as ok, "
        "row_number() over (partition by event_id % (select n from total) order by ts, event_id) as attempt from events)"
        ", tries as (select p.url, d.attempt, d.ok from dealt d join pages p on p.page_id = d.page_id where attempt <= 5)"
        ", won as (select url, min(attempt) as first_ok from tries where ok group by url)"
        ", f as (select t.url, count(*) filter (where not t.ok and (w.first_ok is null or t.attempt < w.first_ok)) as n, "
        "bool_or(w.first_ok is not null) as done from tries t left join won w on w.url = t.url group by t.url) "
        "select url, cast(n as int) as failures, done, not done and n >= 5 as exhausted, "
        "case when not done and n > 0 then pow(2.0, n - 1) end as next_wait, pow(2.0, n) - 1 as total_wait from f"
    )
    counts = ", ".join(f"count(*) filter (where outcome = '{x}') as {x}" for x in ("saved", "denied", "failed", "empty", "non_html"))
    o["a_report"] = (
        f"with {_STATE_ROWS}, v as (select {_host('url')} as host, outcome from state where status = 'visited') "
        f"select host, count(*) as visited, {counts} from v group by host"
    )
    o["r_links"] = o["s_mirror"] = _rewrite_query(True, False, False)
    o["r_static"] = _rewrite_query(False, True, False)
    o["r_styles"] = _rewrite_query(False, False, True)
    o["r_pages"] = o["t_rewrite"] = _rewrite_query(True, True, True)
    served = f"contains(lower({i.CONTENT_TYPE}), 'text/html')"
    o["r_typed_pages"] = (
        f"with {_rewritten(True, True, True)} select f.page_id, f.local_path, "
        f"case when {served.replace('page_id', 'f.page_id')} then md5(f.html) else md5(a.html) end as html_md5 "
        "from final f join aug a on a.page_id = f.page_id"
    )
    o["x_typed_link_set"] = (
        f"with {_link_set(' and not contains(dst_url, ' + chr(39) + '/go/' + chr(39) + ')')} select page_id, dst_url from targets "
        f"where page_id in (select page_id from pages where {served})"
    )
    o["r_css"] = (
        f"with {_RESOURCES} select url, 'out/' || regexp_replace(url, '^https?://', '') as local_path, "
        "replace(replace(content, 'url(\"/img/i1.png\")', 'url(\"../img/i1.png\")'), 'url(/img/i11.png)', 'url(../img/i11.png)') as content "
        "from resources where path like '%.css'"
    )
    o["s_state"] = (
        f"with {_MAPS}, {_STATE_ROWS}, {_RMAP} select 'sitemap' as kind, sitemap_url as url, '' as value from maps "
        "union all select 'page', url, concat_ws(' ', status, outcome, cast(level as varchar)) from state "
        "union all select 'asset', url, local_path from rmap"
    )
    o["t_links"] = f"with {_link_set()} select page_id, dst_url from targets"
    o["t_frontier"] = f"with {_link_set()} select distinct dst_url as url from targets"
    o["t_state"] = (
        f"with {_link_set()}, {_PAGES}, u as (select canonical as url from own union select url from pages) "
        "select url, 'visited' as status, 'saved' as outcome from u union all "
        "select distinct dst_url, 'pending', null from targets where dst_url not in (select url from u)"
    )
    outcome = (
        f"case when {i.STATUS} >= 400 then 'failed' when page_id % 11 = 3 then 'empty' "
        f"when not contains(lower({i.CONTENT_TYPE}), 'text/html') then 'non_html' else 'saved' end"
    )
    o["t_state_typed"] = (
        f"with {_link_set()}, {_PAGES}, seen as (select canonical as url, {outcome} as outcome from own "
        f"union all select url, {outcome} from pages)"
        ", v as (select url, max(outcome) as outcome from seen group by url)"
        f", ok as (select page_id from pages where {i.STATUS} < 400 and page_id % 11 <> 3 and contains(lower({i.CONTENT_TYPE}), 'text/html')) "
        "select url, 'visited' as status, outcome from v union all "
        "select distinct dst_url, 'pending', null from targets where page_id in (select page_id from ok) and dst_url not in (select url from v)"
    )
    return o
