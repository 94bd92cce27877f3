"""robots.txt as expressions over one body.

A body is reduced to one event letter and value per effective line; the groups
of the file are then exactly the matches of "user-agent lines followed by rule
lines" in that event text.  No window, no shuffle: a file is parsed where its
row is.
"""

from __future__ import annotations

from .binding import let, let_struct, q, struct
from .paths import percent_decode_sql
from .urls import UrlParts, with_parts

_BLANKS = " \t\u000b\f\u001c\u001d\u001e\u001f\u0085  "
# The keys that matter and the letters that stand for them.
_KEYS = {"user-agent": "U", "disallow": "D", "allow": "A", "crawl-delay": "C", "request-rate": "Q"}
_GROUP = r"(?md)(?:^U[^\n]*+\n)++(?:^[DACQ][^\n]*+\n)++"
_PLAIN_RULE = r"^/(?!/)[^?#;%]*+\z"


def _trim(text: str) -> str:
    return f"trim(BOTH {q(_BLANKS)} FROM {text})"


def lines_sql(body: str) -> str:
    return f"split({body}, {q(r'\R')})"


def events_sql(body: str) -> str:
    """Event text: one line per effective line, 'B' for an empty one."""

    def event(line: str) -> str:
        def keyed(c: str) -> str:
            key = f"lower({_trim(f'substring_index({c}, {q(":")}, 1)')})"
            value = _trim(f"substring({c}, position(':', {c}) + 1)")
            letters = " ".join(f"when {q(k)} then {q(v)}" for k, v in _KEYS.items())
            return (
                f"case when {line} = '' then 'B' when position(':', {c}) > 0 "
                f"then concat(case {key} {letters} end, {value}) end"
            )

        return let(f"substring_index({line}, '#', 1)", keyed)

    kept = f"filter(transform({lines_sql(body)}, l -> {event('l')}), e -> e is not null)"
    return f"concat(array_join({kept}, {q(chr(10))}), {q(chr(10))})"


def _whole(p: UrlParts) -> str:
    """Path, params, query and fragment of a URL as one text."""
    params = f"if({p.params} = ';', '', {p.params})"
    return (
        f"concat(if(startswith({p.path}, '//'), '//', ''), {p.path}, {params}, "
        f"if({p.query} <> '', concat('?', {p.query}), ''), if({p.fragment} <> '', concat('#', {p.fragment}), ''))"
    )


def _rule_path_sql(value: str) -> str:
    """Comparable text of a rule's path."""

    def general(decoded: str) -> str:
        def build(p: UrlParts) -> str:
            origin = (
                f"concat(if({p.scheme} <> '', concat({p.scheme}, ':'), ''), "
                f"if({p.netloc} <> '', concat('//', {p.netloc}), ''))"
            )
            return f"concat({origin}, {_whole(p)})"

        return f"coalesce({with_parts(decoded, build)}, {decoded})"

    return f"if(rlike({value}, {q(_PLAIN_RULE)}), {value}, {let(percent_decode_sql(value), general)})"


def groups_sql(body: str) -> str:
    """``array<struct<agents, crawl_delay, rules array<struct<allow, path>>>>``
    in file order."""

    def group(text: str) -> str:
        def split(lines: str) -> str:
            agents = f"filter({lines}, e -> startswith(e, 'U'))"
            delays = f"filter({lines}, e -> rlike(e, '^C[0-9]+$'))"
            rules = f"filter({lines}, e -> startswith(e, 'D') or startswith(e, 'A'))"

            def rule(v: str) -> str:
                return struct(allow=f"({v}.letter = 'A' or {v}.path = '')", path=f"{v}.path")

            made = let_struct(rule, letter="substring(e, 1, 1)", path=_rule_path_sql("substring(e, 2)"))
            return struct(
                agents=f"transform({agents}, e -> {percent_decode_sql('substring(e, 2)')})",
                crawl_delay=f"try_cast(substring(try_element_at({delays}, -1), 2) as int)",
                rules=f"transform({rules}, e -> {made})",
            )

        return let(f"split(rtrim({q(chr(10))}, {text}), {q(chr(10))})", split)

    return f"transform(regexp_extract_all({events_sql(body)}, {q(_GROUP)}, 0), g -> {group('g')})"


def chosen_group_sql(groups: str, agent: str) -> str:
    """The group that speaks to an agent: the first whose agent text is part of
    the agent's name, else the first that names everyone, else NULL."""
    token = q(agent.split("/")[0].lower())
    everyone = "array_contains(g.agents, '*')"
    named = f"filter({groups}, g -> not {everyone} and exists(g.agents, a -> contains({token}, lower(a))))"
    default = f"filter({groups}, g -> {everyone})"
    return f"coalesce(try_element_at({named}, 1), try_element_at({default}, 1))"


def target_sql(url: str) -> str:
    """The text of a URL that rules are compared with."""
    whole = let(percent_decode_sql(url), lambda u: with_parts(u, _whole))
    return let(whole, lambda w: f"if({w} = '', '/', {w})")


def first_match_sql(rules: str, target: str) -> str:
    """Verdict of the first rule in order that fits; allowed if none does."""
    fitting = f"filter({rules}, r -> startswith({target}, r.path))"
    return f"coalesce(try_element_at({fitting}, 1).allow, true)"
