"""URL functions by name: temporary SQL functions of a session, inlined into plans as the columns of urls.py are.

    register(spark)
    spark.sql("SELECT canonical_url(url), platform_job_id(url), is_job_url(url) FROM pages")

canonical_url and platform_job_id take a platform as second argument, where it is known.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .. import rules
from .urls import _PARTS


def _text(value: str | None) -> str:
    """A string literal that reads backslashes as they stand."""
    if value is None:
        return "CAST(NULL AS STRING)"
    return "concat(" + ", \"'\", ".join(f"r'{part}'" for part in value.split("'")) + ")" if "'" in value else f"r'{value}'"


def _list(values) -> str:
    return f"array({', '.join(map(_text, values))})" if values else "CAST(array() AS ARRAY<STRING>)"


def _with(name: str, value: str, body: str) -> str:
    """A value that the body uses by name, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _by_platform(value, other: str, url: str = "url") -> str:
    """value(platform) of the named platform, else of the first whose domain is in the URL."""
    named = [f"WHEN platform = {_text(p.slug)} THEN {value(p)}" for p in rules.PLATFORMS]
    found = [f"WHEN contains(lower({url}), {_text(p.domain)}) THEN {value(p)}" for p in rules.PLATFORMS]
    return f"CASE {' '.join(named + found)} ELSE {other} END"


def _canonical() -> str:
    def rule(p) -> str:
        return f"named_struct('required', {_list(p.required)}, 'noise', {_list([*rules.TRACKING_PARAMS, *p.tracking])}, 'alias', {'true' if p.alias else 'false'}, 'domain', {_text(p.domain)}, 'host', {_text(p.host)})"

    none = f"named_struct('required', {_list(())}, 'noise', {_list(rules.TRACKING_PARAMS)}, 'alias', false, 'domain', {_text(None)}, 'host', {_text(None)})"
    parts = [f"regexp_extract(u, {_text(_PARTS)}, {k})" for k in (1, 2, 3, 4)]
    split = f"named_struct('scheme', lower({parts[0]}), 'host', lower({parts[1]}), 'path', {parts[2]}, 'query', {parts[3]}, 'rule', {_by_platform(rule, none, 'u')})"
    decoded = lambda x: f"coalesce(try_url_decode({x}), {x})"
    encoded = lambda x: f"replace(replace(url_encode({x}), '%7E', '~'), '*', '%2A')"
    pair = f"named_struct('k', {decoded(_extract('x', '^([^=]*)'))}, 'v', {decoded(_extract('x', '^[^=]*=(.*)$'))})"
    pairs = f"transform(filter(split(p.query, '&'), x -> x <> ''), x -> {pair})"
    kept = f"filter({pairs}, x -> array_contains(p.rule.required, lower(x.k)) OR NOT (startswith(lower(x.k), 'utm_') OR array_contains(p.rule.noise, lower(x.k))))"
    query = f"array_join(transform(array_sort({kept}), x -> concat({encoded('x.k')}, '=', {encoded('x.v')})), '&')"
    name = r"regexp_replace(regexp_replace(p.host, r'^.*@', ''), r':\d*$', '')"
    host = f"coalesce(CASE WHEN {name} = p.rule.domain OR endswith({name}, concat('.', p.rule.domain)) THEN p.rule.host END, p.host)"
    path = "regexp_replace(CASE WHEN p.rule.alias THEN regexp_replace(p.path, r'^(.*?)/comm/', '$1/') ELSE p.path END, '/{2,}', '/')"
    path = _with("h", path, "CASE WHEN length(h) > 1 THEN regexp_replace(h, '/+$', '') ELSE h END")
    asked = "CASE WHEN q <> '' THEN concat('?', q) ELSE '' END"
    whole = f"concat(CASE WHEN p.scheme <> '' THEN concat(p.scheme, ':') ELSE '' END, CASE WHEN p.host <> '' THEN concat('//', {host}) ELSE '' END, {path}, {_with('q', query, asked)})"
    return _with("u", r"regexp_replace(url, r'(?U)^\s+|\s+$', '')", _with("p", split, f"CASE WHEN p.scheme = '' AND p.host = '' THEN u ELSE {whole} END"))


def _extract(text: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({text}, {_text(pattern)}, {group})"


def _job_id() -> str:
    return _by_platform(lambda p: "coalesce(" + ", ".join(f"nullif({_extract('url', x)}, '')" for x in p.id_patterns) + ")", _text(None))


def _is_job() -> str:
    return f"coalesce(url RLIKE {_text('|'.join(rules.JOB_URLS))}, false)"


def _any(text: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {_text(p)})" for p in parts) + ")"


def _score() -> str:
    terms = [(_any("lower(anchor)", rules.APPLY_PHRASES), rules.ANCHOR_SCORE), (_any("lower(url)", rules.KNOWN_DOMAINS), rules.DOMAIN_SCORE), (_is_job(), rules.JOB_URL_SCORE)]
    added = " + ".join(f"CASE WHEN {c} THEN {x}D ELSE 0D END" for c, x in terms)
    return f"round(least({rules.BASE_SCORE}D + {added}, {rules.MOST_SCORE}D), 2)"


def register(spark: SparkSession) -> None:
    """Makes canonical_url, platform_job_id, is_job_url and link_score known to the session's SQL; again does no harm."""
    known = "url STRING, platform STRING DEFAULT CAST(NULL AS STRING)"
    for head, kind, body in (
        (f"canonical_url({known})", "STRING", _canonical()), (f"platform_job_id({known})", "STRING", _job_id()), ("is_job_url(url STRING)", "BOOLEAN", _is_job()), ("link_score(url STRING, anchor STRING)", "DOUBLE", _score()),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
