"""URL columns: canonical form, posting id, routing predicates and link scores."""

from __future__ import annotations

import ipaddress
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


#: All characters that Unicode calls white space.
_BLANKS = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def any_in(c: Column, parts: list[str]) -> Column:
    """Whether one of the parts is in a text; those that contain another one need no search."""
    least = [p for p in dict.fromkeys(parts) if not any(q != p and q in p for q in parts)]
    return reduce(Column.__or__, [F.contains(c, F.lit(p)) for p in least], F.lit(False))


def once(value: Column, then) -> Column:
    """then(value), for which the value is computed once a row, however often `then` names it; it holds no Python function."""
    return F.transform(F.array(value), then)[0]


def _pick(url: Column, platform: Column | None, value) -> Column:
    """value(platform) of the rule for a URL: that of the named platform, else the first whose domain is in the URL."""
    out = F.lit(None)
    for p in reversed(rules.PLATFORMS):
        out = F.when(F.contains(F.lower(url), F.lit(p.domain)), value(p)).otherwise(out)
    if platform is not None:
        for p in reversed(rules.PLATFORMS):
            out = F.when(platform == p.slug, value(p)).otherwise(out)
    return out


def _words(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def kept_params(query: Column, platform: Column | None = None, rule: Column | None = None) -> Column:
    """The query string without tracking parameters, sorted by decoded name and value, encoded again; `platform` is the one whose rules hold."""
    pairs = F.filter(F.split(query, "&"), lambda x: x != "")
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
    pairs = F.transform(pairs, lambda x: F.struct(decoded(F.regexp_extract(x, "^([^=]*)", 1)).alias("k"), decoded(F.regexp_extract(x, "^[^=]*=(.*)$", 1)).alias("v")))
    common = lambda k: F.startswith(k, F.lit("utm_")) | k.isin(rules.TRACKING_PARAMS)
    if rule is None:
        # The words of the fixed rules are sets; arrays of them would be searched from end to end.
        stays = lambda k: F.coalesce(_by_name(platform, lambda p: (k.isin(*p.required) if p.required else F.lit(False)) | ~(common(k) | k.isin(*p.tracking))), ~common(k))
    else:
        required, noise = F.coalesce(rule["required"], _words(())), F.coalesce(rule["tracking"], _words(()))
        stays = lambda k: F.array_contains(required, k) | ~(common(k) | F.array_contains(noise, k))
    kept = F.filter(pairs, lambda x: stays(F.lower(x["k"])))
    encoded = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    return F.array_join(F.transform(F.array_sort(kept), lambda x: F.concat(encoded(x["k"]), F.lit("="), encoded(x["v"]))), "&")


def canonical_url(url: Column, platform: Column | None = None, rule: Column | None = None) -> Column:
    """One spelling for all URLs of a posting: no tracking, fragment, alias path, doubled or last slash; lower-case scheme and host.

    The URL rules are those of the named platform, else of the first whose domain is in the
    URL; `rule` is a struct of them from a platform table (platforms.with_platform).
    """
    # The platform whose rules hold is found once; each rule is then asked for by its name.
    named = lambda u: [] if rule is not None else [ruled_by(u, platform).alias("platform")]
    parts = lambda u: F.struct(u.alias("url"), *named(u), *[F.regexp_extract(u, _PARTS, k).alias(n) for k, n in enumerate(("scheme", "host", "path", "query"), 1)])
    return once(_trim(url), lambda u: once(parts(u), lambda p: _joined(p["url"], F.lower(p["scheme"]), F.lower(p["host"]), p["path"], p["query"], p["platform"] if rule is None else None, rule)))


def ruled_by(url: Column, platform: Column | None = None) -> Column:
    """The platform whose URL rules hold for a URL: the named one, if it has any, else the first whose domain is in the URL; null for none."""
    out = once(F.lower(url), lambda low: reduce(lambda found, p: F.when(F.contains(low, F.lit(p.domain)), F.lit(p.slug)).otherwise(found), reversed(rules.PLATFORMS), F.lit(None).cast("string")))
    return out if platform is None else F.when(platform.isin([p.slug for p in rules.PLATFORMS]), platform).otherwise(out)


def _by_name(platform: Column, value) -> Column:
    """value(platform) of the rules of the platform that ruled_by() names."""
    out = F.lit(None)
    for p in reversed(rules.PLATFORMS):
        out = F.when(platform == p.slug, value(p)).otherwise(out)
    return out


def _where(needed: Column, change, value: Column) -> Column:
    """change(value) where a test that costs less says that it changes something."""
    return F.when(needed, change(value)).otherwise(value)


def _joined(url: Column, scheme: Column, host: Column, path: Column, query: Column, platform: Column | None, rule: Column | None) -> Column:
    """The canonical URL of the parts of one."""
    name = _where(F.contains(host, F.lit("@")), lambda x: F.regexp_replace(x, "^.*@", ""), host)
    name = _where(F.contains(host, F.lit(":")), lambda x: F.regexp_replace(x, r":\d*$", ""), name)
    if rule is None:
        fixed = once(name, lambda name: _by_name(platform, lambda p: F.lit(None).cast("string") if p.host is None else F.when((name == p.domain) | F.endswith(name, F.lit(f".{p.domain}")), F.lit(p.host))))
        alias = F.coalesce(_by_name(platform, lambda p: F.lit(p.alias is not None)), F.lit(False))
        path = _where(alias & F.contains(path, F.lit("/comm/")), lambda x: F.regexp_replace(x, r"^(.*?)/comm/", "$1/"), path)
    else:
        domain = F.lower(rule["domain"])
        fixed = once(name, lambda name: F.when((name == domain) | F.endswith(name, F.concat(F.lit("."), domain)), rule["host"]))
        # The first alias path in it becomes a slash.
        cut = F.coalesce(F.position(rule["alias"], path), F.lit(0))
        path = F.when(cut > 0, F.concat(F.substring(path, F.lit(1), cut), F.substring(path, cut + F.length(rule["alias"]), F.length(path)))).otherwise(path)
    path = once(path, lambda path: _where(F.contains(path, F.lit("//")), lambda x: F.regexp_replace(x, "/{2,}", "/"), path))
    path = once(path, lambda path: _where((F.length(path) > 1) & path.rlike("/$"), lambda x: F.regexp_replace(x, "/+$", ""), path))
    asked = F.when(query != "", once(kept_params(query, platform, rule), lambda params: F.when(params != "", F.concat(F.lit("?"), params)).otherwise(""))).otherwise("")
    whole = F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(host != "", F.concat(F.lit("//"), F.coalesce(fixed, host))).otherwise(""), path, asked)
    return F.when((scheme == "") & (host == ""), url).otherwise(whole)


def job_id(url: Column, platform: Column | None = None, rule: Column | None = None) -> Column:
    """The posting's id in a URL, by the first pattern of its platform that finds one; null for none."""
    if rule is not None:
        found = F.filter(F.transform(rule["id_patterns"], lambda p: F.call_function("regexp_extract", url, p, F.lit(1))), lambda x: x != "")
        return F.try_element_at(found, F.lit(1))

    def first(p):
        *before, last = [F.regexp_extract(url, pattern, 1) for pattern in p.id_patterns]
        return F.coalesce(*[F.nullif(found, F.lit("")) for found in before], last)

    return F.nullif(_pick(url, platform, first), F.lit(""))


def is_job_url(url: Column) -> Column:
    return F.coalesce(url.rlike("|".join(rules.JOB_URLS)), F.lit(False))


def is_other_url(url: Column) -> Column:
    return once(F.lower(url), lambda low: any_in(low, rules.OTHER_URLS))


def is_bare_domain(url: Column) -> Column:
    return url.rlike(r"(?i)^https?://[^/]+/?$")


def is_nav_anchor(text: Column) -> Column:
    words = r"\b(" + "|".join(map(re.escape, rules.NAV_WORDS)) + r")\b"
    text = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))
    return once(text, lambda text: (text != "") & (any_in(text, rules.NAV_PHRASES) | any_in(text, rules.NAV_WORDS) & text.rlike(words)))


def link_score(url: Column, anchor: Column) -> Column:
    """Confidence that a link is the posting's own, two decimals, 0.99 at most."""
    score = F.lit(rules.BASE_SCORE) + F.when(once(F.lower(anchor), lambda low: any_in(low, rules.APPLY_PHRASES)), rules.ANCHOR_SCORE).otherwise(0.0)
    score = score + F.when(once(F.lower(url), lambda low: any_in(low, rules.KNOWN_DOMAINS)), rules.DOMAIN_SCORE).otherwise(0.0) + F.when(is_job_url(url), rules.JOB_URL_SCORE).otherwise(0.0)
    return F.round(F.least(score, F.lit(rules.MOST_SCORE)), 2)


def link_verdict(url: Column, anchor: Column) -> Column:
    """struct(confidence, reason, direct) of a link: what its score is made of in words, and whether it leads to a posting itself."""
    low, none = F.lower(anchor), F.lit(None).cast("string")
    domain = F.coalesce(*[F.when(F.contains(F.lower(url), F.lit(d)), d) for d in rules.KNOWN_DOMAINS])
    parts = F.array_compact(F.array(
        F.when(any_in(low, rules.APPLY_PHRASES), F.concat(F.lit('"'), anchor, F.lit('" anchor'))).otherwise(none), F.concat(domain, F.lit(" URL")), F.when(is_job_url(url), "direct job-posting URL").otherwise(none),
    ))
    reason = F.when(F.size(parts) > 0, F.array_join(parts, " + ")).otherwise("generic link, no strong signal")
    return F.struct(link_score(url, anchor).alias("confidence"), reason.alias("reason"), is_job_url(url).alias("direct"))


def platform_of(sender: Column) -> Column:
    """Slug of the first enabled platform by priority whose domain is in the sender; null otherwise."""
    out = F.lit(None).cast("string")
    for p in sorted(rules.PLATFORMS, key=lambda p: -p.priority):
        if p.enabled:
            out = F.when(F.contains(F.lower(sender), F.lit(p.domain)), F.lit(p.slug)).otherwise(out)
    return out


#: Parsers in the order in which they are asked, with the part of a sender that each reads; the last reads all.
PARSERS = [("linkedin", "linkedin.com"), ("indeed", "indeed.com"), ("wellfound", "wellfound.com"), ("glassdoor", "glassdoor.com"), ("generic", "")]


def with_parser(slug: str, domain: str, before: str | None = None, parsers: list[tuple[str, str]] = PARSERS) -> list[tuple[str, str]]:
    """The parsers with one more, before the last or before a named one; a name that isn't there is an error."""
    names = [s for s, _ in parsers]
    at = len(parsers) - 1 if before is None else names.index(before)
    return [*parsers[:at], (slug, domain), *parsers[at:]]


def parser_of(sender: Column, parsers: list[tuple[str, str]] = PARSERS) -> Column:
    """The first parser for a sender, whether or not its platform is enabled."""
    out = F.lit(parsers[-1][0])
    for slug, domain in reversed(parsers[:-1]):
        out = F.when(F.contains(F.lower(sender), F.lit(domain)), F.lit(slug)).otherwise(out)
    return out


def enabled_domains() -> list[str]:
    """Domains of the enabled platforms by priority."""
    return [p.domain for p in sorted(rules.PLATFORMS, key=lambda p: p.priority) if p.enabled]


# Host names that are never followed.
BLOCKED_HOSTS = {"localhost", "0.0.0.0"}


def _inner(host: str | None) -> bool | None:
    try:
        at = ipaddress.ip_address(host)
    except ValueError:
        return None
    return at.is_loopback or at.is_private or at.is_link_local or at.is_reserved or at.is_multicast


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and brackets; empty for none."""
    name = F.regexp_replace(F.lower(F.regexp_extract(_trim(url), _PARTS, 2)), "^.*@", "")
    return F.when(F.startswith(name, F.lit("[")), F.regexp_extract(name, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(name, r":\d*$", ""))


def unsafe_reason(url: Column) -> Column:
    """Why a URL must not be followed; null where nothing speaks against it. Names aren't looked up: of hosts, the blocked ones and addresses in figures are judged."""

    @F.arrow_udf("boolean")
    def inner(hosts: pa.Array) -> pa.Array:
        return pa.array([None if h is None else _inner(h) for h in hosts.to_pylist()], pa.bool_())

    url = F.coalesce(_trim(url), F.lit(""))
    scheme, host = F.lower(F.regexp_extract(url, _PARTS, 1)), host_of(url)
    figures = F.when(host.rlike(r"^[0-9.]+$|:"), host)
    return (
        F.when(~scheme.isin("http", "https"), "scheme is not http or https").when(host == "", "no host").when(host.isin(sorted(BLOCKED_HOSTS)), "blocked host")
        .when(inner(figures), "internal or private address")
    )
