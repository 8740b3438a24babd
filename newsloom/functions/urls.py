"""Url, host, platform and account functions (column to column)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F

from ..resources import words as W
from .columns import ColumnLike, col, let, lookup, non_blank


def host(url: ColumnLike) -> Column:
    """Lower-cased host without user info and port; NULL when there is none."""
    return F.lower(F.nullif(F.regexp_extract(col(url), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def domain_of_url(url: ColumnLike) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def with_scheme(url: ColumnLike) -> Column:
    u = non_blank(url)
    return F.when(u.rlike(r"^https?://"), u).otherwise(F.concat(F.lit("https://"), u))


def parent_domains(domain: ColumnLike) -> Column:
    """The host and each of its parent domains, longest first."""
    return let(F.split(col(domain), r"\."), lambda parts: F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


def platform_of_url(url: ColumnLike, hosts: Mapping[str, str] | None = None, substring: bool = False) -> Column:
    """Platform of a url by host suffix; ``substring=True`` searches the whole url instead."""
    table = hosts or W.PLATFORM_HOSTS
    if substring:
        u = F.lower(col(url))
        return F.coalesce(*[F.when(u.contains(h), F.lit(p)) for h, p in table.items()])
    names = parent_domains(F.coalesce(host(url), F.lit("")))
    return F.get(F.filter(F.transform(names, lambda d: lookup(table, d)), lambda p: p.isNotNull()), 0)


def platform(source: ColumnLike, url: ColumnLike, default: str = "web",
             aliases: Mapping[str, str] | None = None) -> Column:
    """Alias of the source name, else platform of the url, else ``default``."""
    return F.coalesce(lookup(aliases or W.SOURCE_ALIASES, F.lower(col(source))), platform_of_url(url), F.lit(default))


def domain(url: ColumnLike, source: ColumnLike, platform_name: ColumnLike, account: ColumnLike,
           names: Iterable[tuple[str, str]] | None = None) -> Column:
    """Domain of the url, else of the source, else implied by the source name, else of the platform, else the account."""
    table = list(names or W.SOURCE_NAME_DOMAINS)
    low = F.lower(F.trim(col(source)))
    by_name = F.coalesce(*[F.when(low.contains(n), F.lit(d)) for n, d in table])
    p = F.lower(col(platform_name))
    by_account = F.when(p.isin("facebook", "tiktok", "youtube"), non_blank(account))
    return F.coalesce(domain_of_url(url), domain_of_url(source), by_name, lookup(W.PLATFORM_DOMAINS, p), by_account)


# Account position in the url of each platform (fixed values).
ACCOUNT_PATTERNS = {
    "facebook": r"facebook\.com/([^/?]+)",
    "youtube": r"youtube\.com/(?:@|c/)([^/?]+)",
    "tiktok": r"tiktok\.com/@([^/?]+)",
    "twitter": r"(?:twitter|x)\.com/([^/?]+)",
}


def account_name(url: ColumnLike, platform_name: ColumnLike, patterns: Mapping[str, str] | None = None) -> Column:
    u, p = col(url), col(platform_name)
    return F.coalesce(*[
        F.when(p == name, F.nullif(F.regexp_extract(u, pattern, 1), F.lit("")))
        for name, pattern in (patterns or ACCOUNT_PATTERNS).items()])


def account_type(kind: ColumnLike, followers: ColumnLike, platform_name: ColumnLike) -> Column:
    """Synonym of the given type; else page above 1000 followers on facebook, channel on youtube."""
    low = F.lower(non_blank(kind))
    p = col(platform_name)
    return F.coalesce(
        lookup(W.ACCOUNT_TYPES, low), low,
        F.when((p == "facebook") & (col(followers) > 1000), F.lit("page")),
        F.when(p == "youtube", F.lit("channel")))


def province(name: ColumnLike, names: Mapping[str, str] | None = None) -> Column:
    c = col(name)
    return F.coalesce(lookup(names or W.PROVINCE_NAMES, F.lower(F.trim(c))), F.initcap(c))


def split_tags(c: ColumnLike) -> Column:
    return F.filter(F.split(col(c), r"(?U)[,\s]+"), lambda t: F.length(t) > 0)
