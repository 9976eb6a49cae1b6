"""Row filters of the crawl: gates before stages, URL rules, duplicates."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern import vocab
from quern.functions import urls
from quern.functions.text import squeeze


def allowed_domain(host: Column, domain: Column, allowed: list[str] | None = None) -> Column:
    """The domain itself, or below it a prefix of the allowlist; without one, any single label."""
    prefix = F.substring(host, F.lit(1), F.length(host) - F.length(domain) - 1)
    below = F.endswith(host, F.concat(F.lit("."), domain))
    listed = vocab.ALLOWED_SUBDOMAINS if allowed is None else allowed
    return (host == domain) | (below & (prefix.isin(listed) if listed else ~F.contains(prefix, F.lit("."))))


def same_site(host: Column, domain: Column) -> Column:
    return (host == domain) | F.endswith(host, F.concat(F.lit("."), domain)) | F.endswith(domain, F.concat(F.lit("."), host))


def excluded_extension(url: Column) -> Column:
    return F.lower(url).rlike(r"\.(?:" + "|".join(vocab.EXCLUDED_EXTENSIONS) + ")$")


def excluded_pattern(url: Column) -> Column:
    return url.rlike("(?i)" + "|".join(vocab.EXCLUDED_PATTERNS))


def extractable(status: Column, markup: Column, content_type: Column) -> Column:
    return (status == "fetched") & markup.isNotNull() & F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("text/html"))


def analysable(status: Column, clean: Column, analysed: Column) -> Column:
    return (status == "extracted") & (F.length(squeeze(F.coalesce(clean, F.lit("")))) > 50) & analysed.isNull()


def needs_browser(error: Column, retries: Column, status: Column, code: Column) -> Column:
    low = F.lower(F.coalesce(error, F.lit("")))
    told = F.contains(low, F.lit("bot challenge")) | F.contains(low, F.lit("bot detection"))
    return told | F.coalesce((retries > 1) & (status == "failed") & code.isin(403, 429), F.lit(False))


def crawl_filter(
    found: DataFrame,
    url: str,
    domain: str,
    seen: DataFrame | None = None,
    rules: dict[str, list[tuple[str, bool]]] | None = None,
    agent: str = "*",
) -> DataFrame:
    """Discovery's conjunction, cheap tests first: domain, extension, pattern, not seen, robots."""
    kept = found.where(
        allowed_domain(urls.authority(F.col(url)), F.col(domain)) & ~excluded_extension(F.col(url)) & ~excluded_pattern(F.col(url))
    )
    if seen is not None:
        kept = kept.join(seen.select(F.col(seen.columns[0]).alias(url)), url, "left_anti")
    return kept.where(robots_allows(F.col(url), rules)) if rules is not None else kept


def link_filter(found: DataFrame, url: str, domain: str, seen: DataFrame | None = None) -> DataFrame:
    """The rule for links in pages: http(s), same site in either direction, extension, pattern, not seen."""
    u = F.col(url)
    kept = found.where(
        urls.is_valid(u) & urls.scheme(u).isin("http", "https") & same_site(
            urls.authority(u),
            F.col(domain),
        ) & ~excluded_extension(u) & ~excluded_pattern(u)
    )
    return kept.join(seen.select(F.col(seen.columns[0]).alias(url)), url, "left_anti") if seen is not None else kept


def page_limit(found: DataFrame, url: str, most: int, order: list[str]) -> DataFrame:
    """The first ``most`` distinct URLs in ``order`` (the URL breaks ties)."""
    first = found.withColumn("_n", F.row_number().over(Window.partitionBy(url).orderBy(*order, url))).where("_n = 1").drop("_n")
    return first.orderBy(*order, url).limit(most)


def parse_robots(text: str, agent: str = "*") -> list[tuple[str, bool]]:
    """(path prefix, allowed) of the group that names ``agent``, else of ``*``; longest prefix first, allow before disallow."""
    groups: dict[str, list[tuple[str, bool]]] = {}
    agents: list[str] = []
    open_group = False
    for raw in text.splitlines():
        line = raw.split("#", 1)[0].strip()
        key, colon, value = line.partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            agents = [*(agents if open_group else []), value.lower()]
            open_group = True
            groups.setdefault(value.lower(), [])
        elif key in ("allow", "disallow"):
            open_group = False
            for a in agents:
                if value:
                    groups[a].append((value, key == "allow"))
    name = agent.lower().split("/")[0]
    rules = groups.get(name) or next((r for a, r in groups.items() if a != "*" and a in name), None) or groups.get("*", [])
    return sorted(rules, key=lambda r: (-len(r[0]), not r[1]))


class EveryHost(dict):
    """One host's rules taken for every host."""

    def __init__(self, rules: list[tuple[str, bool]]) -> None:
        super().__init__({"": rules})


def robots_allows(url: Column, rules: dict[str, list[tuple[str, bool]]]) -> Column:
    """Whether the host's rules admit the URL. Hosts without rules (missing or unreadable files) admit everything. ``rules`` holds
    the hosts of one job, parsed on the driver."""
    import re

    compiled = {
        h: [
            (
                re.compile("".join(".*" if c == "*" else re.escape(c) for c in p.rstrip("$")) + ("$" if p.endswith("$") else "")),
                ok,
            ) for p, ok in rs
        ] for h, rs in rules.items()
    }

    every = compiled.get("", []) if isinstance(rules, EveryHost) else []

    @F.pandas_udf("boolean")
    def allowed(values: pd.Series) -> pd.Series:
        from urllib.parse import urlsplit

        def one(u):
            if u is None:
                return False
            parts = urlsplit(u)
            target = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
            return next((ok for p, ok in (compiled.get(parts.netloc.lower()) or every) if p.match(target)), True)

        return values.map(one)

    return allowed(url)


def conjunction(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))
