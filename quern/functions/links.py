"""Links and assets in markup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import vocab
from quern.functions import urls
from quern.functions.classify import any_contains

_HREF = r"(?i)href=[\"']([^\"']+)[\"']"
_ANCHOR = r"(?i)<a[^>]+href=[\"']([^\"']+)[\"'][^>]*>([^<]*)</a>"


def hrefs(markup: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(markup, F.lit("")), F.lit(_HREF), F.lit(1))


def link_counts(markup: Column, domain: Column) -> Column:
    """Struct of internal and external counts and sorted distinct external hosts. Whatever does not start with ``#`` or ``http`` is internal."""
    found = hrefs(markup)
    absolute = F.filter(found, lambda x: x.startswith("http"))
    outside = F.filter(F.transform(absolute, urls.host_lower), lambda h: ~F.contains(h, domain))
    internal = F.size(F.filter(found, lambda x: ~x.startswith("http") & ~x.startswith("#"))) + F.size(absolute) - F.size(outside)
    return F.struct(
        internal.alias("internal"),
        F.size(outside).alias("external"),
        F.array_sort(F.array_distinct(outside)).alias("external_hosts"),
    )


def asset_category(url: Column, text: Column) -> Column:
    """By extension first, then by pattern in text or address, in order; else ``webpage``."""
    low, words = F.lower(url), F.lower(F.coalesce(text, F.lit("")))
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, exts in vocab.ASSET_EXTENSIONS.items():
        chain = chain.when(reduce(lambda a, b: a | b, [F.endswith(low, F.lit(e)) for e in exts]), name)
    for name, patterns in vocab.ASSET_PATTERNS.items():
        hit = reduce(
            lambda a, b: a | b,
            [c.rlike(f"(?d){p}") if ".*" in p else F.contains(c, F.lit(p)) for p in patterns for c in (words, low)],
        )
        chain = chain.when(hit, name)
    return chain.otherwise("webpage")


def anchors(markup: Column) -> Column:
    """Array of (href, text): the anchors with plain text, repeats kept."""
    found = [F.regexp_extract_all(markup, F.lit(_ANCHOR), F.lit(i)).alias(name) for i, name in ((1, "href"), (2, "text"))]
    return F.arrays_zip(*found)


def linked_assets(pages: DataFrame, key: str = "page_id", url: str = "url", markup: str = "html_content") -> DataFrame:
    """(key, asset_url, asset_type, description): linked assets other than web pages. Links are resolved and typed inside the
    page's array, so only assets become rows and no expression is repeated in a filter."""
    resolved = F.transform(anchors(F.col(markup)), lambda a: F.struct(urls.resolve(F.col(url), a["href"]).alias("asset_url"), a["text"].alias("text")))
    typed = F.transform(
        resolved,
        lambda a: F.struct(
            a["asset_url"].alias("asset_url"),
            asset_category(a["asset_url"], a["text"]).alias("asset_type"),
            F.nullif(F.trim(a["text"]), F.lit("")).alias("description"),
        ),
    )
    assets = F.filter(typed, lambda a: a["asset_type"] != "webpage")
    rows = pages.where(F.col(markup).isNotNull()).select(key, F.explode(assets).alias("_a"))
    return rows.select(key, "_a.asset_url", "_a.asset_type", "_a.description")


def asset_breakdown(assets: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, breakdown): map of asset type to count."""
    counts = assets.groupBy(key, "asset_type").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return counts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("asset_type", "n")))).alias("breakdown"))


def is_challenge(final_url: Column, body: Column, status: Column, server: Column) -> Column:
    """A bot challenge: a known host, two phrases in the body, or a refusal by a protecting server."""
    low = F.lower(F.coalesce(body, F.lit("")))
    phrases = reduce(lambda a, b: a + b, [F.contains(low, F.lit(p)).cast("int") for p in vocab.CHALLENGE_PHRASES])
    refused = (status == 403) & any_contains(F.lower(F.coalesce(server, F.lit(""))), ["cloudflare", "radware"])
    return F.coalesce(
        any_contains(F.lower(final_url), vocab.CHALLENGE_HOSTS),
        F.lit(False),
    ) | (phrases >= 2) | F.coalesce(refused, F.lit(False))
