"""Sources that reach the web, each behind a plain function so that a table or a fake can stand in for it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import vocab
from quern.operators.filters import parse_robots
from quern.schema import FETCH

#: url -> (final url, status, headers, body); raises on connection errors. A browser's fetcher adds (cleaned markup, rendered markdown).
Fetcher = Callable[[str], tuple]


def seeds(spark: SparkSession, domain: str, found: list[str] | None = None) -> DataFrame:
    """The discovered addresses of a domain, or its home page where nothing was discovered."""
    return spark.createDataFrame([(u,) for u in (found or [f"https://{domain}"])], "url string")


def sitemap_urls(xml: str) -> tuple[list[str], list[str]]:
    """(pages, child sitemaps) named in a sitemap document; an unreadable one names nothing."""
    from xml.etree import ElementTree

    try:
        root = ElementTree.fromstring(xml.encode())
    except ElementTree.ParseError:
        return [], []
    local = lambda e: e.tag.rpartition("}")[2]
    locs = lambda parent: [
        (c.text or "").strip() for e in root if local(e) == parent for c in e if local(c) == "loc" and (c.text or "").strip()
    ]
    return sorted(set(locs("url"))), sorted(set(locs("sitemap")))


def discover_sitemaps(host: str, fetch: Fetcher) -> list[str]:
    """Addresses from the first usual location that has any; an index is followed one level down."""
    for location in vocab.SITEMAP_LOCATIONS:
        try:
            _, status, _, body, *_ = fetch(location.format(host=host))
        except OSError:
            continue
        pages, children = sitemap_urls(body) if status == 200 else ([], [])
        for child in children:
            try:
                _, status, _, body, *_ = fetch(child)
            except OSError:
                continue
            pages += sitemap_urls(body)[0] if status == 200 else []
        if pages:
            return sorted(set(pages))
    return []


def parse_sitemaps(documents: DataFrame, xml: str = "body", status: str = "status_code") -> DataFrame:
    """(url): distinct page addresses of stored sitemap documents, read with XPath in the JVM."""
    found = F.explode(F.transform(F.xpath(F.col(xml), F.lit("urlset/url/loc/text()")), lambda x: F.trim(x)))
    return documents.where((F.col(status) == 200) & F.col(xml).isNotNull()).select(found.alias("url")).where("url <> ''").distinct()


def http_fetcher(agent: str = "quern/0.1", timeout: int = 30, retries: int = 3, backoff: float = 1.0) -> Fetcher:
    """Plain HTTP with redirects; 429 and 5xx are tried again with growing pauses."""
    import time
    import urllib.error
    import urllib.request

    def fetch(url: str) -> tuple[str, int, dict[str, str], str]:
        for attempt in range(retries + 1):
            request = urllib.request.Request(url, headers={"User-Agent": agent, "Accept": "text/html,*/*;q=0.8"})
            if attempt:
                time.sleep(backoff * 2 ** (attempt - 1))
            try:
                with urllib.request.urlopen(request, timeout=timeout) as r:
                    return r.url, r.status, dict(r.headers), r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
            except urllib.error.HTTPError as e:
                if e.code not in (429, 500, 502, 503, 504) or attempt == retries:
                    return url, e.code, dict(e.headers), ""
            except OSError:
                if attempt == retries:
                    raise
        raise OSError(url)

    return fetch


def table_fetcher(rows: dict[str, tuple[str, int, dict[str, str], str]]) -> Fetcher:
    """A fetcher that answers from stored responses; unknown addresses give 404."""
    return lambda url: rows.get(url, (url, 404, {}, ""))


def stored_fetcher(folder: str) -> Fetcher:
    """A fetcher that answers from a parquet table (url, status_code, content_type, body), asked for one address at a time."""
    import pyarrow.dataset as ds

    rows = ds.dataset(folder)

    def fetch(url: str) -> tuple[str, int, dict[str, str], str]:
        found = rows.to_table(columns=["status_code", "content_type", "body"], filter=ds.field("url") == url).slice(0, 1).to_pylist()
        if not found:
            return url, 404, {}, ""
        return url, found[0]["status_code"], {"content-type": found[0]["content_type"] or ""}, found[0]["body"] or ""

    return fetch


def robots_rules(hosts: list[str], fetch: Fetcher, agent: str, known: dict | None = None) -> dict[str, list[tuple[str, bool]]]:
    """Rules by host, each robots.txt asked for once; a missing or unreadable one allows everything. ``hosts`` are those of one job."""
    rules = dict(known or {})
    for host in hosts:
        if host not in rules:
            try:
                _, status, _, body, *_ = fetch(f"https://{host}/robots.txt")
            except (OSError, ValueError):
                status, body = 0, ""
            rules[host] = parse_robots(body, agent) if status == 200 else []
    return rules


def fetch_pages(urls: DataFrame, make: Callable[[], Fetcher], partitions: int | None = None, pause: float = 0.0, browser: bool = False) -> DataFrame:
    """The fetch log of ``urls``: column url, and delay (seconds between requests to its host) where given, else ``pause``. Rows of a
    host meet in one partition, so a host is never asked in parallel; one fetcher a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time
        from urllib.parse import urlsplit

        fetch = make()
        last: dict[str, float] = {}
        for pdf in batches:
            out = []
            for url, delay in zip(pdf["url"], pdf["delay"]):
                try:
                    host = urlsplit(url).netloc.lower()
                except ValueError:
                    host = ""
                if host in last:
                    time.sleep(max(0.0, delay - (time.monotonic() - last[host])))
                began = last[host] = time.monotonic()
                cleaned = rendered = error = None
                try:
                    final, status, headers, body, *more = fetch(url)
                    cleaned, rendered = (*more, None, None)[:2]
                except (OSError, ValueError) as e:
                    final, status, headers, body, error = url, None, {}, None, f"{type(e).__name__}: {e}"
                kind = next((v for k, v in headers.items() if k.lower() == "content-type"), None)
                size = len(body.encode()) if body is not None else None
                seconds, now = time.monotonic() - began, datetime.now(timezone.utc)
                out.append((url, final, status, kind, size, body, headers, seconds, error, now, browser, cleaned, rendered))
            frame = pd.DataFrame(out, columns=FETCH.names)
            frame["status_code"], frame["content_length"] = frame["status_code"].astype("Int32"), frame["content_length"].astype("Int64")
            yield frame

    host = F.regexp_extract("url", r"^[^:]+://([^/?#]*)", 1)
    n = partitions or int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    delay = F.col("delay") if "delay" in urls.columns else F.lit(pause)
    return urls.where("url IS NOT NULL").withColumn("_h", F.lower(host)).repartition(n, "_h").select("url", F.coalesce(delay, F.lit(pause)).cast("double").alias("delay")).mapInPandas(run, FETCH)


def route(pages: DataFrame, n: int, key: str = "url") -> DataFrame:
    """``pages`` with ``fetcher``, the number of the fetcher that takes each row; the same address always goes to the same."""
    return pages.withColumn("fetcher", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
