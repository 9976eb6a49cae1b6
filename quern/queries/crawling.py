"""Registered queries of the crawl's own steps: links as a crawl takes them, robots, limiter measures, queues, progress, errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import vocab
from quern.functions import html, text, urls
from quern.operators import filters, frontier, limiter, rollup
from quern.plans import analysis, jobs
from quern.queries.core import _ALLOWED, _EXT, _HOST, _JOBBED, _PAT, _REPLAY, _SEVERITY, _TRACK, _replayed, register
from quern.queries.sql import PART
from quern.sources.tables import table

_SITE = "(a = d OR ends_with(a, '.' || d) OR ends_with(d, '.' || a))"


@register(
    _JOBBED
    + rf""", l AS (SELECT page_id, d, url AS b, trim(replace(unnest(regexp_extract_all(html_content, '(?i)<a[^>]*href="([^"]+)"', 1)), '&amp;', '&')) AS t FROM x WHERE html_content IS NOT NULL AND d IS NOT NULL AND url IS NOT NULL),
m AS (SELECT *, lower({PART(1, 'b')}) AS s, {PART(2, 'b')} AS au, {PART(3, 'b')} AS p, {PART(4, 'b')} AS q, {PART(1, 't')} AS ts FROM l),
y AS (SELECT page_id, d, CASE WHEN ts <> '' AND lower(ts) <> s THEN t WHEN ts <> '' THEN lower(ts) || t[length(ts) + 1:] WHEN starts_with(t, '//') THEN s || ':' || t WHEN starts_with(t, '/') THEN s || '://' || au || t WHEN starts_with(t, '#') THEN s || '://' || au || p || CASE WHEN q <> '' THEN '?' || q ELSE '' END || t
 WHEN starts_with(t, '?') THEN s || '://' || au || p || t ELSE s || '://' || au || regexp_replace(p, '[^/]*$', '') || t END AS u FROM m),
k AS (SELECT page_id, d, lower({PART(1, 'u')}) AS s, {PART(2, 'u')} AS a, {PART(3, 'u')} AS p, array_to_string(list_filter(string_split({PART(4, 'u')}, '&'), lambda z: lower(string_split(z, '=')[1]) NOT IN ({_TRACK})), '&') AS q FROM y),
c AS (SELECT page_id, d, s, a, CASE WHEN s <> '' THEN s || ':' ELSE '' END || CASE WHEN a <> '' THEN '//' || a ELSE '' END || p || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS u FROM k)
SELECT DISTINCT page_id, u AS target_url FROM c WHERE s IN ('http', 'https') AND a <> '' AND {_SITE} AND NOT regexp_matches(lower(u), '\.({_EXT})$') AND NOT regexp_matches(u, '{_PAT}', 'i')"""
)
def crawl_links(spark: SparkSession, folder: str) -> DataFrame:
    """The links of each page as the crawl takes them: parsed, resolved, cleaned, filtered."""
    pages = analysis.with_job_domain(table(spark, folder, "pages"), table(spark, folder, "jobs"))
    rows = html.with_links(pages.where("job_domain IS NOT NULL AND url IS NOT NULL").select("page_id", "job_domain", "url", "html_content"))
    # An explode of one element keeps the filters below from computing the address anew in each of their tests.
    whole = rows.select("page_id", "job_domain", F.explode(F.array(urls.resolve(F.col("url"), F.col("href")))).alias("whole"))
    clean = whole.select("page_id", "job_domain", F.explode(F.array(urls.clean(F.col("whole")))).alias("target_url"))
    return filters.link_filter(clean, "target_url", "job_domain").select("page_id", "target_url").distinct()


@register(
    rf"""WITH j AS (SELECT job_id, regexp_replace(regexp_replace(lower(trim(domain)), '^[a-z]+://', ''), '^www\.|/.*$', '', 'g') AS d FROM jobs), l AS (SELECT DISTINCT target_url AS u, j.d FROM links JOIN j USING (job_id) WHERE target_url IS NOT NULL AND d IS NOT NULL),
x AS (SELECT *, {PART(2, 'u')} AS a FROM l)
SELECT u AS target_url, d AS job_domain FROM x WHERE (a = d OR (ends_with(a, '.' || d) AND a[1:length(a) - length(d) - 1] IN ({_ALLOWED}))) AND NOT regexp_matches(lower(u), '\.({_EXT})$') AND NOT regexp_matches(u, '{_PAT}', 'i')
 AND u NOT IN (SELECT url FROM pages WHERE url IS NOT NULL) AND NOT (regexp_matches({PART(3, 'u')}, '^/(about|contact)/') AND NOT regexp_matches({PART(3, 'u')}, '^/about/history/')) AND NOT regexp_matches({PART(3, 'u')}, '\.php$')"""
)
def crawl_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Discovery's filter over the stored links, with one robots file for all hosts of the jobs."""
    rules = filters.parse_robots("User-agent: *\nDisallow: /about/\nDisallow: /contact/\nAllow: /about/history/\nDisallow: /*.php$\n")
    rows = analysis.with_job_domain(table(spark, folder, "links"), table(spark, folder, "jobs"))
    found = rows.where("target_url IS NOT NULL AND job_domain IS NOT NULL").select("target_url", "job_domain").distinct()
    seen = table(spark, folder, "pages").select("url").where("url IS NOT NULL").distinct()
    kept = filters.crawl_filter(found, "target_url", "job_domain", seen)
    return kept.where(filters.robots_allows(F.col("target_url"), filters.EveryHost(rules))).select("target_url", "job_domain")


@register(
    _REPLAY
    + f""", z AS (SELECT *, {_SEVERITY} AS severity FROM f)
SELECT host, severity, CAST(floor(30 * CASE severity WHEN 'blocked' THEN 3.0 WHEN 'throttled' THEN 2.0 WHEN 'limited' THEN 1.5 ELSE 1.0 END) AS BIGINT) AS timeout,
 round(CAST(least(30.0, delay * CASE severity WHEN 'blocked' THEN 3.0 WHEN 'throttled' THEN 1.8 WHEN 'limited' THEN 1.3 ELSE 1.0 END) AS DOUBLE), 6) AS next_delay,
 CAST(CASE WHEN severity = 'blocked' THEN greatest(0, errors - 3) ELSE errors END AS BIGINT) AS next_errors, CAST(CASE WHEN severity = 'blocked' THEN greatest(0, points - 5) ELSE points END AS BIGINT) AS next_indicators,
 severity = 'blocked' OR coalesce(epoch_us(until) - epoch_us(limited) < 300000000 AND violations > 3, false) AS skip FROM z"""
)
def limiter_measures(spark: SparkSession, folder: str) -> DataFrame:
    """What the limiter's state means for the next request: timeout, degraded state, and whether to skip it."""
    log = table(spark, folder, "pages").withColumn("host", F.expr(_HOST)).where("host IS NOT NULL AND fetched_at IS NOT NULL")
    until = log.groupBy("host").agg(F.max("fetched_at").alias("until"))
    s = _replayed(spark, folder).join(until, "host")
    after = limiter.degrade(F.col("state"), F.col("severity"))
    return s.select(
        "host",
        "severity",
        limiter.adaptive_timeout(F.col("severity")).cast("long").alias("timeout"),
        F.round(after["delay"], 6).alias("next_delay"),
        after["errors"].cast("long").alias("next_errors"),
        after["indicators"].cast("long").alias("next_indicators"),
        limiter.skip_request(F.col("state"), F.col("until")).alias("skip"),
    )


@register(
    _REPLAY
    + f""", z AS (SELECT host, delay, {_SEVERITY} AS severity FROM f),
t AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts DESC, n DESC) AS back FROM ev),
g AS (SELECT host, count(*) AS n_fetches, count(*) FILTER (NOT coalesce(code, 0) BETWEEN 1 AND 399) AS n_failed, round(avg(sec) FILTER (back <= 10), 6) AS recent_mean FROM t GROUP BY host)
SELECT g.host, n_fetches, n_failed, recent_mean, round(delay, 6) AS delay, severity FROM g JOIN z ON g.host = z.host"""
)
def fetch_statistics(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "pages").withColumn("host", F.expr(_HOST)).where("host IS NOT NULL AND fetched_at IS NOT NULL").select(
        "host", "fetched_at", "status_code", F.coalesce((F.unix_micros("processed_at") - F.unix_micros("fetched_at")) / 1e6, F.lit(0.0)).alias("seconds"), (-F.col("page_id")).alias("key")
    )
    out = rollup.fetch_statistics(log, _replayed(spark, folder), key="key")
    return out.withColumns({"recent_mean": F.round("recent_mean", 6), "delay": F.round("delay", 6)})


@register(
    """WITH p AS (SELECT job_id, count(*) FILTER (status IN ('extracted', 'analyzed')) AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status IN ('discovered', 'fetched')) AS pending, count(*) FILTER (status IN ('fetching', 'extracting', 'analyzing')) AS processing FROM pages WHERE job_id IS NOT NULL GROUP BY 1),
x AS (SELECT p.*, (epoch_us(completed_at) - epoch_us(started_at)) / 1e6 AS sec, completed + failed AS processed, pending + processing AS remaining FROM p JOIN jobs USING (job_id)),
y AS (SELECT *, CASE WHEN sec > 0 THEN processed / sec ELSE 0.0 END AS speed FROM x)
SELECT job_id, processed, remaining, round(CASE WHEN processed + remaining > 0 THEN processed * 100.0 / (processed + remaining) ELSE 0.0 END, 6) AS completion_pct, round(speed, 9) AS speed, round(CASE WHEN speed > 0 AND remaining > 0 THEN remaining / speed END, 3) AS eta_seconds FROM y"""
)
def job_progress(spark: SparkSession, folder: str) -> DataFrame:
    is_in = lambda *s: F.count_if(F.col("status").isin(*s))
    counts = table(spark, folder, "pages").where("job_id IS NOT NULL").groupBy("job_id").agg(
        is_in("extracted", "analyzed").alias("completed"), is_in("failed").alias("failed"), is_in("discovered", "fetched").alias("pending"),
        is_in("fetching", "extracting", "analyzing").alias("processing"),
    )
    known = table(spark, folder, "jobs").select("job_id", F.col("started_at").alias("start_time"), F.col("completed_at").alias("_now"))
    out = jobs.progress(counts.join(known, "job_id"), F.col("_now"))
    return out.select(
        "job_id", "processed", "remaining", F.round(F.col("completion_pct").cast("double"), 6).alias("completion_pct"), F.round(F.col("speed").cast("double"), 9).alias("speed"),
        F.round(F.col("eta_seconds").cast("double"), 3).alias("eta_seconds"),
    )


@register(
    """SELECT page_id, CASE WHEN contains(lower(error_message), 'connection') OR contains(lower(error_message), 'timeout') THEN 'retry' WHEN contains(lower(error_message), 'value') THEN 'skip' ELSE 'fail' END AS action,
 coalesce(retry_count < max_retries, false) AS may_retry, nullif(concat_ws('; ', error_message, 'seen'), '') AS message FROM pages WHERE error_message IS NOT NULL"""
)
def error_actions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").where("error_message IS NOT NULL").select(
        "page_id",
        jobs.error_action(F.col("error_message")).alias("action"),
        F.coalesce(jobs.may_retry(F.col("retry_count"), F.col("max_retries")), F.lit(False)).alias("may_retry"),
        jobs.add_error(F.col("error_message"), F.lit("seen")).alias("message"),
    )


@register(
    """SELECT page_id, CASE WHEN browser_fetched AND crawl4ai_markdown <> '' THEN crawl4ai_markdown ELSE markdown_content END AS markdown, coalesce(extraction_method, CASE WHEN browser_fetched THEN 'browser' ELSE 'beautifulsoup' END) AS method FROM pages"""
)
def rendered_path(spark: SparkSession, folder: str) -> DataFrame:
    """The text a page goes on with: the rendered one where a browser fetched it; and the method, where none is stored."""
    return table(spark, folder, "pages").select(
        "page_id",
        html.rendered_text(F.col("markdown_content"), F.col("crawl4ai_markdown"), F.col("browser_fetched")).alias("markdown"),
        text.extraction_method(F.col("extraction_method"), F.col("browser_fetched")).alias("method"),
    )


@register(
    r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(markdown_content, '\n\s*\n\s*\n+', chr(10) || chr(10), 'g'), '^(?:[ \t]*\n)+', ''), '\s+$', '') AS tidy FROM pages WHERE markdown_content IS NOT NULL"""
)
def markdown_tidied(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").where("markdown_content IS NOT NULL").select("page_id", text.tidy_markdown(F.col("markdown_content")).alias("tidy"))


@register(
    f"""WITH e AS (SELECT job_id, subdomain, len(list_distinct(regexp_extract_all(coalesce(clean_content, ''), '(?i){vocab.EMAIL_PATTERN}'))) AS ne FROM pages WHERE job_id IS NOT NULL)
SELECT job_id, count(*) AS total_pages, CAST(sum(ne) AS BIGINT) AS total_emails, count(DISTINCT subdomain) AS total_subdomains FROM e GROUP BY job_id"""
)
def analytics_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "pages").where("job_id IS NOT NULL")
    found = rows.select("job_id", "subdomain", F.size(text.emails(F.coalesce("clean_content", F.lit("")))).cast("long").alias("n"))
    site = found.groupBy("job_id").agg(F.count(F.lit(1)).alias("total_pages"), F.sum("n").alias("emails_found"))
    return rollup.analytics_summary(site, found.where("subdomain IS NOT NULL").select("job_id", "subdomain").distinct())


@register(
    """WITH f AS (SELECT DISTINCT url FROM pages WHERE status = 'failed' AND url IS NOT NULL)
SELECT 'left' AS queue, count(*) AS n FROM pages WHERE status IN ('fetching', 'extracting', 'analyzing') AND url IS NOT NULL AND url NOT IN (SELECT url FROM f)
UNION ALL SELECT 'failed', count(*) FROM pages WHERE status = 'failed' AND url IS NOT NULL"""
)
def moved_to_failed(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses in work that failed leave the queue, and every failure is kept."""
    pages = table(spark, folder, "pages").where("url IS NOT NULL").select("url", "status")
    failed = pages.where("status = 'failed'")
    left, held = frontier.move(pages.where("status IN ('fetching', 'extracting', 'analyzing')"), failed.limit(0), failed, latest=False)
    return frontier.queue_counts({"left": left, "failed": held})


_UNITS = ["KB", "MB", "GB"]


@register(
    f"""SELECT page_id, CASE WHEN n < 1024 THEN printf('%.1fB', n) {' '.join(f"WHEN n < {1024 ** (i + 2)} THEN printf('%.1f{u}', n / {1024.0 ** (i + 1)})" for i, u in enumerate(_UNITS))} ELSE printf('%.1fTB', n / {1024.0**4}) END AS size
FROM (SELECT page_id, CAST(content_length AS DOUBLE) AS n FROM pages WHERE content_length IS NOT NULL)"""
)
def content_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").where("content_length IS NOT NULL").select("page_id", text.format_bytes(F.col("content_length")).alias("size"))
