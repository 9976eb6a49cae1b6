"""Registered queries of the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import vocab
from quern.functions import classify, html, links, text, urls
from quern.operators import filters, frontier, joins, limiter, report, rollup, skew
from quern.plans import analysis, jobs
from quern.queries.sql import ASSET, BARE, COUNT, DEPTH, FULL_TEXT, PART, PATTERN_CLASS, QUALITY, indicator_sum, page_type_sql, subtype_sql
from quern.sinks import exports
from quern.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_KEYS = """
WITH s AS (
  SELECT 'domain' AS key_field, domain AS key_value, status, discovered_at, page_id FROM pages WHERE domain <> ''
  UNION ALL
  SELECT 'subdomain', subdomain, status, discovered_at, page_id FROM pages WHERE subdomain <> ''
)
"""


@register(_KEYS + "SELECT key_field, key_value FROM s GROUP BY 1, 2 HAVING count(*) >= 0.03 * (SELECT count(*) FROM pages)")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return skew.heavy_keys(
        pages,
        ["domain", "subdomain"],
        ["discovered_at", "page_id"],
        F.col("status") == "failed",
    ).select("key_field", "key_value")


@register(
    _KEYS
    + """, r AS (
  SELECT *, coalesce(status = 'failed', false) AS bad,
    row_number() OVER (PARTITION BY key_field, key_value ORDER BY discovered_at NULLS FIRST, page_id)
    - row_number() OVER (PARTITION BY key_field, key_value, coalesce(status = 'failed', false) ORDER BY discovered_at NULLS FIRST, page_id) AS island
  FROM s
), i AS (SELECT key_field, key_value, bad, island, count(*) AS run FROM r GROUP BY ALL)
SELECT key_field, key_value, CAST(sum(run) AS BIGINT) AS n_pages, CAST(sum(CASE WHEN bad THEN run ELSE 0 END) AS BIGINT) AS n_failed,
  CAST(max(CASE WHEN bad THEN run ELSE 0 END) AS BIGINT) AS longest_failure FROM i GROUP BY 1, 2"""
)
def p2_key_totals(spark: SparkSession, folder: str) -> DataFrame:
    totals = skew.key_totals(
        table(spark, folder, "pages"),
        ["domain", "subdomain"],
        ["discovered_at", "page_id"],
        F.col("status") == "failed",
    )
    return totals.select(
        "key_field",
        "key_value",
        F.col("n").alias("n_pages"),
        F.col("n_flagged").alias("n_failed"),
        F.col("longest_run").alias("longest_failure"),
    )


@register(SQL["p2_key_totals"])
def p2_key_totals_chunked(spark: SparkSession, folder: str) -> DataFrame:
    """``p2_key_totals`` in chunks of 50 rows, so that the boundary states of many chunks are merged even on small tables."""
    totals = skew.key_totals(table(spark, folder, "pages"), ["domain", "subdomain"], ["discovered_at", "page_id"], F.col("status") == "failed", 50)
    return totals.select("key_field", "key_value", F.col("n").alias("n_pages"), F.col("n_flagged").alias("n_failed"), F.col("longest_run").alias("longest_failure"))


_SOURCES = f"""
WITH u AS (SELECT 'pages' AS src, url FROM pages WHERE url IS NOT NULL UNION ALL SELECT 'links', source_url FROM links WHERE source_url IS NOT NULL UNION ALL SELECT 'contacts', source_url FROM contacts WHERE source_url IS NOT NULL),
p AS (SELECT src, {PART(2)} AS a FROM u),
k AS (SELECT src, 'domain' AS key_field, a AS key_value FROM p UNION ALL SELECT src, 'subdomain', CASE WHEN len(string_split(a, '.')) > 2 THEN string_split(a, '.')[1] ELSE '' END FROM p)
SELECT key_field, key_value, count(*) FILTER (src = 'pages') AS pages, count(*) FILTER (src = 'links') AS links, count(*) FILTER (src = 'contacts') AS contacts FROM k WHERE key_value <> '' GROUP BY ALL
"""


@register(_SOURCES)
def p2_site_totals(spark: SparkSession, folder: str) -> DataFrame:
    def keyed(name: str, url: str) -> DataFrame:
        rows = table(spark, folder, name).where(F.col(url).isNotNull())
        return rows.select(
            urls.authority(F.col(url)).alias("domain"),
            urls.subdomain_label(F.col(url)).alias("subdomain"),
            F.xxhash64(*rows.columns[:4]).alias("row_key"),
        )

    return skew.source_totals(
        {"pages": keyed("pages", "url"), "links": keyed("links", "source_url"), "contacts": keyed("contacts", "source_url")},
        ["domain", "subdomain"],
        "row_key",
    )


# ---- URL functions ----



@register(
    f"SELECT page_id, lower({PART(1)}) AS scheme, {PART(2)} AS authority, lower({PART(2)}) AS host, regexp_replace({PART(3)}, ';[^/]*$', '') AS path, {PART(4)} AS query, {PART(5)} AS fragment FROM pages"
)
def url_parts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(
        "page_id",
        urls.scheme(F.col("url")).alias("scheme"),
        urls.authority(F.col("url")).alias("authority"),
        urls.host_lower(F.col("url")).alias("host"),
        urls.path(F.col("url")).alias("path"),
        urls.query(F.col("url")).alias("query"),
        urls.fragment(F.col("url")).alias("fragment"),
    )


@register(
    f"SELECT page_id, {DEPTH} AS depth, {PART(4)} <> '' AS has_parameters, CASE WHEN contains({PART(3)}, '.') AND length(regexp_extract({PART(3)}, '[^.]*$', 0)) <= 5 THEN '.' || lower(regexp_extract({PART(3)}, '[^.]*$', 0)) END AS extension FROM pages"
)
def url_depth_ext(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(
        "page_id",
        urls.depth(F.col("url")).cast("long").alias("depth"),
        urls.has_parameters(F.col("url")).alias("has_parameters"),
        urls.extension(F.col("url")).alias("extension"),
    )


@register(f"SELECT page_id, {PATTERN_CLASS} AS url_pattern FROM pages")
def url_pattern_class(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", urls.pattern_class(F.col("url")).alias("url_pattern"))


@register(
    r"SELECT page_id, list_filter(regexp_extract_all(url, '(\d{4}(?:[-/]\d{4})?)', 1), lambda y: CAST(y[1:4] AS INT) BETWEEN 1990 AND 2030)[1] AS academic_year FROM pages"
)
def academic_year(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", urls.academic_year(F.col("url")).alias("academic_year"))


_TRACK = ", ".join(f"'{t}'" for t in vocab.TRACKING_PARAMETERS)


@register(
    f"""WITH x AS (SELECT page_id, lower({PART(1)}) AS s, {PART(2)} AS a, {PART(3)} AS p, array_to_string(list_filter(string_split({PART(4)}, '&'), lambda q: lower(string_split(q, '=')[1]) NOT IN ({_TRACK})), '&') AS q FROM pages)
SELECT page_id, CASE WHEN s <> '' THEN s || ':' ELSE '' END || CASE WHEN a <> '' THEN '//' || a ELSE '' END || p || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS clean_url FROM x"""
)
def url_clean_tracking(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", urls.clean(F.col("url")).alias("clean_url"))


@register(
    f"SELECT page_id, CASE WHEN {PART(1)} <> '' THEN lower({PART(1)}) || ':' ELSE '' END || CASE WHEN {PART(2)} <> '' THEN '//' || lower({PART(2)}) ELSE '' END || {PART(3)} || CASE WHEN {PART(4)} <> '' THEN '?' || {PART(4)} ELSE '' END AS normal_url, {PART(1)} <> '' AND {PART(2)} <> '' AS valid FROM pages"
)
def url_normalised(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(
        "page_id",
        urls.normalise(F.col("url")).alias("normal_url"),
        urls.is_valid(F.col("url")).alias("valid"),
    )


@register(
    f"SELECT page_id, CASE WHEN len(string_split({PART(2)}, '.')) > 2 THEN string_split({PART(2)}, '.')[1] ELSE '' END AS label FROM pages"
)
def subdomain_label(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", urls.subdomain_label(F.col("url")).alias("label"))


_JOBBED = f"WITH j AS (SELECT job_id, {BARE} AS d FROM jobs), x AS (SELECT p.*, j.d, lower({PART(2)}) AS h, {PART(2)} AS a FROM pages p LEFT JOIN j ON p.job_id = j.job_id) "


@register(
    _JOBBED + "SELECT page_id, CASE WHEN h = d THEN 'www' WHEN ends_with(h, '.' || d) THEN h[1:length(h) - length(d) - 1] ELSE 'external' END AS relative FROM x"
)
def subdomain_relative(spark: SparkSession, folder: str) -> DataFrame:
    pages = analysis.with_job_domain(table(spark, folder, "pages"), table(spark, folder, "jobs"))
    return pages.select("page_id", urls.subdomain_relative(F.col("url"), F.col("job_domain")).alias("relative"))


@register(
    """SELECT page_id, CASE WHEN contains(m, 'html') THEN 'html' WHEN contains(m, 'pdf') THEN 'pdf' WHEN contains(m, 'image/') THEN 'image' WHEN contains(m, 'css') THEN 'css' WHEN contains(m, 'javascript') THEN 'javascript'
 WHEN u LIKE '%.pdf' THEN 'pdf' WHEN regexp_matches(u, '\\.(jpg|jpeg|png|gif|webp)$') THEN 'image' WHEN u LIKE '%.css' THEN 'css' WHEN u LIKE '%.js' THEN 'javascript' ELSE 'other' END AS content_class
FROM (SELECT page_id, lower(coalesce(content_type, '')) AS m, lower(url) AS u FROM pages)"""
)
def content_class(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", urls.content_class(F.col("content_type"), F.col("url")).alias("content_class"))


@register(
    "SELECT job_id, 'job_' || translate(replace(replace(replace(domain, 'https://', ''), 'http://', ''), 'www.', ''), '.:/', '___') || '_' || strftime(created_at, '%y%m%d%H') AS made_id, regexp_replace(domain, '[<>:\"/\\\\|?*]', '_', 'g') AS file_name FROM jobs WHERE domain IS NOT NULL AND created_at IS NOT NULL"
)
def job_names(spark: SparkSession, folder: str) -> DataFrame:
    named = table(spark, folder, "jobs").where("domain IS NOT NULL AND created_at IS NOT NULL")
    return named.select(
        "job_id",
        urls.job_id(F.col("domain"), F.col("created_at")).alias("made_id"),
        urls.safe_filename(F.col("domain")).alias("file_name"),
    )


@register(
    rf"""WITH l AS (SELECT DISTINCT source_url AS b, target_url AS t FROM links WHERE source_url IS NOT NULL AND target_url IS NOT NULL),
x AS (SELECT *, lower(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS s, regexp_extract(b, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1) AS a, regexp_extract(b, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS p, regexp_extract(b, '^[^?#]*\?([^#]*)', 1) AS q, regexp_extract(t, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1) AS ts FROM l)
SELECT b AS source_url, t AS target_url, CASE WHEN ts <> '' AND lower(ts) <> s THEN t WHEN ts <> '' THEN lower(ts) || t[length(ts) + 1:] WHEN starts_with(t, '//') THEN s || ':' || t WHEN starts_with(t, '/') THEN s || '://' || a || t
 WHEN starts_with(t, '#') THEN s || '://' || a || p || CASE WHEN q <> '' THEN '?' || q ELSE '' END || t WHEN starts_with(t, '?') THEN s || '://' || a || p || t ELSE s || '://' || a || regexp_replace(p, '[^/]*$', '') || t END AS resolved FROM x"""
)
def links_resolved(spark: SparkSession, folder: str) -> DataFrame:
    pairs = table(spark, folder, "links").where(
        "source_url IS NOT NULL AND target_url IS NOT NULL"
    ).select("source_url", "target_url").distinct()
    return pairs.withColumn("resolved", urls.resolve(F.col("source_url"), F.col("target_url")))


# ---- Filters ----

_ALLOWED = ", ".join(f"'{x}'" for x in vocab.ALLOWED_SUBDOMAINS)


@register(
    _JOBBED + f"SELECT page_id, a = d OR (ends_with(a, '.' || d) AND a[1:length(a) - length(d) - 1] IN ({_ALLOWED})) AS allowed, a = d OR ends_with(a, '.' || d) OR ends_with(d, '.' || a) AS same_site FROM x"
)
def domain_rules(spark: SparkSession, folder: str) -> DataFrame:
    pages = analysis.with_job_domain(table(spark, folder, "pages"), table(spark, folder, "jobs"))
    host = urls.authority(F.col("url"))
    return pages.select(
        "page_id",
        filters.allowed_domain(host, F.col("job_domain")).alias("allowed"),
        filters.same_site(host, F.col("job_domain")).alias("same_site"),
    )


_EXT = "|".join(vocab.EXCLUDED_EXTENSIONS)
_PAT = "|".join(vocab.EXCLUDED_PATTERNS)


@register(
    rf"SELECT DISTINCT target_url, regexp_matches(lower(target_url), '\.({_EXT})$') AS bad_extension, regexp_matches(target_url, '{_PAT}', 'i') AS bad_pattern FROM links WHERE target_url IS NOT NULL"
)
def url_exclusions(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("target_url")
    return table(spark, folder, "links").where("target_url IS NOT NULL").select("target_url").distinct().select(
        "target_url",
        filters.excluded_extension(t).alias("bad_extension"),
        filters.excluded_pattern(t).alias("bad_pattern"),
    )


@register(
    rf"""WITH j AS (SELECT job_id, {BARE} AS d FROM jobs), l AS (SELECT DISTINCT target_url AS u, j.d FROM links JOIN j USING (job_id) WHERE target_url IS NOT NULL),
x AS (SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS s, regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1) AS a FROM l)
SELECT u AS target_url, d AS job_domain FROM x WHERE s IN ('http', 'https') AND a <> '' AND (a = d OR ends_with(a, '.' || d) OR ends_with(d, '.' || a)) AND NOT regexp_matches(lower(u), '\.({_EXT})$') AND NOT regexp_matches(u, '{_PAT}', 'i') AND u NOT IN (SELECT url FROM pages WHERE url IS NOT NULL)"""
)
def link_filter(spark: SparkSession, folder: str) -> DataFrame:
    found = analysis.with_job_domain(
        table(spark, folder, "links"),
        table(spark, folder, "jobs"),
    ).where("target_url IS NOT NULL AND job_domain IS NOT NULL").select("target_url", "job_domain").distinct()
    return filters.link_filter(
        found,
        "target_url",
        "job_domain",
        table(spark, folder, "pages").select("url").where("url IS NOT NULL").distinct(),
    )


_PHRASES = " + ".join(f"CAST(contains(lower(coalesce(html_content, '')), '{p}') AS INT)" for p in vocab.CHALLENGE_PHRASES)
_HOSTS = " OR ".join(f"contains(lower(url), '{h}')" for h in vocab.CHALLENGE_HOSTS)


@register(
    rf"""SELECT page_id, coalesce({_HOSTS}, false) OR ({_PHRASES}) >= 2 AS challenge,
 contains(lower(coalesce(error_message, '')), 'bot challenge') OR contains(lower(coalesce(error_message, '')), 'bot detection') OR coalesce(retry_count > 1 AND status = 'failed' AND status_code IN (403, 429), false) AS needs_browser,
 coalesce(status = 'fetched' AND html_content IS NOT NULL AND contains(lower(coalesce(content_type, '')), 'text/html'), false) AS extractable,
 coalesce(status = 'extracted' AND length(regexp_replace(trim(coalesce(clean_content, ''), chr(9) || chr(10) || chr(13) || ' ' || chr(160)), '[\s\x{{00a0}}]+', ' ', 'g')) > 50 AND analyzed_at IS NULL, false) AS analysable FROM pages"""
)
def stage_gates(spark: SparkSession, folder: str) -> DataFrame:
    no = lambda c: F.coalesce(c, F.lit(False))
    return table(spark, folder, "pages").select(
        "page_id",
        links.is_challenge(F.col("url"), F.col("html_content"), F.col("status_code"), F.lit(None).cast("string")).alias("challenge"),
        filters.needs_browser(F.col("error_message"), F.col("retry_count"), F.col("status"), F.col("status_code")).alias("needs_browser"),
        no(filters.extractable(F.col("status"), F.col("html_content"), F.col("content_type"))).alias("extractable"),
        no(filters.analysable(F.col("status"), F.col("clean_content"), F.col("analyzed_at"))).alias("analysable"),
    )


@register(
    "SELECT page_id, url FROM (SELECT page_id, url, discovered_at, row_number() OVER (PARTITION BY url ORDER BY discovered_at NULLS FIRST, page_id) AS n FROM pages WHERE url IS NOT NULL) WHERE n = 1 ORDER BY discovered_at NULLS FIRST, page_id, url LIMIT 100"
)
def page_limit(spark: SparkSession, folder: str) -> DataFrame:
    return filters.page_limit(
        table(spark, folder, "pages").where("url IS NOT NULL"),
        "url",
        100,
        ["discovered_at", "page_id"],
    ).select("page_id", "url")


# ---- Text functions ----



@register(
    f"SELECT DISTINCT page_id, unnest(regexp_extract_all(clean_content, '(?i){vocab.EMAIL_PATTERN}')) AS email FROM pages WHERE clean_content IS NOT NULL"
)
def emails_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").where(F.col("clean_content").isNotNull()).select(
        "page_id",
        F.explode(text.emails(F.col("clean_content"))).alias("email"),
    )


@register(
    " UNION ALL ".join(
        f"SELECT DISTINCT page_id, '{k}' AS platform, unnest(regexp_extract_all(clean_content, '(?i){p}', 1)) AS handle FROM pages WHERE clean_content IS NOT NULL" for k, p in vocab.SOCIAL_PATTERNS.items()
    )
)
def social_handles(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "pages").where(F.col("clean_content").isNotNull()).select(
        "page_id",
        F.explode(text.social_handles(F.col("clean_content"))).alias("platform", "_l"),
    )
    return found.select("page_id", "platform", F.explode("_l").alias("handle"))


@register(
    "SELECT page_id, " + ", ".join(
        f"{indicator_sum('clean_content', ps)} AS {k}" for k, ps in vocab.CONTENT_INDICATORS.items()
    ) + " FROM pages"
)
def content_indicators(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", text.content_indicators(F.col("clean_content")).alias("i")).select(
        "page_id",
        *[F.col(f"i.{k}").cast("long").alias(k) for k in vocab.CONTENT_INDICATORS],
    )


@register(
    " UNION ALL ".join(
        "SELECT DISTINCT page_id, '%s' AS category, lower(unnest(%s)) AS term FROM pages WHERE clean_content IS NOT NULL" % (
            k,
            "list_concat(" * (len(ps) - 1) + f"regexp_extract_all(clean_content, '(?i){ps[0]}')" + "".join(
                f", regexp_extract_all(clean_content, '(?i){p}'))" for p in ps[1:]
            ),
        ) for k, ps in vocab.SEMANTIC_PATTERNS.items()
    )
)
def semantic_terms(spark: SparkSession, folder: str) -> DataFrame:
    pairs = F.array(
        *[
            F.struct(
                F.lit(k).alias("category"),
                text.semantic_terms(F.col("clean_content"), k).alias("terms"),
            ) for k in vocab.SEMANTIC_PATTERNS
        ]
    )
    return table(spark, folder, "pages").where(F.col("clean_content").isNotNull()).select("page_id", F.explode(pairs).alias("p")).select(
        "page_id",
        "p.category",
        F.explode("p.terms").alias("term"),
    )


@register(
    "SELECT page_id, " + ", ".join(
        "least(10, len(list_distinct(list_transform(%s, lambda x: lower(x))))) AS %s" % (
            "list_concat(" * (len(ps) - 1) + f"regexp_extract_all(coalesce(clean_content, ''), '(?i){ps[0]}')" + "".join(
                f", regexp_extract_all(coalesce(clean_content, ''), '(?i){p}'))" for p in ps[1:]
            ),
            k,
        ) for k, ps in vocab.SEMANTIC_PATTERNS.items()
    ) + " FROM pages"
)
def semantic_indicators(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", text.semantic_indicators(F.col("clean_content")).alias("i")).select(
        "page_id",
        *[F.col(f"i.{k}").cast("long").alias(k) for k in vocab.SEMANTIC_PATTERNS],
    )


@register(page_type_sql("SELECT page_id, page_type, top AS top_score FROM typed"))
def page_type_score(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").withColumn(
        "_t",
        classify.full_text(F.col("clean_content"), F.col("title"), F.col("url")),
    ).withColumn("s", classify.type_scores(F.col("url"), F.col("_t")))
    return pages.select("page_id", classify.page_type(F.col("s")).alias("page_type"), F.array_max("s").cast("long").alias("top_score"))


@register(subtype_sql())
def page_subtype(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.classified(table(spark, folder, "pages")).select("page_id", "page_type", "page_subtype")


@register(
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(markdown_content, '\[([^\]]+)\]\([^\)]+\)', '', 'g'), '!\[([^\]]*)\]\([^\)]+\)', '', 'g'), '[#*`_~]', '', 'g'), '(?m)^-{3,}$', '', 'g'), '
+', chr(10), 'g'), ' +', ' ', 'g'),
 chr(9) || chr(10) || chr(13) || ' ' || chr(160)) AS plain FROM pages WHERE markdown_content IS NOT NULL"""
)
def markdown_to_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").where("markdown_content IS NOT NULL").select(
        "page_id",
        text.markdown_to_text(F.col("markdown_content")).alias("plain"),
    )


@register(f"SELECT page_id, round({QUALITY}, 6) AS quality FROM pages")
def quality_score(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(
        "page_id",
        F.round(text.quality_score(F.col("title"), F.col("clean_content"), F.col("markdown_content")), 6).alias("quality"),
    )


@register(
    "SELECT page_id, trim(regexp_replace(clean_content, '[\\s\\x{00a0}]+', ' ', 'g')) AS squeezed FROM pages WHERE clean_content IS NOT NULL"
)
def whitespace_normalised(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").where(F.col("clean_content").isNotNull()).select(
        "page_id",
        text.squeeze(F.col("clean_content")).alias("squeezed"),
    )


# ---- HTML ----


@register(
    "SELECT page_id, trim(regexp_extract(html_content, '(?is)<title[^>]*>([^<]*)</title>', 1)) AS html_title FROM pages WHERE regexp_matches(html_content, '(?is)<title[^>]*>[^<]+</title>')"
)
def html_title(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").where(
        F.col("html_content").rlike("(?is)<title[^>]*>[^<]+</title>")
    ).select("page_id", "html_content")
    return pages.select("page_id", html.title_in(F.col("html_content")).alias("html_title"))


@register()
def html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = html.with_extraction(table(spark, folder, "pages").where("html_content IS NOT NULL").select("page_id", "html_content"))
    score = text.quality_score(F.col("x_title"), F.col("x_clean_text"), text.tidy_markdown(F.col("x_markdown")))
    return pages.select(
        "page_id",
        F.col("x_clean_text").alias("clean_text"),
        text.tidy_markdown(F.col("x_markdown")).alias("markdown"),
        F.round(score, 6).alias("quality"),
    )


@register(
    "SELECT page_id, trim(replace(unnest(regexp_extract_all(html_content, '(?i)<a[^>]*href=\"([^\"]+)\"', 1)), '&amp;', '&')) AS href FROM pages WHERE html_content IS NOT NULL"
)
def link_edges(spark: SparkSession, folder: str) -> DataFrame:
    return html.with_links(table(spark, folder, "pages").select("page_id", "html_content"))


# ---- Links and assets ----

_LINKED = (
    _JOBBED
    + """, h2 AS (SELECT page_id, coalesce(d, '?') AS d, regexp_extract_all(coalesce(html_content, ''), '(?i)href=["'']([^"'']+)["'']', 1) AS hs FROM x),
o AS (SELECT page_id, hs, list_filter(list_transform(list_filter(hs, lambda u: starts_with(u, 'http')), lambda u: lower(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1))), lambda a: NOT contains(a, d)) AS outside FROM h2)
"""
)


@register(
    _LINKED + "SELECT page_id, CAST(len(list_filter(hs, lambda u: NOT starts_with(u, '#'))) - len(outside) AS BIGINT) AS internal, CAST(len(outside) AS BIGINT) AS external FROM o"
)
def href_counts(spark: SparkSession, folder: str) -> DataFrame:
    pages = analysis.with_job_domain(table(spark, folder, "pages"), table(spark, folder, "jobs"))
    return pages.select("page_id", links.link_counts(F.col("html_content"), F.coalesce("job_domain", F.lit("?"))).alias("c")).select(
        "page_id",
        F.col("c.internal").cast("long").alias("internal"),
        F.col("c.external").cast("long").alias("external"),
    )


_ASSETS = rf"""WITH m AS (SELECT page_id, url, regexp_extract_all(html_content, '(?i)<a[^>]+href=["'']([^"'']+)["''][^>]*>([^<]*)</a>', 1) AS hs, regexp_extract_all(html_content, '(?i)<a[^>]+href=["'']([^"'']+)["''][^>]*>([^<]*)</a>', 2) AS ts FROM pages WHERE html_content IS NOT NULL),
a AS (SELECT page_id, url AS b, hs[i] AS t, ts[i] AS w FROM m, unnest(range(1, len(hs) + 1)) AS r(i)),
x AS (SELECT *, lower(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS s, regexp_extract(b, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1) AS au, regexp_extract(b, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS p, regexp_extract(b, '^[^?#]*\?([^#]*)', 1) AS q, regexp_extract(t, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1) AS ts2 FROM a),
y AS (SELECT page_id, w, CASE WHEN ts2 <> '' AND lower(ts2) <> s THEN t WHEN ts2 <> '' THEN lower(ts2) || t[length(ts2) + 1:] WHEN starts_with(t, '//') THEN s || ':' || t WHEN starts_with(t, '/') THEN s || '://' || au || t WHEN starts_with(t, '#') THEN s || '://' || au || p || CASE WHEN q <> '' THEN '?' || q ELSE '' END || t WHEN starts_with(t, '?') THEN s || '://' || au || p || t ELSE s || '://' || au || regexp_replace(p, '[^/]*$', '') || t END AS asset_url FROM x),
z AS (SELECT page_id, asset_url, {ASSET} AS asset_type, nullif(trim(w), '') AS description FROM y WHERE asset_url IS NOT NULL)
"""


@register(_ASSETS + "SELECT * FROM z WHERE asset_type <> 'webpage'")
def linked_assets(spark: SparkSession, folder: str) -> DataFrame:
    return links.linked_assets(table(spark, folder, "pages"))


@register(_ASSETS + "SELECT page_id, asset_type, count(*) AS n FROM z WHERE asset_type <> 'webpage' GROUP BY ALL")
def asset_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return links.asset_breakdown(links.linked_assets(table(spark, folder, "pages"))).select(
        "page_id",
        F.explode("breakdown").alias("asset_type", "n"),
    ).select(
        "page_id",
        "asset_type",
        F.col("n").cast("long").alias("n"),
    )


@register(
    "SELECT target_url, count(*) AS n, count(DISTINCT source_url) AS n_sources FROM links WHERE target_url IS NOT NULL GROUP BY 1 ORDER BY n DESC, target_url LIMIT 20"
)
def top_link_targets(spark: SparkSession, folder: str) -> DataFrame:
    counts = table(spark, folder, "links").where("target_url IS NOT NULL").groupBy("target_url").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("source_url").alias("n_sources"),
    )
    return counts.orderBy(F.desc("n"), "target_url").limit(20)


# ---- Rollups and reports ----

_STORED = "coalesce(analysis_results.emails_found, 0) AS n_emails, coalesce(analysis_results.social_profiles_found, 0) AS n_handles"
_IND = list(vocab.CONTENT_INDICATORS)
_STORED_IND = ", ".join(f"coalesce(analysis_results.content_indicators.{i}, 0) AS {i}" for i in _IND)


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    a = F.col("analysis_results")
    done = table(spark, folder, "pages").where(a.isNotNull())
    return done.select(
        "page_id",
        "url",
        "subdomain",
        a["page_type"].alias("page_type"),
        F.coalesce(a["emails_found"], F.lit(0)).alias("n_emails"),
        F.coalesce(a["social_profiles_found"], F.lit(0)).alias("n_handles"),
        *[F.coalesce(a["content_indicators"][i], F.lit(0)).alias(i) for i in _IND],
    )


@register(
    f"""SELECT CASE WHEN len(string_split({PART(2)}, '.')) > 2 THEN string_split({PART(2)}, '.')[1] ELSE '' END AS subdomain, {PATTERN_CLASS} AS url_pattern, count(*) AS n_pages,
 CAST(sum({indicator_sum('clean_content', vocab.CONTENT_INDICATORS['funding_references'])}) AS BIGINT) AS funding FROM pages WHERE url IS NOT NULL GROUP BY ALL"""
)
def site_pattern_rollup(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").where("url IS NOT NULL").select(
        urls.subdomain_label(F.col("url")).alias("subdomain"),
        urls.pattern_class(F.col("url")).alias("url_pattern"),
        text.count_matches(F.col("clean_content"), vocab.CONTENT_INDICATORS["funding_references"]).alias("f"),
    )
    return pages.groupBy("subdomain", "url_pattern").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("f").cast("long").alias("funding"))


_CLASS = r"""CASE WHEN contains(lower(coalesce(content_type, '')), 'html') THEN 'html' WHEN contains(lower(coalesce(content_type, '')), 'pdf') THEN 'pdf' WHEN contains(lower(coalesce(content_type, '')), 'image/') THEN 'image'
 WHEN contains(lower(coalesce(content_type, '')), 'css') THEN 'css' WHEN contains(lower(coalesce(content_type, '')), 'javascript') THEN 'javascript' WHEN lower(url) LIKE '%.pdf' THEN 'pdf'
 WHEN regexp_matches(lower(url), '\.(jpg|jpeg|png|gif|webp)$') THEN 'image' WHEN lower(url) LIKE '%.css' THEN 'css' WHEN lower(url) LIKE '%.js' THEN 'javascript' ELSE 'other' END"""
_HANDLES = " + ".join(f"len(list_distinct(regexp_extract_all(coalesce(clean_content, ''), '(?i){p}', 1)))" for p in vocab.SOCIAL_PATTERNS.values())
_CLASSES = ("html", "pdf", "image", "css", "javascript", "other")


@register(
    _LINKED
    + f""", e AS (SELECT x.page_id, x.job_id, o.outside, len(list_filter(o.hs, lambda u: NOT starts_with(u, '#'))) - len(o.outside) AS internal, CASE WHEN h = d THEN 'www' WHEN ends_with(h, '.' || d) THEN h[1:length(h) - length(d) - 1] ELSE 'external' END AS rel,
 len(list_distinct(regexp_extract_all(coalesce(clean_content, ''), '(?i){vocab.EMAIL_PATTERN}'))) AS ne, {_HANDLES} AS nh, {_CLASS} AS class FROM x JOIN o ON x.page_id = o.page_id)
SELECT job_id, count(*) AS total_pages, {', '.join(f"count(*) FILTER (class = '{c}') AS {c}_pages" for c in _CLASSES)}, CAST(sum(internal) AS BIGINT) AS internal_links, CAST(sum(len(outside)) AS BIGINT) AS external_links,
 CAST(sum(ne) AS BIGINT) AS emails_found, CAST(sum(nh) AS BIGINT) AS social_profiles_found, count(DISTINCT rel) AS subdomains, CAST(len(list_distinct(flatten(list(outside)))) AS BIGINT) AS unique_external_domains FROM e GROUP BY job_id"""
)
def site_metrics(spark: SparkSession, folder: str) -> DataFrame:
    out = rollup.site_metrics(analysis.site_rows(table(spark, folder, "pages"), table(spark, folder, "jobs")))
    return out.withColumns({c: F.col(c).cast("long") for c in ("internal_links", "external_links", "emails_found", "social_profiles_found")})


@register(
    f"""WITH e AS (SELECT job_id, subdomain, list_distinct(regexp_extract_all(coalesce(clean_content, ''), '(?i){vocab.EMAIL_PATTERN}')) AS es,
 list_concat({', '.join(f"list_transform(regexp_extract_all(coalesce(clean_content, ''), '(?i){p}', 1), lambda v: '{k}:' || v)" for k, p in vocab.SOCIAL_PATTERNS.items())}) AS hs, clean_content, {_CLASS} AS class FROM pages WHERE job_id IS NOT NULL AND subdomain IS NOT NULL)
SELECT job_id, subdomain, count(*) AS page_count, count(clean_content) AS pages_with_text, CAST(len(list_distinct(flatten(list(es)))) AS BIGINT) AS emails, CAST(len(list_distinct(flatten(list(hs)))) AS BIGINT) AS handles,
 {', '.join(f"count(*) FILTER (class = '{c}') AS {c}_pages" for c in _CLASSES)} FROM e GROUP BY ALL"""
)
def subdomain_metrics(spark: SparkSession, folder: str) -> DataFrame:
    safe = F.coalesce(F.col("clean_content"), F.lit(""))
    rows = table(spark, folder, "pages").where("job_id IS NOT NULL AND subdomain IS NOT NULL").select(
        "job_id",
        "subdomain",
        "clean_content",
        text.emails(safe).alias("emails"),
        text.social_handles(safe).alias("social"),
        urls.content_class(F.col("content_type"), F.col("url")).alias("content_class"),
    )
    return rollup.subdomain_metrics(rows, ["job_id", "subdomain"])


@register(
    "SELECT job_id, subdomain, url, n_links FROM (SELECT job_id, subdomain, url, len(internal_links) AS n_links, row_number() OVER (PARTITION BY job_id, subdomain, url ORDER BY processed_at DESC NULLS LAST, page_id DESC) AS n "
    "FROM pages WHERE job_id IS NOT NULL AND subdomain IS NOT NULL AND url IS NOT NULL AND internal_links IS NOT NULL) WHERE n = 1"
)
def subdomain_page_links(spark: SparkSession, folder: str) -> DataFrame:
    """The links of each page by subdomain; of a page stored several times the last one counts."""
    rows = table(spark, folder, "pages").where("job_id IS NOT NULL AND subdomain IS NOT NULL AND url IS NOT NULL AND internal_links IS NOT NULL")
    return rollup.page_links(rows, ["job_id", "subdomain"])


@register(
    "SELECT page_id, subdomain, CAST(n AS BIGINT) AS n_links, CAST(rank AS BIGINT) AS rank FROM (SELECT page_id, subdomain, len(internal_links) AS n, row_number() OVER (PARTITION BY subdomain ORDER BY len(internal_links) DESC, page_id) AS rank FROM pages WHERE subdomain IS NOT NULL AND internal_links IS NOT NULL) WHERE rank <= 10"
)
def top_pages_per_subdomain(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "pages").where("subdomain IS NOT NULL AND internal_links IS NOT NULL").select(
        "page_id",
        "subdomain",
        F.size("internal_links").cast("long").alias("n_links"),
    )
    return rollup.top_pages(rows, ["subdomain"], "n_links", "page_id").select(
        "page_id",
        "subdomain",
        "n_links",
        F.col("rank").cast("long").alias("rank"),
    )


@register("SELECT status, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS pct FROM pages GROUP BY status")
def status_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return rollup.breakdown(table(spark, folder, "pages"), "status").withColumn("pct", F.col("pct").cast("double"))


@register(
    "WITH a AS (SELECT analysis_results.page_type AS page_type FROM pages WHERE analysis_results IS NOT NULL) SELECT page_type, n, pct FROM (SELECT page_type, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS pct FROM a GROUP BY 1) WHERE page_type IS NOT NULL AND page_type NOT IN ('', 'unknown')"
)
def type_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return rollup.breakdown(_stored(spark, folder), "page_type").where(
        "page_type IS NOT NULL AND page_type NOT IN ('', 'unknown')"
    ).withColumn("pct", F.col("pct").cast("double"))


@register(
    f"WITH a AS (SELECT {_STORED_IND} FROM pages WHERE analysis_results IS NOT NULL) SELECT " + ", ".join(
        f"count(*) FILTER ({i} > 0) AS {i}" for i in _IND
    ) + " FROM a"
)
def indicator_prevalence(spark: SparkSession, folder: str) -> DataFrame:
    return rollup.indicator_prevalence(_stored(spark, folder), _IND)


@register(
    f"WITH a AS (SELECT {_STORED} FROM pages WHERE analysis_results IS NOT NULL) SELECT count(*) AS analyzed, CAST(sum(n_emails) AS BIGINT) AS emails, count(*) FILTER (n_emails > 0) AS pages_with_emails, count(*) FILTER (n_emails > 0) * 100.0 / count(*) AS pct_with_emails, CAST(sum(n_handles) AS BIGINT) AS handles, count(*) FILTER (n_handles > 0) AS pages_with_handles, count(*) FILTER (n_handles > 0) * 100.0 / count(*) AS pct_with_handles FROM a"
)
def contact_totals(spark: SparkSession, folder: str) -> DataFrame:
    out = rollup.contact_totals(_stored(spark, folder))
    return out.withColumns({c: F.col(c).cast("double") for c in ("pct_with_emails", "pct_with_handles")})


@register(
    """SELECT count(*) AS total_pages, count(*) FILTER (browser_fetched) AS browser_fetch_count, count(*) FILTER (browser_fetched) * 100.0 / count(*) AS browser_fetch_percentage, round(avg(markdown_quality_score), 9) AS average_quality_score,
 count(*) FILTER (markdown_quality_score >= 0.7) AS high_quality_pages, count(*) FILTER (markdown_quality_score >= 0.7) * 100.0 / count(markdown_quality_score) AS high_quality_percentage FROM pages"""
)
def extraction_quality(spark: SparkSession, folder: str) -> DataFrame:
    out = rollup.extraction_quality(table(spark, folder, "pages"))
    return out.withColumns(
        {
            "browser_fetch_percentage": F.col("browser_fetch_percentage").cast("double"),
            "high_quality_percentage": F.col("high_quality_percentage").cast("double"),
            "average_quality_score": F.round("average_quality_score", 9),
        }
    )


@register("SELECT coalesce(extraction_method, 'unknown') AS method, count(*) AS n FROM pages GROUP BY 1")
def method_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return rollup.method_histogram(table(spark, folder, "pages"))


@register("SELECT status_code, count(*) AS n FROM pages WHERE status_code IS NOT NULL GROUP BY 1")
def status_codes(spark: SparkSession, folder: str) -> DataFrame:
    return rollup.status_codes(table(spark, folder, "pages"))


@register("SELECT count(*) AS n_pages, count(analyzed_at) AS n_analyzed, count(analyzed_at) * 100.0 / count(*) AS pct FROM pages")
def analysis_completion(spark: SparkSession, folder: str) -> DataFrame:
    n, done = F.count(F.lit(1)), F.count("analyzed_at")
    return table(spark, folder, "pages").agg(
        n.alias("n_pages"),
        done.alias("n_analyzed"),
        rollup.share(done, n).cast("double").alias("pct"),
    )


_PER_JOB = """WITH p AS (SELECT job_id, count(*) AS total, count(*) FILTER (status IN ('fetched', 'extracted', 'analyzed')) AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status IN ('extracted', 'analyzed', 'failed')) AS done,
 CAST(sum(coalesce(len(emails), 0)) AS BIGINT) AS emails, count(DISTINCT nullif(subdomain, '')) AS subdomains FROM pages GROUP BY 1) """


@register(
    f"""WITH q AS (SELECT *, {_CLASS} AS class, coalesce(list_sum(list_transform(map_values(social_media), lambda v: len(v))), 0) AS nh FROM pages),
p AS (SELECT job_id, count(*) AS total, count(*) FILTER (status IN ('fetched', 'extracted', 'analyzed')) AS succeeded, count(*) FILTER (status = 'failed') AS failed,
 CAST(sum(coalesce(len(emails), 0)) AS BIGINT) AS emails, CAST(sum(nh) AS BIGINT) AS handles, count(DISTINCT nullif(subdomain, '')) AS subdomains, {', '.join(f"count(*) FILTER (class = '{c}') AS {c}_pages" for c in _CLASSES)} FROM q GROUP BY 1)
SELECT j.job_id, j.status AS job_status, coalesce(total, 0) AS total, coalesce(succeeded, 0) AS succeeded, coalesce(failed, 0) AS failed, CASE WHEN total > 0 THEN succeeded * 100.0 / total ELSE 0.0 END AS success_rate,
 coalesce(emails, 0) AS emails, coalesce(handles, 0) AS handles, coalesce(subdomains, 0) AS subdomains, {', '.join(f"coalesce({c}_pages, 0) AS {c}_pages" for c in _CLASSES)},
 round((epoch_us(completed_at) - epoch_us(started_at)) / 1e6, 3) AS duration_seconds FROM jobs j LEFT JOIN p ON j.job_id = p.job_id"""
)
def crawl_summary(spark: SparkSession, folder: str) -> DataFrame:
    out = rollup.crawl_summary(table(spark, folder, "pages"), table(spark, folder, "jobs"))
    return out.withColumns({"success_rate": F.col("success_rate").cast("double"), "duration_seconds": F.round("duration_seconds", 3)})


@register(
    f"""SELECT job_id, 'content_class' AS kind, {_CLASS} AS value, count(*) AS n FROM pages WHERE job_id IS NOT NULL GROUP BY ALL
UNION ALL SELECT job_id, 'subdomain', subdomain, count(*) FROM pages WHERE job_id IS NOT NULL AND subdomain <> '' GROUP BY ALL
UNION ALL SELECT job_id, 'status_code', CAST(status_code AS VARCHAR), count(*) FROM pages WHERE job_id IS NOT NULL AND status_code IS NOT NULL GROUP BY ALL"""
)
def crawl_summary_counts(spark: SparkSession, folder: str) -> DataFrame:
    return rollup.crawl_summary_counts(table(spark, folder, "pages"))


@register(
    _PER_JOB + "SELECT j.job_id, j.domain, j.status, coalesce(total, 0) AS n_pages, coalesce(failed, 0) AS n_failed, CASE WHEN total > 0 THEN done * 100.0 / total ELSE 0.0 END AS pct_done FROM jobs j LEFT JOIN p ON j.job_id = p.job_id"
)
def job_status(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.job_status(
        table(spark, folder, "jobs"),
        table(spark, folder, "pages"),
    ).withColumn("pct_done", F.col("pct_done").cast("double"))


@register(
    "SELECT job_id, CAST(CASE WHEN contains(domain, 'harvard.edu') OR contains(domain, 'stanford.edu') THEN 2.0 WHEN contains(domain, '.cc.') OR contains(domain, 'community') THEN 0.5 WHEN contains(domain, 'ue.edu.pe') THEN 3.0 ELSE 1.0 END AS DOUBLE) AS base_delay FROM jobs"
)
def preset_delays(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "jobs").select("job_id", jobs.preset_delay(F.col("domain")).alias("base_delay"))


@register(
    f"SELECT page_id, page_type, CAST(n_emails AS BIGINT) AS score FROM (SELECT page_id, analysis_results.page_type AS page_type, {_STORED} FROM pages WHERE analysis_results IS NOT NULL) WHERE n_emails > 0 ORDER BY n_emails DESC, page_id LIMIT 10"
)
def contact_rich_top10(spark: SparkSession, folder: str) -> DataFrame:
    return report.contact_rich(_stored(spark, folder)).select("page_id", "page_type", F.col("score").cast("long").alias("score"))


@register(
    f"SELECT page_id, page_type, CAST({' + '.join(_IND)} AS BIGINT) AS score FROM (SELECT page_id, analysis_results.page_type AS page_type, {_STORED_IND} FROM pages WHERE analysis_results IS NOT NULL) WHERE {' + '.join(_IND)} > 0 ORDER BY score DESC, page_id LIMIT 15"
)
def indicator_top15(spark: SparkSession, folder: str) -> DataFrame:
    return report.indicator_rich(_stored(spark, folder), _IND).select("page_id", "page_type", F.col("score").cast("long").alias("score"))


@register("SELECT page_id, url FROM pages WHERE analysis_results.page_type = 'news' ORDER BY page_id LIMIT 5")
def sample_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return report.sample_of_type(_stored(spark, folder), "News").select("page_id", "url")


@register(
    "SELECT subdomain, count(*) AS n_pages, CAST(sum(coalesce(analysis_results.emails_found, 0)) AS BIGINT) AS emails, CAST(sum(coalesce(analysis_results.social_profiles_found, 0)) AS BIGINT) AS social FROM pages WHERE analysis_results IS NOT NULL AND subdomain IS NOT NULL GROUP BY 1 ORDER BY n_pages DESC, subdomain LIMIT 10"
)
def subdomain_top10(spark: SparkSession, folder: str) -> DataFrame:
    per = _stored(spark, folder).where("subdomain IS NOT NULL").groupBy("subdomain").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.sum("n_emails").alias("emails"),
        F.sum("n_handles").alias("social"),
    )
    return per.orderBy(F.desc("n_pages"), "subdomain").limit(10)


@register(
    "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 9) AS recent_mean FROM events"
)
def last10_response_mean(spark: SparkSession, folder: str) -> DataFrame:
    return rollup.last_mean(
        table(spark, folder, "events"),
        ["user_id"],
        ["ts", "event_id"],
        "value",
    ).select("event_id", F.round("recent_mean", 9).alias("recent_mean"))


# ---- Sinks ----


_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || 'Z' AS {0}"
_LABEL = f"CASE WHEN len(string_split({PART(2)}, '.')) > 2 THEN string_split({PART(2)}, '.')[1] ELSE '' END"
_TIMES = ("discovered_at", "fetched_at", "processed_at", "analyzed_at")
_LENGTHS = {"internal_links_count": "internal_links", "external_links_count": "external_links", "emails_count": "emails"}


@register(
    f"""SELECT url, status, status_code, content_type, content_length, title, {PART(2)} AS domain, {_LABEL} AS subdomain, regexp_replace({PART(3)}, ';[^/]*$', '') AS path,
 {', '.join(_ISO.format(c) for c in _TIMES)}, error_message, retry_count, {', '.join(f"CAST(coalesce(len({c}), 0) AS BIGINT) AS {n}" for n, c in _LENGTHS.items())},
 CAST(coalesce(list_sum(list_transform(map_values(social_media), lambda v: len(v))), 0) AS BIGINT) AS social_profiles_count, coalesce(analysis_results.page_type, '') AS page_type,
 {', '.join(f"CAST(coalesce(analysis_results.content_indicators.{i}, 0) AS BIGINT) AS {i}" for i in vocab.CONTENT_INDICATORS)},
 coalesce(extraction_method, 'unknown') AS extraction_method, CASE WHEN browser_fetched THEN 'yes' ELSE 'no' END AS browser_fetched,
 CASE WHEN markdown_quality_score IS NULL THEN '' ELSE printf('%.2f', markdown_quality_score) END AS markdown_quality FROM pages"""
)
def page_report(spark: SparkSession, folder: str) -> DataFrame:
    out = exports.page_report(table(spark, folder, "pages"))
    return out.withColumns({c: F.col(c).cast("long") for c in (*_LENGTHS, "social_profiles_count", *vocab.CONTENT_INDICATORS)})


@register(
    f"""WITH s AS (SELECT url, title, {_LABEL} AS subdomain, processed_at, unnest(map_entries(social_media)) AS e FROM pages WHERE social_media IS NOT NULL)
SELECT url AS source_url, 'email' AS contact_type, unnest(emails) AS contact_value, {_LABEL} AS subdomain, title AS page_title, processed_at AS discovered_at FROM pages
UNION ALL SELECT url, e.key, unnest(e.value), subdomain, title, processed_at FROM s"""
)
def contact_rows(spark: SparkSession, folder: str) -> DataFrame:
    return exports.contact_rows(table(spark, folder, "pages"))


@register(
    r"SELECT job_id, CASE WHEN regexp_matches(job_id, '^job_(.*)_([^_]*)$') THEN regexp_replace(job_id, '^job_(.*)_([^_]*)$', '\1-pages-\2.csv') ELSE job_id || '_pages.csv' END AS file_name FROM jobs"
)
def export_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "jobs").select("job_id", exports.file_name_column(F.col("job_id"), "pages", "csv").alias("file_name"))


@register("SELECT job_id, row_number() OVER (PARTITION BY domain ORDER BY created_at DESC NULLS LAST, job_id) <= 5 AS keep FROM jobs")
def retention(spark: SparkSession, folder: str) -> DataFrame:
    return exports.retained(table(spark, folder, "jobs"), ["domain"], "created_at", "job_id").select("job_id", "keep")


# ---- Frontier ----

_RANK = "CASE status WHEN 'failed' THEN -1 WHEN 'fetched' THEN 1 WHEN 'extracted' THEN 2 WHEN 'analyzed' THEN 3 ELSE 0 END"


@register(
    f"SELECT url, page_id, status FROM (SELECT url, page_id, status, row_number() OVER (PARTITION BY url ORDER BY {_RANK} DESC, page_id) AS n FROM pages WHERE url IS NOT NULL) WHERE n = 1"
)
def frontier_latest(spark: SparkSession, folder: str) -> DataFrame:
    return frontier.keep_latest_stage(
        table(spark, folder, "pages").where("url IS NOT NULL").select("url", "page_id", "status"),
        order=["page_id"],
    )


@register(
    "SELECT url FROM pages WHERE status = 'analyzed' UNION ALL SELECT target_url FROM links WHERE target_url IS NOT NULL AND target_url NOT IN (SELECT url FROM pages WHERE status = 'analyzed' AND url IS NOT NULL)"
)
def append_distinct(spark: SparkSession, folder: str) -> DataFrame:
    done = table(spark, folder, "pages").where("status = 'analyzed'").select("url")
    return frontier.append_distinct(
        done,
        table(spark, folder, "links").where("target_url IS NOT NULL").select(F.col("target_url").alias("url")),
    )


@register("SELECT page_id, url FROM pages WHERE status = 'discovered' ORDER BY discovered_at NULLS FIRST, page_id LIMIT 10")
def dequeue_batch(spark: SparkSession, folder: str) -> DataFrame:
    pending = table(spark, folder, "pages").where("status = 'discovered'").select("page_id", "url", "discovered_at")
    return frontier.dequeue(pending, ["discovered_at", "page_id"])[0].select("page_id", "url")


@register(
    "SELECT q AS queue, count(*) AS n FROM (SELECT CASE WHEN status = 'discovered' THEN 'pending' WHEN status IN ('fetching', 'extracting', 'analyzing') THEN 'processing' WHEN status = 'failed' THEN 'failed' ELSE 'completed' END AS q FROM pages) GROUP BY 1"
)
def queue_counts(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    name = F.when(F.col("status") == "discovered", "pending").when(
        F.col("status").isin("fetching", "extracting", "analyzing"),
        "processing",
    ).when(F.col("status") == "failed", "failed").otherwise("completed")
    return frontier.queue_counts({q: pages.where(name == q) for q in ("pending", "processing", "failed", "completed")})


@register(
    """WITH RECURSIVE e AS (SELECT DISTINCT source_url AS s, target_url AS t FROM links WHERE source_url IS NOT NULL AND target_url IS NOT NULL),
seed AS (SELECT min(url) AS url FROM pages WHERE url IS NOT NULL GROUP BY job_id),
w(url, depth) AS (SELECT DISTINCT url, 0 FROM seed UNION SELECT e.t, w.depth + 1 FROM w JOIN e ON e.s = w.url WHERE w.depth < 3)
SELECT url, min(depth) AS depth FROM w GROUP BY url"""
)
def bfs_depth(spark: SparkSession, folder: str) -> DataFrame:
    seeds = table(spark, folder, "pages").where("url IS NOT NULL").groupBy("job_id").agg(F.min("url").alias("url")).select("url")
    return frontier.breadth_first(table(spark, folder, "links"), seeds, "source_url", "target_url", 3)


@register(
    """WITH RECURSIVE e AS (SELECT DISTINCT source_url AS s, target_url AS t FROM links WHERE source_url IS NOT NULL AND target_url IS NOT NULL),
seed AS (SELECT min(url) AS url FROM pages WHERE url IS NOT NULL GROUP BY job_id),
w(url, depth) USING KEY (url) AS (SELECT url, min(0) FROM seed WHERE url IS NOT NULL GROUP BY url UNION
  SELECT e.t, min(w.depth + 1) FROM w JOIN e ON e.s = w.url WHERE NOT EXISTS (SELECT 1 FROM recurring.w AS r WHERE r.url = e.t) GROUP BY e.t)
SELECT url, depth FROM w"""
)
def bfs_depth_all(spark: SparkSession, folder: str) -> DataFrame:
    """``bfs_depth`` without its bound of three links: every reachable address."""
    seeds = table(spark, folder, "pages").where("url IS NOT NULL").groupBy("job_id").agg(F.min("url").alias("url")).select("url")
    return frontier.breadth_first(table(spark, folder, "links"), seeds, "source_url", "target_url")


# ---- Limiter, over the pages as a fetch log ----

_HOST = "lower(regexp_replace(domain, ':[0-9]*$', ''))"
_REPLAY = f"""
WITH RECURSIVE ev AS (
  SELECT {_HOST} AS host, fetched_at AS ts, status_code AS code, coalesce((epoch_us(processed_at) - epoch_us(fetched_at)) / 1e6, 0.0) AS sec,
    row_number() OVER (PARTITION BY {_HOST} ORDER BY fetched_at, page_id) AS n
  FROM pages WHERE domain IS NOT NULL AND fetched_at IS NOT NULL
),
st AS (
  SELECT DISTINCT host, CAST(0 AS BIGINT) AS n, CAST(1.0 AS DOUBLE) AS delay, 0 AS errors, 0 AS wins, 0 AS violations, 0 AS server, 0 AS points,
    CAST([] AS DOUBLE[]) AS times, CAST(NULL AS TIMESTAMP WITH TIME ZONE) AS limited FROM ev
  UNION ALL
  SELECT host, n, CASE WHEN ok AND steady THEN greatest(1.0, d2 * 0.9) WHEN ok THEN d2 ELSE least(30.0, delay * factor) END,
    CASE WHEN ok THEN 0 ELSE errors + 1 END, CASE WHEN ok AND steady THEN 0 WHEN ok THEN wins + 1 ELSE 0 END,
    violations + CASE WHEN c = 429 THEN 1 ELSE 0 END, CASE WHEN ok THEN 0 ELSE srv END,
    points + CASE WHEN ok THEN 0 WHEN c = 429 THEN 2 WHEN c = 403 THEN 3 WHEN c >= 500 THEN CASE WHEN srv > 3 THEN 1 ELSE 0 END WHEN c = 404 THEN 0 ELSE 1 END,
    t2, CASE WHEN c = 429 THEN ts ELSE limited END
  FROM (SELECT *, d2 > 1.0 AND wins + 1 > 10 AS steady FROM (
    SELECT *, CASE WHEN len(t2) >= 5 AND mean < 0.5 AND sec < 0.5 THEN CASE WHEN delay > 1.0 THEN greatest(1.0, delay * 0.95) ELSE delay END
      WHEN len(t2) >= 5 AND mean > 3.0 THEN least(30.0, delay * 1.1) ELSE delay END AS d2 FROM (
      SELECT *, CASE WHEN len(t2) = 0 THEN 0.0
        ELSE list_reduce(t2[greatest(1, len(t2) - 9):], lambda a, b: a + b) / len(t2[greatest(1, len(t2) - 9):]) END AS mean FROM (
        SELECT ev.host, ev.n, ev.ts, ev.sec, coalesce(ev.code, 0) AS c, coalesce(ev.code, 0) BETWEEN 1 AND 399 AS ok,
          st.delay, st.errors, st.wins, st.violations, st.points, st.limited, st.server + CASE WHEN coalesce(ev.code, 0) >= 500 THEN 1 ELSE 0 END AS srv,
          CASE WHEN coalesce(ev.code, 0) = 429 THEN 2.5 WHEN coalesce(ev.code, 0) = 403 THEN 2.0 WHEN coalesce(ev.code, 0) >= 500 THEN 1.5
            WHEN coalesce(ev.code, 0) = 404 THEN 1.1 ELSE 1.2 END AS factor,
          CASE WHEN coalesce(ev.code, 0) BETWEEN 1 AND 399 AND ev.sec > 0 THEN list_append(st.times, ev.sec)[greatest(1, len(st.times) - 48):] ELSE st.times END AS t2
        FROM st JOIN ev ON ev.host = st.host AND ev.n = st.n + 1))))
),
l AS (SELECT host, max(n) AS n, max(ts) AS until FROM ev GROUP BY host),
f AS (SELECT st.*, l.until FROM st JOIN l ON st.host = l.host AND st.n = l.n)
"""
_SEVERITY = "CASE WHEN errors > 5 OR violations > 2 OR points > 8 OR (limited IS NOT NULL AND epoch_us(until) - epoch_us(limited) < 600000000 AND errors > 2) THEN 'blocked' WHEN points > 4 OR errors > 3 THEN 'throttled' WHEN delay > 2 THEN 'limited' ELSE 'normal' END"


def _replayed(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "pages").withColumn("host", F.expr(_HOST))
    seconds = (F.unix_micros("processed_at") - F.unix_micros("fetched_at")) / 1e6
    return limiter.replay(log, "host", "fetched_at", "page_id", F.col("status_code"), seconds)


@register(
    _REPLAY + "SELECT host, n, round(delay, 6) AS delay, CAST(errors AS BIGINT) AS errors, CAST(violations AS BIGINT) AS violations, CAST(points AS BIGINT) AS indicators FROM f"
)
def limiter_replay(spark: SparkSession, folder: str) -> DataFrame:
    return _replayed(spark, folder).select(
        "host",
        "n",
        F.round("state.delay", 6).alias("delay"),
        *[F.col(f"state.{c}").cast("long").alias(c) for c in ("errors", "violations", "indicators")],
    )


@register(_REPLAY + f"SELECT {_SEVERITY} AS severity, count(*) AS n FROM f GROUP BY 1")
def severity_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return _replayed(spark, folder).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


# ---- Beyond the crawl: joins, sets, cubes ----


@register(
    """SELECT o_orderkey, asof_o_totalprice FROM (SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS asof_o_totalprice FROM orders)"""
)
def asof_previous_order(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql.window import Window

    before = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, folder, "orders").select("o_orderkey", F.lag("o_totalprice").over(before).alias("asof_o_totalprice"))


@register(
    "SELECT e.event_id, max_by(r.value, struct_pack(t := r.ts, i := r.event_id)) AS asof_value FROM events e LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') r ON r.user_id = e.user_id AND r.ts <= e.ts WHERE e.event_type = 'click' GROUP BY e.event_id"
)
def asof_last_purchase(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return joins.as_of(
        events.where("event_type = 'click'").select("event_id", "user_id", "ts"),
        events.where("event_type = 'purchase'").select("user_id", "ts", "value", "event_id"),
        ["user_id"],
        "ts",
        ["value"],
        "event_id",
    ).select("event_id", "asof_value")


@register(
    "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_size >= s_nationkey AND p_size < s_nationkey + 2 WHERE p_partkey IS NOT NULL"
)
def range_sizes(spark: SparkSession, folder: str) -> DataFrame:
    spans = table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("lo"), (F.col("s_nationkey") + 2).alias("hi"))
    return joins.range_join(
        table(spark, folder, "part").select("p_partkey", "p_size"),
        spans,
        "p_size",
        "lo",
        "hi",
        4,
    ).select("p_partkey", "s_suppkey")


@register(
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"
)
def cube_flags(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").cube("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
    )


@register(
    "SELECT c_nationkey, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY ROLLUP (c_nationkey, n_name)"
)
def rollup_customers_with_orders(spark: SparkSession, folder: str) -> DataFrame:
    buyers = table(spark, folder, "customer").join(table(spark, folder, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return buyers.join(
        table(spark, folder, "nation"),
        F.col("c_nationkey") == F.col("n_nationkey"),
    ).rollup("c_nationkey", "n_name").agg(F.count(F.lit(1)).alias("n"))


@register(
    "SELECT url FROM (SELECT url FROM pages WHERE url IS NOT NULL INTERSECT SELECT target_url FROM links) EXCEPT SELECT source_url FROM links"
)
def linked_leaf_pages(spark: SparkSession, folder: str) -> DataFrame:
    linked = table(spark, folder, "pages").where("url IS NOT NULL").select("url").intersect(
        table(spark, folder, "links").select("target_url")
    )
    return linked.subtract(table(spark, folder, "links").select("source_url"))


@register(
    "SELECT n_regionkey, c_mktsegment, count(*) AS n, count(DISTINCT c_nationkey) AS n_nations FROM customer JOIN nation ON c_nationkey = n_nationkey "
    "GROUP BY GROUPING SETS ((n_regionkey), (c_mktsegment), ())"
)
def grouping_sets_customers(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    sets = [["n_regionkey"], ["c_mktsegment"], []]
    counts = [F.count(F.lit(1)).alias("n"), F.count_distinct("c_nationkey").alias("n_nations")]
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], "n_regionkey", "c_mktsegment").agg(*counts)


@register(
    "SELECT job_id, CAST(json_extract_string(config, '$.base_delay') AS DOUBLE) AS base_delay, CAST(json_extract_string(config, '$.max_pages') AS BIGINT) AS max_pages, "
    "CAST(json_extract_string(config, '$.max_retries') AS INT) AS max_retries FROM jobs WHERE config IS NOT NULL"
)
def job_settings(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "jobs").where("config IS NOT NULL")
    parsed = F.from_json("config", "base_delay double, max_pages bigint, max_retries int")
    return rows.select("job_id", parsed.alias("c")).select("job_id", "c.base_delay", "c.max_pages", "c.max_retries")


@register("SELECT source_url, target_url FROM links EXCEPT ALL SELECT DISTINCT source_url, target_url FROM links")
def repeated_links(spark: SparkSession, folder: str) -> DataFrame:
    pairs = table(spark, folder, "links").select("source_url", "target_url")
    return pairs.exceptAll(pairs.distinct())


@register(
    "SELECT o_orderpriority, percentile_disc(0.5) WITHIN GROUP (ORDER BY o_totalprice) AS median_price, CAST(ntile_4 AS INT) AS quarter FROM "
    "(SELECT o_orderpriority, o_totalprice, ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS ntile_4 FROM orders) GROUP BY ALL"
)
def median_by_quarter(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql.window import Window

    quarters = F.ntile(4).over(Window.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey"))
    rows = table(spark, folder, "orders").select("o_orderpriority", "o_totalprice", quarters.alias("quarter"))
    median = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY o_totalprice)")
    return rows.groupBy("o_orderpriority", "quarter").agg(median.alias("median_price"))


@register("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def orders_without_returns(spark: SparkSession, folder: str) -> DataFrame:
    returned = table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, folder, "orders").select("o_orderkey", "o_custkey").join(returned, "o_orderkey", "left_anti")


# ---- Streaming ----


@register(
    "WITH w AS (SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT * FROM w WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"
)
def stream_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    from quern.streaming import streams

    return _streamed(spark, folder, lambda s: streams.tumbling_counts(s, "ts", ["event_type"]))


@register(
    """WITH o AS (SELECT user_id, ts, ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM g GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"""
)
def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    from quern.streaming import streams

    return _streamed(spark, folder, lambda s: streams.session_counts(s, "ts", ["user_id"]))


@register("SELECT DISTINCT event_id FROM events")
def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from quern.streaming import streams

    return _streamed(spark, folder, lambda s: streams.deduplicated(s, "ts", ["event_id"]).select("event_id"))


def _streamed(spark: SparkSession, folder: str, build) -> DataFrame:
    """The stream over the events, written to the shared folder and read back as a table."""
    import uuid

    from quern.session import shared_folder
    from quern.streaming import streams

    schema = table(spark, folder, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder).withColumn(
        "ts",
        F.col("ts").cast("timestamp"),
    )
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    return streams.drain_to(build(source), f"{place}/out", f"{place}/checkpoint")
