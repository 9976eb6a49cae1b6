"""Rollups over pages: sites, subdomains, qualities, statuses. All fold by partial aggregation; distinct sets are counted, not collected, where only counts are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.urls import content_class


CLASSES = ("html", "pdf", "image", "css", "javascript", "other")


def share(n: Column, of: Column) -> Column:
    return F.when(of > 0, n * 100.0 / of).otherwise(0.0)


def site_metrics(pages: DataFrame, by: str = "job_id") -> DataFrame:
    """Per site: pages by content class, link totals, distinct external hosts and subdomains, per-page sums of e-mails and handles.

    Needs columns content_class, internal, external, external_hosts, subdomain, n_emails, n_handles. One pass: a page's further
    external hosts become rows that count for nothing else."""
    wanted = [by, "content_class", "internal", "external", "subdomain", "n_emails", "n_handles"]
    rows = pages.select(*wanted, F.posexplode_outer("external_hosts").alias("_at", "_host"))
    first = F.coalesce("_at", F.lit(0)) == 0
    once = lambda c: F.sum(F.when(first, F.col(c)))
    return rows.groupBy(by).agg(
        F.count_if(first).alias("total_pages"),
        *[F.count_if(first & (F.col("content_class") == c)).alias(f"{c}_pages") for c in CLASSES],
        once("internal").alias("internal_links"),
        once("external").alias("external_links"),
        once("n_emails").alias("emails_found"),
        once("n_handles").alias("social_profiles_found"),
        F.count_distinct("subdomain").alias("subdomains"),
        F.count_distinct("_host").alias("unique_external_domains"),
    )


def subdomain_metrics(pages: DataFrame, by: list[str]) -> DataFrame:
    """Per subdomain: pages, pages with text, pages by content class, distinct e-mails and distinct (platform, handle) pairs. Needs
    emails, social, clean_content, content_class."""
    base = pages.groupBy(*by).agg(
        F.count(F.lit(1)).alias("page_count"),
        F.count("clean_content").alias("pages_with_text"),
        *[F.count_if(F.col("content_class") == c).alias(f"{c}_pages") for c in CLASSES],
    )
    mails = pages.select(*by, F.explode("emails").alias("_e")).groupBy(*by).agg(F.count_distinct("_e").alias("emails"))
    handles = pages.select(*by, F.explode("social").alias("_p", "_l")).select(*by, "_p", F.explode("_l").alias("_h")).groupBy(*by).agg(
        F.count_distinct("_p", "_h").alias("handles")
    )
    return base.join(mails, by, "left").join(handles, by, "left").fillna(0, ["emails", "handles"])


def page_links(pages: DataFrame, by: list[str], url: str = "url", links: str = "internal_links", at: str = "processed_at", key: str = "page_id") -> DataFrame:
    """(by, url, n_links): a page's internal links; of a page stored several times the last one counts."""
    order = F.struct(F.col(at).isNotNull(), at, key)
    return pages.groupBy(*by, url).agg(F.max_by(F.size(links).cast("long"), order).alias("n_links"))


def top_pages(pages: DataFrame, by: list[str], score: str, key: str, k: int = 10) -> DataFrame:
    """The ``k`` best pages of each group; equal scores in order of ``key``."""
    ranked = pages.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), key)))
    return ranked.where(F.col("rank") <= k)


def breakdown(rows: DataFrame, by: str) -> DataFrame:
    """(value, n, pct): counts and shares of all rows."""
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def extraction_quality(pages: DataFrame) -> DataFrame:
    """One row: browser share, mean score, share of scores of 0.7 and more."""
    n, q = F.count(F.lit(1)), F.col("markdown_quality_score")
    browser, high = F.count_if(F.col("browser_fetched")), F.count_if(q >= 0.7)
    return pages.agg(
        n.alias("total_pages"),
        browser.alias("browser_fetch_count"),
        share(browser, n).alias("browser_fetch_percentage"),
        F.coalesce(F.avg(q), F.lit(0.0)).alias("average_quality_score"),
        high.alias("high_quality_pages"),
        share(high, F.count(q)).alias("high_quality_percentage"),
    )


def method_histogram(pages: DataFrame) -> DataFrame:
    return pages.groupBy(F.coalesce("extraction_method", F.lit("unknown")).alias("method")).agg(F.count(F.lit(1)).alias("n"))


def crawl_summary(pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row a job: totals, success rate, contact totals, duration in seconds. Jobs without pages have zeros."""
    per = pages.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status").isin("fetched", "extracted", "analyzed")).alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum(F.coalesce(F.size("emails"), F.lit(0))).alias("emails"),
        F.sum(handle_count(F.col("social_media"))).alias("handles"),
        F.count_distinct(F.nullif(F.col("subdomain"), F.lit(""))).alias("subdomains"),
        *[F.count_if(content_class(F.col("content_type"), F.col("url")) == c).alias(f"{c}_pages") for c in CLASSES],
    )
    counted = ["total", "succeeded", "failed", "emails", "handles", "subdomains", *[f"{c}_pages" for c in CLASSES]]
    joined = jobs.select(
        "job_id",
        "status",
        "started_at",
        "completed_at",
    ).withColumnRenamed("status", "job_status").join(per, "job_id", "left").fillna(
        0,
        counted,
    )
    seconds = F.unix_micros("completed_at") / 1e6 - F.unix_micros("started_at") / 1e6
    return joined.select(
        "job_id",
        "job_status",
        "total",
        "succeeded",
        "failed",
        share(F.col("succeeded"), F.col("total")).alias("success_rate"),
        *counted[3:],
        seconds.alias("duration_seconds"),
    )


def handle_count(social: Column) -> Column:
    """Number of handles in a map of platform to handles."""
    return F.aggregate(F.coalesce(F.map_values(social), F.array().cast("array<array<string>>")), F.lit(0), lambda n, v: n + F.coalesce(F.size(v), F.lit(0)))


def crawl_summary_counts(pages: DataFrame, by: str = "job_id") -> DataFrame:
    """(by, kind, value, n): the summary's tables of pages by content class, by subdomain (where it has one) and by status code."""
    values = F.array(
        F.struct(F.lit("content_class").alias("kind"), content_class(F.col("content_type"), F.col("url")).alias("value")),
        F.struct(F.lit("subdomain").alias("kind"), F.nullif(F.col("subdomain"), F.lit("")).alias("value")),
        F.struct(F.lit("status_code").alias("kind"), F.col("status_code").cast("string").alias("value")),
    )
    rows = pages.where(F.col(by).isNotNull()).select(by, F.explode(values).alias("_v")).select(by, "_v.kind", "_v.value")
    return rows.where("value IS NOT NULL").groupBy(by, "kind", "value").agg(F.count(F.lit(1)).alias("n"))


def status_codes(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("status_code").isNotNull()).groupBy("status_code").agg(F.count(F.lit(1)).alias("n"))


def last_mean(rows: DataFrame, by: list[str], order: list[str], value: str, n: int = 10) -> DataFrame:
    """``rows`` with the mean of the last ``n`` values of each group."""
    return rows.withColumn("recent_mean", F.avg(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-(n - 1), 0)))


def contact_totals(pages: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    mails, social = F.count_if(F.col("n_emails") > 0), F.count_if(F.col("n_handles") > 0)
    return pages.agg(
        n.alias("analyzed"),
        F.sum("n_emails").alias("emails"),
        mails.alias("pages_with_emails"),
        share(mails, n).alias("pct_with_emails"),
        F.sum("n_handles").alias("handles"),
        social.alias("pages_with_handles"),
        share(social, n).alias("pct_with_handles"),
    )


def indicator_prevalence(pages: DataFrame, indicators: list[str]) -> DataFrame:
    return pages.agg(*[F.count_if(F.col(i) > 0).alias(i) for i in indicators])


def redirect_log(fetches: DataFrame, by: str = "job_id") -> DataFrame:
    """(by, fetched_at, url, final_url, status_code): a row for each fetch whose final address differs; no group is collected."""
    return fetches.where(F.col("url") != F.col("final_url")).select(by, "fetched_at", "url", "final_url", "status_code")


def fetch_statistics(
    fetches: DataFrame,
    limits: DataFrame,
    host: str = "host",
    at: str = "fetched_at",
    seconds: str = "seconds",
    key: str = "url",
) -> DataFrame:
    """(host, n_fetches, n_failed, recent_mean, delay, severity): the fetch log by host beside the limiter's state (host, state, severity)."""
    newest = Window.partitionBy(host).orderBy(F.desc(at), key)
    counts = fetches.groupBy(host).agg(
        F.count(F.lit(1)).alias("n_fetches"),
        F.count_if(F.coalesce(F.col("status_code"), F.lit(0)).between(1, 399) == F.lit(False)).alias("n_failed"),
    )
    recent = fetches.withColumn("_n", F.row_number().over(newest)).where("_n <= 10").groupBy(host).agg(F.avg(seconds).alias("recent_mean"))
    return counts.join(recent, host, "left").join(
        limits.select(F.col("host").alias(host), F.col("state.delay").alias("delay"), "severity"),
        host,
        "left",
    )


def analytics_summary(site: DataFrame, subdomains: DataFrame, by: str = "job_id") -> DataFrame:
    """(by, total_pages, total_subdomains, total_emails): the totals of both rollups."""
    per = subdomains.groupBy(by).agg(F.count(F.lit(1)).alias("total_subdomains"))
    return site.select(by, "total_pages", F.col("emails_found").alias("total_emails")).join(per, by, "left").fillna(0, ["total_subdomains"])
