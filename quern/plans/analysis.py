"""The page analysis as one plan: every family of features is a projection; nothing shuffles until a rollup asks for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern import vocab
from quern.functions import classify, links, text, urls
from quern.session import join_small

INDICATORS = list(vocab.CONTENT_INDICATORS)


def with_job_domain(pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """``pages`` with ``job_domain``, the bare domain of the page's job; null for unknown jobs."""
    known = jobs.select(
        "job_id",
        urls.bare_domain(F.col("domain")).alias("job_domain"),
    ).where("job_id IS NOT NULL").dropDuplicates(["job_id"])
    return join_small(pages, known, ["job_id"], "left", row_bytes=96)


def classified(pages: DataFrame, url: str = "url", title: str = "title", clean: str = "clean_content") -> DataFrame:
    """``pages`` with type_scores, page_type and page_subtype."""
    scored = pages.withColumn(
        "_quern_text",
        classify.full_text(F.col(clean), F.col(title), F.col(url)),
    ).withColumn("type_scores", classify.type_scores(F.col(url), F.col("_quern_text")))
    typed = scored.withColumn("page_type", classify.page_type(F.col("type_scores")))
    return typed.withColumn("page_subtype", classify.page_subtype(F.col("page_type"), F.col(url), F.col("_quern_text"))).drop("_quern_text")


def analysed(pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """``pages`` with all features of the analysis as columns."""
    u, c, h = F.col("url"), F.col("clean_content"), F.col("html_content")
    out = classified(with_job_domain(pages, jobs)).withColumns(
        {
            "found_emails": text.emails(F.coalesce(c, F.lit(""))),
            "found_social": text.social_handles(F.coalesce(c, F.lit(""))),
            "indicators": text.content_indicators(c),
            "semantic": text.semantic_indicators(c),
            "structure": urls.url_structure(u),
            "links": links.link_counts(h, F.coalesce("job_domain", F.lit("?"))),
            "content_class": urls.content_class(F.col("content_type"), u),
            "relative_subdomain": urls.subdomain_relative(u, F.col("job_domain")),
        }
    )
    handles = F.aggregate(F.map_values("found_social"), F.lit(0), lambda n, v: n + F.size(v))
    return out.withColumns(
        {
            "n_emails": F.size("found_emails"),
            "n_handles": handles,
            "internal": F.col("links.internal"),
            "external": F.col("links.external"),
            "external_hosts": F.col("links.external_hosts"),
            **{i: F.col(f"indicators.{i}") for i in INDICATORS},
        }
    )


def site_rows(pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """What ``rollup.site_metrics`` needs of the analysis, and nothing else."""
    done = analysed(pages, jobs)
    return done.select(
        "job_id",
        "content_class",
        "internal",
        "external",
        "external_hosts",
        F.col("relative_subdomain").alias("subdomain"),
        "n_emails",
        "n_handles",
    )
