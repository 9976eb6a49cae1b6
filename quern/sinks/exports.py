"""Exports of pages, contacts, metrics and summaries."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import urls

# ---- Fixed values: the columns of the pages report, in order. ----
PAGE_COLUMNS = [
    "url", "status", "status_code", "content_type", "content_length", "title", "domain", "subdomain", "path", "discovered_at", "fetched_at", "processed_at", "analyzed_at",
    "error_message", "retry_count", "internal_links_count", "external_links_count", "emails_count", "social_profiles_count", "page_type", "funding_references",
    "collaboration_indicators", "technology_transfer", "industry_connections", "extraction_method", "browser_fetched", "markdown_quality",
]
EXTRA_COLUMNS = ["page_subtype", "url_pattern", "path_depth", "academic_year", "linked_assets_count"]
# ---- End of fixed values. ----


def _iso(c: str) -> Column:
    return F.date_format(F.col(c), "yyyy-MM-dd'T'HH:mm:ssXXX")


def _size(c: Column) -> Column:
    return F.coalesce(F.when(c.isNotNull(), F.size(c)), F.lit(0))


def page_report(pages: DataFrame, extra: bool = False, empty: bool = False) -> DataFrame:
    """The flat report of pages; ``extra`` adds the wider columns, ``empty`` writes nulls as empty text."""
    a = F.col("analysis_results")
    handles = F.aggregate(
        F.coalesce(F.map_values("social_media"), F.array().cast("array<array<string>>")),
        F.lit(0),
        lambda n, v: n + F.size(v),
    )
    derived = {
        "domain": urls.authority(F.col("url")),
        "subdomain": urls.subdomain_label(F.col("url")),
        "path": urls.path(F.col("url")),
        **{c: _iso(c) for c in ("discovered_at", "fetched_at", "processed_at", "analyzed_at")},
        "internal_links_count": _size(F.col("internal_links")),
        "external_links_count": _size(F.col("external_links")),
        "emails_count": _size(F.col("emails")),
        "social_profiles_count": handles,
        "page_type": F.coalesce(a["page_type"], F.lit("")),
        **{
            i: F.coalesce(a["content_indicators"][i], F.lit(0)) for i in (
                "funding_references",
                "collaboration_indicators",
                "technology_transfer",
                "industry_connections",
            )
        },
        "extraction_method": F.coalesce("extraction_method", F.lit("unknown")),
        "browser_fetched": F.when(F.col("browser_fetched"), "yes").otherwise("no"),
        "markdown_quality": F.coalesce(F.format_string("%.2f", "markdown_quality_score"), F.lit("")).alias("q"),
        "page_subtype": a["page_subtype"],
        "url_pattern": a["url_structure"]["url_pattern"],
        "path_depth": a["url_structure"]["path_depth"],
        "academic_year": a["url_structure"]["academic_year"],
        "linked_assets_count": a["linked_assets_count"],
    }
    derived["markdown_quality"] = F.when(F.col("markdown_quality_score").isNull(), "").otherwise(
        F.format_string("%.2f", "markdown_quality_score")
    )
    names = PAGE_COLUMNS + (EXTRA_COLUMNS if extra else [])
    out = pages.select(*[derived.get(c, F.col(c)).alias(c) for c in names])
    return out.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names]) if empty else out


def contact_rows(pages: DataFrame) -> DataFrame:
    """(source_url, contact_type, contact_value, subdomain, page_title, discovered_at): a row for each e-mail, then for each handle."""
    common = [
        F.col("url").alias("source_url"),
        urls.subdomain_label(F.col("url")).alias("subdomain"),
        F.col("title").alias("page_title"),
        F.col("processed_at").alias("discovered_at"),
    ]
    order = ["source_url", "contact_type", "contact_value", "subdomain", "page_title", "discovered_at"]
    mails = pages.select(*common, F.lit("email").alias("contact_type"), F.explode("emails").alias("contact_value"))
    social = pages.select(
        *common,
        F.explode("social_media").alias("contact_type", "_l"),
    ).select("*", F.explode("_l").alias("contact_value")).drop("_l")
    return mails.select(*order).unionByName(social.select(*order))


def write(df: DataFrame, path: str, kind: str, mode: str = "overwrite") -> None:
    """``csv`` with a header, ``json`` lines, ``parquet`` or ``orc``."""
    writer = df.write.mode(mode)
    writer = writer.option("header", True).option("escape", '"') if kind == "csv" else writer
    getattr(writer, {"csv": "csv", "json": "json", "parquet": "parquet", "orc": "orc"}[kind])(path)


def page_documents(pages: DataFrame) -> DataFrame:
    """(value): each page as one JSON document."""
    return pages.select(F.to_json(F.struct("*")).alias("value"))


def documents(df: DataFrame, **constants: str) -> DataFrame:
    """(value): each row of a rollup as one JSON document, with constant fields (a job, a time) added."""
    return df.select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in constants.items()], *df.columns)).alias("value"))


def contact_elements(pages: DataFrame, job: str) -> DataFrame:
    """(url, title, emails, social_media): the pages of a job that have contacts."""
    has = (_size(F.col("emails")) > 0) | (F.coalesce(F.size(F.map_keys("social_media")), F.lit(0)) > 0)
    return pages.where((F.col("job_id") == job) & has).select("url", "title", "emails", "social_media")


def contact_document(pages: DataFrame, job: str, at: datetime | None = None, most: int = 100_000) -> DataFrame:
    """(job_id, exported_at, total, contacts): the pages of a job that have contacts as one document. One row holds them all, so
    beyond ``most`` it is refused: write ``contact_elements`` then, a line each."""
    found = contact_elements(pages, job)
    if found.limit(most + 1).count() > most:
        raise ValueError("too many contacts for one document; write contact_elements")
    return found.agg(
        F.count(F.lit(1)).alias("total"),
        F.array_sort(F.collect_list(F.struct("url", "title", "emails", F.map_entries("social_media").alias("social_media")))).alias("contacts"),
    ).select(F.lit(job).alias("job_id"), F.lit(at).cast("timestamp").alias("exported_at"), "total", "contacts")


def file_name(job_id: str, kind: str, ext: str) -> str:
    """``job_{domain}_{time}`` gives ``{domain}-{kind}-{time}.{ext}``; other ids ``{id}_{kind}.{ext}``."""
    m = re.match(r"^job_(.*)_([^_]*)$", job_id)
    return f"{m.group(1)}-{kind}-{m.group(2)}.{ext}" if m else f"{job_id}_{kind}.{ext}"


def file_name_column(job_id: Column, kind: str, ext: str) -> Column:
    p = r"^job_(.*)_([^_]*)$"
    named = F.concat(F.regexp_extract(job_id, p, 1), F.lit(f"-{kind}-"), F.regexp_extract(job_id, p, 2), F.lit(f".{ext}"))
    return F.when(job_id.rlike(p), named).otherwise(F.concat(job_id, F.lit(f"_{kind}.{ext}")))


def retained(files: DataFrame, by: list[str], at: str, key: str, keep: int = 5) -> DataFrame:
    """``files`` with ``keep``: whether the file is among the newest of its group."""
    return files.withColumn("keep", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(at), key)) <= keep)


def stamp(at: datetime) -> str:
    return at.strftime("%Y%m%d_%H%M%S")
