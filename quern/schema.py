"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

_SIMPLE = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "strings": T.ArrayType(T.StringType()),
}


def _struct(text: str, **types: T.DataType) -> T.StructType:
    """Fields from ``name type, ...``; other types are given by name."""
    known = _SIMPLE | types
    return T.StructType([T.StructField(name, known[kind]) for name, kind in (f.split() for f in text.split(","))])


ANALYSIS = _struct(
    "page_type string, page_subtype string, emails_found int, social_profiles_found int, content_indicators indicators, url_structure structure, linked_assets_count int, asset_breakdown counts, semantic_indicators semantic",
    indicators=_struct("funding_references int, collaboration_indicators int, technology_transfer int, industry_connections int"),
    structure=_struct("path_depth int, url_pattern string, academic_year string, file_extension string"),
    counts=T.MapType(T.StringType(), T.IntegerType()),
    semantic=_struct("academic_focus int, research_methods int, academic_levels int, institutional_roles int, academic_activities int"),
)
PAGE = _struct(
    "url string, job_id string, status string, discovered_at timestamp, fetched_at timestamp, processed_at timestamp, analyzed_at timestamp, status_code int, content_type string, content_length bigint, " "html_content string, title string, clean_content string, markdown_content string, extraction_method string, browser_fetched boolean, cleaned_html string, crawl4ai_markdown string, markdown_quality_score double, " "internal_links strings, external_links strings, emails strings, social_media handles, analysis_results analysis, error_message string, retry_count int, max_retries int",
    handles=T.MapType(T.StringType(), T.ArrayType(T.StringType())),
    analysis=ANALYSIS,
)
LINK = _struct("source_url string, target_url string, job_id string, anchor_text string, is_internal boolean, discovered_at timestamp")
CONTACT = _struct("job_id string, source_url string, contact_type string, value string, context string, discovered_at timestamp")
JOB = _struct(
    "job_id string, domain string, status string, created_at timestamp, started_at timestamp, completed_at timestamp, config string, total_pages bigint, processed_pages bigint, failed_pages bigint, subdomains_found int"
)
FETCH = _struct(
    "url string, final_url string, status_code int, content_type string, content_length bigint, body string, headers map, seconds double, error string, fetched_at timestamp, browser_fetched boolean, cleaned_html string, rendered_markdown string",
    map=T.MapType(T.StringType(), T.StringType()),
)
