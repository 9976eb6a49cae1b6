"""Registered queries of the subpackage; ``queries()`` and ``oracle_sql()`` are merged by ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import format_duplicates, leakage, near_duplicates, packing, pii, repeated_lines, residue, spam, wrappers
from quern.llm.oracle import SQL
from quern.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_lines.repeated_lines(table(spark, folder, "pages")).select("page_id", "line_no")


def p1_clean(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_lines.remove_repeated_lines(table(spark, folder, "pages")).where(F.col("clean_content").isNotNull()).select(
        "page_id",
        F.length("clean_content").cast("long").alias("n_chars"),
        F.col("n_removed_lines").cast("long").alias("n_removed_lines"),
        F.col("n_removed_blocks").cast("long").alias("n_removed_blocks"),
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return format_duplicates.duplicate_pairs(
        table(spark, folder, "contacts"),
        "contact_id",
        format_duplicates.canonical_contact(),
    ).select("keep_id", "copy_id")


def p3_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    return format_duplicates.collapse(
        table(spark, folder, "contacts"),
        "contact_id",
        format_duplicates.canonical_contact(),
    ).select("contact_id", "contact_type", F.col("n_copies").cast("long").alias("n_copies"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_items(leakage.leaked_passages(table(spark, folder, "documents"), table(spark, folder, "eval_items")))


def p9_substituted(spark: SparkSession, folder: str) -> DataFrame:
    found = leakage.leaked_passages(table(spark, folder, "documents"), table(spark, folder, "eval_items"), substitutions=2)
    return found.select("doc_id", "item_id", (F.col("run") - F.col("substitutions")).alias("equal_words"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue_pages(table(spark, folder, "pages")).select("page_id")


def p7_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue_pages(table(spark, folder, "pages")).groupBy("reason").agg(F.count(F.lit(1)).alias("n_pages"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam.spam_documents(table(spark, folder, "documents")).select("doc_id").distinct()


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    return spam.spam_scores(table(spark, folder, "documents"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = near_duplicates.duplicate_pairs(
        table(spark, folder, "pages"),
        doc_id="page_id",
        text="clean_content",
        shingle=3,
        threshold=0.7,
        min_words=50,
    )
    return pairs.select(F.col("id_a").alias("page_id_a"), F.col("id_b").alias("page_id_b"))


def p6_classes(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.duplicate_classes(table(spark, folder, "documents"))


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), table(spark, folder, "pack_sizes"))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(packing.pack_documents(table(spark, folder, "documents"), table(spark, folder, "pack_sizes")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return wrappers.furniture_lines(table(spark, folder, "pages"))


def p4_bodies(spark: SparkSession, folder: str) -> DataFrame:
    bodies = wrappers.main_bodies(table(spark, folder, "pages")).where(F.col("clean_content").isNotNull())
    return bodies.select(
        "page_id",
        F.length("clean_content").cast("long").alias("n_chars"),
        F.col("n_furniture_lines").cast("long").alias("n_furniture_lines"),
    )


def p4_wrappers(spark: SparkSession, folder: str) -> DataFrame:
    found = wrappers.infer_wrappers(table(spark, folder, "pages"))

    def describe(batches):
        for pdf in batches:
            held = [wrappers.Wrapper.load(w) for w in pdf["wrapper"]]
            yield pdf[["host"]].assign(n_pages=[w.pages for w in held], pattern=[w.pattern() for w in held])

    return found.mapInPandas(describe, "host string, n_pages long, pattern string")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_personal(table(spark, folder, "pages"))


def p5_redacted(spark: SparkSession, folder: str) -> DataFrame:
    held = table(spark, folder, "pages").select("page_id", "clean_content").where(F.col("clean_content").isNotNull())
    return pii.redact(held).select(
        "page_id",
        F.length("clean_content").cast("long").alias("n_chars"),
        F.col("n_redacted").cast("long").alias("n_redacted"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_clean, p3_found, p3_collapsed, p4_found, p4_bodies, p4_wrappers, p5_found, p5_redacted, p6_found, p6_classes, p7_found, p7_reasons,
        p8_packed, p8_fill, p9_found, p9_items, p9_substituted, p10_found, p10_scores,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
