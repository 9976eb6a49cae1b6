"""Short ranked reports. Ties are broken by a key, so results are repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranked(rows: DataFrame, score: Column, key: str, k: int, least: float = 0) -> DataFrame:
    """The ``k`` rows of highest ``score`` above ``least``."""
    return rows.withColumn("score", score).where(F.col("score") > least).orderBy(F.desc("score"), key).limit(k)


def contact_rich(pages: DataFrame, key: str = "page_id", k: int = 10) -> DataFrame:
    return ranked(pages, F.col("n_emails"), key, k)


def indicator_rich(pages: DataFrame, indicators: list[str], key: str = "page_id", k: int = 15) -> DataFrame:
    return ranked(pages, sum((F.col(i) for i in indicators[1:]), F.col(indicators[0])), key, k)


def sample_of_type(pages: DataFrame, kind: str, key: str = "page_id", k: int = 5) -> DataFrame:
    return pages.where(F.col("page_type") == kind.lower()).orderBy(key).limit(k)
