"""Joins beyond equality, beyond the crawl's own needs: as-of and range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(left: DataFrame, right: DataFrame, on: list[str], at: str, value: list[str], key: str) -> DataFrame:
    """``left`` with the ``value`` columns of the latest row of ``right`` not after its ``at``: one sort of the union, no pairs."""
    l = left.select("*", *[F.lit(None).cast(right.schema[v].dataType).alias(f"_r_{v}") for v in value], F.lit(1).alias("_side"))
    r = right.select(*on, at, *[F.col(v).alias(f"_r_{v}") for v in value], F.lit(0).alias("_side"))
    both = l.unionByName(r, allowMissingColumns=True)
    before = Window.partitionBy(*on).orderBy(at, "_side", key).rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when(F.col("_side") == 0, F.struct(*[f"_r_{v}" for v in value])), ignorenulls=True).over(before)
    return both.withColumn("_found", found).where("_side = 1").select(
        *left.columns,
        *[F.col(f"_found._r_{v}").alias(f"asof_{v}") for v in value],
    )


def range_join(points: DataFrame, spans: DataFrame, point: str, start: str, end: str, width: int) -> DataFrame:
    """Pairs with start <= point < end: spans are dealt to buckets of ``width``, and joined on the bucket."""
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    dealt = spans.where(F.col(end) > F.col(start)).withColumn(
        "_b",
        F.explode(F.sequence(bucket(start), F.floor((F.col(end) - 1) / width).cast("long"))),
    )
    return points.withColumn("_b", bucket(point)).join(dealt, "_b").where(
        (F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))
    ).drop("_b")
