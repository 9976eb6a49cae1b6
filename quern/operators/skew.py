"""Per-key results over tables in which a few keys hold most rows.

Method (exact offset chunking): the rows are range-partitioned and sorted by key and order, so that a heavy key spreads
over many partitions; rows are counted per (partition, key); prefix sums over a key's partitions give each partition's
offset; offset plus place in the partition numbers the rows of a key exactly; equal-sized chunks of a key's numbers are
processed apart; and the ordered boundary states of a key's chunks are merged.

Nothing is ever grouped by the bare key except chunk states (rows of the key / chunk size) and (partition, key) counts.

Defined results: rows with a null key are left out; rows with equal order values keep one fixed but arbitrary order, so
only order-independent results may depend on them; an empty table gives no rows; repeated rows count as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.session import cut, small_enough

CHUNK_ROWS = 100_000


def number_rows(df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` with ``row_no``, counting from 1 within equal ``keys`` in ``order``, exact over all partitions.

    The rows are cut to disk once, so that partition numbers and places are those of one fixed layout."""
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    placed = cut(
        kept.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order).withColumn(
            "_place",
            F.monotonically_increasing_id(),
        ),
        "ranged",
    )
    placed = placed.withColumn("_pid", F.shiftright("_place", 33))
    counts = placed.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # at most one row a partition
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_pid", *keys, "_first", "_before")
    side = F.broadcast(offsets) if small_enough(offsets, 128) else offsets.hint("merge")
    return placed.join(side, ["_pid", *keys]).withColumn(
        "row_no",
        F.col("_before") + F.col("_place") - F.col("_first") + 1,
    ).drop("_pid", "_place", "_first", "_before")


def chunk_of(row_no: Column, chunk_rows: int = CHUNK_ROWS) -> Column:
    return F.floor((row_no - 1) / F.lit(chunk_rows)).cast("long")


def longest_runs(df: DataFrame, keys: list[str], order: list[str], flag: Column, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(keys, n, n_flagged, longest_run): per key the rows, the flagged rows, and the longest run of flagged rows in ``order``.

    A chunk's state is (rows, flagged, leading run, trailing run, longest run); two neighbours merge by joining the first's
    trailing run to the second's leading run."""
    numbered = number_rows(df.select(*keys, *order, F.coalesce(flag.cast("boolean"), F.lit(False)).cast("int").alias("_flag")), keys, order)
    chunked = numbered.withColumn("_chunk", chunk_of(F.col("row_no"), chunk_rows))
    inside = Window.partitionBy(*keys, "_chunk").orderBy("row_no")
    islands = chunked.withColumn("_island", F.sum(1 - F.col("_flag")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy(*keys, "_chunk", "_island").agg(F.sum("_flag").alias("_run"), F.count(F.lit(1)).alias("_rows"))
    states = runs.groupBy(*keys, "_chunk").agg(
        F.sum("_rows").alias("rows"), F.sum("_run").alias("flagged"), F.max("_run").alias("longest"),
        F.sum(F.when(F.col("_island") == 0, F.col("_run")).otherwise(0)).alias("lead"), F.max_by("_run", "_island").alias("trail"),
    )
    ordered = states.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_chunk", "rows", "flagged", "longest", "lead", "trail"))).alias("_s")
    )
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("rows", "flagged", "longest", "lead", "trail")])

    def merge(a: Column, b: Column) -> Column:
        whole_a, whole_b = a["flagged"] == a["rows"], b["flagged"] == b["rows"]
        return F.struct(
            (a["rows"] + b["rows"]).alias("rows"), (a["flagged"] + b["flagged"]).alias("flagged"),
            F.greatest(a["longest"], b["longest"], a["trail"] + b["lead"]).alias("longest"),
            F.when(whole_a, a["rows"] + b["lead"]).otherwise(a["lead"]).alias("lead"),
            F.when(whole_b, a["trail"] + b["rows"]).otherwise(b["trail"]).alias("trail"),
        )

    merged = ordered.select(*keys, F.aggregate("_s", zero, merge).alias("_m"))
    return merged.select(
        *keys,
        F.col("_m.rows").alias("n"),
        F.col("_m.flagged").alias("n_flagged"),
        F.col("_m.longest").alias("longest_run"),
    )


def stacked_keys(df: DataFrame, fields: list[str], keep: list[str]) -> DataFrame:
    """(key_field, key_value, keep...): one row for each row and field, null and empty values left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("key_field"), F.col(f).cast("string").alias("key_value")) for f in fields]))
    return df.select(pairs.alias("_k"), *keep).select("_k.key_field", "_k.key_value", *keep).where(
        F.col("key_value").isNotNull() & (F.col("key_value") != "")
    )


def key_totals(pages: DataFrame, fields: list[str], order: list[str], failed: Column, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(key_field, key_value, n, n_flagged, longest_run): rows, failures and longest run of failures of each value of each field."""
    rows = stacked_keys(pages.withColumn("_quern_failed", failed), fields, [*order, "_quern_failed"])
    return longest_runs(rows, ["key_field", "key_value"], order, F.col("_quern_failed"), chunk_rows)


def source_totals(sources: dict[str, DataFrame], fields: list[str], order: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(key_field, key_value, one count for each source): the rows of several tables by value of each field.

    Each table has the ``fields`` and an ``order`` column that tells rows of a key apart, so that a heavy key can be split."""
    stacked = None
    for name, df in sources.items():
        rows = stacked_keys(df, fields, [order]).withColumn("_source", F.lit(name))
        stacked = rows if stacked is None else stacked.unionByName(rows)
    numbered = number_rows(stacked, ["key_field", "key_value"], ["_source", order])
    counts = [F.count_if(F.col("_source") == name).alias(name) for name in sources]
    states = numbered.withColumn("_chunk", chunk_of(F.col("row_no"), chunk_rows)).groupBy("key_field", "key_value", "_chunk").agg(*counts)
    return states.groupBy("key_field", "key_value").agg(*[F.sum(name).alias(name) for name in sources])


def heavy_keys(
    pages: DataFrame,
    fields: list[str],
    order: list[str],
    failed: Column,
    share: float = 0.03,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """(key_field, key_value, n, share): the values held by at least ``share`` of all rows of ``pages``."""
    total = pages.count()
    return key_totals(pages, fields, order, failed, chunk_rows).where(F.col("n") / F.lit(max(total, 1)) >= share).select(
        "key_field",
        "key_value",
        "n",
        (F.col("n") / F.lit(max(total, 1))).alias("share"),
    )


def join_hot(big: DataFrame, small: DataFrame, on: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """Inner join of ``big`` with per-key rows ``small`` (unique on ``on``, column ``n`` the key's rows in ``big``).

    Keys with at least 1/5000 of ``total`` rows are at most 5000, a proven bound: they are broadcast, and their rows never
    shuffle. All other keys are small, and join by shuffle."""
    if how != "inner":
        raise ValueError("join_hot joins inner only")
    least = max(1, total // 5000)
    hot, cold = small.where(F.col(n) >= least), small.where(F.col(n) < least)
    heavy = big.join(F.broadcast(hot), on)
    rest = big.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    return heavy.unionByName(rest)
