"""The URL frontier: queues as tables, moves as joins, and breadth-first expansion over a link table."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern import vocab
from quern.session import cut

#: Layers found before the known addresses are written as one table again, so that plans of deep walks stay short.
FOLD = 16


def append_distinct(existing: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """Rows of ``new`` whose key is not in ``existing``, added to it; repeats inside ``new`` are kept."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti").select(*existing.columns))


def stage_rank(status) -> F.Column:
    chain = F.when(F.lit(False), F.lit(0))
    for name, rank in vocab.STAGE_RANK.items():
        chain = chain.when(status == name, rank)
    return chain.otherwise(0)


def keep_latest_stage(pages: DataFrame, key: str = "url", order: list[str] | None = None) -> DataFrame:
    """One row a key: that of the latest stage, the first in ``order`` among equals."""
    by = Window.partitionBy(key).orderBy(F.desc(stage_rank(F.col("status"))), *(order or []))
    return pages.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def dequeue(pending: DataFrame, order: list[str], n: int = 10) -> tuple[DataFrame, DataFrame]:
    """(head, rest) of the queue in ``order``."""
    head = pending.orderBy(*order).limit(n)
    return head, pending.join(head.select(*order), order, "left_anti")


def move(
    source: DataFrame,
    target: DataFrame,
    rows: DataFrame,
    key: str = "url",
    latest: bool = True,
    order: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(source without the rows' keys, target with the rows added); ``latest`` keeps one row a key."""
    added = keep_latest_stage(rows, key, order) if latest else rows
    return source.join(rows.select(key).distinct(), key, "left_anti"), append_distinct(target, added.select(*target.columns), key)


def queue_counts(queues: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in queues.items():
        n = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("queue"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def breadth_first(links: DataFrame, seeds: DataFrame, source: str, target: str, most_depth: int | None = None) -> DataFrame:
    """(url, depth): the least number of links from a seed to each reachable address; of all depths, or up to ``most_depth``.

    Each round joins only the newest layer and drops what is known; layers are cut, so lineage does not grow. A hot target is
    folded to one row before it meets the known table."""
    edges = cut(
        links.select(F.col(source).alias("s"), F.col(target).alias("url")).where("s IS NOT NULL AND url IS NOT NULL").distinct(),
        "edges",
    )
    known = layer = cut(
        seeds.select(F.col(seeds.columns[0]).alias("url")).where("url IS NOT NULL").distinct().withColumn("depth", F.lit(0)),
        "layer",
    )
    for depth in count(1) if most_depth is None else range(1, most_depth + 1):
        reached = edges.join(layer.select(F.col("url").alias("s")), "s").select("url").distinct()
        layer = cut(reached.join(known.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)), "layer")
        if layer.limit(1).count() == 0:
            break
        known = known.unionByName(layer)
        if depth % FOLD == 0:
            known = cut(known, "known")
    return known
