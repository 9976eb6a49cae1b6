"""Problem 1: lines that one site repeats over its pages.

Method: the lines of a site are nodes weighted by the number of pages they are on, and two lines that follow each other on
a page are joined by an edge weighted likewise. Nodes and edges of high support are kept, the connected components are the
site's boilerplate blocks; a single line that stands among other lines from page to page is a block of its own. On a page, a run of
neighbouring lines of one block is an occurrence of it, and occurrences are deleted whole: with the lines without letters
(rules, dates, blank lines) that stand inside. By the definition of ``p1_found`` every line of high support is a case, so
there the graph names the block of a row; in the cleaned text it also decides what else goes.

Cost: lines are reduced to 64-bit keys in the JVM, once, and written; only (site, key, page) triples are shuffled, hashed over
all three, so a site with a third of all rows is no hot spot. A kept node is on at least ``min_share`` of its site's pages, so a site has
at most ``lines per page / min_share`` kept nodes: that bounds the graph each component task sees, whatever the site's size.

Defined results: rows with a null site or text take no part and come out unchanged; an empty line, or one without letters,
is never a case; a page given twice counts once; equal lines of one page count once for support, and all are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quern.session import cut, join_small

MIN_PAGES = 6
MIN_SHARE = 0.05


def site_of(domain: Column) -> Column:
    """The host in lower case without its port."""
    return F.regexp_replace(F.lower(domain), r":\d*$", "")


def line_table(pages: DataFrame, page_id: str, site: Column, text: str) -> DataFrame:
    """(page_id, site, line_no, ord, key): one row for each line with letters. ``ord`` numbers the lines that have letters."""
    letters = F.split(F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\n]+", " "), "\n")
    numbered = F.filter(
        F.transform(letters, lambda x, i: F.struct((i + 1).cast("long").alias("line_no"), F.trim(x).alias("words"))),
        lambda x: x["words"] != "",
    )
    return (
        pages.where(F.col(text).isNotNull())
        .select(F.col(page_id).alias("page_id"), site.alias("site"), numbered.alias("_lines"))
        .where(F.col("site").isNotNull() & F.col("page_id").isNotNull())
        .select("page_id", "site", F.posexplode("_lines").alias("ord", "_line"))
        .select("page_id", "site", F.col("_line.line_no").alias("line_no"), "ord", F.xxhash64("_line.words").alias("key"))
    )


def frequent_lines(lines: DataFrame, pages_per_site: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(site, key, support): the nodes on at least ``min_pages`` pages and ``min_share`` of the site's pages."""
    support = lines.groupBy("site", "key").agg(F.count_distinct("page_id").alias("support")).where(F.col("support") >= min_pages)
    return join_small(support, pages_per_site, ["site"]).where(
        F.col("support") / F.col("site_pages") >= min_share
    ).select("site", "key", "support", "site_pages")


def _components(site: str, nodes: list[int], edges: list[tuple[int, int]]) -> dict[int, int]:
    parent = {n: n for n in nodes}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


BLOCKS = T.StructType(
    [
        T.StructField("site", T.StringType()),
        T.StructField("key", T.LongType()),
        T.StructField("block", T.LongType()),
        T.StructField("support", T.LongType()),
    ]
)


def _blocks_of_site(pdf):
    import pandas as pd

    edges = pdf[pdf["next"].notna()]
    nodes = pdf[pdf["next"].isna()]
    found = _components(pdf["site"].iloc[0], nodes["key"].tolist(), [(int(a), int(b)) for a, b in zip(edges["key"], edges["next_exact"])])
    return pd.DataFrame({"site": nodes["site"], "key": nodes["key"], "block": nodes["key"].map(found), "support": nodes["support"]})


def repeated_blocks(
    pages: DataFrame,
    page_id: str = "page_id",
    domain: str = "domain",
    text: str = "clean_content",
    min_pages: int = MIN_PAGES,
    min_share: float = MIN_SHARE,
) -> tuple[DataFrame, DataFrame]:
    """``(blocks, occurrences)``: blocks has (site, key, block, support); occurrences has (page_id, site, line_no, ord, key) of all lines in blocks."""
    site = site_of(F.col(domain))
    lines = cut(line_table(pages, page_id, site, text), "p1-all")
    per_site = pages.where(F.col(text).isNotNull()).select(
        site.alias("site"),
        F.col(page_id).alias("page_id"),
    ).where(F.col("site").isNotNull()).groupBy("site").agg(F.count_distinct("page_id").alias("site_pages"))
    per_site = cut(per_site, "p1-sites")
    nodes = cut(frequent_lines(lines, per_site, min_pages, min_share), "p1-nodes")
    occurrences = cut(join_small(lines, nodes.select("site", "key", "site_pages"), ["site", "key"], row_bytes=96), "p1-lines")
    # Neighbours: ord + 1 of one line meets ord of the next on its page; both sides are (page, ord) keys, so no key is hot.
    after = occurrences.select("page_id", "site", (F.col("ord") - 1).alias("ord"), F.col("key").alias("next")).distinct()
    edges = (
        occurrences.select("page_id", "site", "site_pages", "ord", "key").distinct().join(after, ["page_id", "site", "ord"])
        .groupBy("site", "key", "next", "site_pages").agg(F.count_distinct("page_id").alias("support"))
        .where((F.col("support") >= min_pages) & (F.col("support") / F.col("site_pages") >= min_share))
    )
    both = nodes.select(
        "site",
        "key",
        F.lit(None).cast("double").alias("next"),
        F.lit(0).cast("long").alias("next_exact"),
        "support",
    ).unionByName(edges.select("site", "key", F.lit(1.0).alias("next"), F.col("next").alias("next_exact"), "support"))
    blocks = cut(both.groupBy("site").applyInPandas(_blocks_of_site, BLOCKS), "p1-blocks")
    return blocks, occurrences


def repeated_lines(pages: DataFrame, **options) -> DataFrame:
    """(page_id, line_no, ord, site, block, support): every occurrence of a line that belongs to a boilerplate block of its site."""
    blocks, occurrences = repeated_blocks(pages, **options)
    return join_small(
        occurrences,
        blocks,
        ["site", "key"],
        row_bytes=96,
    ).select("page_id", "line_no", "ord", "site", "block", "support").distinct()


def block_occurrences(found: DataFrame) -> DataFrame:
    """(page_id, block, first, last): the runs of neighbouring lines of one block on a page, from ``repeated_lines``."""
    along = Window.partitionBy("page_id").orderBy("ord")  # the lines of one page
    apart = (F.lag("block").over(along) != F.col("block")) | (F.lag("ord").over(along) != F.col("ord") - 1)
    runs = found.withColumn("_run", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("page_id", "_run").agg(F.min("block").alias("block"), F.min("line_no").alias("first"), F.max("line_no").alias("last")).drop("_run")


def remove_repeated_lines(
    pages: DataFrame,
    page_id: str = "page_id",
    domain: str = "domain",
    text: str = "clean_content",
    **options,
) -> DataFrame:
    """All rows and columns of ``pages``, with ``text`` freed of the occurrences of its site's blocks, and ``n_removed_lines`` and
    ``n_removed_blocks`` added."""
    found = repeated_lines(pages, page_id=page_id, domain=domain, text=text, **options)
    gone = block_occurrences(found).groupBy(F.col("page_id").alias("_quern_id")).agg(F.collect_list(F.struct("first", "last")).alias("_quern_gone"))
    kept = F.filter(
        F.split(F.col(text), "\n"), lambda x, i: ~F.exists("_quern_gone", lambda g: (i + 1).cast("long").between(g["first"], g["last"]))
    )
    out = pages.join(gone, F.col(page_id) == F.col("_quern_id"), "left")
    touched = F.col("_quern_gone").isNotNull() & F.col(domain).isNotNull() & F.col(text).isNotNull()
    lines = F.aggregate("_quern_gone", F.lit(0).cast("long"), lambda n, g: n + g["last"] - g["first"] + 1)
    return out.withColumn("_quern_cut", touched).withColumn(
        text,
        F.when(F.col("_quern_cut"), F.array_join(kept, "\n")).otherwise(F.col(text)),
    ).withColumn("n_removed_lines", F.when(F.col("_quern_cut"), lines).otherwise(0)).withColumn(
        "n_removed_blocks",
        F.when(F.col("_quern_cut"), F.size("_quern_gone")).otherwise(0),
    ).drop("_quern_id", "_quern_gone", "_quern_cut")
