"""Problem 6: groups of texts that share most of their word sequences.

Method: adaptive multi-match prefixes. Texts become sets of hashed word shingles; equal sets are collapsed first, so copies
are never compared. A sketch counts in how many texts each shingle occurs, orders shingles from rare to common, and tells each
document what its own prefix would cost: the texts that its prefix shingles are expected to meet. Two sets of similarity t share
l of their |s| - ceil(t|s|) + l rarest shingles, for any l; so each document's prefix is lengthened with its cost, by a shingle for every doubling,
and a pair needs the smaller l of the two in common before it is verified (``MOST_NEEDED`` at most). This misses no pair.
A document whose prefix would meet more than ``PREFIX_COST`` texts even so, of any size, has signatures of its whole set: each takes the
least shingle of the set under a hash function of its own, lengthened by the least under further ones until the texts it is expected to
meet are ``COST`` at most (or it holds ``most_required`` shingles, which grow with the logarithm of the corpus), and a pair of two such
documents must share ``MATCHES`` signatures. The number of signatures follows from the similarity: two sets of similarity t share fewer than that with
probability at most ``MISS``. A pair of a cheap and a costly document is found by the cheap one's prefix, of which the costly one emits
what some cheap document holds. Candidates are verified exactly.

Cost: signatures travel as packed arrays, one per hash range and batch; a range has a partition of its own and holds about
``RANGE_ROWS`` signatures, and its pairs are passed on as they come. A signature shared by more than ``HOT`` texts, and a class of
more than ``HOT`` copies, is cut into blocks, whose pairs are expanded by separate tasks. The sketch has a byte for each of 2^21 to 2^25 cells,
by the number of texts; it is folded in rounds, and nothing else is sent to the driver.

Defined results: null texts and texts of fewer than ``min_words`` words (or than one shingle) take part in no pair and are a
class of their own in ``duplicate_classes``; equal sets have similarity 1; a repeated id is taken once, with one of its texts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.leakage import WordIds, window_hashes, words
from quern.operators.skew import join_hot, number_rows
from quern.session import cut, join_small

SHINGLE, THRESHOLD = 5, 0.8
MISS = 1e-6
MATCHES = 3
#: Texts that a document's prefix may be expected to meet; those up to which one shared shingle suffices; most that are needed.
PREFIX_COST, FREE, MOST_NEEDED = 256, 4, 8
#: Texts that a signature of the whole set may be expected to meet, of a random choice of shingles. Those of one sentence go together, so
#: signatures meet more than that.
COST = 1 / 32
#: A candidate's matches add up to this; it is divisible by every number of matches needed.
WHOLE = 840
CHUNK = 1 << 16
FAN_IN = 64
RANGE_ROWS = 1_000_000
HOT = 1_000
PAIRS = 1_000_000
_U = np.uint64
_ROW = np.dtype([("sig", "<u8"), ("id", "<i8"), ("n", "<i4"), ("level", "u1"), ("need", "u1"), ("seeks", "u1")])
#: Number of texts by sketch byte: an eighth of a doubling a step.
_TEXTS = 2.0 ** (np.arange(256) / 8)


def shingle_set(ids: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all sequences of ``n`` words."""
    return np.unique(window_hashes(ids, "1" * n))


def shingle_table(docs: DataFrame, doc_id: str, text: str, shingle: int, min_words: int) -> DataFrame:
    """(id, n, form, shingles): the sets as packed 64-bit values; ``form`` identifies the set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordIds()
        for pdf in batches:
            out = []
            for i, t in zip(pdf["id"], pdf["text"]):
                ws = words(t)
                if len(ws) >= max(min_words, shingle):
                    s = shingle_set(hasher(ws), shingle)
                    data = s.astype("<u8").tobytes()
                    out.append((i, len(s), xxhash.xxh3_128_hexdigest(data), data))
            yield pd.DataFrame(out, columns=["id", "n", "form", "shingles"])

    picked = docs.select(
        F.col(doc_id).cast("long").alias("id"),
        F.col(text).alias("text"),
    ).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    return picked.mapInPandas(run, "id long, n int, form string, shingles binary")


def sketch_cells(n_sets: int) -> int:
    return 1 << min(25, max(21, (16 * max(n_sets, 1)).bit_length()))


def _cell(s: np.ndarray, cells: int) -> np.ndarray:
    return (s & _U(cells - 1)).astype(np.int64)


def _packed_cells(cell: np.ndarray, count: np.ndarray) -> bytes:
    """The cells of a chunk that hold anything, and their counts: what a part writes follows its rows, not the size of the sketch."""
    return zlib.compress(cell.astype("<u2").tobytes() + count.astype("<i4").tobytes(), 1)


def _unpacked_cells(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(bytes(data))
    n = len(raw) // 6
    return np.frombuffer(raw, "<u2", n).astype(np.int64), np.frombuffer(raw, "<i4", n, 2 * n)


def cell_counts(sets: DataFrame, cells: int, pick=None) -> np.ndarray:
    """A byte for each cell: in how many sets its shingles occur (of those that ``pick`` takes from a set), on the scale of
    ``_TEXTS``, never too low; 0 for one set or none. Folded in rounds of ``FAN_IN`` partitions."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, part = np.zeros(cells, np.int32), 0
        for pdf in batches:
            if len(pdf):
                part = int(pdf["part"].iloc[0])
                held = [np.frombuffer(x, "<u8") for x in pdf["shingles"]]
                held = held if pick is None else [pick(x) for x in held]
                np.add.at(counts, _cell(np.concatenate(held), cells), 1)
        at = np.flatnonzero(counts)
        ends = np.searchsorted(at, np.arange(cells // CHUNK + 1) * CHUNK)
        for c in np.flatnonzero(np.diff(ends)):
            some = at[ends[c] : ends[c + 1]]
            yield pd.DataFrame({"chunk": [c], "part": [part], "counts": [_packed_cells(some - c * CHUNK, counts[some])]})

    def total(key, pdf):
        summed = np.zeros(CHUNK, np.int64)
        for b in pdf["counts"]:
            cell, count = _unpacked_cells(b)
            summed[cell] += count
        at = np.flatnonzero(summed)
        return pd.DataFrame({"chunk": [int(key[0])], "part": [int(key[1])], "counts": [_packed_cells(at, np.minimum(summed[at], 2**31 - 1))]})

    schema = "chunk int, part int, counts binary"
    merged = cut(sets.select("shingles", F.spark_partition_id().alias("part")).mapInPandas(partial, schema), "p6-cells")
    most = (merged.agg(F.max("part").alias("m")).first()["m"] or 0) + 1
    while most > FAN_IN:
        merged = cut(merged.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("chunk", "part").applyInPandas(total, schema), "p6-cells")
        most = -(-most // FAN_IN)
    merged = merged.withColumn("part", F.lit(0)).groupBy("chunk", "part").applyInPandas(total, schema)
    out = np.zeros(cells, np.uint8)
    for r in merged.toLocalIterator():  # cells / CHUNK rows, of a fixed size in all
        cell, count = _unpacked_cells(r["counts"])
        out[r["chunk"] * CHUNK + cell] = np.minimum(255, np.ceil(8 * np.log2(count)))
    return out


def most_required(n_sets: int) -> int:
    """The most shingles a signature is lengthened to: one more for every 11 times as many texts, so that those a signature of common
    shingles meets do not grow as the corpus does."""
    return max(4, math.ceil(2 * math.log2(max(n_sets, 1)) / 7))


@lru_cache(maxsize=256)
def signatures_needed(t: float, required: int) -> int:
    """The least number of signatures of ``required`` shingles of which two sets of similarity t share fewer than ``MATCHES`` with
    probability at most ``MISS``; two sets agree on the least shingle under a hash function with the probability t."""
    p, m = t**required, MATCHES
    while sum(math.comb(m, i) * p**i * (1 - p) ** (m - i) for i in range(MATCHES)) > MISS:
        m += 1
    return m


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9FB21C651E98DF25)
    return x ^ (x >> _U(28))


class Prefix:
    """A document's prefix: its shingles from rare to common, the level from which each belongs to it, its cost and its need."""

    def __init__(self, s: np.ndarray, held: np.ndarray, t: float) -> None:
        n = len(s)
        base = n - math.ceil(t * n - 1e-9) + 1
        most = min(MOST_NEEDED, n - base + 1)
        self.order = np.lexsort((s, held))[: base + most - 1]
        counts = held[self.order]
        self.cost = float((_TEXTS[counts[:base]] - 1).sum())
        self.need = min(most, 1 + int(math.log2(1 + self.cost / FREE)))
        self.level = np.maximum(1, np.arange(len(self.order)) - base + 2)
        self.shared = counts > 0
        #: Whether the document looks for its partners by its prefix: it is cheap.
        self.seeks = self.cost <= PREFIX_COST
        #: Whether partners may know it as costly: it emits signatures of its whole set.
        self.grouped = not self.seeks
        self.most = most


def prefix_rows(p: Prefix, s: np.ndarray, cells: np.ndarray | None = None) -> np.ndarray:
    """Rows of the prefix: for a seeking document up to its need, for others all that a seeking one holds (``cells``)."""
    need = p.need if p.seeks else p.most
    take = p.shared & (p.level <= need)
    if not p.seeks:
        take &= cells[_cell(s[p.order], len(cells))] > 0
    rows = np.zeros(int(take.sum()), _ROW)
    rows["sig"] = _mixed(s[p.order][take] ^ _U(0x5851F42D4C957F2D)) | _U(1)
    rows["level"], rows["need"], rows["seeks"] = p.level[take], need, p.seeks
    return rows


@lru_cache(maxsize=16)
def _multipliers(n: int) -> np.ndarray:
    """Odd factors, one for each hash function: ``y * factor`` of 32 bits orders shingles at random."""
    return (_mixed(_mixed(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))) >> _U(32)).astype(np.uint32) | np.uint32(1)


def _least(y: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The place of the least of ``y`` under each hash function."""
    out, step = np.empty(len(factors), np.int64), max(1, CHUNK // len(y))
    for i in range(0, len(factors), step):
        out[i : i + step] = (y * factors[i : i + step, None]).argmin(axis=1)
    return out


def group_rows(s: np.ndarray, held: np.ndarray, n_sets: int, t: float) -> np.ndarray:
    """Rows of the signatures of a whole set; each depends only on the shingles it takes, so two sets that agree on them act alike."""
    required = most_required(n_sets)
    m = signatures_needed(t, required)
    factors = _multipliers(m * required).reshape(required, m)
    y = (_mixed(s) >> _U(32)).astype(np.uint32)
    # Expected partners of a signature, in logarithms: the texts, times each shingle's share of them.
    share, limit = held / 8 - math.log2(max(n_sets, 1)), math.log2(COST) - math.log2(max(n_sets, 1))
    sig, met, rare = np.arange(1, m + 1, dtype=np.uint64) * _U(0xD6E8FEB86659FD93), np.zeros(m), np.full(m, 255, np.uint8)
    less = np.arange(m)
    for factor in factors:
        at = _least(y, factor[less])
        sig[less] = _mixed(sig[less] ^ s[at]) * _U(0x9E3779B97F4A7C15)
        rare[less] = np.minimum(rare[less], held[at])
        met[less] += share[at]
        less = less[met[less] > limit]
        if not len(less):
            break
    sig = sig[rare > 0] & ~_U(1)
    rows = np.zeros(len(sig), _ROW)
    rows["sig"], rows["need"], rows["seeks"] = sig, MATCHES, 1
    return rows


def signatures(s: np.ndarray, counts: np.ndarray, cells: np.ndarray, n_sets: int, t: float) -> np.ndarray:
    held = counts[_cell(s, len(counts))]
    p = Prefix(s, held, t)
    rows = prefix_rows(p, s, cells)
    return rows if not p.grouped else np.concatenate([rows, group_rows(s, held, n_sets, t)])


def _pairs_of(rows: np.ndarray, t: float, hot: list | None) -> Iterator[np.ndarray]:
    """(a, b, weight), a < b, of rows sorted by signature, seeking ones first, that share one, and whose sizes allow similarity t."""
    sig = rows["sig"]
    starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    sizes = np.diff(np.append(starts, len(rows)))
    seeking = np.add.reduceat(rows["seeks"].astype(np.int64), starts) if len(rows) else sizes
    many = (sizes > 1) & (seeking > 0)
    for k, c in np.unique(np.stack([sizes[many], seeking[many]], axis=1), axis=0) if many.any() else ():
        at = starts[many & (sizes == k) & (seeking == c)]
        if hot is not None and k > HOT:
            hot.extend(rows[a : a + k] for a in at)
            continue
        i, j = np.triu_indices(k, 1)
        i, j = i[i < c], j[i < c]
        step = max(1, PAIRS // len(i))
        for first in range(0, len(at), step):
            yield _fitting(rows[(at[first : first + step, None] + i).ravel()], rows[(at[first : first + step, None] + j).ravel()], t)


def _fitting(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    need = np.minimum(a["need"], b["need"])
    fits = (np.minimum(a["n"], b["n"]) >= t * np.maximum(a["n"], b["n"]) - 1e-9) & (a["id"] != b["id"])
    fits &= (np.maximum(a["level"], b["level"]) <= need) & ((a["seeks"] | b["seeks"]) > 0)
    a, b = a[fits], b[fits]
    return np.stack([np.minimum(a["id"], b["id"]), np.maximum(a["id"], b["id"]), WHOLE // need[fits].astype(np.int64)], axis=1)


def _frame(pairs: list[np.ndarray]) -> pd.DataFrame:
    """Pairs with their summed weights, beside empty columns for blocks of hot signatures."""
    p = np.concatenate(pairs) if pairs else np.zeros((0, 3), np.int64)
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    first = np.flatnonzero(np.concatenate([[True], (p[1:, :2] != p[:-1, :2]).any(axis=1)])) if len(p) else np.zeros(0, np.int64)
    w = np.add.reduceat(p[:, 2], first) if len(p) else np.zeros(0, np.int64)
    none = pd.array([None] * len(first), dtype="Int64")
    return pd.DataFrame({"a": p[first, 0], "b": p[first, 1], "w": w, "sig": none, "block": none, "rows": [None] * len(first)})


def candidate_pairs(sets: DataFrame, n_sets: int, t: float) -> DataFrame:
    """(a, b), a < b: pairs that share as many prefix shingles as the cheaper of the two needs, or ``MATCHES`` signatures."""
    spark = sets.sparkSession
    cells = sketch_cells(n_sets)
    counts = spark.sparkContext.broadcast(cell_counts(sets, cells))  # at most 32 MB

    def of_seeking(s: np.ndarray) -> np.ndarray:
        p = Prefix(s, counts.value[_cell(s, cells)], t)
        # Twice, so that one seeking document already tells a cell from an empty one.
        return np.repeat(s[p.order][p.shared & (p.level <= p.need)], 2) if p.seeks else s[:0]

    sought = spark.sparkContext.broadcast(np.packbits(cell_counts(sets, cells, of_seeking) > 0))
    ranges = max(1, math.ceil(n_sets * 200 / RANGE_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    most = RANGE_ROWS

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, wanted = counts.value, np.unpackbits(sought.value)
        held: list[np.ndarray] = []

        def packed() -> pd.DataFrame:
            rows = np.concatenate(held)
            held.clear()
            r = ((rows["sig"] >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)
            order = np.argsort(r, kind="stable")
            found, first = np.unique(r[order], return_index=True)
            return pd.DataFrame({"range": found, "rows": [x.tobytes() for x in np.split(rows[order], first[1:])]})

        size = 0
        for pdf in batches:
            for i, data in zip(pdf["id"], pdf["shingles"]):
                s = np.frombuffer(data, "<u8")
                rows = signatures(s, known, wanted, n_sets, t)
                rows["id"], rows["n"] = i, len(s)
                held.append(rows)
                size += len(rows)
                if size >= most:
                    yield packed()
                    size = 0
        if size:
            yield packed()

    def matched_range(parts: list[bytes]) -> Iterator[pd.DataFrame]:
        rows = np.frombuffer(b"".join(parts), _ROW)
        rows = rows[np.lexsort((1 - rows["seeks"], rows["sig"]))]
        hot: list[np.ndarray] = []
        held, size = [], 0
        for pairs in _pairs_of(rows, t, hot):
            held.append(pairs)
            size += len(pairs)
            if size >= PAIRS:
                yield _frame(held)
                held, size = [], 0
        yield _frame(held)
        for g in hot:
            for b in range(0, len(g), HOT):
                yield pd.DataFrame({"a": [None], "b": [None], "w": [None], "sig": [int(g["sig"][:1].view("<i8")[0])], "block": [b // HOT], "rows": [g[b : b + HOT].tobytes()]})

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The ranges of a partition, one after another; its rows come sorted by range."""
        at, parts = None, []
        for pdf in batches:
            for r, data in zip(pdf["range"], pdf["rows"]):
                if r != at and parts:
                    yield from matched_range(parts)
                    parts = []
                at = r
                parts.append(data)
        if parts:
            yield from matched_range(parts)

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x, y, same in zip(pdf["x"], pdf["y"], pdf["same"]):
                a, b = np.frombuffer(x, _ROW), np.frombuffer(y, _ROW)
                i, j = np.triu_indices(len(a), 1) if same else (g.ravel() for g in np.indices((len(a), len(b))))
                p = _fitting(a[i], b[j], t)
                yield pd.DataFrame({"a": p[:, 0], "b": p[:, 1], "w": p[:, 2]})

    emitted = sets.select("id", "shingles").mapInPandas(emit, "range long, rows binary")
    matched = cut(
        emitted.repartitionById(ranges, F.col("range").cast("int")).sortWithinPartitions("range").mapInPandas(
            match, "a long, b long, w long, sig long, block long, rows binary"
        ),
        "p6-candidates",
    )
    x = matched.where(F.col("sig").isNotNull()).select("sig", F.col("block").alias("i"), F.col("rows").alias("x"))
    y = matched.where(F.col("sig").isNotNull()).select("sig", F.col("block").alias("j"), F.col("rows").alias("y"))
    blocks = x.join(y, "sig").where("i <= j").select("x", "y", (F.col("i") == F.col("j")).alias("same"))
    weighed = matched.where(F.col("sig").isNull()).select("a", "b", "w").unionByName(blocks.mapInPandas(across, "a long, b long, w long"))
    return weighed.groupBy("a", "b").agg(F.sum("w").alias("w")).where(F.col("w") >= WHOLE).select("a", "b")


def _verify(t: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for a, b, x, y in zip(pdf["a"], pdf["b"], pdf["x"], pdf["y"]):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = np.concatenate([x, y])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                j = shared / (len(x) + len(y) - shared)
                if j >= t:
                    out.append((a, b, j))
            yield pd.DataFrame(out, columns=["a", "b", "similarity"])

    return run


def similar_sets(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    min_words: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """``(pairs, members)``: pairs has (a, b, similarity) of representatives, a < b; members has (id, rep) of every text that takes part."""
    sets = cut(shingle_table(docs, doc_id, text, shingle, min_words), "p6-sets")
    if sets.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count():
        sets = cut(sets.dropDuplicates(["id"]), "p6-sets")
    reps = sets.groupBy("form").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    copied = cut(reps.where("copies > 1"), "p6-copied")
    members_of_copied = join_hot(sets.select("id", "form"), copied, ["form"], "copies", sets.count()).select("id", "rep").distinct()
    copies = cut(members_of_copied.where("id <> rep"), "p6-copies")
    single = join_small(sets, copies.select("id"), ["id"], "left_anti", row_bytes=24)
    members = join_small(
        sets.select("id"),
        copies,
        ["id"],
        "left",
        row_bytes=32,
    ).select("id", F.coalesce("rep", "id").alias("rep")).distinct()
    n = single.count()
    pairs = cut(candidate_pairs(single, n, threshold), "p6-pairs")
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    held = join_small(sets.select("id", "shingles"), wanted, ["id"], "left_semi", row_bytes=24)
    both = pairs.join(
        held.select(F.col("id").alias("a"), F.col("shingles").alias("x")),
        "a",
    ).join(held.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInPandas(_verify(threshold), "a long, b long, similarity double"), members


def copies_in_pairs(members: DataFrame) -> DataFrame:
    """(p, q), p < q: the pairs of each class of copies. A class is cut into blocks of ``HOT`` ids, and pairs of blocks are spread
    over all tasks, so that no task holds a class."""
    several = members.where("id <> rep").select("rep").distinct()
    held = join_small(members, several, ["rep"], "left_semi", row_bytes=24)
    numbered = number_rows(held, ["rep"], ["id"])
    blocks = numbered.groupBy("rep", F.floor((F.col("row_no") - 1) / HOT).alias("block")).agg(F.collect_list("id").alias("ids"))
    x, y = blocks.select("rep", F.col("block").alias("i"), F.col("ids").alias("x")), blocks.select("rep", F.col("block").alias("j"), F.col("ids").alias("y"))
    met = x.join(y, "rep").where("i <= j")
    met = met.repartition(F.col("rep"), F.col("i"), F.col("j"))
    return met.select(F.explode("x").alias("p"), "y").select("p", F.explode("y").alias("q")).where((F.col("p") < F.col("q")))


def duplicate_pairs(docs: DataFrame, **options) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of texts at least ``threshold`` alike, copies included."""
    pairs, members = similar_sets(docs, **options)
    members = cut(members, "p6-members")
    left = members.select(F.col("id").alias("p"), F.col("rep").alias("a"))
    right = members.select(F.col("id").alias("q"), F.col("rep").alias("b"))
    across = pairs.select("a", "b").join(left, "a").join(right, "b").select("p", "q")
    inside = copies_in_pairs(members)
    return across.unionByName(inside).select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b): smallest id reachable. Each round takes the least label around and then
    its label, and is cut; it ends when no label changes."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(
            labels.select(F.col("id").alias("b"), "label"),
            "b",
        ).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        least = labels.join(near, "id", "left").select(
            "id",
            F.col("label").alias("old"),
            F.least("label", F.coalesce("near", "label")).alias("new"),
        )
        jumped = least.join(
            labels.select(F.col("id").alias("new"), F.col("label").alias("jump")),
            "new",
            "left",
        ).select("id", "old", F.least("new", F.coalesce("jump", "new")).alias("label"))
        done = cut(jumped, "labels")
        labels = done.select("id", "label")
        if done.where("old <> label").limit(1).count() == 0:
            return labels.withColumnRenamed("label", "component")


def duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """(id, class_id, links): one row for each text with an id; ``links`` counts the representatives that its own is similar to."""
    pairs, members = similar_sets(docs, doc_id=doc_id, **options)
    pairs = cut(pairs, "p6-links")
    links = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    classes = components(pairs).withColumnRenamed("id", "rep")
    ids = docs.select(F.col(doc_id).cast("long").alias("id")).where("id IS NOT NULL").distinct()
    known = ids.join(members, "id", "left").withColumn("rep", F.coalesce("rep", "id"))
    return known.join(classes, "rep", "left").join(links, "rep", "left").select(
        "id",
        F.coalesce("component", "rep").alias("class_id"),
        F.coalesce("links", F.lit(0)).alias("links"),
    )
