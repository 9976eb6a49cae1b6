"""Problem 9: passages of held-out items inside training documents.

Method: spaced-seed hashing. A seed is a fixed mask over a window of words; positions at 0 are ignored, so a window hashes
equal in item and document although words at those positions differ. Window hashes of items and documents are joined, and
around each hit the aligned words are compared, with a number of substitutions allowed. The masks are chosen so that a passage
hits wherever its differing words stand: every placement is tried at start-up. So the result is exact with and without
substitutions; given masks that miss a placement are refused.

Cost: documents stay where they are. Items are few by nature, but that is measured: up to ``MOST_WINDOWS`` item windows are
broadcast as sorted hashes with a bit table in front; beyond that, the documents' window hashes are joined by shuffle.

Defined results: words are runs of letters and digits in lower case; null, blank or shorter texts hit nothing; an item given
twice, or a passage repeated in a document, gives one row; a text of any length is read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed masks of 12 words; each keeps 8 or 9 of them.
MASKS = ("111010010111", "110110110111", "101101101111")
#: Masks taken for substitutions, and placements of differing words tried; beyond that one mask of neighbouring words is used.
MOST_MASKS = 4
MOST_PLACEMENTS = 5_000
MOST_WINDOWS = 1_000_000
_WORD = re.compile(r"[^\W_]+")
_P = np.uint64(0x9E3779B97F4A7C15)
FOUND = "doc_id long, item_id long, doc_word long, item_word long, run long, substitutions long"


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class WordIds:
    """64-bit hashes of words, the same in every process; kept for words seen before, up to a fixed number."""

    def __init__(self, most: int = 1 << 18) -> None:
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, ws: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, ws), dtype=np.uint64, count=len(ws))
        except KeyError:
            import xxhash

            if len(known) > self.most:
                known.clear()
            for w in ws:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(known.__getitem__, ws), dtype=np.uint64, count=len(ws))


def _placements(min_run: int, substitutions: int) -> list[tuple[int, frozenset[int]]]:
    """(words, places that differ) of the shortest passages; a longer one holds one of these or one with fewer differences."""
    return [(min_run + s, frozenset(x)) for s in range(substitutions + 1) for x in combinations(range(min_run + s), s)]


def _hits(mask: str, words: int, differ: frozenset[int]) -> bool:
    kept = [i for i, keep in enumerate(mask) if keep == "1"]
    return any(not any(at + i in differ for i in kept) for at in range(words - len(mask) + 1))


def _neighbours(min_run: int, substitutions: int) -> str:
    """So many equal words stand together in every passage: its equal words lie in at most ``substitutions`` + 1 stretches."""
    return "1" * -(-min_run // (substitutions + 1))


def covers(masks: tuple[str, ...], min_run: int, substitutions: int) -> bool:
    """Whether some mask hits each passage of ``min_run`` equal words with up to ``substitutions`` others, wherever these stand."""
    least = len(_neighbours(min_run, substitutions))
    if any(len(m) <= least for m in masks):
        return True
    if sum(comb(min_run + s, s) for s in range(substitutions + 1)) > MOST_PLACEMENTS:
        return False
    return all(any(_hits(m, n, differ) for m in masks) for n, differ in _placements(min_run, substitutions))


@cache
def masks_for(min_run: int, substitutions: int) -> tuple[str, ...]:
    """Masks that miss no passage: ``MASKS`` where they do, else the heaviest few that greedy choice finds."""
    if covers(MASKS, min_run, substitutions):
        return MASKS
    plain = _neighbours(min_run, substitutions)
    if sum(comb(min_run + s, s) for s in range(substitutions + 1)) > MOST_PLACEMENTS:
        return (plain,)
    sought = _placements(min_run, substitutions)
    span = min(min_run, len(MASKS[0]))
    for weight in range(span - 1, max(len(plain), 1), -1):
        left, chosen = set(range(len(sought))), []
        reach = {}
        for size in range(weight, span + 1):
            for inner in combinations(range(1, size - 1), weight - 2):
                mask = "".join("1" if i in (0, *inner, size - 1) else "0" for i in range(size))
                reach[mask] = {i for i, x in enumerate(sought) if _hits(mask, *x)}
        while left and len(chosen) < MOST_MASKS:
            best = max(reach, key=lambda m: len(reach[m] & left))
            chosen.append(best)
            left -= reach[best]
        if not left:
            return tuple(chosen)
    return (plain,)


def window_hashes(ids: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the kept words of each window, by start."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(len(mask)))
    for i, keep in enumerate(mask):
        if keep == "1":
            h = (h ^ ids[i : i + n]) * _P
            h ^= h >> np.uint64(32)
    return h


def _longest(a: np.ndarray, b: np.ndarray, allowed: int) -> tuple[int, int, int]:
    """(start, length, substitutions) of the stretch of aligned ``a`` and ``b`` with at most ``allowed`` differences that has the most
    equal words; of equals the longest, then the first."""
    wrong = np.flatnonzero(a != b)
    edges = np.concatenate([[-1], wrong, [len(a)]])
    best = (0, 0, 0)
    for i in range(len(edges) - 1):
        j = min(i + 1 + allowed, len(edges) - 1)
        lo, hi = edges[i] + 1, edges[j]
        used = j - i - 1
        if (hi - lo - used, hi - lo) > (best[1] - best[2], best[1]):
            best = (int(lo), int(hi - lo), int(used))
    return best


class Items:
    """Word ids and window hashes of the held-out items."""

    def __init__(self, rows: list[tuple[int, str]], masks: tuple[str, ...]) -> None:
        hasher = WordIds()
        self.masks = masks
        self.item_ids = [r[0] for r in rows]
        self.words = [hasher(words(r[1])) for r in rows]
        self.tables = []
        for mask in masks:
            hs = [window_hashes(w, mask) for w in self.words]
            h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
            item = np.repeat(np.arange(len(hs)), [len(x) for x in hs])
            place = np.concatenate([np.arange(len(x)) for x in hs]) if hs else np.zeros(0, np.int64)
            order = np.argsort(h, kind="stable")
            # A table in front of the search, of a size that fits the number of windows.
            bits = np.zeros(1 << min(24, max(8, (16 * len(h)).bit_length())), bool)
            bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)] = True
            self.tables.append((h[order], item[order], place[order], bits))


def _overlaps(doc: np.ndarray, items: Items, min_run: int, allowed: int) -> dict[int, tuple[int, int, int, int]]:
    """Best overlap of each item (by its place) that reaches ``min_run`` words: (doc start, item start, length, substitutions)."""
    found: dict[int, tuple[int, int, int, int]] = {}
    tried: set[tuple[int, int]] = set()
    for mask, (hashes, item, place, bits) in zip(items.masks, items.tables):
        h = window_hashes(doc, mask)
        at = np.flatnonzero(bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)])
        if not len(at):
            continue
        lo, hi = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
        for d, a, b in zip(at[hi > lo], lo[hi > lo], hi[hi > lo]):
            for k in range(a, b):
                it, diagonal = int(item[k]), int(d - place[k])
                if (it, diagonal) in tried:
                    continue
                tried.add((it, diagonal))
                w = items.words[it]
                start, end = max(0, diagonal), min(len(doc), diagonal + len(w))
                s, n, subs = _longest(doc[start:end], w[start - diagonal : end - diagonal], allowed)
                if n - subs >= min_run and (it not in found or (n - subs, n) > (found[it][2] - found[it][3], found[it][2])):
                    found[it] = (start + s, start + s - diagonal, n, subs)
    return found


def leaked_passages(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_run: int = 12,
    substitutions: int = 0,
    masks: tuple[str, ...] | None = None,
    most_windows: int = MOST_WINDOWS,
) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, run, substitutions): one row for each document and item that share a passage of at
    least ``min_run`` equal words, apart from at most ``substitutions`` differing ones within it: the one with the most equal words."""
    masks = masks or masks_for(min_run, substitutions)
    if not covers(masks, min_run, substitutions):
        raise ValueError("the masks miss some passages of that length with so many substitutions")
    spark = docs.sparkSession
    held = items.select(
        F.col(item_id).cast("long").alias("item_id"),
        F.col(item_text).alias("text"),
    ).where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    size = (held.agg(F.sum(F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+"))).alias("n")).first()["n"] or 0) * len(masks)
    plain = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).alias("text"),
    ).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    if size <= most_windows:
        kept = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in held.toLocalIterator()])

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            table, hasher = Items(kept.value, masks), WordIds()
            for pdf in batches:
                out = []
                for d, t in zip(pdf["doc_id"], pdf["text"]):
                    for it, hit in _overlaps(hasher(words(t)), table, min_run, substitutions).items():
                        out.append((d, table.item_ids[it], *hit))
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "doc_word", "item_word", "run", "substitutions"])

        return _best(plain.mapInPandas(search, FOUND))
    # Texts, not ids, are joined: two texts of one id are both searched, and a text given twice once.
    marked = lambda df: df.withColumn("t", F.xxhash64("text"))
    docs_, items_ = marked(plain), marked(held)
    hashes = lambda df, key: df.mapInPandas(_window_rows(key, masks), f"{key} long, {key}_t long, h long").distinct()
    pairs = hashes(docs_, "doc_id").join(hashes(items_, "item_id"), "h").select("doc_id", "doc_id_t", "item_id", "item_id_t").distinct()
    both = pairs.join(
        items_.select("item_id", F.col("t").alias("item_id_t"), F.col("text").alias("_item")), ["item_id", "item_id_t"]
    ).join(docs_.select("doc_id", F.col("t").alias("doc_id_t"), "text").dropDuplicates(["doc_id", "doc_id_t"]), ["doc_id", "doc_id_t"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordIds()
        for pdf in batches:
            out = []
            for d, i, t, w in zip(pdf["doc_id"], pdf["item_id"], pdf["text"], pdf["_item"]):
                for hit in _overlaps(hasher(words(t)), Items([(i, w)], masks), min_run, substitutions).values():
                    out.append((d, i, *hit))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "doc_word", "item_word", "run", "substitutions"])

    return _best(both.select("doc_id", "item_id", "text", "_item").mapInPandas(verify, FOUND))


def _best(found: DataFrame) -> DataFrame:
    """One row for each document and item: the passage with the most equal words, of equals the longest, then the first."""
    order = F.struct(F.col("run") - F.col("substitutions"), "run", -F.col("doc_word"), -F.col("item_word"))
    rest = F.struct("doc_word", "item_word", "run", "substitutions")
    return found.groupBy("doc_id", "item_id").agg(F.max_by(rest, order).alias("_b")).select("doc_id", "item_id", "_b.*")


def _window_rows(key: str, masks: tuple[str, ...]):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordIds()
        for pdf in batches:
            for k, t, text in zip(pdf[key], pdf["t"], pdf["text"]):
                ids = hasher(words(text))
                h = np.unique(np.concatenate([window_hashes(ids, m) + np.uint64(i) for i, m in enumerate(masks)])).view(np.int64)
                yield pd.DataFrame({key: np.full(len(h), k), f"{key}_t": np.full(len(h), t), "h": h})

    return rows


def leaked_items(found: DataFrame) -> DataFrame:
    """(item_id, n_docs, longest_run) of the items that leaked."""
    return found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("run").alias("longest_run"))
