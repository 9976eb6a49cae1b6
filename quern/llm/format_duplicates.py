"""Problem 3: records that differ only in white space, case, punctuation or the order of fields.

Method: each record gets a canonical form and its 64-bit hash, written once, sorted by hash within each partition. The hash
space is cut into segments. Every partition fills two Bloom filters a segment, of hashes it saw and of hashes it saw again;
they are merged segment by segment, where a bit pattern present in two partitions counts as seen again. Only records whose
hash the merged "again" filter may hold are shuffled and grouped exactly by their canonical form; the others are singletons.

Cost: a filter takes ``BITS_PER_ROW`` bits a row, so for billions of rows it fits no broadcast. The segments are therefore
worked in waves of at most ``filter_bytes`` each: a wave's filters are built, merged, broadcast (their size is bounded by
that parameter) and probed against the rows of those hashes only, which the sorted table lets the scan pick by column
statistics. The rows are the same however many waves there are, and a singleton never shuffles. Filters are probed as packed
bytes. A group of copies with a third of all rows is folded to its smallest id by partial aggregation and joined back by
``join_hot``.

Defined results: a record with a null id, type, value or URL, or whose value or URL has no letter or digit, takes no part
in ``duplicate_pairs`` and comes out of ``collapse`` as a record of one copy. Ties and repeated rows: equal ids count once.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.skew import join_hot
from quern.session import BROADCAST_BYTES, cut

SEGMENT_BITS = 1 << 20
BITS_PER_ROW = 16
HASHES = 4
_ALNUM = r"[^\p{L}\p{N}]+"


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), _ALNUM, "")


def _fields(c: Column, delimiter: str) -> Column:
    parts = F.transform(F.split(F.lower(c), delimiter), lambda x: F.regexp_replace(x, _ALNUM, ""))
    return F.array_join(F.array_sort(F.filter(parts, lambda x: x != "")), "\u0001")


def canonical_value(value: Column) -> Column:
    """Letters and digits of each field (delimited by comma, semicolon, bar or slash) in lower case, the fields sorted."""
    return _fields(value, r"[,;|/]")


def canonical_url(url: Column) -> Column:
    """Scheme, port, host and path, sorted parameters and fragment, each reduced to letters and digits in lower case."""
    text = F.trim(F.regexp_replace(url, r"^[\s ]+|[\s ]+$", ""))
    rfc = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*?)(?::(\d*)\s*)?(?=[/?#]|$))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    parts = F.split(F.regexp_replace(text, rfc, "$1\u0004$2\u0004$3\u0004$4\u0004$5\u0004$6"), "\u0004")
    return F.concat_ws("\u0002", _plain(parts[0]), parts[2], _plain(F.concat(parts[1], parts[3])), _fields(parts[4], "&"), _plain(parts[5]))


def canonical_contact(kind: str = "contact_type", value: str = "value", url: str = "source_url") -> Column:
    """Canonical form of a contact; null where it takes no part."""
    usable = F.col(kind).isNotNull() & F.col(value).rlike(r"[\p{L}\p{N}]") & F.col(url).rlike(r"[\p{L}\p{N}]")
    return F.when(usable, F.concat_ws("\u0003", F.col(kind), canonical_value(F.col(value)), canonical_url(F.col(url))))


def _edge(segment: int, segments: int) -> int:
    """The least hash of a segment; segments are equal ranges of the signed 64-bit hashes."""
    return -(1 << 63) + -(-(segment << 64) // segments)


def _positions(h: np.ndarray, segments: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each hash, and its HASHES bit places within the segment."""
    edges = np.array([_edge(s, segments) for s in range(1, segments)], dtype=np.int64)
    seg = np.searchsorted(edges, h, "right").astype(np.int64)
    u = h.astype(np.uint64)
    x = (u ^ (u >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    y = (x * np.uint64(0xC4CEB9FE1A85EC53)) ^ (x >> np.uint64(29))
    step = (y >> np.uint64(32)) | np.uint64(1)
    places = ((y & np.uint64(0xFFFFFFFF))[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)[None, :]) % np.uint64(bits)
    return seg, places.astype(np.int64)


def _pack(bits: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype=np.uint8)


def _held(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether all of a row's places are set in the packed bits."""
    return ((data[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1).all(axis=1)


def _partial_filters(segments: int, bits: int):
    """One partition's filters, a segment at a time; it holds the partition's hashes of one wave."""

    def fill(batches):
        held = [pdf["h"].to_numpy(dtype=np.int64) for pdf in batches]
        if not held:
            return
        hashes, n = np.unique(np.concatenate(held), return_counts=True)
        seg, places = _positions(hashes, segments, bits)
        order = np.argsort(seg, kind="stable")
        found, at = np.unique(seg[order], return_index=True)
        for s, rows in zip(found, np.split(order, at[1:])):
            once, again = np.zeros(bits, np.uint8), np.zeros(bits, np.uint8)
            once[places[rows].ravel()] = 1
            again[places[rows[n[rows] > 1]].ravel()] = 1
            yield pd.DataFrame({"seg": [int(s)], "once": [_pack(once)], "again": [_pack(again)]})

    return fill


def _merge_segment(key, pdf):
    """A bit set in two partitions' filters counts as seen again, so a hash of two partitions always passes."""
    once = again = None
    for o, a in zip(pdf["once"], pdf["again"]):
        o, a = _unpack(o), _unpack(a)
        if once is None:
            once, again = o.copy(), a.copy()
        else:
            again |= a | (once & o)
            once |= o
    return pd.DataFrame({"seg": [int(key[0])], "again": [zlib.compress(again.tobytes(), 1)]})


def _probe(kept, segments: int, bits: int):
    def run(batches):
        filters: dict[int, np.ndarray] = {}
        for pdf in batches:
            seg, places = _positions(pdf["h"].to_numpy(dtype=np.int64), segments, bits)
            hit = np.zeros(len(pdf), bool)
            for s in np.unique(seg):
                s = int(s)
                if s not in kept.value:
                    continue
                if s not in filters:
                    filters[s] = _unpack(kept.value[s])
                at = seg == s
                hit[at] = _held(filters[s], places[at])
            yield pdf.assign(again=hit)

    return run


def waves(rows: int, filter_bytes: int, segment_bits: int) -> tuple[int, list[tuple[int, int]]]:
    """(segments of the whole hash space, [first, end) segments of each wave)."""
    segments = max(1, math.ceil(rows * BITS_PER_ROW / segment_bits))
    most = max(1, filter_bytes // (segment_bits // 8))
    return segments, [(a, min(segments, a + most)) for a in range(0, segments, most)]


def with_repeats(hashed: DataFrame, rows: int, filter_bytes: int = BROADCAST_BYTES, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """``hashed`` (a written table with column ``h``) with ``again``: whether its hash may occur more than once. Rows that occur
    once have it true only as false positives of the filter."""
    spark = hashed.sparkSession
    segments, parts = waves(rows, filter_bytes, segment_bits)
    out = None
    for first, end in parts:
        lo, hi = _edge(first, segments), _edge(end, segments) - 1
        mine = hashed if len(parts) == 1 else hashed.where(F.col("h").between(lo, hi))
        partial = mine.select("h").mapInPandas(_partial_filters(segments, segment_bits), "seg long, once binary, again binary")
        merged = partial.groupBy("seg").applyInPandas(_merge_segment, "seg long, again binary")
        # At most end - first segments of segment_bits: within filter_bytes, whatever the table.
        kept = spark.sparkContext.broadcast({r["seg"]: bytes(r["again"]) for r in merged.toLocalIterator()})
        probed = mine.mapInPandas(_probe(kept, segments, segment_bits), T.StructType([*hashed.schema.fields, T.StructField("again", T.BooleanType())]))
        out = probed if out is None else out.unionByName(probed)
    return out


def _canonical_table(df: DataFrame, record_id: str, canonical: Column, keep: list[str], name: str) -> DataFrame:
    """(_quern_id, form, h, kept columns) of the records that take part, written once and sorted by hash within partitions."""
    forms = df.select(F.col(record_id).alias("_quern_id"), canonical.alias("_quern_form"), *[F.col(f"`{c}`") for c in keep])
    forms = forms.where(F.col("_quern_id").isNotNull() & F.col("_quern_form").isNotNull()).withColumn("h", F.xxhash64("_quern_form"))
    return cut(forms.sortWithinPartitions("h"), name)


def _groups(suspects: DataFrame, rows: int) -> DataFrame:
    """(_quern_id, keep_id, n_copies) of the records in sets of two or more, from those that may repeat."""
    groups = suspects.groupBy("_quern_form").agg(
        F.min("_quern_id").alias("keep_id"),
        F.count_distinct("_quern_id").alias("n_copies"),
    ).where(F.col("n_copies") > 1)
    return join_hot(suspects.select("_quern_id", "_quern_form").distinct(), cut(groups, "p3-groups"), ["_quern_form"], "n_copies", rows)


def duplicate_pairs(df: DataFrame, record_id: str, canonical: Column, **filters: int) -> DataFrame:
    """(keep_id, copy_id, n_copies): for each set of two or more equal records its smallest id, and one row for each other id."""
    forms = _canonical_table(df, record_id, canonical, [], "p3-forms")
    rows = forms.count()
    suspects = cut(with_repeats(forms, rows, **filters).where("again").select("_quern_id", "_quern_form"), "p3-suspects")
    return _groups(suspects, rows).where(F.col("_quern_id") != F.col("keep_id")).select(
        "keep_id", F.col("_quern_id").alias("copy_id"), "n_copies"
    )


def collapse(df: DataFrame, record_id: str, canonical: Column, **filters: int) -> DataFrame:
    """All columns of ``df``, one row for each set of equal records (the row with the smallest id), with ``n_copies``.

    Only records that may repeat are joined; singletons, and records that take no part, go straight to the result."""
    own = [f"_quern_c{i}" for i in range(len(df.columns))]
    usable = F.when(F.col(record_id).isNotNull(), canonical)
    plain = df.withColumn("_quern_in", usable).toDF(*own, "_quern_in")
    aside = plain.where(F.col("_quern_in").isNull())
    at = own[df.columns.index(record_id)]
    forms = _canonical_table(plain.where(F.col("_quern_in").isNotNull()), at, F.col("_quern_in"), own, "p3-forms")
    rows = forms.count()
    probed = cut(with_repeats(forms, rows, **filters), "p3-probed")
    suspects = probed.where("again")
    found = _groups(suspects.select("_quern_id", "_quern_form"), rows).distinct()
    hot = suspects.join(found.select("_quern_id", "keep_id", "n_copies"), "_quern_id", "left")
    kept = hot.where(F.col("keep_id").isNull() | (F.col("keep_id") == F.col("_quern_id")))
    one = F.lit(1).cast("long").alias("n_copies")
    whole = aside.select(*own, one).unionByName(probed.where(~F.col("again")).select(*own, one)).unionByName(
        kept.select(*own, F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))
    )
    return whole.toDF(*[c if c != "n_copies" else "n_copies_before" for c in df.columns], "n_copies")
