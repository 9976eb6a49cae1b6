"""Problem 8: documents into containers of fixed capacity.

Method: bounded-space online best fit. Texts are measured in tokens of a public tokenizer; in order of arrival each goes
into the open container it leaves the least free space in, found in a bitset keyed by free space. The number of open
containers is fixed; where a new one is needed beyond it, the fullest closes. A text longer than a container is cut into
full containers and a rest, and only then.

Cost: texts are tokenised where they are, whole; (id, tokens) pairs, not texts, are shuffled to blocks of about ``BLOCK_ROWS`` by
hash of the id, and each block packs alone, so blocks bound both memory and the loss of one open set a block. All container
kinds are packed in one pass over a block. Inside a block the order is that of the ids, so a result does not depend on how
the input is partitioned.

Defined results: null ids are left out; null and empty texts, and texts without tokens, need no container and get none;
equal ids are packed once for each row; kinds with a null or non-positive capacity are left out; of a kind given twice the
larger capacity counts; no kinds or no documents give no rows.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import cut

OPEN_BINS = 64
BLOCK_ROWS = 50_000
DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the usual pre-tokenising pattern of the byte-level vocabulary above.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
PACKED = "container_kind string, capacity int, container_id string, doc_id long, piece int, tokens int"


@lru_cache(maxsize=4)
def token_counter(path: str):
    """A function from texts to their numbers of tokens, for any of the vocabulary formats (.tiktoken, .json, .model)."""
    if path.endswith(".tiktoken"):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines()) if a}
        encoding = tiktoken.Encoding("quern", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(list(texts), add_special_tokens=False)]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in model.encode(list(texts), num_threads=1)]


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of each row with an id and a text that has tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = token_counter(tokenizer)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": np.array(count(pdf["text"]), dtype=np.int64)})

    picked = docs.where(F.col(doc_id).isNotNull() & (F.length(text) > 0)).select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).alias("text"),
    )
    return picked.mapInPandas(run, "doc_id long, tokens long").where("tokens > 0")


def pack(sizes: list[int], capacity: int, open_bins: int = OPEN_BINS) -> list[tuple[int, int, int, int]]:
    """(item, piece, size, container) for each piece of each item, in order. Containers are numbered as they open."""
    out = []
    bits = 0  # bit f: some open container has f free
    at: dict[int, list[int]] = {}
    n_open = opened = 0
    for item, size in enumerate(sizes):
        piece = 0
        while size > capacity:
            out.append((item, piece, capacity, opened))
            opened += 1
            size -= capacity
            piece += 1
        fits = bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            container = at[free].pop()
            if not at[free]:
                bits ^= 1 << free
        else:
            if n_open == open_bins:
                least = (bits & -bits).bit_length() - 1
                at[least].pop(0)
                if not at[least]:
                    bits ^= 1 << least
                n_open -= 1
            free, container = capacity, opened
            opened += 1
            n_open += 1
        out.append((item, piece, size, container))
        left = free - size
        if left:
            bits |= 1 << left
            at.setdefault(left, []).append(container)
        else:
            n_open -= 1
    return out


def pack_documents(
    docs: DataFrame,
    kinds: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str = DEFAULT_TOKENIZER,
    open_bins: int = OPEN_BINS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(container_kind, capacity, container_id, doc_id, piece, tokens): the container of each document, or of each piece of one
    that exceeds the capacity."""
    found = kinds.where(
        F.col("container_kind").isNotNull() & (F.col("capacity") > 0)
    ).groupBy("container_kind").agg(F.max("capacity").alias("capacity"))
    capacities = {r["container_kind"]: r["capacity"] for r in found.limit(1001).collect()}
    if len(capacities) > 1000:
        raise ValueError("more than 1000 kinds of containers")
    counts = cut(token_counts(docs, doc_id, text, tokenizer), "p8-tokens")
    blocks = max(1, math.ceil(counts.count() / block_rows))

    def run(key, pdf):
        pdf = pdf.sort_values(["doc_id", "tokens"], kind="stable")
        ids, sizes, out = pdf["doc_id"].to_numpy(), pdf["tokens"].tolist(), []
        for kind in sorted(capacities):
            rows = np.array(pack(sizes, capacities[kind], open_bins), dtype=np.int64).reshape(-1, 4)
            prefix = f"{kind}-{key[0]}-"
            out.append(
                pd.DataFrame(
                    {
                        "container_kind": kind,
                        "capacity": capacities[kind],
                        "container_id": [prefix + str(c) for c in rows[:, 3]],
                        "doc_id": ids[rows[:, 0]],
                        "piece": rows[:, 1],
                        "tokens": rows[:, 2],
                    }
                )
            )
        return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in PACKED.split(", ")])

    # As many partitions as blocks, by number, so that no two blocks wait for one another.
    dealt = counts.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    return dealt.groupBy("block").applyInPandas(run, PACKED)


def fill_report(packed: DataFrame) -> DataFrame:
    """(container_kind, n_containers, n_documents, tokens, fill): how full the containers of each kind are on average."""
    total = packed.groupBy("container_kind").agg(
        F.max("capacity").alias("_c"),
        F.count_distinct("container_id").alias("n_containers"),
        F.count_distinct("doc_id").alias("n_documents"),
        F.sum("tokens").alias("tokens"),
    )
    return total.select(
        "container_kind",
        "n_containers",
        "n_documents",
        "tokens",
        (F.col("tokens") / (F.col("_c") * F.col("n_containers"))).alias("fill"),
    )
