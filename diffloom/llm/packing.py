"""Best-fit packing with several permitted sequence lengths.

A document's tokens are cut into pieces of at most the largest capacity. Pieces are dealt by hash into shards of a
bounded number of pieces; shards are packed independently, each by best fit in order of falling length:

* a piece goes into the open bin that it leaves with the least room;
* where none has room, a bin is opened. For every permitted capacity that holds the piece, the bin is filled on
  trial with what remains (largest first); the capacity with the least cost per token held is opened. A capacity's
  cost is itself plus ``overhead``, so capacities compete on one scale;
* at the end every bin shrinks to the smallest permitted capacity that holds its contents.

A shard holds thousands of bins, so what shards lose at their ends is a fraction of a bin in thousands.

Defined results: documents without tokens get one piece of length 0 that takes no bin (bin null); ties between
pieces go to the smaller id and piece; repeated rows are pieces of their own.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffloom.llm.common import settle, text_or_empty

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Pieces of a shard, about; the number of shards grows with the pieces.
SHARD = 4096
#: Cost of a sequence beside its tokens.
OVERHEAD = 16


def word_count(text: str = "text") -> Column:
    """Tokens of a text where the caller counts none: its runs of non-blank bytes."""
    folded = F.translate(text_or_empty(text), "\t\n\x0b\x0c\r", "     ")
    trimmed = F.btrim(folded)
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " +"))).cast("long")


def _fill(room: int, sizes: list[int], left: dict[int, int]) -> int:
    """Tokens that a bin with ``room`` takes of what remains, largest first. ``sizes`` ascends."""
    held, taken = 0, {}
    at = bisect_left(sizes, room + 1) - 1
    while at >= 0 and room > 0:
        size = sizes[at]
        n = min(room // size, left[size] - taken.get(size, 0))
        if n > 0:
            taken[size] = taken.get(size, 0) + n
            held, room = held + n * size, room - n * size
        at = min(at - 1, bisect_left(sizes, room + 1) - 1)
    return held


def pack(lengths: np.ndarray, capacities: tuple[int, ...], overhead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, capacity after downsizing and offset of each piece; ``lengths`` falls and is at least 1."""
    capacities = tuple(sorted(capacities))
    values, counts = np.unique(lengths, return_counts=True)
    left, sizes = dict(zip(values.tolist(), counts.tolist(), strict=True)), values.tolist()
    open_bins: list[tuple[int, int]] = []  # (room, bin), ascending
    bin_of, offset, held = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    choice: tuple[int, int] = (0, 0)
    for i, n in enumerate(lengths.tolist()):
        left[n] -= 1
        if not left[n]:
            del left[n], sizes[bisect_left(sizes, n)]
        at = bisect_left(open_bins, (n, -1))
        if at < len(open_bins):
            room, b = open_bins.pop(at)
        else:
            cost = [((c + overhead) / (n + _fill(c - n, sizes, left)), c) for c in capacities if c >= n]
            choice = min(cost)
            room, b = choice[1], len(held)
            held.append(0)
        bin_of[i], offset[i] = b, held[b]
        held[b] += n
        if room > n:
            insort(open_bins, (room - n, b))
    fit = np.searchsorted(capacities, np.array(held, dtype=np.int64)) if held else np.zeros(0, np.int64)
    return bin_of, np.array(capacities)[fit][bin_of] if held else offset, offset


def pack_documents(
    docs: DataFrame, tokens: Column | None = None, doc_id: str = "doc_id", text: str = "text", capacities: tuple[int, ...] = CAPACITIES, shard: int = SHARD, overhead: int = OVERHEAD
) -> DataFrame:
    """One row per piece: doc_id, piece, first_token, n_tokens, shard, bin, capacity, offset."""
    largest = max(capacities)
    counted = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (word_count(text) if tokens is None else tokens).cast("long").alias("n"), F.xxhash64(F.col(text)).alias("_th"))
    pieces = counted.select(
        "doc_id", "_th", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / largest) - 1, F.lit(0)).cast("int"))).alias("piece")
    ).select("doc_id", "_th", "piece", (F.col("piece").cast("long") * largest).alias("first_token"), F.least(F.lit(largest), F.col("n") - F.col("piece") * largest).cast("long").alias("n_tokens"))
    pieces = settle(pieces)
    shards = max(1, -(-pieces.count() // shard))
    # The row number of the written table deals the pieces: repeated rows, alike in every column, spread as well.
    filled = pieces.filter("n_tokens > 0").withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("_th", "ascending")])
        made = pack(rows["n_tokens"].to_numpy(), capacities, overhead)
        for name, values in zip(("bin", "capacity", "offset"), made, strict=True):
            rows = rows.append_column(name, pa.array(values, pa.int64()))
        return rows.drop_columns(["_th"])

    schema = "doc_id long, piece int, first_token long, n_tokens long, shard int, bin long, capacity long, offset long"
    packed = filled.groupBy("shard").applyInArrow(work, schema)
    empty = pieces.filter("n_tokens <= 0").select(
        "doc_id", "piece", "first_token", "n_tokens", *[F.lit(None).cast(t).alias(c) for c, t in (("shard", "int"), ("bin", "long"), ("capacity", "long"), ("offset", "long"))]
    )
    return packed.unionByName(empty)
