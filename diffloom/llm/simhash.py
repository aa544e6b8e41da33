"""SimHash near-dedup by bit-sliced comparison.

Fingerprints are compared as bit planes: plane p holds bit p of 64 fingerprints in one machine word. Adding up
differing bits of one fingerprint against 64 others is then a carry-save counter of a few word operations a plane,
and a word is given up as soon as all its lanes exceed the radius.

Which fingerprints meet: 64 bits are cut into radius + 2 blocks; two fingerprints within the radius agree in at
least two blocks, so every pair of blocks makes a table of buckets, and only a bucket's fingerprints are compared.
Only distinct fingerprints enter, with the smallest id of their rows. A bucket beyond ``BUCKET`` fingerprints is
dealt into slots and every pair of slots becomes a group of its own, so no group outgrows a task and no pair is
lost. A group answers with a star per connected part (at most one row per member), never with all its pairs; stars
are joined to components by alternating large-star and small-star steps.

Defined results: a text without words, or null, has fingerprint 0 and is linked like any other; repeated rows share
fingerprint and component; a component's id is its smallest non-null doc_id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.llm.common import own_names, settle

#: Fingerprints of a bucket that are compared in one group.
BUCKET = 4096

_ONE = np.uint64(1)


def fingerprint_of(text: bytes, shingle: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles, as a signed 64-bit integer."""
    words = text.lower().split()  # on bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) <= shingle:
        hashes = [digest(joined, 42)]
    else:
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    counts, size = np.zeros(64, dtype=np.int64), 1 << 14
    for at in range(0, len(hashes), size):
        part = np.array(hashes[at : at + size], dtype="<u8").view(np.uint8)
        counts += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    value = int((2 * counts > len(hashes)).dot(_ONE << np.arange(64, dtype=np.uint64)))
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(_id, _th, fp) per row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text")
            fps = [fingerprint_of(t.as_py() or b"", shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_th"), pa.array(fps, pa.int64())], names=["_id", "_th", "fp"])

    given = docs.select(F.col(doc_id).cast("long").alias("_id"), F.xxhash64(F.col(text)).alias("_th"), F.col(text).cast("binary").alias("_text"))
    return given.mapInArrow(work, "_id long, _th long, fp long")


def _tables(radius: int) -> list[int]:
    """One mask per pair of the radius + 2 blocks of bits."""
    edges = np.linspace(0, 64, radius + 3).astype(int)
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    return [a | b for a, b in combinations(blocks, 2)]


def _parts(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the connected parts inside each group (``group`` ascending): (member, root) as row numbers."""
    n = len(fps)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.concatenate((first, [n])))
    words = (sizes + 63) // 64
    word_base = np.concatenate(([0], np.cumsum(words)))
    of = np.repeat(np.arange(len(first)), sizes)
    local = np.arange(n) - first[of]
    slot, lane = word_base[of] + local // 64, (local % 64).astype(np.uint64)
    planes = np.zeros((64, word_base[-1]), dtype=np.uint64)
    for p in range(64):
        np.bitwise_or.at(planes[p], slot, ((fps >> np.uint64(p)) & _ONE) << lane)
    filled = np.zeros(word_base[-1], dtype=np.uint64)
    np.bitwise_or.at(filled, slot, _ONE << lane)
    root = np.arange(n)
    a_all, b_all = [], []
    row = 0
    while row < n:  # as many rows as make about a quarter of a million (row, word) cells
        upto = row + max(1, int(np.searchsorted(np.cumsum(words[of[row:]]), 1 << 18, "right")))
        rows = np.repeat(np.arange(row, upto), words[of[row:upto]])
        inner = np.arange(len(rows)) - np.repeat(np.cumsum(words[of[row:upto]]) - words[of[row:upto]], words[of[row:upto]])
        cell = word_base[of[rows]] + inner
        alive = filled[cell]
        counters = [np.zeros(len(rows), dtype=np.uint64) for _ in range(radius.bit_length())]
        for p in range(64):
            carry = planes[p][cell] ^ (np.uint64(0) - ((fps[rows] >> np.uint64(p)) & _ONE))
            for i, c in enumerate(counters):
                counters[i], carry = c ^ carry, c & carry
            over = carry
            if radius + 1 < 1 << len(counters):  # counters can hold radius + 1: those lanes are out too
                over = over | np.bitwise_and.reduce([c if (radius + 1) >> i & 1 else ~c for i, c in enumerate(counters)])
            alive = alive & ~over
            if p % 16 == 15:  # words without a lane left are abandoned
                keep = np.flatnonzero(alive)
                if len(keep) < len(alive):
                    rows, inner, cell, alive = rows[keep], inner[keep], cell[keep], alive[keep]
                    counters = [c[keep] for c in counters]
        if len(rows):
            bits = np.unpackbits(alive.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
            at, hit = np.nonzero(bits)
            a, b = rows[at], first[of[rows[at]]] + inner[at] * 64 + hit
            a_all.append(a[a > b]), b_all.append(b[a > b])
        row = upto
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a_all, b_all))
    while len(a):
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low), np.minimum.at(root, b, low)
        np.minimum.at(root, before, root)
        root = root[root]
        if (root == before).all():
            break
    member = np.flatnonzero(root != np.arange(n))
    return member, root[member]


def links(distinct: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) between distinct ``fp`` values; connected as all pairs within ``radius`` bits are."""
    masks = _tables(radius)
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for i, m in enumerate(masks)])
    rows = distinct.select("fp", F.explode(keys).alias("k")).select("k.t", "k.key", "fp")
    sizes = rows.groupBy("t", "key").count().filter("count > 1").select("t", "key", F.ceil(F.col("count") / bucket).cast("int").alias("m"))
    dealt = rows.join(sizes, ["t", "key"]).withColumn("i", F.pmod(F.xxhash64("fp"), F.col("m")))
    dealt = dealt.select("t", "key", "fp", "i", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j"))
    group = F.xxhash64("t", "key", F.least("i", "j"), F.greatest("i", "j"))  # groups that share a hash are only compared needlessly
    grouped = dealt.select(group.alias("g"), "fp").repartition("g").sortWithinPartitions("g", "fp")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(g: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            member, root = _parts(fp.view(np.uint64), g, radius)
            return pa.RecordBatch.from_arrays([pa.array(fp[member]), pa.array(fp[root])], names=["u", "v"])

        held_g, held_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            g = np.concatenate((held_g, batch.column("g").to_numpy()))
            fp = np.concatenate((held_fp, batch.column("fp").to_numpy()))
            new = np.concatenate(([True], (g[1:] != g[:-1]) | (fp[1:] != fp[:-1])))
            g, fp = g[new], fp[new]
            end = int(np.searchsorted(g, g[-1], "left"))  # the last group may go on in the next batch
            if end:
                yield answer(g[:end], fp[:end])
            held_g, held_fp = g[end:], fp[end:]
        if len(held_g):
            yield answer(held_g, held_fp)

    return grouped.mapInArrow(work, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (u, v): root is the smallest vertex it is connected with."""
    now = settle(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = now.union(now.select(F.col("v"), F.col("u"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", "m")).filter("u <> v").distinct()
        now = settle(small)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            return now.select(F.col("u").alias("v"), F.col("v").alias("root"))
        state = seen


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Per row of ``docs``: _id, _th (hash of the text), fp (signed), root (a fingerprint that stands for the
    component), component_id."""
    prints = settle(fingerprints(docs, text, doc_id, shingle))
    distinct = settle(prints.groupBy("fp").agg(F.min("_id").alias("low")))
    roots = components(links(distinct, radius, bucket)).select(F.col("v").alias("fp"), "root")
    known = distinct.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    ids = known.groupBy("root").agg(F.min("low").alias("component_id"))
    table = known.join(ids, "root").select("fp", "root", "component_id")
    return prints.join(table, "fp").select("_id", "_th", "fp", "root", "component_id")


def hex_of(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """The rows of ``docs``, one of each component: the smallest by doc_id, then by hash of the text. Copies with the
    same id and text count as one row."""
    docs = own_names(docs)
    names = docs.columns
    near = near_duplicates(docs, text, doc_id, shingle, radius, bucket)
    best = near.groupBy("root").agg(F.min(F.struct("_id", "_th")).alias("best"))
    winners = settle(best.select("best._id", "best._th").distinct())
    known = docs.withColumns({"_i": F.col(doc_id).cast("long"), "_t": F.xxhash64(F.col(text))})
    stay = known.join(winners, known["_i"].eqNullSafe(winners["_id"]) & (known["_t"] == winners["_th"]), "left_semi")
    # Rows alike in id and text: one of them, by a hash of all their columns, then once each.
    lone = stay.groupBy("_i", "_t").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    twice = stay.join(lone, stay["_i"].eqNullSafe(lone["_i"]) & (stay["_t"] == lone["_t"]), "left_semi")
    once = stay.join(lone, stay["_i"].eqNullSafe(lone["_i"]) & (stay["_t"] == lone["_t"]), "left_anti")
    return once.select(*names).unionByName(twice.dropDuplicates(["_i", "_t"]).select(*names))
