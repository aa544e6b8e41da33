"""Exact top-k by inner product with KD-trees per shard.

Vectors are dealt into shards of about ``SHARD`` rows. Each shard becomes one tree, built once and kept as one row:
median splits along the widest side, every node with the tight box of its points. No inner product inside a box
exceeds sum(max(q * low, q * high)), so a query walks the tree best bound first and stops when the best bound left is
below its kth score. Queries are dealt into blocks. A block first meets one shard; the kth scores found there go with
the queries to all other shards, where most walks then end early. Bounds equal to the kth score are still walked, so
ties are settled by id alone.

Every (shard, block) pair is a group of its own: one tree and one block in memory, whatever the table's size.
Queries of a stated set against all rows cost (rows x queries) at worst; the trees and the propagated kth score are
what saves work.

Defined results: vectors that are null or hold null or non-finite components, and rows without an id, take no part;
only vectors of one length meet; rows that carry the query's id are its own; a query id that occurs repeatedly asks
with its smallest vector; repeated candidates are ranked one after another.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffloom.llm.common import settle

SHARD, BLOCK, LEAF = 8192, 1024, 128


def quantised(vectors: DataFrame, scale: float = 64.0, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): components times ``scale``, rounded down; only rows that take part."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.transform(F.col(vector), lambda c: c.cast("double")).alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.filter(F.col("id").isNotNull() & F.col("x").isNotNull()).filter(finite).select("id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def build_tree(ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> dict:
    """Nodes in breadth-first order: boxes, children (-1 at leaves) and the run of points below each."""
    order = np.arange(len(ids))
    spans, children, boxes = [(0, len(ids))], [], []
    at = 0
    while at < len(spans):
        lo, hi = spans[at]
        own = points[order[lo:hi]]
        low, high = own.min(axis=0), own.max(axis=0)
        boxes.append((low, high))
        wide = int((high - low).argmax()) if own.shape[1] else 0
        if hi - lo <= leaf or not own.shape[1] or high[wide] == low[wide]:
            children.append((-1, -1))
        else:
            middle = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(own[:, wide], middle)]
            children.append((len(spans), len(spans) + 1))
            spans += [(lo, lo + middle), (lo + middle, hi)]
        at += 1
    return {
        "ids": ids[order],
        "points": points[order],
        "spans": spans,
        "children": children,
        "low": np.array([b[0] for b in boxes]),
        "high": np.array([b[1] for b in boxes]),
    }


def search(tree: dict, ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, id, score): the k best of the tree for each query, less those below its bound."""
    points, low, high = tree["points"], tree["low"], tree["high"]
    most = max((int(np.abs(x).max()) if x.size else 0) for x in (points, queries))
    if most * most * max(1, points.shape[1]) < 1 << 53:  # doubles hold every sum exactly, and multiply faster
        points, low, high, queries = (x.astype(np.float64) for x in (points, low, high, queries))
    limits = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    out = []
    for i, q in enumerate(queries):
        limit, kth = limits[i].tolist(), int(bounds[i])
        scores, found = np.zeros(0, points.dtype), np.zeros(0, np.int64)
        heap = [(-limit[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < kth:
                break
            left, right = tree["children"][node]
            if left >= 0:
                for child in (left, right):
                    if limit[child] >= kth:
                        heapq.heappush(heap, (-limit[child], child))
                continue
            a, b = tree["spans"][node]
            s = points[a:b] @ q
            take = np.flatnonzero((s >= kth) & (tree["ids"][a:b] != ids[i]))
            if not len(take):
                continue
            scores, found = np.concatenate((scores, s[take])), np.concatenate((found, tree["ids"][a:b][take]))
            if len(scores) >= k:
                best = np.lexsort((found, -scores))[:k]
                scores, found = scores[best], found[best]
                kth = max(kth, int(scores[-1]))
        best = np.lexsort((found, -scores))[:k]
        out += zip([int(ids[i])] * len(best), found[best].tolist(), scores[best].astype(np.int64).tolist(), strict=True)
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, vec_id: str = "vec_id", vector: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of every query's ``k`` best. ``is_query`` is a condition on ``id``."""
    usable = settle(quantised(vectors, scale, vec_id, vector).withColumn("dim", F.size("v")))
    sizes = {r["dim"]: r["n"] for r in usable.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(4096).collect()}  # a row per length of vectors
    asked = settle(usable.filter(is_query).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")))
    counts = {r["dim"]: r["n"] for r in asked.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(4096).collect()}
    shards = {d: -(-n // shard) for d, n in sizes.items()}
    blocks = {d: -(-n // block) for d, n in counts.items()}

    def of(numbers: dict[int, int]) -> Column:
        pairs = [F.lit(x) for d, n in numbers.items() for x in (d, n)]
        return F.coalesce(F.create_map(*pairs)[F.col("dim")], F.lit(1)) if pairs else F.lit(1)

    dealt = usable.join(F.broadcast(asked.select("dim").distinct()), "dim", "left_semi").withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), of(shards)).cast("int"))

    def plant(rows: pa.Table) -> pa.Table:
        ids = rows["id"].to_numpy()
        points = np.array(rows["v"].to_pylist(), dtype=np.int64).reshape(len(ids), -1)
        tree = pickle.dumps(build_tree(ids, points.astype(np.int16) if points.size and np.abs(points).max() < 1 << 15 else points))
        return pa.table({"dim": rows["dim"][:1].combine_chunks(), "shard": rows["shard"][:1].combine_chunks(), "tree": pa.array([tree], pa.binary())})

    trees = settle(dealt.groupBy("dim", "shard").applyInArrow(plant, "dim int, shard int, tree binary"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), of(blocks)).cast("int")).withColumn("home", F.pmod("block", of(shards)).cast("int"))

    def meet(grove: pa.Table, wanted: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if grove.num_rows and wanted.num_rows:
            tree = pickle.loads(grove["tree"][0].as_py())
            tree["points"] = tree["points"].astype(np.int64)
            tree["low"], tree["high"] = tree["low"].astype(np.int64), tree["high"].astype(np.int64)
            ids = wanted["id"].to_numpy()
            queries = np.array(wanted["v"].to_pylist(), dtype=np.int64).reshape(len(ids), -1)
            found = search(tree, ids, queries, wanted["kth"].to_numpy(), k)
        return pa.table({n: pa.array([f[i] for f in found], pa.int64()) for i, n in enumerate(("query_id", "vec_id", "score"))})

    def walk(wanted: DataFrame) -> DataFrame:
        """``wanted``: dim, shard, block, id, v, kth."""
        blocks_at = wanted.select("dim", "shard", "block").distinct()
        keys = ["dim", "shard", "block"]
        pairs = trees.join(blocks_at, ["dim", "shard"]).select(*[F.col(c).alias(c) for c in (*keys, "tree")])
        return pairs.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score long")

    lowest = F.lit(-(1 << 63)).cast("long")
    first = settle(walk(asked.select("dim", F.col("home").alias("shard"), "block", "id", "v", lowest.alias("kth"))))
    kth = first.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(lowest).alias("kth"))
    others = asked.join(kth, "id", "left").select("dim", F.explode(F.sequence(F.lit(0), of(shards) - 1)).alias("shard"), "block", "id", "v", F.coalesce("kth", lowest).alias("kth"), "home")
    rest = walk(others.filter("shard <> home").drop("home"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
