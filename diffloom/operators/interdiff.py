"""Two iterations of one change: what its author changed between them, and threads carried over."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def iteration_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """After against after, per file either iteration touched: ``(diffset_id, path, before, after,
    in_both)``. A file one iteration lacks reads there as the other's before side; equal ids drop out.
    A deleted file's after side goes by its path, its id null."""
    key = ["diffset_id", "path"]

    def sides(changes: DataFrame, p: str) -> tuple[DataFrame, DataFrame]:
        after = changes.groupBy(*key).agg(
            F.max("after").alias(f"{p}_after"), F.lit(True).alias(f"{p}_listed"),
        )
        before = changes.filter("before is not null").groupBy("diffset_id", F.coalesce("old_path", "path").alias("path")).agg(
            F.any_value("before").alias(f"{p}_before")
        )
        return after, before

    f_after, f_before = sides(first, "f")
    t_after, t_before = sides(second, "t")
    rows = f_after.join(t_after, key, "full_outer").join(f_before, key, "left").join(t_before, key, "left")
    before = F.when(F.col("f_listed"), F.col("f_after")).otherwise(F.col("t_before"))
    after = F.when(F.col("t_listed"), F.col("t_after")).otherwise(F.col("f_before"))
    return (
        rows.select(*key, before.alias("before"), after.alias("after"), (F.col("f_listed") & F.col("t_listed")).alias("_both"))
        .filter(~F.col("before").eqNullSafe(F.col("after")))
        .select(*key, "before", "after", F.coalesce("_both", F.lit(False)).alias("in_both"))
    )


def unshared_hunks(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hunks equal in removed and added text cancel one for one, in order; the rest is what an author
    changed. Hunks: ``diffset_id, path, frag_no, hash``. Ranks are per file and text, so they are bounded
    by the hunks of one file."""
    key = ["diffset_id", "path", "hash"]
    nth = Window.partitionBy(*key).orderBy("frag_no")
    a = first.withColumn("_nth", F.row_number().over(nth))
    b = second.withColumn("_nth", F.row_number().over(nth))
    on = [*key, "_nth"]
    return a.join(b.select(*on), on, "left_anti").drop("_nth"), b.join(a.select(*on), on, "left_anti").drop("_nth")


def touches(frags: DataFrame, regions: DataFrame, by: list[str]) -> DataFrame:
    """Fragments ``(frag_no, start, end)`` that touch a region ``(start, end)`` of their file, both
    half-open; an empty range is a point and touches its neighbours.

    A fragment touches a region that starts before its end and ends past its start. Running over starts, the
    furthest end so far decides it, in one pass over a file's fragments and regions: no pair is formed.
    Solid ranges and points are kept apart, since two solid ranges that only meet do not touch.
    """
    none = F.lit(None).cast("bigint")
    f = frags.select(*by, "frag_no", F.col("start").cast("bigint").alias("s"), F.col("end").cast("bigint").alias("e"))
    r = regions.select(*by, F.col("start").cast("bigint").alias("s"), F.col("end").cast("bigint").alias("e"))
    # Regions with start < end of the fragment (or <= where either is a point): ask at the fragment's end.
    asks = f.select(*by, F.col("e").alias("at"), F.lit(1).alias("o"), "frag_no", "s", "e", none.alias("re"), F.lit(None).cast("boolean").alias("point"))
    tells = r.select(*by, F.col("s").alias("at"), F.lit(0).alias("o"), none.alias("frag_no"), none.alias("s"), none.alias("e"), F.col("e").alias("re"), (F.col("s") == F.col("e")).alias("point"))
    rows = asks.unionByName(tells)
    upto = Window.partitionBy(*by).orderBy("at", "o").rowsBetween(Window.unboundedPreceding, 0)
    strictly = Window.partitionBy(*by).orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    reach = rows.withColumns(
        {
            "_any": F.max("re").over(upto),
            "_points": F.max(F.when(F.col("point"), F.col("re"))).over(upto),
            "_solid": F.max(F.when(~F.col("point"), F.col("re"))).over(strictly),
        }
    ).filter("o = 1")
    point = F.col("s") == F.col("e")
    hit = F.when(point, F.col("_any") >= F.col("s")).otherwise(
        F.coalesce(F.col("_points") >= F.col("s"), F.lit(False)) | F.coalesce(F.col("_solid") > F.col("s"), F.lit(False))
    )
    return reach.filter(F.coalesce(hit, F.lit(False))).select(*by, "frag_no").distinct()


def beside_kept(frags: DataFrame, by: list[str]) -> DataFrame:
    """Fragments with ``keep`` decided: a kept diff stays; context stays while the nearest diff on either
    side, with no elision between, is kept; all else is elided and adjacent elisions merge. ``frags`` has
    ``frag_no, kind, kept`` (of diffs)."""
    up = Window.partitionBy(*by).orderBy("frag_no").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by).orderBy(F.desc("frag_no")).rowsBetween(Window.unboundedPreceding, 0)
    state = F.when(F.col("kind") == "diff", F.col("kept")).when(F.col("kind") == "elided", F.lit(False))
    before, after = F.last(state, ignorenulls=True).over(up), F.last(state, ignorenulls=True).over(down)
    beside = F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))
    keep = F.when(F.col("kind") == "diff", F.col("kept")).when(F.col("kind") == "unchanged", beside).otherwise(False)
    rows = frags.withColumn("keep", keep)
    order = Window.partitionBy(*by).orderBy("frag_no")
    shown = F.when(F.col("keep"), F.col("kind")).otherwise("elided")
    rows = rows.withColumn("shown", shown)
    rows = rows.withColumn("_before", F.lag("shown").over(order))
    return rows.filter("shown <> 'elided' or coalesce(_before, '') <> 'elided'").drop("_before")


def blob_in(threads: DataFrame, changes: DataFrame, other: DataFrame) -> DataFrame:
    """The blob a thread's path and side name in one iteration. A file the iteration does not list is
    unchanged there, so it borrows the other iteration's before side, unless a file both list with
    different before blobs proves that the base moved. Adds ``blob``; ``known`` is false where it cannot
    be told."""
    names = changes.select("diffset_id", F.explode(F.array(
        F.struct(F.lit("before").alias("side"), F.coalesce("old_path", "path").alias("path"), F.col("before").alias("blob")),
        F.struct(F.lit("after").alias("side"), F.col("path").alias("path"), F.col("after").alias("blob")),
    )).alias("n")).select("diffset_id", "n.*")
    listed = names.groupBy("diffset_id", "side", "path").agg(F.max("blob").alias("_listed_blob"), F.lit(True).alias("_listed"))
    mentioned = changes.select("diffset_id", F.explode(F.array("path", "old_path")).alias("path")).filter("path is not null").distinct().withColumn("_mentioned", F.lit(True))

    def base(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("diffset_id", F.coalesce("old_path", "path").alias("path")).agg(F.max("before").alias(name))

    moved = base(changes, "_x").join(base(other, "_y"), ["diffset_id", "path"]).filter(~F.col("_x").eqNullSafe(F.col("_y"))).select("diffset_id").distinct().withColumn("_moved", F.lit(True))
    rows = (
        threads.join(listed, ["diffset_id", "side", "path"], "left")
        .join(mentioned, ["diffset_id", "path"], "left")
        .join(base(other, "_borrowed"), ["diffset_id", "path"], "left")
        .join(moved, "diffset_id", "left")
    )
    unknown = F.col("_mentioned").isNotNull() | F.col("_moved").isNotNull()
    blob = F.when(F.col("_listed"), F.col("_listed_blob")).when(~unknown, F.col("_borrowed"))
    return rows.withColumn("blob", blob).withColumn("known", F.col("blob").isNotNull()).select(*threads.columns, "blob", "known")


def port_threads(threads: DataFrame, node_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Threads carried to the next iteration and the lost ones. ``threads``: ``thread_id, old_blob,
    new_blob, nodes`` (array of node ids); ``node_map``: ``(old_blob, new_blob, node_a, node_b)``. The same
    blob keeps a thread as it is; else every node needs its counterpart."""
    same = threads.filter("old_blob = new_blob").select("thread_id", "nodes")
    differs = threads.filter("old_blob <> new_blob")
    nodes = differs.select("thread_id", "old_blob", "new_blob", F.posexplode("nodes").alias("_i", "node_a"))
    mapped = nodes.join(node_map, ["old_blob", "new_blob", "node_a"], "left").groupBy("thread_id").agg(
        F.bool_and(F.col("node_b").isNotNull()).alias("_all"),
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "node_b"))), lambda n: n["node_b"]).alias("nodes"),
    )
    ported = same.unionByName(mapped.filter("_all").select("thread_id", "nodes"))
    return ported, threads.join(ported.select("thread_id"), "thread_id", "left_anti")
