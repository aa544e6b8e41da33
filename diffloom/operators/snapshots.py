"""Snapshot algebra: what changed between two listings of a file tree.

A snapshot has one row per ``(diffset_id, path)`` with ``mode`` and ``blob_id``; every function handles
all change sets at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.functions.paths import base_name
from diffloom.functions.scan import ranked
from diffloom.session import cut

# File modes and the id of the empty blob.
TREE = 0o040000
GITLINK = 0o160000
EMPTY_BLOBS = ["e69de29bb2d1d6434b8b29ae775ad8c2e48c5391", "d41d8cd98f00b204e9800998ecf8427e"]

KEY = ["diffset_id", "path"]


def diff_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that differ between two snapshots: added, deleted, modified; a file that becomes a submodule
    (or the reverse) is a deletion and an addition."""
    a = before.select(*KEY, F.col("mode").alias("old_mode"), F.col("blob_id").alias("old_id"))
    b = after.select(*KEY, F.col("mode").alias("new_mode"), F.col("blob_id").alias("new_id"))
    both = a.join(b, KEY, "full_outer").filter(
        ~(F.col("old_id").eqNullSafe(F.col("new_id")) & F.col("old_mode").eqNullSafe(F.col("new_mode")))
    )
    has_old, has_new = F.col("old_id").isNotNull(), F.col("new_id").isNotNull()
    split = has_old & has_new & ((F.col("old_mode") == GITLINK) != (F.col("new_mode") == GITLINK))
    deleted, added, modified = F.lit("deleted"), F.lit("added"), F.lit("modified")
    statuses = (
        F.when(split, F.array(deleted, added))
        .when(~has_new, F.array(deleted))
        .when(~has_old, F.array(added))
        .otherwise(F.array(modified))
    )
    rows = both.select("*", F.explode(statuses).alias("status"))
    gone, new = F.col("status") == "deleted", F.col("status") == "added"
    mode = F.when(gone, F.col("old_mode")).otherwise(F.col("new_mode"))
    return rows.select(
        *KEY,
        F.lit(None).cast("string").alias("old_path"),
        "status",
        F.when(~new, F.col("old_id")).alias("before"),
        F.when(~gone, F.col("new_id")).alias("after"),
        mode.alias("mode"),
        F.when((F.col("status") == "modified") & (F.col("old_mode") != F.col("new_mode")), F.col("old_mode"))
        .alias("old_mode"),
        (mode == GITLINK).alias("submodule"),
    )


def pair_renames(changed: DataFrame) -> DataFrame:
    """Pairs a deleted and an added file of one change set that hold the same blob. Equal base names pair
    first, by rank of path; what is left pairs by rank. Each file is used once; empty blobs and submodules
    never pair. Copies of one blob may be any share of a change set, so ranks come from ``ranked``."""
    changed = cut(changed)  # read several times below, and small beside the snapshots it came from
    able = ~F.col("submodule") & ~F.coalesce(F.col("before"), F.col("after")).isin(EMPTY_BLOBS)
    gone = changed.filter((F.col("status") == "deleted") & able).select(
        "diffset_id", F.col("before").alias("blob"), "path", "mode"
    )
    new = changed.filter((F.col("status") == "added") & able).select(
        "diffset_id", F.col("after").alias("blob"), "path", "mode"
    )
    # Only blobs with a file on both sides can pair, which is a small part of a change set.
    gone, new = (
        gone.join(new.select("diffset_id", "blob").distinct(), ["diffset_id", "blob"], "left_semi"),
        new.join(gone.select("diffset_id", "blob").distinct(), ["diffset_id", "blob"], "left_semi"),
    )
    sides = gone.withColumn("side", F.lit("a")).unionByName(new.withColumn("side", F.lit("b")))
    sides = sides.withColumn("name", base_name(F.col("path")))

    def pair(rows: DataFrame, by: list[str]) -> DataFrame:
        at = ranked(rows, ["diffset_id", "blob", *by, "side"], ["path"], "rank")
        pick = lambda side, col: F.max(F.when(F.col("side") == side, F.col(col)))
        return (
            at.groupBy("diffset_id", "blob", *by, "rank")
            .agg(
                pick("a", "path").alias("old_path"),
                pick("b", "path").alias("path"),
                pick("a", "mode").alias("a_mode"),
                pick("b", "mode").alias("b_mode"),
            )
            .filter("old_path is not null and path is not null")
            .select("diffset_id", "blob", "old_path", "path", "a_mode", "b_mode")
        )

    first = pair(sides, ["name"])
    used = first.select("diffset_id", F.col("old_path").alias("path"), F.lit("a").alias("side")).unionByName(
        first.select("diffset_id", "path", F.lit("b").alias("side"))
    )
    left = sides.join(used, ["diffset_id", "path", "side"], "left_anti")
    pairs = first.unionByName(pair(left, []))
    renamed = pairs.select(
        "diffset_id",
        "path",
        "old_path",
        F.lit("renamed").alias("status"),
        F.col("blob").alias("before"),
        F.col("blob").alias("after"),
        F.col("b_mode").alias("mode"),
        F.when(F.col("a_mode") != F.col("b_mode"), F.col("a_mode")).alias("old_mode"),
        F.lit(False).alias("submodule"),
    )
    taken = renamed.select("diffset_id", F.col("old_path").alias("path"), F.lit("deleted").alias("status"))
    taken = taken.unionByName(renamed.select("diffset_id", "path", F.lit("added").alias("status")))
    rest = changed.join(taken, ["diffset_id", "path", "status"], "left_anti")
    return rest.select(*renamed.columns).unionByName(renamed)


def flatten_trees(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Every file under each root, keyed by its path. ``roots`` has ``(snapshot_id, tree_id)``; level by
    level, one join per level of the deepest tree. A broken table in which a tree holds itself ends that way
    down where its id comes round again."""
    level = roots.select("snapshot_id", "tree_id", F.lit("").alias("prefix"), F.array("tree_id").alias("seen"))
    files = None
    while True:
        step = cut(
            level.join(entries, "tree_id").select(
                "snapshot_id",
                F.concat("prefix", "name").alias("path"),
                "mode",
                F.col("child_id").alias("blob_id"),
                "seen",
            )
        )
        found = step.filter(F.col("mode") != TREE).drop("seen")
        files = found if files is None else files.unionByName(found)
        trees = step.filter((F.col("mode") == TREE) & ~F.array_contains("seen", F.col("blob_id")))
        if trees.isEmpty():
            return files
        level = trees.select(
            "snapshot_id", F.col("blob_id").alias("tree_id"), F.concat("path", F.lit("/")).alias("prefix"), F.concat("seen", F.array("blob_id")).alias("seen")
        )


def diff_trees(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """``diff_snapshots`` of two trees that never descends below equal subtree ids. ``pairs`` has
    ``(diffset_id, tree_a, tree_b)``, either side null for the empty tree. A level's work is the changed
    part of the trees at that level."""
    a = entries.select(
        F.col("tree_id").alias("tree_a"), "name", F.col("mode").alias("mode_a"), F.col("child_id").alias("id_a")
    )
    b = entries.select(
        F.col("tree_id").alias("tree_b"), "name", F.col("mode").alias("mode_b"), F.col("child_id").alias("id_b")
    )
    # ``seen`` holds the pairs of trees on the way down; one that comes round again ends it.
    both = lambda x, y: F.array(F.struct(F.coalesce(x, F.lit("")).alias("a"), F.coalesce(y, F.lit("")).alias("b")))
    level = pairs.select("diffset_id", F.lit("").alias("prefix"), "tree_a", "tree_b", both(F.col("tree_a"), F.col("tree_b")).alias("seen"))
    out = None
    while True:
        left = level.join(a, "tree_a").select("diffset_id", "prefix", "name", "mode_a", "id_a", F.col("seen").alias("seen_a"))
        right = level.join(b, "tree_b").select("diffset_id", "prefix", "name", "mode_b", "id_b", F.col("seen").alias("seen_b"))
        step = left.join(right, ["diffset_id", "prefix", "name"], "full_outer").filter(
            ~(F.col("id_a").eqNullSafe(F.col("id_b")) & F.col("mode_a").eqNullSafe(F.col("mode_b")))
        )
        step = cut(step.withColumn("path", F.concat("prefix", "name")).withColumn("seen", F.coalesce("seen_a", "seen_b")).drop("seen_a", "seen_b"))
        tree_a, tree_b = (F.coalesce(F.col(m) == TREE, F.lit(False)) for m in ("mode_a", "mode_b"))
        found = step.select(
            "diffset_id",
            "path",
            F.when(~tree_a, F.col("mode_a")).alias("mode_a"),
            F.when(~tree_a, F.col("id_a")).alias("id_a"),
            F.when(~tree_b, F.col("mode_b")).alias("mode_b"),
            F.when(~tree_b, F.col("id_b")).alias("id_b"),
        ).filter("id_a is not null or id_b is not null")
        out = found if out is None else out.unionByName(found)
        down_a, down_b = F.when(tree_a, F.col("id_a")), F.when(tree_b, F.col("id_b"))
        deeper = step.filter((tree_a | tree_b) & ~F.arrays_overlap("seen", both(down_a, down_b)))
        if deeper.isEmpty():
            break
        level = deeper.select(
            "diffset_id",
            F.concat("path", F.lit("/")).alias("prefix"),
            down_a.alias("tree_a"),
            down_b.alias("tree_b"),
            F.concat("seen", both(down_a, down_b)).alias("seen"),
        )
    before = out.filter("id_a is not null").select("diffset_id", "path", F.col("mode_a").alias("mode"), F.col("id_a").alias("blob_id"))
    after = out.filter("id_b is not null").select("diffset_id", "path", F.col("mode_b").alias("mode"), F.col("id_b").alias("blob_id"))
    changed = diff_snapshots(before, after)
    # A submodule that moves to another commit reads as removed and added again in a tree diff.
    bumped = (F.col("status") == "modified") & F.col("submodule")
    split = F.when(bumped, F.array(F.lit("deleted"), F.lit("added"))).otherwise(F.array("status"))
    rows = changed.withColumn("status", F.explode(split))
    return rows.withColumn(
        "before", F.when(F.col("status") != "added", F.col("before"))
    ).withColumn("after", F.when(F.col("status") != "deleted", F.col("after")))


def combined_changes(by_parent: DataFrame, parents: DataFrame) -> DataFrame:
    """A merge's first-parent changes whose path changed against every parent. ``by_parent`` has one row
    per ``(commit, parent_no, path)``, ``parents`` one per commit with ``n_parents``."""
    everywhere = by_parent.groupBy("commit", "path").agg(F.countDistinct("parent_no").alias("_n"))
    kept = everywhere.join(parents, "commit").filter("_n = n_parents").select("commit", "path")
    return by_parent.filter("parent_no = 1").join(kept, ["commit", "path"], "left_semi")


def resolve_before(changes: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The base blob of every change that has a before side, looked up at its old path; a miss goes to
    the second table."""
    sides = changes.withColumn("_at", F.coalesce("old_path", "path"))
    known = base.select("diffset_id", F.col("path").alias("_at"), F.col("blob_id").alias("base_blob"))
    found = sides.join(known, ["diffset_id", "_at"], "left")
    needs = F.col("status") != "added"
    columns = [*changes.columns, "base_blob"]
    ok = found.filter(~needs | F.col("base_blob").isNotNull()).withColumn(
        "base_blob", F.when(needs, F.col("base_blob"))
    )
    return ok.select(*columns), found.filter(needs & F.col("base_blob").isNull()).select(
        *changes.columns, F.col("_at").alias("missing_path")
    )


def merge_type_changes(changes: DataFrame) -> DataFrame:
    """A deletion and an addition of one path become one change, their line counts added."""
    lone = F.col("old_path").isNull() & (F.col("before").isNull() | F.col("after").isNull())
    rest = changes.filter(~lone)
    merged = (
        changes.filter(lone)
        .groupBy("diffset_id", "path")
        .agg(
            F.lit(None).cast("string").alias("old_path"),
            F.max("before").alias("before"),
            F.max("after").alias("after"),
            F.sum("added").alias("added"),
            F.sum("removed").alias("removed"),
        )
    )
    return rest.select(*merged.columns).unionByName(merged)


def all_paths(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct paths of two iterations, old names included."""

    def names(df: DataFrame) -> DataFrame:
        return df.select("diffset_id", F.explode(F.array("path", "old_path")).alias("path"))

    return names(a).union(names(b)).filter("path is not null").distinct()


def common_paths(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY).intersect(b.select(*KEY))


def changed_ids(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Ids present on one side only, with ``kind`` added or removed."""
    x = a.select(*keys).distinct().withColumn("_a", F.lit(1))
    y = b.select(*keys).distinct().withColumn("_b", F.lit(1))
    return (
        x.join(y, keys, "full_outer")
        .filter("_a is null or _b is null")
        .select(*keys, F.when(F.col("_a").isNull(), "added").otherwise("removed").alias("kind"))
    )


def sort_changes(changes: DataFrame) -> DataFrame:
    """Change sets in path order. A range partitioning, not one task."""
    return changes.orderBy("diffset_id", "path", "status")
