"""Diffs of keyed object graphs in two versions, given as rows.

``graph`` names the project on every table; the two versions are two DataFrames of one shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffloom.operators.snapshots import changed_ids
from diffloom.session import cut


def object_paths(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """Each object's full path: its own part and its parents' up to the top, parts that are null or
    ``<group>`` left out. ``objects``: ``graph, object_id, part``; ``edges``: ``graph, parent, child``.
    A cycle ends the climb at the first object met twice. One join per level of the deepest path."""
    part = F.when(F.col("part") != "<group>", F.col("part"))
    own = objects.select("graph", F.col("object_id").alias("_at"), part.alias("_part"))
    up = edges.groupBy("graph", F.col("child").alias("_at")).agg(F.max("parent").alias("_up"))
    step = own.join(up, ["graph", "_at"], "left")
    level = cut(step.select("graph", F.col("_at").alias("object_id"), F.array(F.col("_part")).alias("parts"), F.array("_at").alias("seen"), "_up"))
    done = None
    while True:
        ended = F.col("_up").isNull() | F.array_contains("seen", F.col("_up"))
        out = level.filter(ended).select("graph", "object_id", "parts")
        done = out if done is None else done.unionByName(out)
        more = level.filter(~ended).withColumnRenamed("_up", "_at")
        if more.isEmpty():
            break
        level = cut(more.join(step.withColumnRenamed("_up", "_next"), ["graph", "_at"], "left").select(
            "graph", "object_id", F.concat(F.array("_part"), "parts").alias("parts"), F.concat("seen", F.array("_at")).alias("seen"), F.col("_next").alias("_up")))
    return done.select("graph", "object_id", F.array_join(F.filter("parts", lambda p: p.isNotNull()), "/").alias("path"))


def placements(memberships: DataFrame, phases: DataFrame, paths: DataFrame) -> DataFrame:
    """Where each build file sits: its file's path, its phase, the target that owns the phase.
    ``memberships``: ``graph, build_file, file_id, phase_id``; ``phases``: ``graph, phase_id, phase, target``."""
    return (
        memberships.join(paths.select("graph", F.col("object_id").alias("file_id"), "path"), ["graph", "file_id"], "left")
        .join(phases, ["graph", "phase_id"], "left")
        .select("graph", "build_file", F.coalesce("path", "file_id").alias("path"), "target", "phase")
    )


def _sided_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows on one side only, with the columns of the side that has them."""
    kinds = changed_ids(before, after, keys)
    gone = before.join(kinds.filter("kind = 'removed'"), keys)
    new = after.join(kinds.filter("kind = 'added'"), keys)
    return new.unionByName(gone)


def placements_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    return _sided_diff(before, after, ["graph", "build_file"])


def requirement_text(kind: Column, version: Column, branch: Column, revision: Column) -> Column:
    """What a dependency asks for: its branch, else its revision, else kind and version."""
    return F.coalesce(
        F.concat(F.lit("branch "), branch), F.concat(F.lit("revision "), revision), F.nullif(F.concat_ws(" ", kind, version), F.lit(""))
    )


def packages(products: DataFrame, references: DataFrame) -> DataFrame:
    """Dependencies by id: products with the reference they come from, and references no product uses,
    named by the last part of their address. ``products``: ``graph, package_id, name, reference_id``;
    ``references``: ``graph, reference_id, url, kind, version, branch, revision``."""
    asked = requirement_text(F.col("kind"), F.col("version"), F.col("branch"), F.col("revision"))
    known = references.select("graph", "reference_id", "url", asked.alias("requirement"))
    used = products.join(known, ["graph", "reference_id"], "left").select("graph", "package_id", "name", "url", "requirement")
    alone = known.join(products.select("graph", "reference_id"), ["graph", "reference_id"], "left_anti")
    name = F.regexp_replace(F.substring_index("url", "/", -1), r"\.git$", "")
    alone = alone.select("graph", F.col("reference_id").alias("package_id"), F.coalesce(name, "reference_id").alias("name"), "url", "requirement")
    return used.unionByName(alone)


def packages_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    return _sided_diff(before, after, ["graph", "package_id"])


def targets_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Targets gained or lost, and phases gained or lost in targets both sides have. Rows:
    ``graph, target_id, target, phase_id, phase``, a target without phases with nulls."""
    keys = ["graph", "target_id"]
    one = lambda df: df.groupBy(*keys).agg(F.max("target").alias("target"))
    whole = _sided_diff(one(before), one(after), keys).select(*keys, "target", F.lit(None).cast("string").alias("phase"), "kind")
    both = one(before).select(*keys).join(one(after).select(*keys), keys)
    phases = lambda df: df.filter("phase_id is not null").join(both, keys, "left_semi").select(*keys, "phase_id", "target", "phase")
    inner = _sided_diff(phases(before), phases(after), [*keys, "phase_id"]).select(*keys, "target", "phase", "kind")
    return whole.unionByName(inner)


def setting_tokens(value: Column) -> Column:
    """A setting's words: a list's own, or a string's, quotes kept together and dropped at the ends."""
    words = F.regexp_extract_all(value["text"], F.lit(r"""(?:[^\s"']+|"[^"]*"|'[^']*')+"""), F.lit(0))
    bare = lambda w: F.regexp_replace(w, r"""^(?:"(.*)"|'(.*)')$""", "$1$2")
    split = lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"""(?:[^\s"']+|"[^"]*"|'[^']*')+"""), F.lit(0)), bare)
    return F.when(value["list"].isNotNull(), F.flatten(F.transform(value["list"], split))).otherwise(F.transform(words, bare))


def settings_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Settings that differ per ``(graph, target, configuration, key)`` in configurations both sides have.
    ``settings`` is a map to ``struct<text, list>``. A list that became a string of the same words, or the
    reverse, is ``noise``."""
    keys = ["graph", "target", "configuration"]
    both = before.select(*keys).join(after.select(*keys), keys)

    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.join(both, keys, "left_semi").select(*keys, F.explode("settings").alias("key", name))

    joined = rows(before, "b").join(rows(after, "a"), [*keys, "key"], "full_outer").filter("not (b <=> a)")
    shown = lambda v: F.coalesce(v["text"], F.array_join(v["list"], " "), F.lit(""))
    is_list = lambda v: v["list"].isNotNull()
    noise = (is_list(F.col("b")) != is_list(F.col("a"))) & setting_tokens(F.col("b")).eqNullSafe(setting_tokens(F.col("a")))
    present = F.col("a").isNotNull() & F.col("b").isNotNull()
    return joined.select(*keys, "key", shown(F.col("b")).alias("before"), shown(F.col("a")).alias("after"), (present & noise).alias("noise"))


def project_summary(objects: DataFrame, configurations: DataFrame) -> DataFrame:
    """A new project as counts: targets, files, settings."""
    counts = objects.groupBy("graph").agg(F.count_if(F.col("isa") == "target").alias("targets"), F.count_if(F.col("isa") == "file").alias("files"))
    settings = configurations.groupBy("graph").agg(F.sum(F.size("settings")).alias("settings"))
    return counts.join(settings, "graph", "left").na.fill(0, ["settings"])
