"""Unified diffs: text to files, hunks and numbered lines.

A patch is one row of text; its lines are numbered and every window is over the lines of one patch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from diffloom.sources.blobs import explode_lines

HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
INDEX = r"^index ([0-9a-f]+)\.\.([0-9a-f]+)(?: (\d+))?$"
GIT = r"^diff --git "


def _group(pattern: str, group: int):
    return F.nullif(F.regexp_extract("text", pattern, group), F.lit(""))


def patch_rows(patches: DataFrame, by: str = "patch_id") -> DataFrame:
    """Every line of every patch with its file and hunk number and whether it lies in a hunk's body.

    A hunk's body ends when the counts of its header are used up, not at the next header, so a removed
    line that looks like a header stays a line. Inside one header's reach the lines' prefixes count down
    both sides by running sums.
    """
    lines = explode_lines(patches.select(by, "text"))
    order = Window.partitionBy(by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_header = F.col("text").rlike(HEADER)
    rows = lines.withColumn("_block", F.sum(is_header.cast("int")).over(order))
    block = Window.partitionBy(by, "_block").orderBy("line_no")
    upto = block.rowsBetween(Window.unboundedPreceding, 0)
    before = block.rowsBetween(Window.unboundedPreceding, -1)
    count = lambda g: F.when(
        is_header, F.coalesce(_group(HEADER, g).cast("int"), F.lit(1))
    )
    c = F.substring("text", 1, 1)
    context = (c == " ") | (F.col("text") == "")
    rows = rows.withColumns(
        {
            "_old_n": F.first(count(2), ignorenulls=True).over(upto),
            "_new_n": F.first(count(4), ignorenulls=True).over(upto),
            "_minus": F.when(~is_header & (context | (c == "-")), 1).otherwise(0),
            "_plus": F.when(~is_header & (context | (c == "+")), 1).otherwise(0),
        }
    )
    used_old = F.coalesce(F.sum("_minus").over(before), F.lit(0))
    used_new = F.coalesce(F.sum("_plus").over(before), F.lit(0))
    left = (used_old < F.col("_old_n")) | (used_new < F.col("_new_n"))
    # A header found while a body still has lines to take is a line of that body only if its prefix could
    # be one; '@' never is, so every header starts a hunk.
    body = (F.col("_block") > 0) & ~is_header & F.coalesce(left | (c == "\\"), F.lit(False))
    # Once past the body, later lines (file headers) are outside even if prefixes happen to match.
    rows = rows.withColumn("_body", body.cast("int"))
    ended = F.max(F.when(~is_header & (F.col("_body") == 0), 1).otherwise(0)).over(upto)
    rows = rows.withColumn("in_body", (F.col("_body") == 1) & (ended == 0))
    is_file = ~F.col("in_body") & F.col("text").rlike(GIT)
    rows = rows.withColumn("file_no", F.sum(is_file.cast("int")).over(order))
    hunk = Window.partitionBy(by, "file_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("hunk_no", F.sum(is_header.cast("int")).over(hunk)).select(
        by, "line_no", "text", "file_no", "hunk_no", "in_body", is_header.alias("is_header")
    )


def patch_files(rows: DataFrame, by: str = "patch_id") -> DataFrame:
    """One row per file of a patch: paths, status, blob ids, mode, binary."""
    head = rows.filter("file_no > 0 and not in_body and not is_header")
    pick = lambda value: F.max(value)
    null_blob = r"^0+$"
    git = F.when(F.col("text").rlike(GIT), F.substring("text", F.lit(12), F.length("text")))
    seen = head.groupBy(by, "file_no").agg(
        pick(git).alias("_git"),
        pick(_group(INDEX, 1)).alias("_old"),
        pick(_group(INDEX, 2)).alias("_new"),
        pick(_group(INDEX, 3)).alias("_mode"),
        pick(_group(r"^new file mode (\d+)$", 1)).alias("_added"),
        pick(_group(r"^deleted file mode (\d+)$", 1)).alias("_gone"),
        F.bool_or(F.col("text").startswith("Binary files ") | (F.col("text") == "GIT binary patch")).alias("binary"),
    )
    # Unquoted: both paths are equally long when the file kept its name; else they part at " b/".
    half = ((F.length("_git") - 1) / 2).cast("int")
    even = (F.length("_git") % 2 == 1) & (
        F.substring("_git", F.lit(3), half - 2) == F.substring("_git", half + 4, half - 2)
    )
    at = F.instr("_git", " b/")
    old = F.when(even, F.substring("_git", F.lit(3), half - 2)).otherwise(F.substring("_git", F.lit(3), at - 3))
    new = F.when(even, F.substring("_git", half + 4, half - 2)).otherwise(F.substring("_git", at + 3, F.length("_git")))
    blob = lambda c: F.when(~F.col(c).rlike(null_blob), F.col(c))
    status = (
        F.when(F.col("_gone").isNotNull(), "deleted")
        .when(F.col("_added").isNotNull(), "added")
        .when(F.col("old_path") != F.col("new_path"), "renamed")
        .otherwise("modified")
    )
    return seen.withColumns({"old_path": old, "new_path": new}).select(
        by, "file_no", "old_path", "new_path", status.alias("status"),
        blob("_old").alias("old_blob"), blob("_new").alias("new_blob"),
        F.coalesce("_added", "_mode").alias("mode"), "binary",
    )


def patch_lines(rows: DataFrame, by: str = "patch_id") -> DataFrame:
    """The lines of hunks: ``op``, their text, their numbers on both sides, and their ``position`` below
    the file's first header, later headers counted."""
    inside = rows.filter("hunk_no > 0 and (in_body or is_header)")
    c = F.substring("text", 1, 1)
    op = F.when(F.col("is_header"), "@").when(F.col("text") == "", " ").otherwise(c)
    start = lambda g: F.when(F.col("is_header"), F.regexp_extract("text", HEADER, g).cast("int"))
    size = lambda g: F.when(F.col("is_header"), F.coalesce(_group(HEADER, g).cast("int"), F.lit(1)))
    hunk = Window.partitionBy(by, "file_no", "hunk_no").orderBy("line_no")
    before = hunk.rowsBetween(Window.unboundedPreceding, -1)
    head = hunk.rowsBetween(Window.unboundedPreceding, 0)
    file = Window.partitionBy(by, "file_no").orderBy("line_no")
    numbered = inside.withColumns(
        {
            "op": op,
            "_old0": F.first(start(1), ignorenulls=True).over(head),
            "_new0": F.first(start(3), ignorenulls=True).over(head),
            "_oldn": F.first(size(2), ignorenulls=True).over(head),
            "_newn": F.first(size(4), ignorenulls=True).over(head),
            "position": F.row_number().over(file) - 1,
        }
    )
    old_used = F.coalesce(F.sum(F.col("op").isin(" ", "-").cast("int")).over(before), F.lit(0))
    new_used = F.coalesce(F.sum(F.col("op").isin(" ", "+").cast("int")).over(before), F.lit(0))
    return (
        numbered.withColumns({"_ou": old_used, "_nu": new_used})
        .filter("op <> '@'")
        .select(
            by, "file_no", "hunk_no", "line_no", "op",
            F.substring("text", F.lit(2), F.length("text")).alias("text"),
            F.when(F.col("op").isin(" ", "-"), F.col("_old0") + F.col("_ou")).alias("old_line"),
            F.when(F.col("op").isin(" ", "+"), F.col("_new0") + F.col("_nu")).alias("new_line"),
            # Where the row sits on the new side: lines it comes after.
            (F.when(F.col("_newn") == 0, F.col("_new0")).otherwise(F.col("_new0") - 1) + F.col("_nu")).alias("new_after"),
            "position",
        )
    )


def hunk_ranges(rows: DataFrame, by: str = "patch_id") -> DataFrame:
    """The covered line ranges of every hunk, per side, inclusive; an empty side covers nothing."""
    heads = rows.filter("is_header")
    side = lambda name, g: F.struct(
        F.lit(name).alias("side"),
        F.regexp_extract("text", HEADER, g).cast("int").alias("start"),
        F.coalesce(_group(HEADER, g + 1).cast("int"), F.lit(1)).alias("n"),
    )
    both = heads.select(by, "file_no", "hunk_no", F.explode(F.array(side("before", 1), side("after", 3))).alias("s"))
    return both.filter("s.n > 0").select(
        by, "file_no", "hunk_no", "s.side", "s.start", (F.col("s.start") + F.col("s.n") - 1).alias("end")
    )


def reverse_patch(after_lines: DataFrame, lines: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The old side's lines rebuilt from the new side's and the patch: ``(by, old_line, text)`` and the
    context or added lines the new side does not hold, which name a patch of another revision.

    A new line that an added row claims is dropped; the others keep their order, and removed rows go in
    after the new line they follow.
    """
    claimed = lines.filter("new_line is not null").select(
        *by, F.col("new_line").alias("line_no"), "op", F.col("text").alias("_expected")
    )
    new = after_lines.select(*by, "line_no", "text")
    joined = new.join(claimed, [*by, "line_no"], "full_outer")
    wrong = joined.filter("_expected is not null and (text is null or text <> _expected)").select(
        *by, "line_no", F.col("_expected").alias("expected"), F.col("text").alias("found")
    )
    kept = joined.filter("text is not null and coalesce(op, ' ') <> '+'").select(
        *by, F.col("line_no").alias("_at"), F.lit(0).alias("_rank"), F.lit(0).alias("_n"), "text"
    )
    removed = lines.filter("op = '-'").select(
        *by, F.col("new_after").alias("_at"), F.lit(1).alias("_rank"), F.col("line_no").alias("_n"), "text"
    )
    order = Window.partitionBy(*by).orderBy("_at", "_rank", "_n")
    rebuilt = kept.unionByName(removed).withColumn("old_line", F.row_number().over(order))
    return rebuilt.select(*by, "old_line", "text"), wrong
