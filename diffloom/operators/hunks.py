"""From an alignment to rows, hunks and their bookkeeping.

Every window here is over the lines of one file pair, bounded by its texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffloom.functions import text as T
from diffloom.session import cut

CONTEXT = 3
EXPAND_STEP = 20
WORDY = r"[\p{L}\p{N}_]"


def diff_rows(aligned: DataFrame, by: list[str]) -> DataFrame:
    """One row per line of the merged view, ``row_no`` from 1: a pair once, then the removed and the added
    lines of the gap after it. ``op`` is ' ', '-' or '+'."""
    kept = F.col("mate").isNotNull()
    rows = aligned.filter("side = 'b' or mate is null or side = 'a'").filter(~(kept & (F.col("side") == "b")))
    op = F.when(kept, " ").when(F.col("side") == "a", "-").otherwise("+")
    rank = F.when(kept, 0).when(F.col("side") == "a", 1).otherwise(2)
    order = Window.partitionBy(*by).orderBy("gap", "_rank", "line_no")
    extra = [c for c in aligned.columns if c not in {*by, "side", "line_no", "mate", "gap"}]
    return (
        rows.withColumn("op", op)
        .withColumn("_rank", rank)
        .withColumn("row_no", F.row_number().over(order))
        .select(
            *by,
            "row_no",
            "op",
            "gap",
            F.when(F.col("side") == "a", F.col("line_no")).alias("line_a"),
            F.when(F.col("side") == "a", F.col("mate")).otherwise(F.col("line_no")).alias("line_b"),
            *extra,
        )
    )


def rescue_marks(lines: DataFrame) -> DataFrame:
    """Lines with no more of their text and key than ``rescue_lines`` asks: whether a word is in it, whether the key is
    empty, and which key it is."""
    word = F.when(F.col("text").rlike(WORDY), "w").otherwise("")
    return lines.withColumns({"text": word, "key": F.when(F.col("key") == "", "").otherwise(F.base64(F.unhex(F.md5("key"))))})


def rescue_lines(rows: DataFrame, by: list[str]) -> DataFrame:
    """Inside a hunk, equal word-bearing lines that pair in order read as context. ``rows`` are diff rows
    with ``key`` and ``text``; a hunk is the run of changed lines of one gap. Returns the pairs."""
    from diffloom.operators.align import align_lines

    changed = rows.filter("op <> ' '").filter(F.col("text").rlike(WORDY) | (F.col("key") == ""))
    side = F.when(F.col("op") == "-", "a").otherwise("b")
    # A key is as long as its line; its hash says as much. The lines and the alignment are each read twice.
    lines = changed.select(
        *by, "gap", side.alias("side"), F.coalesce("line_a", "line_b").alias("_line"), F.unhex(F.md5("key")).alias("key")
    )
    nth = Window.partitionBy(*by, "gap", "side").orderBy("_line")
    lines = cut(lines.withColumn("line_no", F.row_number().over(nth)).withColumnRenamed("gap", "hunk"))
    mated = cut(align_lines(lines, [*by, "hunk"], keep_key=False))
    a = mated.filter("side = 'a' and mate is not null").select(*by, "hunk", F.col("_line").alias("line_a"), F.col("mate").alias("_m"))
    b = mated.filter("side = 'b'").select(*by, "hunk", F.col("_line").alias("line_b"), F.col("line_no").alias("_m"))
    return a.join(b, [*by, "hunk", "_m"]).select(*by, "hunk", "line_a", "line_b")


def fragments(rows: DataFrame, by: list[str], context: int = CONTEXT) -> DataFrame:
    """Hunks with ``context`` lines around them: ``diff``, ``unchanged`` and ``elided`` runs in order. A run
    of blank lines gained or lost opens no context, and one hidden line is never elided."""
    changed = F.col("op") != " "
    gap = Window.partitionBy(*by, "gap")
    order = Window.partitionBy(*by).orderBy("row_no")
    near = order.rowsBetween(-context, context)
    solid_change = F.max(F.when(changed & (F.col("key") != ""), 1).otherwise(0)).over(gap)
    marked = rows.withColumn("_loud", F.when(changed, solid_change).otherwise(0)).withColumn(
        "_near", F.max("_loud").over(near)
    )
    state = F.when(changed, "d").when(F.col("_near") == 1, "u").otherwise("e")
    marked = marked.withColumn("_state", state)
    marked = marked.withColumn(
        "_start", (F.coalesce(F.lag("_state").over(order), F.lit("")) != F.col("_state")).cast("int")
    ).withColumn("frag_no", F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # Lines of a side before the run place an empty side.
    marked = marked.withColumn(
        "_seen_a", F.count("line_a").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("_seen_b", F.count("line_b").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.count(F.lit(1))
    return (
        marked.groupBy(*by, "frag_no")
        .agg(
            F.min("_state").alias("_state"),
            (F.max("_seen_a") - F.count("line_a") + 1).alias("before_start"),
            F.count("line_a").alias("before_n"),
            (F.max("_seen_b") - F.count("line_b") + 1).alias("after_start"),
            F.count("line_b").alias("after_n"),
            n.alias("_n"),
        )
        .withColumn(
            "kind",
            F.when(F.col("_state") == "d", "diff")
            .when((F.col("_state") == "e") & (F.col("_n") > 1), "elided")
            .otherwise("unchanged"),
        )
        .select(*by, "frag_no", "kind", "before_start", "before_n", "after_start", "after_n")
    )


def line_stats(rows: DataFrame, by: list[str]) -> DataFrame:
    """Added and removed lines per file, from diff rows or patch lines."""
    return rows.groupBy(*by).agg(
        F.count(F.when(F.col("op") == "+", 1)).alias("added"),
        F.count(F.when(F.col("op") == "-", 1)).alias("removed"),
    )


def merge_ranges(ranges: DataFrame, by: list[str]) -> DataFrame:
    """Half-open ranges of one text, overlapping and touching ones joined, empty ones dropped."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = ranges.filter("end > start").select(*by, "start", "end").withColumn("_reach", reach)
    fresh = F.when(F.col("_reach") >= F.col("start"), 0).otherwise(1)
    rows = rows.withColumn("_fresh", fresh).withColumn(
        "_run", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    return rows.groupBy(*by, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def paint_ranges(ranges: DataFrame, lines: DataFrame, by: list[str]) -> DataFrame:
    """Merged ranges cut at line ends with indentation left out, and joined across spaces on a line.

    ``lines`` has ``start`` (offset of the line's first character) and ``text`` (without its newline).
    """
    span = lines.select(*by, F.col("start").alias("_ls"), (F.col("start") + F.length("text")).alias("_le"), "text")
    merged = merge_ranges(ranges, by)
    # A merged range and a line meet once per line it covers; both tables are disjoint and ordered, so the
    # running maximum of starts finds the line a range begins in without comparing all of them.
    begins = merged.select(*by, F.col("start").alias("_at"), "start", "end", F.lit(None).cast("bigint").alias("_ls"),
                           F.lit(None).cast("bigint").alias("_le"), F.lit(None).cast("string").alias("text"), F.lit(1).alias("_o"))
    rows = span.select(*by, F.col("_ls").alias("_at"), F.lit(None).cast("bigint").alias("start"),
                       F.lit(None).cast("bigint").alias("end"), "_ls", "_le", "text", F.lit(0).alias("_o"))
    order = Window.partitionBy(*by).orderBy("_at", "_o")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    events = rows.unionByName(begins)
    last = lambda c: F.last(c, ignorenulls=True).over(upto)
    first_line = events.withColumn("_fl", last("_ls")).withColumn("_fe", last("_le")).withColumn("_ft", last("text"))
    # The range's first line, from the range's own row; its later lines, from theirs.
    head = first_line.filter("_o = 1").select(*by, "start", "end", F.col("_fl").alias("_ls"), F.col("_fe").alias("_le"), F.col("_ft").alias("text"), F.lit(True).alias("_head"))
    tail = events.withColumn("_rs", last("start")).withColumn("_re", last("end")).filter(
        "_o = 0 and _rs < _ls and _re > _ls"
    ).select(*by, F.col("_rs").alias("start"), F.col("_re").alias("end"), "_ls", "_le", "text", F.lit(False).alias("_head"))
    indent = F.length(F.regexp_extract("text", r"^([ \t]*)", 1))
    pieces = head.unionByName(tail).select(
        *by,
        F.when(F.col("_head"), F.col("start")).otherwise(F.col("_ls") + indent).alias("start"),
        F.least("end", "_le").alias("end"),
        "_ls",
        "text",
    ).filter("end > start")
    row = Window.partitionBy(*by, "_ls").orderBy("start")
    prev = F.lag("end").over(row)
    between = F.substring(F.col("text"), (prev - F.col("_ls") + 1).cast("int"), (F.col("start") - prev).cast("int"))
    joins = prev.isNotNull() & between.rlike(r"^[ \t]*$")
    pieces = pieces.withColumn("_fresh", F.when(joins, 0).otherwise(1)).withColumn(
        "_run", F.sum("_fresh").over(row.rowsBetween(Window.unboundedPreceding, 0))
    )
    return pieces.groupBy(*by, "_ls", "_run").agg(
        F.min("start").alias("start"), F.max("end").alias("end")
    ).select(*by, "start", "end")


def marked_lines(ranges: DataFrame, by: list[str]) -> DataFrame:
    """Distinct lines that changed or moved ranges cover; ``start`` and ``end`` count lines, half-open."""
    return merge_ranges(ranges, by).groupBy(*by).agg(F.sum(F.col("end") - F.col("start")).alias("marked"))


FUNCNAME = r"^[\p{L}\p{Nl}_$]"


def funcnames(lines: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``scope``: the last unindented identifier-led line at or above each line, cut to 80 characters."""
    name = F.when(
        F.col("text").rlike(FUNCNAME), F.substring(F.trim(F.regexp_replace("text", "\r$", "")), 1, 80)
    )
    upto = Window.partitionBy(*by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("scope", F.last(name, ignorenulls=True).over(upto))


def gaps(frags: DataFrame, revealed: DataFrame, by: list[str]) -> DataFrame:
    """What each elided run still hides after ``revealed`` lines (``frag_no, top, bottom``)."""
    order = Window.partitionBy(*by).orderBy("frag_no")
    rows = frags.withColumn("_next", F.lead("after_start").over(order)).filter("kind = 'elided'")
    shown = revealed.groupBy(*by, "frag_no").agg(F.sum("top").alias("top"), F.sum("bottom").alias("bottom"))
    rows = rows.join(shown, [*by, "frag_no"], "left").na.fill(0, ["top", "bottom"])
    end = F.coalesce(F.col("_next"), F.col("after_start") + F.col("after_n"))
    return rows.select(
        *by,
        "frag_no",
        (F.col("before_start") + F.col("top")).alias("before_line"),
        (F.col("after_start") + F.col("top")).alias("after_line"),
        F.greatest(end - F.col("after_start") - F.col("top") - F.col("bottom"), F.lit(0)).alias("hidden"),
        ((F.col("before_start") == 1) & (F.col("after_start") == 1)).alias("at_start"),
        F.col("_next").isNull().alias("at_end"),
        ((F.col("top") > 0) | (F.col("bottom") > 0)).alias("revealed"),
    )


def expand_gap(gap_rows: DataFrame, lines: DataFrame, by: list[str], direction: str = "down") -> DataFrame:
    """The lines one step of ``EXPAND_STEP`` reveals: from the top of a gap (``down``), its bottom (``up``)
    or ``all`` of it. A line carries the gap it falls in by a running ``last`` over the file's lines."""
    step = F.least(F.lit(EXPAND_STEP).cast("bigint"), F.col("hidden").cast("bigint"))
    first = F.col("after_line")
    wanted = {
        "down": (first, first + step),
        "up": (first + F.col("hidden") - step, first + F.col("hidden")),
        "all": (first, first + F.col("hidden")),
    }[direction]
    starts = gap_rows.filter("hidden > 0").select(
        *by, wanted[0].cast("bigint").alias("_from"), wanted[1].cast("bigint").alias("_to"), "frag_no"
    )
    # A gap is keyed by its first line, so an equi-join marks that line and the rest follow it in order.
    rows = lines.withColumn("_from", F.col("line_no").cast("bigint")).join(starts, [*by, "_from"], "left")
    upto = Window.partitionBy(*by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_to", F.last("_to", ignorenulls=True).over(upto)).withColumn(
        "frag_no", F.last("frag_no", ignorenulls=True).over(upto)
    )
    return rows.filter("line_no < _to").select(*by, "frag_no", "line_no", "text")


def fill_line_map(mapped: DataFrame, by: list[str]) -> DataFrame:
    """Fills unmapped display lines between two mapped ones when both gaps are equally long. ``mapped`` has
    ``line_no`` and ``source_line``, null where unmapped."""
    up = Window.partitionBy(*by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by).orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(F.col("source_line").isNotNull(), F.col("line_no"))
    rows = (
        mapped.withColumn("_pd", F.last(at, ignorenulls=True).over(up))
        .withColumn("_ps", F.last("source_line", ignorenulls=True).over(up))
        .withColumn("_nd", F.last(at, ignorenulls=True).over(down))
        .withColumn("_ns", F.last("source_line", ignorenulls=True).over(down))
    )
    equal = (F.col("_nd") - F.col("_pd")) == (F.col("_ns") - F.col("_ps"))
    filled = F.when(equal, F.col("_ps") + F.col("line_no") - F.col("_pd"))
    return rows.withColumn("source_line", F.coalesce("source_line", filled)).select(*mapped.columns)


def line_ratio(aligned: DataFrame, by: list[str]) -> DataFrame:
    """Twice the kept lines over the lines of both sides."""
    return aligned.groupBy(*by).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count("mate").alias("_kept"),
        (F.count("mate") / F.count(F.lit(1))).alias("ratio"),
    ).select(*by, "lines", F.col("_kept").alias("kept"), "ratio")


def drop_whitespace_edits(edits: DataFrame) -> DataFrame:
    """An edit whose two texts are equal once whitespace is dropped is no edit; a missing side is empty."""
    old, new = (T.solid(F.coalesce(F.col(c), F.lit(""))) for c in ("old_text", "new_text"))
    return edits.filter(old != new)
