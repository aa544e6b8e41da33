"""Review state: marks, rollups, approval, threads.

``marks`` is a log of writes ``(key, wall, logical, device, ...)``. ``outline`` has one row per node of a
change set: ``diffset_id, path, frag_no, side, node_no, parent`` (node_no of the parent, -1 at the top),
``key`` (the node's score key) and ``atom`` (the edit it is, or null). Scores and viewed marks join by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffloom.functions.keys import stamp_order
from diffloom.functions.scan import ranked
from diffloom.operators.walks import to_ends
from diffloom.session import cut

PLACED_PREFIX = r"^Lines? (\d+)(?:-(\d+))? \((before|after)\):\n\n"  # fixed value: how a moved comment names its lines


def lww_state(marks: DataFrame, value: str, keys: list[str] = ["key"], rank: Column | None = None) -> DataFrame:  # noqa: B006
    """The last write per key: larger clock, then device, then rank. An aggregate, so any order, split or
    repetition of the log gives the same state, and a hot key combines before the shuffle."""
    order = stamp_order(F.col("wall"), F.col("logical"), F.col("device"), F.col(value).cast("int") if rank is None else rank)
    last = F.max_by(F.struct(value, "wall", "logical", "device"), order)
    return marks.groupBy(*keys).agg(last.alias("_e")).select(*keys, "_e.*")


def assign_hlc(writes: DataFrame, by: str = "device", order: str = "seq", received: str | None = None, logical: str = "logical") -> DataFrame:
    """A hybrid clock reading per row of a device: the largest wall clock seen so far, and how many writes have passed
    since it was reached. With ``received``, rows that are true there are stamps of other devices (``wall``,
    ``logical``), which move the clock past themselves: of one wall clock, the writes so far on top of the received
    stamp that reaches furthest. Devices may be of any size, so all of it is spread scans."""
    from diffloom.functions.scan import running

    top = running(writes, [by], [order], {"hlc_wall": ("max", F.col("wall"))})
    if received is None:
        numbered = ranked(top, [by, "hlc_wall"], [order], "_n")
        return numbered.withColumn("hlc_logical", (F.col("_n") - 1).cast("int")).drop("_n")
    told = F.coalesce(F.col(received), F.lit(False))
    ticks = running(top, [by, "hlc_wall"], [order], {"_n": ("sum", F.when(told, 0).otherwise(1).cast("bigint"))})
    ahead = F.when(told & (F.col("wall") == F.col("hlc_wall")), F.coalesce(logical, F.lit(0)) - F.col("_n")).otherwise(-1)
    reach = running(ticks, [by, "hlc_wall"], [order], {"_m": ("max", ahead.cast("bigint"))})
    return reach.withColumn("hlc_logical", (F.col("_n") + F.greatest(F.col("_m"), F.lit(-1))).cast("int")).drop("_n", "_m")


def atom_index(outline: DataFrame) -> DataFrame:
    """Distinct atoms per change set, numbered by first occurrence, with how often and where they occur."""
    place = F.struct("path", "frag_no", "side", "node_no")
    atoms = outline.filter("atom is not null").groupBy("diffset_id", "atom").agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("occurrences"), F.countDistinct("path").alias("files"),
        F.countDistinct("path", "frag_no").alias("hunks"),
    )
    return ranked(atoms, ["diffset_id"], ["first", "atom"], "atom_no")


def viewed_rollup(outline: DataFrame, viewed: DataFrame, level: list[str]) -> DataFrame:
    """Whether everything beneath a target is viewed; null when it holds no atom. ``level`` names the
    target: the file, the hunk or the node. ``viewed`` has one row per ``(atom, viewed)``."""
    state = outline.join(viewed.select("atom", "viewed"), "atom", "left")
    seen = F.when(F.col("atom").isNotNull(), F.coalesce("viewed", F.lit(False)))
    return state.groupBy(*level).agg(F.bool_and(seen).alias("viewed"))


def covered_atoms(outline: DataFrame, scored: DataFrame) -> DataFrame:
    """``(diffset_id, atom)`` of the atoms that a scored node holds: the way up from an atom's node ends at the nearest
    scored node, or where the outline does. Ways are followed by pointer jumping, so their number of rounds is the log
    of the depth. Nodes are numbered in document order, parents first; a parent that is not below its node's number
    belongs to a broken outline and ends the way. ``scored`` has the nodes' places."""
    place = lambda n: F.struct("diffset_id", "path", "frag_no", "side", F.col(n).alias("node_no"))
    stops = cut(scored.select(place("node_no").alias("at")).distinct())
    there = outline.select(place("node_no").alias("to")).distinct()
    ways = outline.filter("parent >= 0 and parent < node_no").select(place("node_no").alias("at"), place("parent").alias("to")).distinct()
    ends = to_ends(ways.join(stops, "at", "left_anti").join(there, "to", "left_semi").select("at", "to", F.lit(1).alias("steps")))
    atoms = outline.filter("atom is not null").select("diffset_id", "atom", place("node_no").alias("at")).join(ends.select("at", "end"), "at", "left")
    return atoms.select("diffset_id", "atom", F.coalesce("end", "at").alias("at")).join(stops, "at", "left_semi").select("diffset_id", "atom").distinct()


def approval(outline: DataFrame, scores: DataFrame, viewed: DataFrame) -> DataFrame:
    """A change set's approval: the least score on its nodes, and how many of its edits were read. An edit
    is read when a scored node holds it, or when it is viewed. A viewed edit no score covers caps the least
    score at +1, unless it is a row atom (its id begins ``row:``). ``scores`` has ``(key, score)`` with
    null for a cleared one; marks of other iterations match no key."""
    where = ["diffset_id", "path", "frag_no", "side", "node_no"]
    scored = cut(outline.join(scores.filter("score is not null").select("key", "score"), "key").select(*where, "score"))
    least = scored.groupBy("diffset_id").agg(F.min("score").alias("least"))
    covered = covered_atoms(outline, scored).withColumn("covered", F.lit(True))
    atoms = outline.filter("atom is not null").select("diffset_id", "atom").distinct()
    return _judged(outline.select("diffset_id").distinct(), atoms, least, covered, viewed)


def _judged(sets: DataFrame, atoms: DataFrame, least: DataFrame, covered: DataFrame, viewed: DataFrame) -> DataFrame:
    """The approval of every set from its atoms, its least score and the atoms that scored nodes hold."""
    state = atoms.join(covered, ["diffset_id", "atom"], "left").join(viewed.select("atom", "viewed"), "atom", "left")
    is_covered, is_viewed = F.coalesce("covered", F.lit(False)), F.coalesce("viewed", F.lit(False))
    caps = is_viewed & ~is_covered & ~F.col("atom").startswith("row:")
    counts = state.groupBy("diffset_id").agg(
        F.count(F.lit(1)).alias("edits"), F.count(F.when(is_covered | is_viewed, 1)).alias("read"), F.bool_or(caps).alias("_caps")
    )
    rows = sets.join(counts, "diffset_id", "left").join(least, "diffset_id", "left").na.fill(0, ["edits", "read"])
    heaviest = F.when(F.col("_caps"), F.least(F.coalesce("least", F.lit(1)), F.lit(1))).otherwise(F.col("least"))
    rows = rows.withColumn("heaviest", heaviest)
    state_ = (
        F.when(F.col("heaviest") == -2, "blocked")
        .when((F.col("heaviest") == 2) & (F.col("edits") > 0) & (F.col("read") == F.col("edits")), "approved")
        .otherwise("pending")
    )
    return rows.select("diffset_id", state_.alias("state"), "heaviest", "read", "edits")


class ApprovalIndex:
    """What an approval asks of an outline, for callers that judge one outline by many states of its marks: which keys a
    change set has, which atoms, and which keys stand on the way up from an atom. Ways are made once, by doubling, so
    their number of rounds is the log of the depth; a judgement joins marks to distinct keys and walks no outline."""

    def __init__(self, outline: DataFrame) -> None:
        place = lambda n: F.struct(F.xxhash64("diffset_id", "path", "frag_no", "side", n), F.xxhash64(F.lit(1), "diffset_id", "path", "frag_no", "side", n))
        up = F.when((F.col("parent") >= 0) & (F.col("parent") < F.col("node_no")), place("parent"))
        nodes = cut(outline.select("diffset_id", "atom", "key", place("node_no").alias("at"), up.alias("to")))
        reach = nodes.filter("atom is not null").select("diffset_id", "atom", "at")
        hops = nodes.filter("to is not null").select("at", "to").distinct()
        while not hops.isEmpty():
            reach = cut(reach.unionByName(reach.join(hops, "at").select("diffset_id", "atom", F.col("to").alias("at"))))
            hops = cut(hops.join(hops.select(F.col("at").alias("to"), F.col("to").alias("_to")), "to").select("at", F.col("_to").alias("to")))
        keyed = nodes.filter("key is not null").select("at", "key").distinct()
        self.holders = cut(reach.join(keyed, "at").select("diffset_id", "atom", "key").distinct())
        self.keys = cut(nodes.filter("key is not null").select("diffset_id", "key").distinct())
        self.atoms = cut(nodes.filter("atom is not null").select("diffset_id", "atom").distinct())
        self.sets = cut(nodes.select("diffset_id").distinct())

    def asked(self) -> DataFrame:
        """``(diffset_id, key)``: the keys of the marks that a set's approval depends on."""
        return self.keys.union(self.atoms).distinct()

    def approval(self, sets: DataFrame, scores: DataFrame, viewed: DataFrame) -> DataFrame:
        """``approval`` of the given ``sets`` (diffset_id)."""
        of = lambda df: df.join(sets, "diffset_id", "left_semi")
        given = scores.filter("score is not null").select("key", "score")
        least = of(self.keys).join(given, "key").groupBy("diffset_id").agg(F.min("score").alias("least"))
        covered = of(self.holders).join(given.select("key"), "key", "left_semi").select("diffset_id", "atom").distinct()
        return _judged(of(self.sets), of(self.atoms), least, covered.withColumn("covered", F.lit(True)), viewed)


def review_event(state: Column) -> Column:
    return F.when(state == "blocked", "REQUEST_CHANGES").when(state == "approved", "APPROVE").otherwise("COMMENT")


def progress(files: DataFrame, viewed_files: DataFrame) -> DataFrame:
    """Files viewed of all, tests counted apart. ``viewed_files`` is the file rollup; ``files`` has ``is_test``."""
    rows = files.join(viewed_files, ["diffset_id", "path"], "left")
    seen = F.coalesce("viewed", F.lit(False))
    return rows.groupBy("diffset_id").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(seen).alias("viewed"),
        F.count_if("is_test").alias("test_files"), F.count_if(F.col("is_test") & seen).alias("tests_viewed"),
    )


def viewed_everywhere(touches: DataFrame, seen: DataFrame) -> DataFrame:
    """Whether a path is viewed in every commit that touches it: false if one shows it unviewed, null while
    one was never drawn. ``seen`` has ``(review_id, commit, path, viewed)`` for the drawn commits."""
    rows = touches.join(seen, ["review_id", "commit", "path"], "left")
    return rows.groupBy("review_id", "path").agg(
        F.when(F.bool_or(F.col("viewed") == F.lit(False)), F.lit(False))
        .when(F.count_if(F.col("viewed").isNull()) > 0, F.lit(None).cast("boolean"))
        .otherwise(F.lit(True)).alias("viewed")
    )


def row_atoms(changed_lines: DataFrame, outline: DataFrame, by: list[str]) -> DataFrame:
    """Changed lines that hold text and no atom node covers, each an atom of its own. ``outline`` has the
    atom nodes' ``first, last`` lines; a running furthest end over lines and node starts of one file says
    which lines are covered. ``changed_lines`` has ``line_no, text``."""
    none = F.lit(None)
    lines = changed_lines.filter(F.trim("text") != "").select(*by, "line_no", "text", none.cast("int").alias("_last"))
    nodes = outline.select(*by, F.col("first").alias("line_no"), none.cast("string").alias("text"), F.col("last").cast("int").alias("_last"))
    upto = Window.partitionBy(*by).orderBy("line_no", F.col("text").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.unionByName(nodes).withColumn("_reach", F.max("_last").over(upto))
    free = rows.filter("text is not null and (_reach is null or _reach < line_no)")
    return free.select(*by, "line_no", F.concat(F.lit("row:"), F.md5(F.concat_ws("\u0000", *by, "text"))).alias("atom"))


def review_state(notes: DataFrame) -> DataFrame:
    """Notes per thread: how many, how many pending, and whether a review is under way there."""
    thread = F.coalesce("thread_id", "note_id")
    return notes.groupBy("review_id", thread.alias("thread")).agg(
        F.count(F.lit(1)).alias("notes"), F.count_if("pending").alias("pending"), F.bool_or("pending").alias("reviewing")
    )


AXES = ["necessity", "clarity", "consistency"]  # fixed values: the request axes


def axis_scores(comments: DataFrame) -> DataFrame:
    """Every axis of a verdict: -1 where a change was requested, +1 where a read claim covers the node,
    null where nobody read it. ``comments`` has ``node_key, read, requests``."""
    nodes = comments.groupBy("node_key").agg(
        F.bool_or(F.coalesce("read", F.lit(False))).alias("read"), *[F.bool_or(F.array_contains("requests", a)).alias(f"_{a}") for a in AXES]
    )
    axes = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"_{a}").alias("requested")) for a in AXES]))
    rows = nodes.select("node_key", "read", axes.alias("_x"))
    return rows.select("node_key", F.col("_x.axis").alias("axis"), F.when(F.col("_x.requested"), -1).when(F.col("read"), 1).alias("score"))


def review_queue(outline: DataFrame, reviewers: DataFrame, viewed: DataFrame) -> DataFrame:
    """What each reviewer has left to read, in document order: one stop per atom and hunk, on its first
    side. ``viewed`` has ``(reviewer, atom)``; ``reviewers`` ``(reviewer, diffset_id)``."""
    stops = outline.filter("atom is not null").groupBy("diffset_id", "path", "frag_no", "atom").agg(
        F.min(F.struct(F.when(F.col("side") == "before", 0).otherwise(1).alias("o"), "node_no")).alias("_s")
    )
    rows = reviewers.join(stops, "diffset_id").join(viewed, ["reviewer", "atom"], "left_anti")
    rows = rows.select("reviewer", "diffset_id", "path", "frag_no", "atom", F.col("_s.o").alias("side_no"), F.col("_s.node_no").alias("node_no"))
    return ranked(rows, ["reviewer"], ["diffset_id", "path", "frag_no", "side_no", "node_no"], "place")


def next_stop(outline: DataFrame, reviewers: DataFrame, viewed: DataFrame, at: DataFrame) -> DataFrame:
    """The first stop of ``review_queue`` past a position ``(reviewer, diffset_id, path, frag_no)``. The queue itself is not
    needed: tasks keep the least place past the position per reviewer and atom, and only these meet the viewed atoms."""
    here = at.select("reviewer", F.col("diffset_id").alias("_set"), F.struct("diffset_id", "path", "frag_no").alias("_at"))
    ahead = cut(reviewers.select("reviewer", "diffset_id").distinct().join(here, "reviewer").filter("diffset_id >= _set").drop("_set"))
    place = F.struct("path", "frag_no", F.when(F.col("side") == "before", 0).otherwise(1).alias("o"), "node_no")
    past = outline.filter("atom is not null").join(ahead, "diffset_id").filter(F.struct("diffset_id", "path", "frag_no") > F.col("_at"))
    first = past.groupBy("reviewer", "diffset_id", "atom").agg(F.min(place).alias("_p")).join(viewed, ["reviewer", "atom"], "left_anti")
    best = first.groupBy("reviewer").agg(F.min(F.struct("diffset_id", "_p", "atom")).alias("_n"))
    return best.select("reviewer", "_n.diffset_id", F.col("_n._p.path").alias("path"), F.col("_n._p.frag_no").alias("frag_no"), F.col("_n.atom").alias("atom"))


# --- threads -----------------------------------------------------------------------------------------


def build_threads(comments: DataFrame, at: DataFrame) -> DataFrame:
    """Flat review comments grouped under their roots, with the line each thread has at a commit. ``at``
    has ``(diffset_id, commit, is_head, left_is_before)``; a thread with no line there drops out."""
    root = F.coalesce("in_reply_to_id", "id")
    replies = comments.withColumn("root", root)
    threads = replies.groupBy("diffset_id", "root").agg(
        F.count(F.lit(1)).alias("comments"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "author"))), lambda c: c["author"]), ",").alias("authors"),
        F.min_by("id", F.struct(F.col("id") != F.col("root"), "id")).alias("_root_id"),
    )
    heads = comments.select("diffset_id", F.col("id").alias("_root_id"), "path", "line", "side", "original_line", "original_commit_id")
    rows = threads.join(heads, ["diffset_id", "_root_id"]).join(at, "diffset_id")
    line = F.when(F.col("original_commit_id") == F.col("commit"), F.col("original_line")).when(F.col("is_head"), F.col("line"))
    return rows.withColumn("_line", line).filter(
        "_line is not null and side is not null and (side <> 'LEFT' or left_is_before)"
    ).select(
        "diffset_id", "root", "path", F.when(F.col("side") == "LEFT", "before").otherwise("after").alias("side"),
        F.col("_line").alias("line"), "comments", "authors",
    )


def thread_lines(threads: DataFrame) -> DataFrame:
    """The lines a thread has at one commit: the ones its prefix names or its original ones if it was
    written there, its current ones at the head unless outdated, none on the left side off the merge base.
    Columns as the forge names them, with ``written, current, left_is_before``."""
    m = lambda g: F.nullif(F.regexp_extract("body", PLACED_PREFIX, g), F.lit(""))
    placed = F.col("written") & m(1).isNotNull()
    side = F.when(F.col("diff_side") == "LEFT", "before").otherwise("after")
    line = F.when(F.col("written"), F.col("original_line")).when(F.col("current") & ~F.col("is_outdated"), F.col("line"))
    first = F.when(F.col("written"), F.col("original_start_line")).when(F.col("current") & ~F.col("is_outdated"), F.col("start_line"))
    counts = (F.col("subject_type") != "FILE") & (F.coalesce(line, F.lit(0)) > 0) & ((side == "after") | F.col("left_is_before"))
    return threads.select(
        "thread_id",
        F.when(placed, m(3)).otherwise(side).alias("side"),
        F.when(placed, m(1).cast("int")).when(counts, F.coalesce(first, line).cast("int")).alias("start"),
        F.when(placed, F.coalesce(m(2), m(1)).cast("int")).when(counts, line.cast("int")).alias("end"),
        F.when(placed, F.regexp_replace("body", PLACED_PREFIX, "")).otherwise(F.col("body")).alias("body"),
    )


def place_comments(anchors: DataFrame, hunks: DataFrame, width: int = 64) -> DataFrame:
    """Where a comment goes: the hunk that overlaps its lines most, cut to it, else the whole file; with a
    prefix that names lines the place leaves out. ``anchors``: ``anchor_id, diffset_id, path, side, start,
    end``; ``hunks``: the same key with inclusive ranges. Lines meet hunks through buckets of ``width``
    lines, an equi-join; the first of equal overlaps wins."""
    from diffloom.functions.scan import spans

    key = ["diffset_id", "path", "side"]
    a = anchors.select("anchor_id", *key, "start", "end", spans(F.col("start"), F.col("end"), width).alias("_bucket"))
    h = hunks.select(*key, F.col("start").alias("_hs"), F.col("end").alias("_he"), spans(F.col("start"), F.col("end"), width).alias("_bucket"))
    lo, hi = F.greatest("start", "_hs"), F.least("end", "_he")
    hits = a.join(h, [*key, "_bucket"]).withColumns({"_lo": lo, "_hi": hi}).filter("_hi >= _lo")
    best = hits.groupBy("anchor_id").agg(F.max(F.struct((F.col("_hi") - F.col("_lo")).alias("n"), (-F.col("_lo")).alias("f"))).alias("_b"))
    rows = anchors.join(best, "anchor_id", "left")
    first = -F.col("_b.f")
    last = first + F.col("_b.n")
    named = F.when(F.col("start") == F.col("end"), F.concat(F.lit("Line "), F.col("start"))).otherwise(
        F.concat(F.lit("Lines "), F.col("start"), F.lit("-"), F.col("end"))
    )
    prefix = F.concat(named, F.lit(" ("), F.col("side"), F.lit("):\n\n"))
    inside = (first == F.col("start")) & (last == F.col("end"))
    return rows.select(
        "anchor_id", F.when(F.col("_b").isNull(), "FILE").otherwise("LINE").alias("subject_type"),
        first.alias("start_line"), last.alias("line"), F.when(F.coalesce(inside, F.lit(False)), "").otherwise(prefix).alias("prefix"),
    )


def restore_anchors(threads: DataFrame, changes: DataFrame) -> DataFrame:
    """The anchor of a thread read back: its hidden key while path and both blobs still match, else its
    lines while the change set holds the file, else the file's root. Of several changes under one name the one with
    the largest blob ids counts. ``threads`` carry ``key_path, key_side,
    key_before, key_after, key_nodes`` (null without a key), ``side, path, start``."""
    files = changes.select("diffset_id", F.col("path").alias("_path"), F.coalesce("old_path", "path").alias("_old"), F.col("before").alias("_before"), F.col("after").alias("_after"))
    names = files.select("diffset_id", F.explode(F.array(F.struct(F.lit("before").alias("s"), F.col("_old").alias("p")), F.struct(F.lit("after").alias("s"), F.col("_path").alias("p")))).alias("_n"), "_path", "_before", "_after")
    names = names.select("diffset_id", F.col("_n.s").alias("_side"), F.col("_n.p").alias("_name"), "_path", "_before", "_after")
    names = names.groupBy("diffset_id", "_side", "_name").agg(F.max(F.struct(F.coalesce("_before", F.lit("")), F.coalesce("_after", F.lit("")), "_path", "_before", "_after")).alias("_f"))
    by_key = names.select("diffset_id", F.col("_side").alias("key_side"), F.col("_name").alias("key_path"), F.col("_f").alias("_k"))
    rows = threads.join(by_key, ["diffset_id", "key_side", "key_path"], "left")
    listed = names.select("diffset_id", F.col("_side").alias("side"), F.col("_name").alias("path"), F.lit(True).alias("_listed"))
    rows = rows.join(listed, ["diffset_id", "side", "path"], "left")
    keyed = (
        (F.col("_k._path") == F.col("path")) & F.col("_k._before").eqNullSafe(F.col("key_before")) & F.col("_k._after").eqNullSafe(F.col("key_after"))
    )
    how = F.when(F.coalesce(keyed, F.lit(False)), "key").when(F.col("_listed") & F.col("start").isNotNull(), "lines").otherwise("file")
    return rows.select("thread_id", "diffset_id", how.alias("anchored_by"), F.when(how == "key", F.col("key_side")).otherwise(F.col("side")).alias("side"), "path",
                       F.when(how == "key", F.col("key_nodes")).alias("nodes"), F.when(how == "lines", F.col("start")).alias("start"))
