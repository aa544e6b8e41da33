"""Registered queries over review state."""

from pyspark.sql import functions as F

from diffloom.functions import keys as K
from diffloom.functions.paths import is_test_path
from diffloom.operators import review as R
from diffloom.plans.line_queries import BY, aligned, bare, edit_number
from diffloom.plans.registry import Data, fragment, oracle_fragment, query
from diffloom.plans.snapshot_queries import _TEST, changes

oracle_fragment("viewed_marks", """select key, arg_max(viewed, (wall, logical, device, cast(viewed as int))) viewed, max((wall, logical, device)) stamp from marks group by 1""")
oracle_fragment("score_marks", """select key, case s when 9 then null else s end score from (select key, arg_max(coalesce(score, 9), (wall, logical, device, coalesce(score, 0))) s from marks group by 1) m""")


def viewed_marks(d: Data):
    return R.lww_state(d.marks, "viewed")


def score_marks(d: Data):
    return R.lww_state(d.marks, "score", rank=F.coalesce("score", F.lit(0)))


@query("x1_lww_viewed", "select key, viewed, stamp.element_1 wall, stamp.element_2 logical, stamp.element_3 device from (select key, viewed, stamp from viewed_marks) m".replace("stamp.element_1", "stamp[1]").replace("stamp.element_2", "stamp[2]").replace("stamp.element_3", "stamp[3]"))
def _(d):
    return viewed_marks(d)


@query("x1_lww_scores", "select key, coalesce(score, 0) score from score_marks")
def _(d):
    return score_marks(d).select("key", F.coalesce("score", F.lit(0)).alias("score"))


@query("f16_stamp_order", """select key, row_number() over (partition by key order by wall, logical, device, coalesce(score, 0), event_id) place, event_id from (
 select m.*, e.event_id from marks m join (select event_id, 'atom-'||cast(event_id % 500 as varchar) key, epoch_us(ts) wall, event_id % 3 logical, cast(user_id as varchar) device from events) e using (key, wall, logical, device)) x""")
def _(d):
    from diffloom.functions.scan import ranked

    rows = d.sql("""select 'atom-'||cast(event_id % 500 as string) key, @MICROS(ts) wall, event_id % 3 logical, cast(user_id as string) device, event_id,
 case event_type when 'error' then -2 when 'signup' then -1 when 'purchase' then 2 when 'click' then 1 end score from {events}""")
    order = K.stamp_order(F.col("wall"), F.col("logical"), F.col("device"), F.col("score"))
    return ranked(rows.withColumn("_o", order), ["key"], ["_o", "event_id"], "place").select("key", "place", "event_id")


@query("x2_assign_hlc", """select event_id, hlc_wall, cast(row_number() over (partition by user_id, hlc_wall order by event_id) - 1 as int) hlc_logical from (
 select event_id, user_id, max(w) over (partition by user_id order by event_id rows between unbounded preceding and current row) hlc_wall
 from (select event_id, user_id, epoch_us(ts) // 1000000 - (event_id * 7919) % 4000 w from events) e) x""")
def _(d):
    w = d.sql("select event_id, user_id, floor(@MICROS(ts) / 1000000) - (event_id * 7919) % 4000 wall from {events}")
    return R.assign_hlc(w, "user_id", "event_id").select("event_id", "hlc_wall", "hlc_logical")


# One root node per file side of a hunk run, and one child per changed line with text.
oracle_fragment("outline", """select diffset_id, path, frag_no, side, node_no, parent, atom, 'atom-'||cast(h as varchar) as key from (
 select *, (('0x'||substr(md5(path||'|'||side||'|'||cast(frag_no as varchar)||'|'||cast(node_no as varchar)), 1, 7))::bigint) % 2000 h from (
 select diffset_id, path, gap frag_no, case side when 'a' then 'before' else 'after' end side, line_no node_no, 0 parent, 'atom-'||cast((('0x'||substr(md5(path||key), 1, 7))::bigint) % 700 as varchar) atom
 from aligned where mate is null and key <> ''
 union all select distinct diffset_id, path, gap, case side when 'a' then 'before' else 'after' end, 0, -1, null from aligned where mate is null and key <> '') u) o""")


def outline(d: Data):
    """An outline in line form: per hunk side a root, and a child per changed line that holds text."""

    def build(d: Data):
        number = lambda *parts: F.conv(F.substring(F.md5(F.concat_ws("", *parts)), 1, 7), 16, 10).cast("bigint")
        if d.has("aligned"):
            rows = aligned(d).filter("mate is null and key <> ''").withColumn("edit", edit_number())
        else:
            rows = bare(d).filter("mate is null and not blank")
        rows = rows.withColumn("side", F.when(F.col("side") == "a", "before").otherwise("after")).withColumnRenamed("gap", "frag_no")
        atom = F.concat(F.lit("atom-"), F.col("edit").cast("string"))
        leaves = rows.select(*BY, "frag_no", "side", F.col("line_no").alias("node_no"), F.lit(0).alias("parent"), atom.alias("atom"))
        roots = rows.select(*BY, "frag_no", "side").distinct().select(*BY, "frag_no", "side", F.lit(0).alias("node_no"), F.lit(-1).alias("parent"), F.lit(None).cast("string").alias("atom"))
        place = number("path", F.lit("|"), "side", F.lit("|"), F.col("frag_no").cast("string"), F.lit("|"), F.col("node_no").cast("string")) % 2000
        return leaves.unionByName(roots).withColumn("key", F.concat(F.lit("atom-"), place.cast("string")))

    return d.shared("outline", build)


def viewed_atoms(d: Data):
    return viewed_marks(d).select(F.col("key").alias("atom"), "viewed")


@query("a11_atom_index", """select diffset_id, atom, occurrences, files, hunks, row_number() over (partition by diffset_id order by f, atom) atom_no from (
 select diffset_id, atom, min((path, frag_no, side, node_no)) f, count(*) occurrences, count(distinct path) files, count(distinct (path, frag_no)) hunks from outline where atom is not null group by 1, 2) x""")
def _(d):
    return R.atom_index(outline(d)).select("diffset_id", "atom", "occurrences", "files", "hunks", "atom_no")


for _level, _cols in (("files", "diffset_id, path"), ("hunks", "diffset_id, path, frag_no"), ("nodes", "diffset_id, path, frag_no, side, node_no")):

    def _make(cols):
        def run(d):
            names = cols.split(", ")
            return R.viewed_rollup(outline(d), viewed_atoms(d), names).select(*names, F.coalesce(F.col("viewed").cast("string"), F.lit("none")).alias("viewed"))

        return run

    query(f"a6_viewed_{_level}", f"""select {_cols}, coalesce(cast(bool_and(case when o.atom is not null then coalesce(m.viewed, false) end) as varchar), 'none') viewed
 from outline o left join viewed_marks m on m.key = o.atom group by {_cols}""")(_make(_cols))

oracle_fragment("approvals", """select diffset_id, case when heaviest = -2 then 'blocked' when heaviest = 2 and edits > 0 and read = edits then 'approved' else 'pending' end state, heaviest, read, edits from (
 select s.diffset_id, coalesce(c.edits, 0) edits, coalesce(c.read, 0) read, case when c.caps then least(coalesce(l.least_, 1), 1) else l.least_ end heaviest
 from (select distinct diffset_id from outline) s
 left join (select o.diffset_id, min(k.score) least_ from outline o join score_marks k using (key) where k.score is not null group by 1) l using (diffset_id)
 left join (select diffset_id, count(*) edits, count(case when cov or vw then 1 end) read, bool_or(vw and not cov and not starts_with(atom, 'row:')) caps from (
   select a.diffset_id, a.atom, bool_or(coalesce(k.score, kr.score) is not null) cov, bool_or(coalesce(v.viewed, false)) vw
   from outline a left join score_marks k on k.key = a.key
   left join outline r on r.diffset_id = a.diffset_id and r.path = a.path and r.frag_no = a.frag_no and r.side = a.side and r.node_no = 0
   left join score_marks kr on kr.key = r.key left join viewed_marks v on v.key = a.atom
   where a.atom is not null group by 1, 2) x group by 1) c using (diffset_id)) y""")


@query("a7_approval", "select diffset_id, state, coalesce(heaviest, 0) heaviest, read, edits from approvals")
def _(d):
    a = R.approval(outline(d), score_marks(d).select("key", "score"), viewed_atoms(d))
    return a.withColumn("heaviest", F.coalesce("heaviest", F.lit(0)))


@query("a8_review_event", "select diffset_id, case state when 'blocked' then 'REQUEST_CHANGES' when 'approved' then 'APPROVE' else 'COMMENT' end event from approvals")
def _(d):
    a = R.approval(outline(d), score_marks(d).select("key", "score"), viewed_atoms(d))
    return a.select("diffset_id", R.review_event(F.col("state")).alias("event"))


oracle_fragment("file_views", "select diffset_id, path, bool_and(coalesce(m.viewed, false)) viewed from outline o left join viewed_marks m on m.key = o.atom where o.atom is not null group by 1, 2")
oracle_fragment("set_progress", f"""select diffset_id, count(*) files, count(case when viewed then 1 end) viewed, count(case when {_TEST} then 1 end) test_files, count(case when {_TEST} and viewed then 1 end) tests_viewed
 from (select distinct diffset_id, path from changes) c left join file_views v using (diffset_id, path) group by 1""")


def set_progress(d: Data):
    files = changes(d).select(*BY).distinct().withColumn("is_test", is_test_path(F.col("path")))
    return R.progress(files, R.viewed_rollup(outline(d), viewed_atoms(d), BY))


@query("a9_progress", "select * from set_progress")
def _(d):
    return set_progress(d)


# Pull requests: an order touches parts; its line numbers are commits, drawn when the ship date is odd.
fragment("touches", "select distinct l_orderkey review_id, l_linenumber commit_no, l_partkey % 5 path from {lineitem}")
fragment("drawn", "select l_orderkey review_id, l_linenumber commit_no, l_partkey % 5 path, max(l_quantity) > 10 viewed from {lineitem} where l_suppkey % 4 <> 0 group by 1, 2, 3")


@query("a10_viewed_everywhere", """select t.review_id, t.path, case when bool_or(not v.viewed) then 'false' when count(*) > count(v.viewed) then 'unknown' else 'true' end viewed
 from touches t left join drawn v using (review_id, commit_no, path) group by 1, 2""")
def _(d):
    r = R.viewed_everywhere(d.touches.withColumnRenamed("commit_no", "commit"), d.drawn.withColumnRenamed("commit_no", "commit"))
    return r.select("review_id", "path", F.coalesce(F.col("viewed").cast("string"), F.lit("unknown")).alias("viewed"))


oracle_fragment("node_spans", """select diffset_id, path, side, line_no "first", line_no + line_no % 3 "last" from aligned where mate is null and line_no % 4 = 1""")


@query("a12_row_atoms", """select a.diffset_id, a.path, a.side, a.line_no, 'row:'||md5(a.diffset_id||chr(0)||a.path||chr(0)||a.side||chr(0)||a.text) atom from aligned a
 where mate is null and trim(text) <> '' and not exists (select 1 from node_spans n where n.diffset_id = a.diffset_id and n.path = a.path and n.side = a.side and a.line_no between n."first" and n."last")""")
def _(d):
    lines = aligned(d).filter("mate is null")
    nodes = lines.filter("line_no % 4 = 1").select(*BY, "side", F.col("line_no").alias("first"), (F.col("line_no") + F.col("line_no") % 3).alias("last"))
    return R.row_atoms(lines, nodes, [*BY, "side"])


fragment("notes", """select conv_id % 37 review_id, conv_id * 1000 + turn note_id, case when turn > 0 then conv_id * 1000 end thread_id, turn % 4 = 3 pending, role author, turn, conv_id from {conversations}""")


@query("a17_review_state", "select review_id, coalesce(thread_id, note_id) thread, count(*) notes, count(case when pending then 1 end) pending, bool_or(pending) reviewing from notes group by 1, 2")
def _(d):
    return R.review_state(d.notes)


@query("a18_axis_scores", """select node_key, axis, coalesce(case when bool_or(event_type = 'error' and a.i = value_i) then -1 when bool_or(event_type in ('view', 'click')) then 1 end, 0) score
 from (select event_id % 300 node_key, event_type, cast(floor(value) as bigint) % 3 value_i from events) e, (select unnest(['necessity', 'clarity', 'consistency']) axis, unnest([0, 1, 2]) i) a group by 1, 2""")
def _(d):
    axes = F.array(*[F.lit(a) for a in R.AXES])
    c = d.events.select((F.col("event_id") % 300).alias("node_key"), F.col("event_type").isin("view", "click").alias("read"),
                        F.when(F.col("event_type") == "error", F.array(F.get(axes, (F.floor("value") % 3).cast("int")))).otherwise(F.array().cast("array<string>")).alias("requests"))
    return R.axis_scores(c).withColumn("score", F.coalesce("score", F.lit(0)))


oracle_fragment("stops", """select s.reviewer, o.diffset_id, o.path, o.frag_no, o.atom, min((case o.side when 'before' then 0 else 1 end, node_no)) s
 from outline o join (select distinct user_id % 5 reviewer, 'src'||cast(user_id % 20 as varchar) diffset_id from events) s using (diffset_id)
 where o.atom is not null and not exists (select 1 from (select distinct user_id % 5 reviewer, 'atom-'||cast(event_id % 500 as varchar) atom from events where event_type = 'view') v where v.reviewer = s.reviewer and v.atom = o.atom)
 group by 1, 2, 3, 4, 5""")


def reading(d: Data):
    """Who reviews which change sets, and the atoms each has viewed."""
    reviewers = d.events.select((F.col("user_id") % 5).alias("reviewer"), F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("diffset_id")).distinct()
    seen = d.events.filter("event_type = 'view'").select((F.col("user_id") % 5).alias("reviewer"), F.concat(F.lit("atom-"), (F.col("event_id") % 500).cast("string")).alias("atom")).distinct()
    return reviewers, seen


@query("t4_review_queue", "select reviewer, diffset_id, path, frag_no, atom, row_number() over (partition by reviewer order by diffset_id, path, frag_no, s) place from stops")
def _(d):
    return R.review_queue(outline(d), *reading(d)).select("reviewer", "diffset_id", "path", "frag_no", "atom", "place")


@query("t4_next_stop", """select reviewer, diffset_id, path, frag_no, atom from (select *, row_number() over (partition by reviewer order by diffset_id, path, frag_no, s) r from stops where diffset_id > 'src14' or (diffset_id = 'src14' and (path > 'src14/src/2' or (path = 'src14/src/2' and frag_no > 0)))) x where r = 1""")
def _(d):
    reviewers, seen = reading(d)
    at = reviewers.select("reviewer").distinct().select("reviewer", F.lit("src14").alias("diffset_id"), F.lit("src14/src/2").alias("path"), F.lit(0).cast("bigint").alias("frag_no"))
    return R.next_stop(outline(d), reviewers, seen, at)


oracle_fragment("thread_at", "select distinct diffset_id, cast(cast(substr(diffset_id, 4) as int) + 20 as varchar) commit, cast(substr(diffset_id, 4) as int) % 2 = 0 is_head, cast(substr(diffset_id, 4) as int) % 3 <> 1 left_is_before from comments")


@query("j20_build_threads", """select c.diffset_id, r.root, c.path, case c.side when 'LEFT' then 'before' else 'after' end side, case when c.original_commit_id = t.commit then c.original_line when t.is_head then c.line end line, r.n comments, r.authors
 from (select diffset_id, coalesce(in_reply_to_id, id) root, count(*) n, string_agg(author, ',' order by id) authors from comments group by 1, 2) r
 join comments c on c.diffset_id = r.diffset_id and c.id = r.root join thread_at t on t.diffset_id = c.diffset_id
 where (c.original_commit_id = t.commit or t.is_head) and (c.side <> 'LEFT' or t.left_is_before)""")
def _(d):
    n = F.substring("diffset_id", F.lit(4), F.length("diffset_id")).cast("int")
    at = d.comments.select("diffset_id").distinct().select("diffset_id", (n + 20).cast("string").alias("commit"), (n % 2 == 0).alias("is_head"), (n % 3 != 1).alias("left_is_before"))
    return R.build_threads(d.comments, at)


fragment("forge_threads", """select id thread_id, case when conv_id % 3 = 0 then 'LEFT' else 'RIGHT' end diff_side, line, case when conv_id % 2 = 0 then line - 1 end start_line,
 original_line, case when conv_id % 2 = 1 then original_line - 1 end original_start_line, turn % 3 = 1 is_outdated, case when conv_id % 11 = 0 then 'FILE' else 'LINE' end subject_type,
 case when conv_id % 5 = 0 then 'Lines 3-'||cast(4 + turn as string)||' (before):'||chr(10)||chr(10)||body when conv_id % 5 = 1 then 'Line 7 (after):'||chr(10)||chr(10)||body else body end body,
 turn % 2 = 0 written, conv_id % 4 <> 0 current, conv_id % 7 <> 0 left_is_before, body plain, conv_id, turn from comments""")


@query("j19_thread_lines", """select thread_id, case when written and conv_id % 5 = 0 then 'before' when written and conv_id % 5 = 1 then 'after' when diff_side = 'LEFT' then 'before' else 'after' end side,
 coalesce(case when written and conv_id % 5 = 0 then 3 when written and conv_id % 5 = 1 then 7 when ok then coalesce(s, l) end, 0) "start",
 coalesce(case when written and conv_id % 5 = 0 then 4 + turn when written and conv_id % 5 = 1 then 7 when ok then l end, 0) "end",
 md5(case when written and conv_id % 5 < 2 then plain else body end) body from (
 select *, subject_type <> 'FILE' and l is not null and l > 0 and (diff_side <> 'LEFT' or left_is_before) ok from (
 select *, case when written then original_line when current and not is_outdated then line end l, case when written then original_start_line when current and not is_outdated then start_line end s from forge_threads) t) u""")
def _(d):
    t = R.thread_lines(d.forge_threads)
    return t.select("thread_id", "side", F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("end", F.lit(0)).alias("end"), F.md5("body").alias("body"))


fragment("place_anchors", """select id anchor_id, diffset_id, path, case when side = 'LEFT' then 'before' else 'after' end side, line start_, line + turn * 3 end_ from comments""")
fragment("place_hunks", """select distinct diffset_id, path, s side, h * 9 + conv_id % 4 start_, h * 9 + conv_id % 4 + 4 + h % 3 end_ from comments cross join (select 0 h union all select 1 union all select 2 union all select 9) x cross join (select 'before' s union all select 'after') y where turn = 0""")


@query("j17_place_comments", """select anchor_id, case when lo is null then 'FILE' else 'LINE' end subject_type, coalesce(lo, 0) start_line, coalesce(hi, 0) line,
 case when lo = start_ and hi = end_ then '' else (case when start_ = end_ then 'Line '||cast(start_ as varchar) else 'Lines '||cast(start_ as varchar)||'-'||cast(end_ as varchar) end)||' ('||side||'):'||chr(10)||chr(10) end prefix
 from (select a.*, case when h.start_ is not null then greatest(a.start_, h.start_) end lo, case when h.start_ is not null then least(a.end_, h.end_) end hi, row_number() over (partition by anchor_id order by least(a.end_, h.end_) - greatest(a.start_, h.start_) desc, greatest(a.start_, h.start_)) r
 from place_anchors a left join place_hunks h on h.diffset_id = a.diffset_id and h.path = a.path and h.side = a.side and h.start_ <= a.end_ and h.end_ >= a.start_) x where r = 1""")
def _(d):
    named = lambda df: df.withColumnsRenamed({"start_": "start", "end_": "end"})
    p = R.place_comments(named(d.place_anchors), named(d.place_hunks))
    return p.select("anchor_id", "subject_type", F.coalesce("start_line", F.lit(0)).alias("start_line"), F.coalesce("line", F.lit(0)).alias("line"), "prefix")


oracle_fragment("thread_keys", """select row_number() over (order by diffset_id, path, status) thread_id, diffset_id, path, 'after' side, case when length(path) % 3 = 0 then null else 5 end "start",
 case when length(path) % 2 = 0 then path end key_path, case when length(path) % 2 = 0 then 'after' end key_side, case when length(path) % 4 = 0 then 'stale' else "before" end key_before, "after" key_after from changes""")


@query("j21_restore_anchors", """select t.diffset_id, t.path, case when k.path is not null then 'key' when l.path is not null and t."start" is not null then 'lines' else 'file' end anchored_by from thread_keys t
 left join (select diffset_id, path, f."before" "before", f."after" "after" from (select diffset_id, path, max(struct_pack(b := coalesce("before", ''), a := coalesce("after", ''), "before" := "before", "after" := "after")) f from changes group by 1, 2) y) k on k.diffset_id = t.diffset_id and k.path = t.key_path and k."before" is not distinct from t.key_before and k."after" is not distinct from t.key_after
 left join (select distinct diffset_id, path from changes) l on l.diffset_id = t.diffset_id and l.path = t.path""")
def _(d):
    c = changes(d)
    n = F.length("path")
    even = n % 2 == 0
    threads = c.select(F.md5(F.concat("diffset_id", "path", "status")).alias("thread_id"), "diffset_id", "path", F.lit("after").alias("side"), F.when(n % 3 != 0, 5).alias("start"),
                       F.when(even, F.col("path")).alias("key_path"), F.when(even, "after").alias("key_side"), F.when(n % 4 == 0, "stale").otherwise(F.col("before")).alias("key_before"),
                       F.col("after").alias("key_after"), F.when(even, F.lit("0.1")).alias("key_nodes"))
    return R.restore_anchors(threads, changes(d)).select("diffset_id", "path", "anchored_by")


@query("h7_review_dashboard", """select p.diffset_id, a.state, a.read, a.edits, p.files, p.viewed, coalesce(t.threads, 0) threads, coalesce(t.pending, 0) pending
 from set_progress p left join approvals a using (diffset_id) left join (select diffset_id, count(distinct coalesce(in_reply_to_id, id)) threads, count(case when pending then 1 end) pending from comments group by 1) t using (diffset_id)""")
def _(d):
    """Per change set: its approval, how much of it was viewed, and its threads."""
    a = R.approval(outline(d), score_marks(d).select("key", "score"), viewed_atoms(d))
    threads = R.review_state(d.comments.select(F.col("diffset_id").alias("review_id"), F.col("id").alias("note_id"), F.col("in_reply_to_id").alias("thread_id"), "pending"))
    t = threads.groupBy(F.col("review_id").alias("diffset_id")).agg(F.count("*").alias("threads"), F.sum("pending").alias("pending"))
    rows = set_progress(d).join(a, "diffset_id", "left").join(t, "diffset_id", "left").na.fill(0, ["threads", "pending"])
    return rows.select("diffset_id", "state", "read", "edits", "files", "viewed", "threads", "pending")
