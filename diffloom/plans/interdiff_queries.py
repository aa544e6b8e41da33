"""Registered queries over two iterations of a change."""

from pyspark.sql import functions as F

from diffloom.operators import align as A
from diffloom.operators import hunks as H
from diffloom.operators import interdiff as I
from diffloom.operators import snapshots as S
from diffloom.functions import text as T
from diffloom.functions.text import compare_key
from diffloom.plans.line_queries import BY, align_sql, duck_key, duck_lines
from diffloom.plans.registry import Data, oracle_fragment, query
from diffloom.session import cut
from diffloom.sources.blobs import explode_lines

_LATER = """select coalesce(a.diffset_id, b.diffset_id) diffset_id, coalesce(a.path, b.path) path, case when a.path is null then 'added' when b.path is null then 'deleted' else 'modified' end status,
 a.blob_id "before", b.blob_id "after" from snap_before a full outer join snap_later b on a.diffset_id = b.diffset_id and a.path = b.path
 where (a.blob_id is distinct from b.blob_id or a.mode is distinct from b.mode)"""
# Both iterations without rename pairing and submodules, so that one path is one change.
oracle_fragment("first_changes", _LATER.replace("snap_later", "snap_after"))
oracle_fragment("later_changes", _LATER)


def _plain(d: Data, after):
    rows = S.diff_snapshots(d.snap_before, after)
    one = rows.groupBy(*BY).agg(F.max("before").alias("before"), F.max("after").alias("after"))
    return one.withColumn("old_path", F.lit(None).cast("string"))


def first_changes(d: Data):
    return d.shared("first_changes", lambda d: _plain(d, d.snap_after))


def later_changes(d: Data):
    return d.shared("later_changes", lambda d: _plain(d, d.snap_later))


oracle_fragment("iteration_pairs", """select diffset_id, path, "before", "after", in_both from (
 select coalesce(f.diffset_id, t.diffset_id) diffset_id, coalesce(f.path, t.path) path, case when f.path is not null then f."after" else t."before" end "before",
   case when t.path is not null then t."after" else f."before" end "after", f.path is not null and t.path is not null in_both
 from first_changes f full outer join later_changes t on f.diffset_id = t.diffset_id and f.path = t.path) x where "before" is distinct from "after" """)


def iteration_pairs(d: Data):
    return d.shared("iteration_pairs", lambda d: I.iteration_pairs(first_changes(d), later_changes(d)))


@query("j7_iteration_pairs", """select diffset_id, path, coalesce("before", '') "before", coalesce("after", '') "after", in_both from iteration_pairs""")
def _(d):
    return iteration_pairs(d).na.fill("", ["before", "after"])


# One alignment over three kinds of pairs at once: each iteration's own, and iteration against iteration.
oracle_fragment("all_texts", "select blob_id, any_value(text) text from (select blob_id, text from snap_before union all select blob_id, text from snap_after union all select blob_id, text from snap_later) t group by 1")
oracle_fragment("three_pairs", """select 'first' kind, diffset_id, path, "before", "after" from first_changes where "before" is distinct from "after" union all
 select 'later', diffset_id, path, "before", "after" from later_changes where "before" is distinct from "after" union all select 'between', diffset_id, path, "before", "after" from iteration_pairs""")
oracle_fragment("three_lines", f"""select kind, diffset_id, path, side, i line_no, l text, {duck_key('l')} key from (
 select kind, diffset_id, path, side, unnest(ls) l, generate_subscripts(ls, 1) i from (
 select kind, diffset_id, path, side, {duck_lines('text')} ls from (
   select p.*, 'a' side, coalesce(t.text, '') text from three_pairs p left join all_texts t on t.blob_id = p."before"
   union all select p.*, 'b', coalesce(t.text, '') from three_pairs p left join all_texts t on t.blob_id = p."after") s) u) v""")
align_sql("three_aligned", "three_lines", "kind, diffset_id, path")
KEY = ["kind", *BY]


def three_texts(d: Data, kinds=("first", "later", "between"), touched: bool = False):
    """Both sides of every pair of some kinds with their texts, written since the alignment reads them twice. ``touched``
    leaves only files that differ between the iterations."""
    make = {"first": first_changes, "later": later_changes, "between": iteration_pairs}
    pairs = None
    for kind in kinds:
        rows = make[kind](d).filter(~F.col("before").eqNullSafe(F.col("after"))).select(F.lit(kind).alias("kind"), *BY, "before", "after")
        pairs = rows if pairs is None else pairs.unionByName(rows)
    if touched:
        pairs = pairs.join(iteration_pairs(d).select(*BY), BY, "left_semi")
    sides = pairs.select(*KEY, F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("before").alias("blob_id")), F.struct(F.lit("b").alias("side"), F.col("after").alias("blob_id")))).alias("s"))
    sides = sides.select(*KEY, "s.side", "s.blob_id").filter("blob_id is not null")
    blobs = d.snap_before.select("blob_id", "text").union(d.snap_after.select("blob_id", "text")).union(d.snap_later.select("blob_id", "text"))
    blobs = blobs.join(sides.select("blob_id").distinct(), "blob_id", "left_semi").groupBy("blob_id").agg(F.any_value("text").alias("text"))
    return sides.join(blobs, "blob_id").select(*KEY, "side", "text")


def between_aligned(d: Data):
    """The lines of iteration against iteration: pairs are aligned one by one, so no other kind is needed."""

    def build(d: Data):
        lines = explode_lines(d.shared("between_texts", lambda d: three_texts(d, ["between"]))).withColumn("key", compare_key(F.col("text")))
        return A.align_lines(lines, KEY, keep_key=False)

    return d.shared("between_aligned", build).withColumn("key", compare_key(F.col("text")))


def marked_lines(texts):
    """Lines as fragments need them: of a line's text only a hash, and whether it is blank. Texts are shuffled no more."""
    text = F.col("text")
    blank = F.when(text.rlike(rf"^{T.SPACE}*$"), "").otherwise("x")
    return explode_lines(texts).select(*KEY, "side", "line_no", compare_key(text).alias("key"), F.base64(F.unhex(F.md5(text))).alias("text"), blank.alias("solid"))


oracle_fragment("three_rows", """select *, row_number() over (partition by kind, diffset_id, path order by gap, rk, line_no) row_no from (
 select kind, diffset_id, path, gap, line_no, text, key, case when mate is not null then ' ' when side = 'a' then '-' else '+' end op, case when mate is not null then 0 when side = 'a' then 1 else 2 end rk,
   case when side = 'a' then line_no end line_a, case when side = 'a' then mate else line_no end line_b from three_aligned where not (side = 'b' and mate is not null)) r""")
oracle_fragment("three_states", """select *, case when op <> ' ' then 'd' when max(loud) over (partition by kind, diffset_id, path order by row_no rows between 3 preceding and 3 following) = 1 then 'u' else 'e' end state
 from (select *, case when op <> ' ' then max(case when op <> ' ' and key <> '' then 1 else 0 end) over (partition by kind, diffset_id, path, gap) else 0 end loud from three_rows) r""")
oracle_fragment("three_runs", """select *, sum(fresh) over w frag_no, count(line_a) over w seen_a, count(line_b) over w seen_b
 from (select *, cast(coalesce(lag(state) over (partition by kind, diffset_id, path order by row_no), '') <> state as int) fresh from three_states) r
 window w as (partition by kind, diffset_id, path order by row_no rows between unbounded preceding and current row)""")
oracle_fragment("three_frags", """select kind, diffset_id, path, frag_no, case when min(state) = 'd' then 'diff' when min(state) = 'e' and count(*) > 1 then 'elided' else 'unchanged' end frag_kind,
 max(seen_a) - count(line_a) + 1 a_start, max(seen_a) + 1 a_end, max(seen_b) - count(line_b) + 1 b_start, max(seen_b) + 1 b_end, md5(string_agg(case when op <> ' ' then op||text end, chr(10) order by row_no)) hash
 from three_runs group by kind, diffset_id, path, frag_no""")


def own_frags(d: Data):
    """Fragments of both iterations' own pairs."""
    return d.shared("own_frags", lambda d: _aligned_frags(d.shared("own_texts", lambda d: three_texts(d, ["first", "later"]))))


def three_frags(d: Data):
    """Fragments of all three kinds of pairs, of the files that differ between the iterations."""
    return d.shared("three_frags", lambda d: _aligned_frags(d.shared("three_texts", lambda d: three_texts(d, touched=True))))


def _aligned_frags(texts):
    aligned = cut(A.align_lines(marked_lines(texts), KEY, keep_key=False))
    return _frags(H.diff_rows(aligned.withColumnRenamed("solid", "key"), KEY))


def _frags(rows):
    """Fragments with a hash of each hunk's text; ``text`` may be a line's hash."""
    key = ["pair_kind", *BY]
    rows = rows.withColumnRenamed("kind", "pair_kind")
    frags = H.fragments(rows, key)
    changed = rows.filter("op <> ' '")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", F.concat("op", "text").alias("t")))), lambda r: r["t"]), "\n")
    hashes = changed.groupBy(*key, "gap").agg(F.md5(text).alias("hash"), F.count("line_a").alias("n_a"), F.count("line_b").alias("n_b"),
                                              F.min("line_a").alias("_a"), F.min("line_b").alias("_b"))
    # A hunk is the changed run after `gap` pairs; its first line on a side it has identifies its fragment.
    diffs = frags.filter("kind = 'diff'")
    hashes = hashes.select(*key, F.when(F.col("n_a") > 0, F.concat(F.lit("a"), F.col("_a").cast("string"))).otherwise(F.concat(F.lit("b"), F.col("_b").cast("string"))).alias("_id"), "hash")
    own = F.when(F.col("before_n") > 0, F.concat(F.lit("a"), F.col("before_start").cast("string"))).otherwise(F.concat(F.lit("b"), F.col("after_start").cast("string")))
    diffs = diffs.select(*key, "frag_no", own.alias("_id")).join(hashes, [*key, "_id"]).select(*key, "frag_no", "hash")
    return frags.join(diffs, [*key, "frag_no"], "left")


oracle_fragment("own_hunks", "select *, row_number() over (partition by kind, diffset_id, path, hash order by frag_no) nth from three_frags where frag_kind = 'diff' and kind <> 'between'")
oracle_fragment("unshared", """select kind, diffset_id, path, frag_no, b_start, b_end from own_hunks h where not exists (
 select 1 from own_hunks o where o.kind <> h.kind and o.diffset_id = h.diffset_id and o.path = h.path and o.hash = h.hash and o.nth = h.nth)""")


def unshared(frags):
    f = frags.filter("kind = 'diff'")
    cols = [*BY, "frag_no", "hash", "after_start", "after_n"]
    return I.unshared_hunks(f.filter("pair_kind = 'first'").select(*cols), f.filter("pair_kind = 'later'").select(*cols))


@query("j8_unshared_hunks", "select kind, diffset_id, path, cast(frag_no as bigint) frag_no from unshared")
def _(d):
    a, b = unshared(own_frags(d))
    return a.select(F.lit("first").alias("kind"), *BY, "frag_no").unionByName(b.select(F.lit("later").alias("kind"), *BY, "frag_no"))


def _touch(a0, a1, b0, b1):
    return f"(case when {a0} = {a1} or {b0} = {b1} then {a0} <= {b1} and {b0} <= {a1} else {a0} < {b1} and {b0} < {a1} end)"


oracle_fragment("between_frags", f"""select f.*, frag_kind = 'diff' and (not p.in_both
   or exists (select 1 from unshared u where u.kind = 'first' and u.diffset_id = f.diffset_id and u.path = f.path and {_touch('u.b_start', 'u.b_end', 'f.a_start', 'f.a_end')})
   or exists (select 1 from unshared u where u.kind = 'later' and u.diffset_id = f.diffset_id and u.path = f.path and {_touch('u.b_start', 'u.b_end', 'f.b_start', 'f.b_end')})) kept
 from three_frags f join iteration_pairs p using (diffset_id, path) where f.kind = 'between'""")


def between_frags(d: Data):
    """Fragments of iteration against iteration, the diffs marked that touch a hunk the iterations do not share."""

    def build(d: Data):
        # A hunk of either iteration counts only in a file that differs between them.
        frags = three_frags(d).filter("pair_kind = 'between'")
        one, two = unshared(three_frags(d))
        region = lambda df: df.select(*BY, F.col("after_start").alias("start"), (F.col("after_start") + F.col("after_n")).alias("end"))
        side = lambda s: frags.filter("kind = 'diff'").select(*BY, "frag_no", F.col(f"{s}_start").alias("start"), (F.col(f"{s}_start") + F.col(f"{s}_n")).alias("end"))
        hit = I.touches(side("before"), region(one), BY).union(I.touches(side("after"), region(two), BY)).distinct().withColumn("_hit", F.lit(True))
        pairs = iteration_pairs(d).select(*BY, "in_both")
        rows = frags.join(hit, [*BY, "frag_no"], "left").join(pairs, BY)
        kept = (F.col("kind") == "diff") & (~F.col("in_both") | F.coalesce("_hit", F.lit(False)))
        return rows.withColumn("kept", kept).drop("_hit", "pair_kind")

    return d.shared("between_frags", build)


@query("j10_touches", "select diffset_id, path, cast(frag_no as bigint) frag_no from between_frags where kept and path in (select path from iteration_pairs where in_both)")
def _(d):
    return between_frags(d).filter("kept and in_both").select(*BY, "frag_no")


oracle_fragment("beside", """select *, case when shown <> 'elided' or coalesce(lag(shown) over (partition by diffset_id, path order by frag_no), '') <> 'elided' then true else false end listed from (
 select *, case when frag_kind = 'diff' then case when kept then 'diff' else 'elided' end when frag_kind = 'unchanged' and (coalesce(up, false) or coalesce(down, false)) then 'unchanged' else 'elided' end shown from (
 select *, last_value(st ignore nulls) over (partition by diffset_id, path order by frag_no rows between unbounded preceding and current row) up,
   last_value(st ignore nulls) over (partition by diffset_id, path order by frag_no desc rows between unbounded preceding and current row) down
 from (select *, case when frag_kind = 'diff' then kept when frag_kind = 'elided' then false end st from between_frags) x) y) z""")


@query("j11_beside_kept", "select diffset_id, path, cast(frag_no as bigint) frag_no, shown from beside where listed")
def _(d):
    return I.beside_kept(between_frags(d), BY).select(*BY, "frag_no", "shown")


@query("h3_interdiff", """select diffset_id, path, cast(frag_no as bigint) frag_no, shown, a_start, b_start from beside b where listed and exists (
 select 1 from between_frags k where k.diffset_id = b.diffset_id and k.path = b.path and k.kept)""")
def _(d):
    rows = I.beside_kept(between_frags(d), BY)
    authored = rows.filter("kept").select(*BY).distinct()
    return rows.join(authored, BY, "left_semi").select(*BY, "frag_no", "shown", F.col("before_start").alias("a_start"), F.col("after_start").alias("b_start"))


oracle_fragment("paths_seen", """select diffset_id, path, unnest(['before', 'after']) side from (select diffset_id, path from first_changes union select diffset_id, path from later_changes union select diffset_id, path from snap_before) x""")
oracle_fragment("moved_base", """select distinct f.diffset_id from first_changes f join later_changes t using (diffset_id, path) where f."before" is distinct from t."before" """)


@query("j9_blob_in", """select s.diffset_id, s.path, s.side, coalesce(case when f.path is not null then case s.side when 'before' then f."before" else f."after" end
 when s.diffset_id not in (select diffset_id from moved_base) then t."before" end, '') blob
 from paths_seen s left join first_changes f using (diffset_id, path) left join later_changes t on t.diffset_id = s.diffset_id and t.path = s.path""")
def _(d):
    seen = first_changes(d).select(*BY).union(later_changes(d).select(*BY)).union(d.snap_before.select(*BY)).distinct()
    threads = seen.select(*BY, F.explode(F.array(F.lit("before"), F.lit("after"))).alias("side"))
    return I.blob_in(threads, first_changes(d), later_changes(d)).select(*BY, "side", F.coalesce("blob", F.lit("")).alias("blob"))


# Threads on pairs of lines of every file between the iterations; a line's counterpart is its mate.
oracle_fragment("ported", """select a.diffset_id||':'||a.path||':'||cast(a.line_no as varchar) thread_id, a.mate, b.mate mate2 from three_aligned a
 left join three_aligned b on b.kind = a.kind and b.diffset_id = a.diffset_id and b.path = a.path and b.side = 'a' and b.line_no = a.line_no + 1 where a.kind = 'between' and a.side = 'a'""")


def ported(d: Data):
    lines = between_aligned(d).filter("side = 'a'")
    name = F.concat_ws(":", "diffset_id", "path")
    threads = lines.select(F.concat_ws(":", "diffset_id", "path", F.col("line_no").cast("string")).alias("thread_id"), name.alias("old_blob"),
                           F.concat(name, F.lit("'")).alias("new_blob"), F.array(F.col("line_no"), F.col("line_no") + 1).alias("nodes"))
    node_map = lines.filter("mate is not null").select(name.alias("old_blob"), F.concat(name, F.lit("'")).alias("new_blob"), F.col("line_no").alias("node_a"), F.col("mate").alias("node_b"))
    return I.port_threads(threads, node_map)


@query("j23_port_threads", "select thread_id, cast(mate as varchar)||','||cast(mate2 as varchar) nodes from ported where mate is not null and mate2 is not null")
def _(d):
    return ported(d)[0].select("thread_id", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("nodes"))


@query("j23_lost_threads", "select thread_id from ported where mate is null or mate2 is null")
def _(d):
    return ported(d)[1].select("thread_id")
