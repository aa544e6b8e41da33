"""Registered queries over lines: alignment, hunks, and the change report."""

from pyspark.sql import functions as F

from diffloom.functions import paths as P
from diffloom.functions import text as T
from diffloom.operators import align as A
from diffloom.operators import hunks as H
from diffloom.plans.registry import Data, fragment, oracle_fragment, query
from diffloom.plans.snapshot_queries import _PRODUCED, changes
from diffloom.session import cut, drop_cut
from diffloom.sources.blobs import explode_lines

BY = ["diffset_id", "path"]

# The text of both sides of every change whose content differs.
oracle_fragment("texts", "select blob_id, any_value(text) text from (select blob_id, text from snap_before union all select blob_id, text from snap_after) t group by 1")
oracle_fragment("pair_texts", """select c.diffset_id, c.path, c.status, coalesce(a.text, '') text_a, coalesce(b.text, '') text_b
 from changes c left join texts a on a.blob_id = c."before" left join texts b on b.blob_id = c."after"
 where c."before" is distinct from c."after" and c.mode <> 57344""")


def duck_lines(text: str) -> str:
    """A list of lines in DuckDB: none for an empty text, none after a final newline."""
    return (f"case when {text} = '' then [] when ends_with({text}, chr(10)) "
            f"then string_split({text}, chr(10))[:-2] else string_split({text}, chr(10)) end")


# Tokens without look-behind: a mark that follows a word is taken with it, and parted from it afterwards.
_QUOTED = "|".join(rf"{q}[^{q}\\]*(?:\\.[^{q}\\]*)*{q}" for q in ("\"", "''", "`"))
TOKEN = rf"[\p{{L}}\p{{N}}_]+[\"''`]?|{_QUOTED}|[^\s\x0B\p{{Z}}\x{{FEFF}}\p{{L}}\p{{N}}_]"


MERGED = r"[\p{L}\p{N}_]+[\"''`]"


def duck_key(line: str) -> str:
    """The key lines compare by, in DuckDB."""
    parted = rf"regexp_replace(t, '^([\p{{L}}\p{{N}}_]+)([\"''`])$', '\1' || chr(1) || '\2')"
    return rf"array_to_string([regexp_replace({parted}, '{T.SPACES}', '', 'g') for t in regexp_extract_all({line}, '{TOKEN}')], chr(1))"


oracle_fragment("pair_lines", f"""select diffset_id, path, 'a' side, i line_no, l text, {duck_key('l')} key
 from (select diffset_id, path, unnest(ls) l, generate_subscripts(ls, 1) i from (select diffset_id, path, {duck_lines('text_a')} ls from pair_texts) p) q
 union all select diffset_id, path, 'b' side, i line_no, l text, {duck_key('l')} key
 from (select diffset_id, path, unnest(ls) l, generate_subscripts(ls, 1) i from (select diffset_id, path, {duck_lines('text_b')} ls from pair_texts) p) q""")


#: Rounds stated for DuckDB: more than any text of the test data needs.
ORACLE_ROUNDS = 12


def align_sql(name: str, source: str, by: str, rounds: int = ORACLE_ROUNDS) -> None:
    """States the alignment for DuckDB as one fragment per step."""
    upto = "rows between unbounded preceding and current row"
    oracle_fragment(f"{name}_head", f"""select *, min(eq) over (partition by {by}, side order by line_no {upto}) = 1 head,
 max(line_no) over (partition by {by}, side) - line_no rev
 from (select *, coalesce(cast(max(case when side = 'a' then key end) over (partition by {by}, line_no)
   = max(case when side = 'b' then key end) over (partition by {by}, line_no) as int), 0) eq from {source}) s""")
    oracle_fragment(f"{name}_tail", f"""select * exclude (eq, head, rev, eq2, other, tail), count(mate) over (partition by {by}, side order by line_no {upto}) gap
 from (select *, case when head then line_no when tail then other end mate
 from (select *, not head and min(eq2) over (partition by {by}, side, head order by rev {upto}) = 1 tail
 from (select *, coalesce(cast(max(case when side = 'a' then key end) over w = max(case when side = 'b' then key end) over w as int), 0) eq2,
   case when side = 'a' then max(case when side = 'b' then line_no end) over w else max(case when side = 'a' then line_no end) over w end other
 from {name}_head window w as (partition by {by}, rev, head)) s) t) u""")
    last = f"{name}_tail"
    for r in range(rounds):
        occurrence = (f", row_number() over (partition by {by}, gap, key, mate is null, side order by line_no) nth"
                      if r >= A.UNIQUE_ROUNDS else ", 1 nth")
        this = f"{name}_r{r}"
        oracle_fragment(f"{this}m", f"""select *, mate is null and na = 1 and nb = 1 cand from (
 select *, max(case when side = 'a' then line_no end) over w la, max(case when side = 'b' then line_no end) over w lb,
   count(case when side = 'a' then 1 end) over w na, count(case when side = 'b' then 1 end) over w nb
 from (select *{occurrence} from {last}) s window w as (partition by {by}, gap, key, mate is null, nth)) t""")
        oracle_fragment(f"{this}b", f"""select *, coalesce(sum(nblk) over (partition by {by}, gap, side, cand order by ra {upto}), 0) blk,
   sum(npart) over (partition by {by}, gap, side, cand order by ra {upto}) part
 from (select *, cast(lag(rb - ra) over w <> rb - ra as int) nblk,
   cast(coalesce(max(rb) over (partition by {by}, gap, side, cand order by ra rows between unbounded preceding and 1 preceding), 0) = ra - 1 as int) npart
 from (select *, row_number() over (partition by {by}, gap, side, cand order by lb, line_no) rb,
   row_number() over (partition by {by}, gap, side, cand order by la, line_no) ra from {this}m) s
 window w as (partition by {by}, gap, side, cand order by ra)) t""")
        oracle_fragment(this, f"""select * exclude (gap0), count(mate) over (partition by {by}, side order by line_no {upto}) gap from (
 select * exclude (mate, gap, nth, la, lb, na, nb, cand, rb, ra, nblk, npart, blk, part, weight, best), gap gap0,
   case when cand and weight = best then (case when side = 'a' then lb else la end) else mate end mate
 from (select *, max(weight) over (partition by {by}, gap, side, cand, part) best
 from (select *, count(*) over (partition by {by}, gap, side, cand, part, blk) * 1000000 - blk weight from {this}b) s) t) u""")
        last = this
    oracle_fragment(name, f"select * from {last}")


align_sql("aligned", "pair_lines", "diffset_id, path")
oracle_fragment("merged_rows", """select *, row_number() over (partition by diffset_id, path order by gap, rk, line_no) row_no from (
 select diffset_id, path, gap, line_no, text, key, case when mate is not null then ' ' when side = 'a' then '-' else '+' end op,
   case when mate is not null then 0 when side = 'a' then 1 else 2 end rk,
   case when side = 'a' then line_no end line_a, case when side = 'a' then mate else line_no end line_b
 from aligned where not (side = 'b' and mate is not null)) r""")
oracle_fragment("merged_states", """select *, case when op <> ' ' then 'd' when max(loud) over (partition by diffset_id, path order by row_no rows between 3 preceding and 3 following) = 1 then 'u' else 'e' end state
 from (select *, case when op <> ' ' then max(case when op <> ' ' and key <> '' then 1 else 0 end) over (partition by diffset_id, path, gap) else 0 end loud from merged_rows) r""")
oracle_fragment("merged_runs", """select *, sum(fresh) over w frag_no, count(line_a) over w seen_a, count(line_b) over w seen_b
 from (select *, cast(coalesce(lag(state) over (partition by diffset_id, path order by row_no), '') <> state as int) fresh from merged_states) r
 window w as (partition by diffset_id, path order by row_no rows between unbounded preceding and current row)""")
oracle_fragment("fragments", """select diffset_id, path, frag_no, case when min(state) = 'd' then 'diff' when min(state) = 'e' and count(*) > 1 then 'elided' else 'unchanged' end kind,
 max(seen_a) - count(line_a) + 1 before_start, count(line_a) before_n, max(seen_b) - count(line_b) + 1 after_start, count(line_b) after_n
 from merged_runs group by diffset_id, path, frag_no""")


def with_texts(d: Data, changed):
    """Both sides' texts of the changes whose content differs. Equal ids and submodules drop out before any
    text is read; only blobs a change needs are fetched, each once, whichever snapshot holds it."""
    needed = changed.filter(~F.col("before").eqNullSafe(F.col("after")) & ~F.col("submodule"))
    ids = needed.select(F.explode(F.array("before", "after")).alias("blob")).filter("blob is not null").distinct()
    blobs = d.snap_before.select(F.col("blob_id").alias("blob"), "text").unionByName(d.snap_after.select(F.col("blob_id").alias("blob"), "text"))
    # The semi-join comes first, so texts of unchanged files are never shuffled; then copies fold into one.
    blobs = blobs.join(ids, "blob", "left_semi").groupBy("blob").agg(F.any_value("text").alias("text"))
    a = blobs.select(F.col("blob").alias("before"), F.col("text").alias("text_a"))
    b = blobs.select(F.col("blob").alias("after"), F.col("text").alias("text_b"))
    return needed.join(a, "before", "left").join(b, "after", "left")


def pair_lines(pairs, key=T.compare_key):
    """Lines of both sides, long form, with the key they compare by."""
    sides = pairs.select(
        *BY,
        F.explode(
            F.array(
                F.struct(F.lit("a").alias("side"), F.coalesce("text_a", F.lit("")).alias("text")),
                F.struct(F.lit("b").alias("side"), F.coalesce("text_b", F.lit("")).alias("text")),
            )
        ).alias("s"),
    ).select(*BY, "s.side", "s.text")
    return explode_lines(sides).withColumn("key", key(F.col("text")))


def sided(d: Data, changed):
    """``(by, side, text)`` of the changes whose content differs, one row per side, as ``with_texts`` pairs them. A text is
    shuffled once, by its blob."""
    needed = changed.filter(~F.col("before").eqNullSafe(F.col("after")) & ~F.col("submodule"))
    sides = needed.select(*BY, F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("blob")) for s, c in (("a", "before"), ("b", "after"))])).alias("s"))
    sides = sides.select(*BY, "s.side", "s.blob").filter("blob is not null")
    blobs = d.snap_before.select(F.col("blob_id").alias("blob"), "text").unionByName(d.snap_after.select(F.col("blob_id").alias("blob"), "text"))
    blobs = blobs.join(sides.select("blob").distinct(), "blob", "left_semi").groupBy("blob").agg(F.any_value("text").alias("text"))
    return sides.join(blobs, "blob").select(*BY, "side", "text")


def side_texts(d: Data, changed):
    """The texts of ``sided``, written, since an alignment reads them for the keys and again for the lines."""
    return d.shared("side_texts", lambda d: sided(d, changed))


def side_lines(sides):
    """The lines of sides with the key they compare by."""
    return explode_lines(sides.withColumn("text", F.coalesce("text", F.lit("")))).withColumn("key", T.compare_key(F.col("text")))


def edit_number():
    """The number of the edit a line is, told from its path and its key."""
    return (F.conv(F.substring(F.md5(F.concat_ws("", "path", "key")), 1, 7), 16, 10).cast("bigint") % 700).cast("int")


def bare(d: Data):
    """The aligned lines without text and key, which are the longest part of them: a hash of the key, whether it is
    blank, the number of words and of the edit. They are told once, before the alignment."""

    def build(d: Data):
        lines = side_lines(sided(d, changes(d)))
        lines = lines.select(*BY, "side", "line_no", F.unhex(F.md5("key")).alias("key"), (F.col("key") == "").alias("blank"),
                             F.size(T.words(F.col("text"))).alias("atoms"), edit_number().alias("edit"))
        return A.align_lines(cut(lines), BY).withColumnRenamed("key", "hash")

    return d.shared("bare", build)


def aligned(d: Data):
    if not d.has("aligned"):
        # Once the lines are written no one reads the sides; where another query of the session has written them, they stay.
        sides = side_texts(d, changes(d)) if d.has("side_texts") else cut(sided(d, changes(d)))
        d.shared("aligned", lambda d: A.align_lines(side_lines(sides), BY, keep_key=False))
        if not d.has("side_texts"):
            drop_cut(sides)
    rows = d.shared("aligned", aligned)
    return rows.withColumn("key", T.compare_key(F.col("text")))


def diff_rows(d: Data):
    return H.diff_rows(aligned(d), BY)


def fragments(d: Data):
    return H.fragments(diff_rows(d), BY)


def solid_edits(rows):
    """The gaps of diff rows whose two sides differ in more than blanks. A gap is a part of one file."""
    side = lambda op: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("op") == op, F.struct("row_no", T.solid(F.col("text")).alias("s"))))), lambda r: r["s"]), "")
    return rows.filter("op <> ' '").groupBy(*BY, "gap").agg(side("-").alias("_o"), side("+").alias("_n")).filter("_o <> _n").select(*BY, "gap")


def change_report(d: Data):
    """Per changed file: status, line counts, whether it folds, and why."""
    changed = changes(d)
    pairs = with_texts(d, changed)
    stats = H.line_stats(diff_rows(d), BY)
    # A file's own facts stay a row; the text is read here only for its first characters.
    shown = F.coalesce("text_b", "text_a")
    facts = pairs.select(*BY, "status", P.produced_by(F.col("path"), shown).alias("produced"),
                         F.greatest(F.length(F.coalesce("text_a", F.lit(""))), F.length(F.coalesce("text_b", F.lit("")))).alias("chars"))
    rows = changed.select(*BY, "status", "mode", "before", "after").join(facts, [*BY, "status"], "left").join(
        stats.join(facts.select(*BY, "status"), BY), [*BY, "status"], "left"
    )
    # A file whose old and new lines hold the same characters, blanks aside, was only formatted.
    edited = solid_edits(diff_rows(d)).select(*BY).distinct().withColumn("edited", F.lit(True))
    rows = rows.join(edited, BY, "left").na.fill(0, ["added", "removed"]).na.fill(False, ["edited"])
    formatted = F.col("chars").isNotNull() & F.col("before").isNotNull() & F.col("after").isNotNull() & ~F.col("edited")
    reason = P.collapse_reason(
        F.col("produced"), F.col("status") == "deleted",
        P.fallback_class(F.col("chars"), F.lit(0), F.lit(0)), F.col("added") + F.col("removed"),
        F.lit(False), formatted,
    )
    return rows.select(
        *BY, "status", F.coalesce(P.language_for_path(F.col("path")), F.lit("")).alias("language"),
        P.is_test_path(F.col("path")).alias("is_test"), "added", "removed",
        F.coalesce(reason, F.lit("")).alias("collapsed"),
    )


from diffloom.plans.snapshot_queries import _BASE, _EXT, _LANG, _NAMES, _TEST  # noqa: E402

_LANGUAGE = f"""coalesce(case {_NAMES.format(_BASE)} when {_BASE} like 'Dockerfile.%' then 'dockerfile'
 when {_BASE} like '.env.%' then 'ini' when regexp_matches({_BASE}, '(?i)\\.ya?ml\\.liquid$') then 'yaml' {_LANG.format(_EXT)} end, '')"""
oracle_fragment("stats", """select diffset_id, path, count(case when op = '+' then 1 end) added, count(case when op = '-' then 1 end) removed from merged_rows group by 1, 2""")
oracle_fragment("report", f"""select diffset_id, path, status, {_LANGUAGE} "language", {_TEST} is_test, added, removed, coalesce(
 case when not (produced = 'lockfile' and added + removed <= 10) then produced end, case when status = 'deleted' then 'deleted' end,
 case when chars > 500000 and added + removed > 400 then 'too-large' end, case when chars is not null and "before" is not null and "after" is not null and not edited then 'format-only' end, '') collapsed
 from (select c."before", c."after", e.diffset_id is not null edited, c.diffset_id, c.path, c.status, coalesce(s.added, 0) added, coalesce(s.removed, 0) removed, f.produced, f.chars
 from changes c left join (select s.*, p.status from stats s join pair_texts p using (diffset_id, path)) s using (diffset_id, path, status)
 left join (select diffset_id, path, status, {_PRODUCED} produced, greatest(length(text_a), length(text_b)) chars
   from (select *, case when status = 'deleted' then text_a else text_b end text from pair_texts) p) f using (diffset_id, path, status)
 left join (select distinct diffset_id, path from (select diffset_id, path, gap, string_agg(case when op = '-' then text end, '' order by row_no) o, string_agg(case when op = '+' then text end, '' order by row_no) n from merged_rows where op <> ' ' group by 1, 2, 3) g
   where regexp_replace(coalesce(o, ''), '{T.SPACES}', '', 'g') <> regexp_replace(coalesce(n, ''), '{T.SPACES}', '', 'g')) e on e.diffset_id = c.diffset_id and e.path = c.path) r""")


@query("h1_change_report", "select * from report")
def _(d):
    return change_report(d)


@query("p5_collapse_reason", "select collapsed, status, count(*) files, cast(sum(added + removed) as bigint) changed_lines from report group by 1, 2")
def _(d):
    return change_report(d).groupBy("collapsed", "status").agg(F.count("*").alias("files"), F.sum(F.col("added") + F.col("removed")).alias("changed_lines"))


@query("w1_align_lines", "select diffset_id, path, line_no line_a, mate line_b from aligned where side = 'a' and mate is not null")
def _(d):
    return A.line_map(aligned(d), BY)


@query("h1_diff_rows", "select diffset_id, path, row_no, op, md5(text) text_md5 from merged_rows")
def _(d):
    return diff_rows(d).select(*BY, "row_no", "op", F.md5("text").alias("text_md5"))


@query("w3_hunks", "select diffset_id, path, cast(frag_no as bigint) frag_no, kind, before_start, before_n, after_start, after_n from fragments")
def _(d):
    return fragments(d)


@query("a1_line_stats", "select * from stats")
def _(d):
    return H.line_stats(diff_rows(d), BY)


@query("a1_set_stats", "select diffset_id, count(*) files, cast(sum(added) as bigint) added, cast(sum(removed) as bigint) removed from stats group by 1")
def _(d):
    return H.line_stats(diff_rows(d), BY).groupBy("diffset_id").agg(
        F.count("*").alias("files"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))


@query("a13_line_ratio", """select diffset_id, path, count(*) lines, count(mate) kept, cast(count(mate) as double) / count(*) ratio from aligned group by 1, 2""")
def _(d):
    return H.line_ratio(aligned(d), BY)


@query("s4_explode_lines", f"""select doc_id, i line_no, md5(l) line from (select doc_id, unnest(ls) l, generate_subscripts(ls, 1) i
 from (select doc_id, {duck_lines('text')} ls from documents) p) q""")
def _(d):
    lines = explode_lines(d.documents.select("doc_id", "text"))
    return lines.select("doc_id", "line_no", F.md5("text").alias("line"))
