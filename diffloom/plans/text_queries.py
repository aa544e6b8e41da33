"""Registered queries over text, ranges and hunks' bookkeeping."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from diffloom.functions import keys as K
from diffloom.functions import paths as P
from diffloom.functions import text as T
from diffloom.operators import align as A
from diffloom.operators import hunks as H
from diffloom.plans.line_queries import BY, MERGED, TOKEN, align_sql, aligned, diff_rows, duck_lines, fragments, side_lines, side_texts
from diffloom.plans.registry import Data, fragment, oracle_fragment, query
from diffloom.plans.snapshot_queries import changes
from diffloom.sources import blobs as B

oracle_fragment("doc_lines", f"select doc_id, i line_no, l text from (select doc_id, unnest(ls) l, generate_subscripts(ls, 1) i from (select doc_id, {duck_lines('text')} ls from documents) p) q")
# Matches of the pattern without look-behind with their places; one that took a mark along is two tokens.
oracle_fragment("line_tokens", f"""select doc_id, line_no, row_number() over (partition by doc_id, line_no order by "start") tok_no, token, "start" from (
 select doc_id, line_no, unnest(case when two then [t[:-2], t[-1:]] else [t] end) token, unnest(case when two then [s, s + length(t) - 1] else [s] end) "start" from (
 select *, regexp_matches(t, '^{MERGED}$') two, sum(length(t) + length(g)) over (partition by doc_id, line_no order by i rows between unbounded preceding and current row) - length(t) s from (
 select doc_id, line_no, unnest(ts) t, generate_subscripts(ts, 1) i, unnest(gs[:len(ts)]) g from (
 select doc_id, line_no, regexp_extract_all(text, '{TOKEN}') ts, regexp_split_to_array(text, '{TOKEN}') gs from doc_lines) x) y) z) w""")


def doc_lines(d: Data):
    return B.explode_lines(d.documents.select("doc_id", "text"))


@query("s5_explode_tokens", "select * from line_tokens")
def _(d):
    return B.explode_tokens(doc_lines(d))


@query("f2_line_key", f"""select key_md5, count(*) n from (select md5(cast(to_json(coalesce(ts, cast([] as varchar[]))) as varchar)) key_md5 from doc_lines left join (
 select doc_id, line_no, list(regexp_replace(token, '{T.SPACES}', '', 'g') order by tok_no) ts from line_tokens group by 1, 2) x using (doc_id, line_no)) y group by 1""")
def _(d):
    return doc_lines(d).groupBy(F.md5(T.line_key(F.col("text"))).alias("key_md5")).agg(F.count("*").alias("n"))


@query("f3_text_hash", """select hash, count(*) n from (select md5(coalesce(ts, '')) hash from doc_lines left join (
 select doc_id, line_no, string_agg(token, chr(1) order by tok_no) ts from line_tokens group by 1, 2) x using (doc_id, line_no)) y group by 1""")
def _(d):
    return doc_lines(d).groupBy(T.text_hash(F.col("text")).alias("hash")).agg(F.count("*").alias("n"))


@query("f4_atom_keys", """select doc_id, md5(source||chr(0)||lang||chr(1)||'x'||chr(0)||case when doc_id % 2 = 0 then '='||md5(text) else '' end||chr(0)||case when doc_id % 3 = 0 then '' else '='||md5(lang) end) atom from documents""")
def _(d):
    key = K.atom_key(F.col("source"), F.array("lang", F.lit("x")), F.when(F.col("doc_id") % 2 == 0, F.md5("text")), F.when(F.col("doc_id") % 3 != 0, F.md5("lang")))
    return d.documents.select("doc_id", key.alias("atom"))


@query("f5_mark_keys", """select diffset_id, path, 'file'||chr(0)||path||chr(0)||coalesce("before", 'null')||chr(0)||coalesce("after", 'null') file_mark,
 'node'||chr(0)||path||chr(0)||'after'||chr(0)||'0.2'||chr(0)||md5(path) node_mark, 'move'||chr(0)||path||':1-2:'||md5(path)||chr(0) move_mark, 'atom'||chr(0)||md5(path) atom_mark, status from changes""")
def _(d):
    path = F.col("path")
    return changes(d).select(
        *BY, K.file_mark(path, F.col("before"), F.col("after")).alias("file_mark"), K.node_mark(path, F.lit("after"), F.array(F.lit("0"), F.lit("2")), F.md5(path)).alias("node_mark"),
        K.move_mark(K.move_half(path, F.lit(1), F.lit(2), path), F.lit(None).cast("string")).alias("move_mark"), K.atom_mark(F.md5(path)).alias("atom_mark"), "status")


@query("f6_line_of", """select doc_id, off, least(length(substr(text, 1, off)) - length(replace(substr(text, 1, off), chr(10), '')), greatest(length(text) - length(replace(text, chr(10), '')) - case when ends_with(text, chr(10)) then 1 else 0 end, 0)) line,
 case when instr(substr(text, off + 1), chr(10)) = 0 then length(text) else off + instr(substr(text, off + 1), chr(10)) end line_end
 from (select doc_id, text, unnest(range(0, length(text) + 1, 50)) off from documents) o""")
def _(d):
    rows = d.documents.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.length("text"), F.lit(50))).alias("off"))
    return rows.select("doc_id", "off", T.line_of(F.col("text"), F.col("off")).alias("line"), T.line_end(F.col("text"), F.col("off")).alias("line_end"))


@query("f8_chars_of", f"""select doc_id, length(regexp_replace(substr(text, 1, length(text) // 3), '{T.SPACES}', '', 'g')) "start", length(regexp_replace(text, '{T.SPACES}', '', 'g')) "end" from documents""")
def _(d):
    c = T.chars_of(F.col("text"), F.floor(F.length("text") / 3).cast("int"), F.length("text"))
    return d.documents.select("doc_id", c["start"].alias("start"), c["end"].alias("end"))


@query("f8_display_range", f"""select doc_id, line_no, coalesce(offs[n // 3 + 1], length(text)) "start", coalesce(offs[n] + 1, offs[n // 3 + 1], length(text)) "end" from (
 select *, len(offs) n from (select *, [i for i in range(0, length(text)) if not regexp_full_match(text[i + 1], '{T.SPACE}')] offs from doc_lines) x) y""")
def _(d):
    n = F.length(T.solid(F.col("text")))
    r = T.display_range(F.col("text"), F.floor(n / 3).cast("int"), n)
    return doc_lines(d).select("doc_id", "line_no", r["start"].alias("start"), r["end"].alias("end"))


oracle_fragment("display_words", f"""select doc_id, line_no, i, w, brk from (select doc_id, line_no, unnest(ws) w, generate_subscripts(ws, 1) i, unnest(bs[:len(ws)]) brk from (
 select doc_id, line_no, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_$]+') ws, regexp_split_to_array(text, '[\\p{{L}}\\p{{N}}_$]+') bs from doc_lines) x) y""")


@query("f8_words_of", f"""select doc_id, line_no, i place, sum(n) over w - length(w) "start", sum(n) over w "end" from (
 select *, length(w) + length(regexp_replace(brk, '{T.SPACES}', '', 'g')) n from display_words) x window w as (partition by doc_id, line_no order by i rows between unbounded preceding and current row)""")
def _(d):
    return B.explode_words(doc_lines(d)).select("doc_id", "line_no", "place", "start", "end")


@query("f13_words", r"select w word, count(*) n from (select unnest(regexp_extract_all(text, '[\p{L}_$][\p{L}\p{N}_$]*')) w from documents) x group by 1")
def _(d):
    return d.documents.select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


fragment("commented", "select doc_id, case doc_id % 4 when 0 then '// ' when 1 then '  # ' when 2 then ' * ' else '' end||replace(text, chr(10), chr(10)||case when doc_id % 3 = 0 then '//' else ' *' end) text from {documents}")


@query("f14_marker_free", r"select doc_id, md5(replace(regexp_replace(regexp_replace(text, '(?m)^([ \t]*)\*/', '\1' || chr(1) || '/', 'g'), '(?m)^[ \t]*(?:\*|//+|#)[ \t]*', '', 'g'), chr(1), '*')) plain from commented")
def _(d):
    return d.commented.select("doc_id", F.md5(T.marker_free(F.col("text"))).alias("plain"))


fragment("literals", """select l_orderkey, l_linenumber, case l_linenumber % 6 when 0 then cast(l_orderkey as string)||'.'||cast(l_partkey % 100 as string)||'0' when 1 then '-00'||cast(l_suppkey as string)||'000' when 2 then '.'||cast(l_partkey as string)||'e-2' when 3 then '0x1f' when 4 then '+'||cast(l_suppkey as string)||'E+3' else '0.000' end raw from {lineitem}""")


@query("f15_decimal_value", r"""select raw, case when v is null then '' when k = '' then s||'0e0' else s||k||'e'||cast(p + length(dg) - length(k) as varchar) end canonical, count(*) n from (
 select *, regexp_replace(dg, '0+$', '') k from (select *, regexp_replace(w||f, '^0+', '') dg, case when regexp_full_match(raw, '[+-]?\d*(\.\d*)?([eE][+-]?\d+)?') and w||f <> '' then 1 end v,
 case when starts_with(raw, '-') then '-' else '' end s, coalesce(try_cast(nullif(e, '') as int), 0) - length(f) p from (
 select raw, regexp_extract(raw, '^([+-]?)(\d*)(?:\.(\d*))?(?:[eE]([+-]?\d+))?$', 2) w, regexp_extract(raw, '^([+-]?)(\d*)(?:\.(\d*))?(?:[eE]([+-]?\d+))?$', 3) f, regexp_extract(raw, '^([+-]?)(\d*)(?:\.(\d*))?(?:[eE]([+-]?\d+))?$', 4) e from literals) a) b) c group by 1, 2""")
def _(d):
    return d.literals.groupBy("raw", F.coalesce(T.decimal_value(F.col("raw")), F.lit("")).alias("canonical")).agg(F.count("*").alias("n"))


oracle_fragment("gap_texts", f"select diffset_id, path, gap, string_agg(case when op = '-' then text end, chr(10) order by row_no) old_text, string_agg(case when op = '+' then text end, chr(10) order by row_no) new_text from merged_rows where op <> ' ' group by 1, 2, 3")


def gap_texts(d: Data):
    side = lambda op: F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("row_no", "op", "text"))), lambda r: r["op"] == op), lambda r: r["text"]), "\n")
    rows = diff_rows(d).filter("op <> ' '").groupBy(*BY, "gap").agg(side("-").alias("_o"), side("+").alias("_n"), F.count("line_a").alias("a"), F.count("line_b").alias("b"))
    return rows.withColumns({"old_text": F.when(F.col("a") > 0, F.col("_o")), "new_text": F.when(F.col("b") > 0, F.col("_n"))})


@query("p8_solid_edits", f"""select diffset_id, path, gap from gap_texts where regexp_replace(coalesce(old_text, ''), '{T.SPACES}', '', 'g') <> regexp_replace(coalesce(new_text, ''), '{T.SPACES}', '', 'g')""")
def _(d):
    return H.drop_whitespace_edits(gap_texts(d)).select(*BY, "gap")


@query("f17_mostly_kept", f"""select diffset_id, path, cast(sum(case when op = ' ' then n else 0 end) as bigint) kept, cast(sum(n) as bigint) total, sum(case when op = ' ' then n else 0 end) * 2 >= sum(n) mostly_kept
 from (select *, length(regexp_replace(text, '{T.SPACES}', '', 'g')) n from merged_rows) x group by 1, 2""")
def _(d):
    n = F.length(T.solid(F.col("text")))
    rows = diff_rows(d).groupBy(*BY).agg(F.sum(F.when(F.col("op") == " ", n).otherwise(0)).alias("kept"), F.sum(n).alias("total"))
    return rows.withColumn("mostly_kept", T.mostly_kept(F.col("kept"), F.col("total")))


# --- blobs -------------------------------------------------------------------------------------------


def raw_blobs(d: Data):
    """Document texts as bytes; some with a NUL early on, some cut inside a character."""
    i = F.col("doc_id")
    content = F.encode("text", "utf-8")
    content = F.when(i % 9 == 0, F.concat(content, F.unhex(F.lit("00")))).when(i % 9 == 1, F.concat(F.unhex(F.lit("C3")), content)).otherwise(content)
    return d.documents.select("doc_id", content.alias("content"), "text")


@query("s2_decode_blobs", """select doc_id, (doc_id % 9 = 0 and octet_length(encode(text)) < 8000) or doc_id % 9 = 1 is_binary, case when (doc_id % 9 = 0 and octet_length(encode(text)) < 8000) or doc_id % 9 = 1 then '' else md5(case when doc_id % 9 = 0 then text||chr(0) else text end) end text_md5 from documents""")
def _(d):
    b = B.decode_blobs(raw_blobs(d).drop("text"))
    return b.select("doc_id", "is_binary", F.coalesce(F.md5("text"), F.lit("")).alias("text_md5"))


@query("s3_blob_ids", """select doc_id, sha1('blob '||cast(octet_length(encode(text)) as varchar)||chr(0)||text) blob_id, doc_id % 2 = 0 or substr(sha1('blob '||cast(octet_length(encode(text)) as varchar)||chr(0)||text), 1, 7) = '0000000' matches from documents""")
def _(d):
    b = B.with_blob_id(d.documents.select("doc_id", F.encode("text", "utf-8").alias("content")))
    b = b.withColumn("expected", F.when(F.col("doc_id") % 2 == 0, F.substring("blob_id", 1, 7)).otherwise("0000000"))
    return B.check_blob_id(b).select("doc_id", "blob_id", "matches")


# --- ranges ------------------------------------------------------------------------------------------
fragment("ranges", "select l_orderkey doc, cast(l_partkey % 97 as int) start_, cast(l_partkey % 97 + l_suppkey % 12 as int) end_ from {lineitem}")
oracle_fragment("merged_ranges", """select doc, min(start_) "start", max(end_) "end" from (select *, sum(fresh) over (partition by doc order by start_, end_ rows between unbounded preceding and current row) run from (
 select *, case when max(end_) over (partition by doc order by start_, end_ rows between unbounded preceding and 1 preceding) >= start_ then 0 else 1 end fresh from ranges where end_ > start_) x) y group by doc, run""")


def ranges(d: Data):
    return d.ranges.withColumnsRenamed({"start_": "start", "end_": "end"})


@query("w4_merge_ranges", "select * from merged_ranges")
def _(d):
    return H.merge_ranges(ranges(d), ["doc"])


# Painted characters one by one: the furthest end and the start of the joined range so far, over ranges and characters.
@query("w4_paint_ranges", r"""with l as (select doc_id, line_no, text, coalesce(sum(length(text) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) ls from doc_lines),
 r as (select doc_id, ls + 1 s, ls + 6 + line_no * 7 % 90 e from l union all select doc_id, ls + 7 + line_no * 7 % 90, ls + 11 + line_no * 7 % 90 from l),
 m as (select doc_id, s, e, case when max(e) over (partition by doc_id order by s, e rows between unbounded preceding and 1 preceding) >= s then null else s end fresh from r),
 c as (select doc_id, line_no, ls, ls + i p, substr(text, i + 1, 1) ch, i < length(regexp_extract(text, '^[ \t]*')) inside from (select *, unnest(range(0, length(text))) i from l) x),
 ev as (select doc_id, s p, 0 o, e, fresh, cast(null as bigint) line_no, cast(null as bigint) ls, cast(null as varchar) ch, cast(null as boolean) inside from m union all select doc_id, p, 1, null, null, line_no, ls, ch, inside from c),
 w as (select *, max(e) over f reach, max(fresh) over f run from ev window f as (partition by doc_id order by p, o rows between unbounded preceding and current row)),
 k as (select *, coalesce(reach > p and (not inside or run >= ls), false) painted from w where o = 1),
 g as (select *, sum(case when not painted and ch not in (' ', chr(9)) then 1 else 0 end) over (partition by doc_id, line_no order by p rows between unbounded preceding and current row) island from k)
 select doc_id, cast(min(p) as bigint) "start", cast(max(p) + 1 as bigint) "end" from g where painted group by doc_id, line_no, island""")
def _(d):
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    lines = doc_lines(d).withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)))
    reach = F.col("line_no") * 7 % 90
    asked = F.array(*[F.struct((F.col("start") + a).alias("start"), (F.col("start") + b).alias("end")) for a, b in ((1, reach + 6), (reach + 7, reach + 11))])
    return H.paint_ranges(lines.select("doc_id", F.explode(asked).alias("r")).select("doc_id", "r.*"), lines, ["doc_id"])


@query("a2_marked_lines", "select doc, cast(sum(\"end\" - \"start\") as bigint) marked from merged_ranges group by 1")
def _(d):
    return H.marked_lines(ranges(d), ["doc"])


@query("w14_outermost", """select r.doc, r.start_ "start", r.end_ "end" from (select distinct * from ranges) r where not exists (select 1 from ranges o where o.doc = r.doc and o.start_ <= r.start_ and o.end_ >= r.end_ and (o.start_ < r.start_ or o.end_ > r.end_))""")
def _(d):
    from diffloom.operators.nodes import outermost

    return outermost(ranges(d), ["doc"]).select("doc", "start", "end")


# --- context -----------------------------------------------------------------------------------------
@query("w5_funcnames", r"""select doc_id, line_no, coalesce(last_value(name ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and current row), '') scope from (
 select *, case when regexp_matches(text, '^[\p{L}\p{Nl}_$]') then substr(trim(regexp_replace(text, '\r$', '')), 1, 80) end name from doc_lines) x""")
def _(d):
    return H.funcnames(doc_lines(d), ["doc_id"]).select("doc_id", "line_no", F.coalesce("scope", F.lit("")).alias("scope"))


oracle_fragment("gap_rows", """select diffset_id, path, frag_no, before_start + top before_line, after_start + top after_line, greatest(coalesce(nxt, after_start + after_n) - after_start - top - bottom, 0) hidden, before_start = 1 and after_start = 1 at_start, nxt is null at_end, top > 0 or bottom > 0 revealed
 from (select *, lead(after_start) over (partition by diffset_id, path order by frag_no) nxt, case when frag_no % 3 = 0 then 2 else 0 end top, case when frag_no % 2 = 0 then 1 else 0 end bottom from fragments) f where kind = 'elided'""")


def gap_rows(d: Data):
    frags = fragments(d)
    revealed = frags.filter("kind = 'elided'").select(*BY, "frag_no", F.when(F.col("frag_no") % 3 == 0, 2).otherwise(0).alias("top"), F.when(F.col("frag_no") % 2 == 0, 1).otherwise(0).alias("bottom"))
    return H.gaps(frags, revealed, BY)


@query("w6_gaps", "select * replace (cast(frag_no as bigint) as frag_no) from gap_rows")
def _(d):
    return gap_rows(d)


for _dir, _lo, _hi in (("down", "after_line", "after_line + least(20, hidden)"), ("up", "after_line + hidden - least(20, hidden)", "after_line + hidden"), ("all", "after_line", "after_line + hidden")):

    def _make(direction):
        def run(d):
            lines = aligned(d).filter("side = 'b'").select(*BY, "line_no", "text")
            return H.expand_gap(gap_rows(d), lines, BY, direction).select(*BY, "frag_no", "line_no", F.md5("text").alias("text_md5"))

        return run

    query(f"h9_expand_{_dir}", f"""select g.diffset_id, g.path, cast(g.frag_no as bigint) frag_no, l.line_no, md5(l.text) text_md5 from gap_rows g join aligned l on l.side = 'b' and l.diffset_id = g.diffset_id and l.path = g.path
 and l.line_no >= {_lo} and l.line_no < {_hi}""")(_make(_dir))

oracle_fragment("display_map", """select diffset_id, path, line_no, case when line_no % 5 in (1, 4) and mate is not null then mate end source_line from aligned where side = 'b'""")


@query("w11_fill_line_map", """select diffset_id, path, line_no, coalesce(source_line, case when nd - pd = ns - ps then ps + line_no - pd end, 0) source_line from (
 select *, last_value(case when source_line is not null then line_no end ignore nulls) over u pd, last_value(source_line ignore nulls) over u ps, last_value(case when source_line is not null then line_no end ignore nulls) over n nd, last_value(source_line ignore nulls) over n ns
 from display_map window u as (partition by diffset_id, path order by line_no rows between unbounded preceding and current row), n as (partition by diffset_id, path order by line_no desc rows between unbounded preceding and current row)) x""")
def _(d):
    rows = aligned(d).filter("side = 'b'").select(*BY, "line_no", F.when((F.col("line_no") % 5).isin(1, 4), F.col("mate")).alias("source_line"))
    return H.fill_line_map(rows, BY).withColumn("source_line", F.coalesce("source_line", F.lit(0)))


@query("p6_fallback_class", """select doc_id, coalesce(case when n_chars * 400 > 500000 or n_chars * 20 > 50000 then 'too-large' when n_chars % 7 > 0.1 * n_chars then 'parse-error' end, '') fallback from documents""")
def _(d):
    n = F.col("n_chars")
    return d.documents.select("doc_id", F.coalesce(P.fallback_class(n * 400, n * 20, F.when(n * 400 > 0, n % 7) * 400), F.lit("")).alias("fallback"))


@query("p7_is_inflated", """select diffset_id, path, added, removed, (added + removed) > 0 and added * 40 > greatest(100, (added + removed) * 10) inflated from stats""")
def _(d):
    s = H.line_stats(diff_rows(d), BY)
    total = F.col("added") + F.col("removed")
    return s.select(*BY, "added", "removed", P.is_inflated(F.col("added") * 40, total).alias("inflated"))


# --- pairs -------------------------------------------------------------------------------------------
# Parents with children in two orders: an order's lines by line number and by part.
fragment("sibling_pairs", "select l_orderkey parent, l_linenumber * 10 pos_a, max(l_partkey * 100 + l_linenumber) pos_b from {lineitem} group by l_orderkey, l_linenumber")


@query("w2_out_of_order", """select parent, pos_a, pos_b from (select *, max(weight) over (partition by parent, part) best from (select *, count(*) over (partition by parent, part, blk) * 1000000 - blk weight from (
 select *, coalesce(sum(nb) over w, 0) blk, sum(np) over w part from (select *, cast(lag(rb - ra) over (partition by parent order by ra) <> rb - ra as int) nb,
   cast(coalesce(max(rb) over (partition by parent order by ra rows between unbounded preceding and 1 preceding), 0) = ra - 1 as int) np from (
 select *, row_number() over (partition by parent order by pos_a) ra, row_number() over (partition by parent order by pos_b) rb from sibling_pairs) s) t
 window w as (partition by parent order by ra rows between unbounded preceding and current row)) u) v) z where weight <> best""")
def _(d):
    return A.out_of_order(d.sibling_pairs, ["parent"])


# Hunks before any line inside them was matched: the common head and tail stripped, the rest one hunk.
oracle_fragment("rescue_lines", r"""select *, row_number() over (partition by diffset_id, path, hunk, side order by line) line_no from (
 select diffset_id, path, gap hunk, side, line_no line, key from aligned_tail where mate is null and (regexp_matches(text, '[\p{L}\p{N}_]') or key = '')) x""")
align_sql("rescued", "rescue_lines", "diffset_id, path, hunk")


@query("w13_rescue_lines", "select a.diffset_id, a.path, a.hunk, a.line line_a, b.line line_b from rescued a join rescued b on b.side = 'b' and b.diffset_id = a.diffset_id and b.path = a.path and b.hunk = a.hunk and b.line_no = a.mate where a.side = 'a'")
def _(d):
    coarse = A.align_lines(H.rescue_marks(side_lines(side_texts(d, changes(d)))), BY, rounds=0)
    return H.rescue_lines(H.diff_rows(coarse, BY), BY)
