"""Registered queries over unified diffs."""

from pyspark.sql import functions as F

from diffloom.operators import hunks as H
from diffloom.plans.registry import Data, fragment, oracle_fragment, query
from diffloom.plans.line_queries import duck_lines
from diffloom.sources import patches as S
from diffloom.sources.blobs import explode_lines

# One patch per source file: the first line reworded, the second dropped, a line added at the end; its
# context is the rest of the text. ``t`` is the text without a final newline, ``n`` how many lines it has; a
# text of one line has nothing to drop, and one of none only gains a line.
fragment("patch_inputs", """
select doc_id, source, text, t, case when text = '' then 0 else length(t) - length(replace(t, chr(10), '')) + 1 end n
from (select doc_id, source, text, case when substr(text, length(text), 1) = chr(10) then substr(text, 1, length(text) - 1) else text end t from {documents}) x""")
fragment("patch_split", """
select doc_id, source, n, split_part(t, chr(10), 1) l1, case when n > 1 then split_part(t, chr(10), 2) else '' end l2,
       case when n < 3 then '' else substr(t, length(split_part(t, chr(10), 1)) + length(split_part(t, chr(10), 2)) + 3) end rest, text,
       case when n > 1 then n else n + 1 end tail
from patch_inputs""")
fragment("patches", """
select doc_id patch_id, 'diff --git a/'||source||'/'||cast(doc_id as string)||' b/'||(case when doc_id % 5 = 0 then 'new' else source end)||'/'||cast(doc_id as string)||chr(10)
 ||(case when doc_id % 7 = 0 then 'new file mode 100644'||chr(10) when doc_id % 7 = 1 then 'deleted file mode 100644'||chr(10) else '' end)
 ||'index '||substr(md5(text), 1, 7)||'..'||(case when doc_id % 7 = 1 then '0000000' else substr(md5(l1), 1, 7) end)||' 100644'||chr(10)
 ||'--- a/'||source||'/'||cast(doc_id as string)||chr(10)||'+++ b/'||source||'/'||cast(doc_id as string)||chr(10)
 ||(case when n = 0 then '' else (case when n = 1 then '@@ -1 +1 @@' else '@@ -1,2 +1 @@' end)||chr(10)||'-'||l1||chr(10)||'+'||l1||' reworded'||chr(10)||(case when n = 1 then '' else '-'||l2||chr(10) end) end)
 ||'@@ -'||cast(n as string)||',0 +'||cast(tail as string)||' @@ tail'||chr(10)||'+'||'-- added after line '||cast(n as string)||chr(10)
 ||'diff --git a/logo.png b/logo.png'||chr(10)||'index 1111111..2222222 100644'||chr(10)||'Binary files a/logo.png and b/logo.png differ'||chr(10) text
from patch_split""")
fragment("patched", """
select doc_id patch_id, (case when n = 0 then '' else l1||' reworded'||chr(10) end)||(case when n < 3 then '' else rest||chr(10) end)||'-- added after line '||cast(n as string) text, text before
from patch_split""")


FILE = ["patch_id", "file_no"]


def rows(d: Data):
    return d.shared("patch_rows", lambda d: S.patch_rows(d.patches))


@query("s6_patch_files", """select doc_id patch_id, 1 file_no, source||'/'||cast(doc_id as varchar) old_path,
 case when doc_id % 5 = 0 then 'new' else source end||'/'||cast(doc_id as varchar) new_path,
 case doc_id % 7 when 0 then 'added' when 1 then 'deleted' else case when doc_id % 5 = 0 then 'renamed' else 'modified' end end status,
 substr(md5(text), 1, 7) old_blob, case when doc_id % 7 = 1 then '' else substr(md5(l1), 1, 7) end new_blob, '100644' "mode", false "binary" from patch_split
 union all select doc_id, 2, 'logo.png', 'logo.png', 'modified', '1111111', '2222222', '100644', true from patch_split""")
def _(d):
    f = S.patch_files(rows(d))
    return f.withColumns({"new_blob": F.coalesce("new_blob", F.lit("")), "old_blob": F.coalesce("old_blob", F.lit(""))})


oracle_fragment("patch_line_rows", """
select doc_id patch_id, 1 hunk_no, '-' op, l1 text, 1 old_line, 0 new_line, 1 "position" from patch_split where n > 0 union all
select doc_id, 1, '+', l1||' reworded', 0, 1, 2 from patch_split where n > 0 union all
select doc_id, 1, '-', l2, 2, 0, 3 from patch_split where n > 1 union all
select doc_id, case when n = 0 then 1 else 2 end, '+', '-- added after line '||cast(n as varchar), 0, tail, case n when 0 then 1 when 1 then 4 else 5 end from patch_split""")


@query("w8_hunk_line_numbers", """select patch_id, hunk_no, op, md5(text) text_md5, old_line, new_line, "position" from patch_line_rows""")
def _(d):
    return S.patch_lines(rows(d)).select(
        "patch_id", "hunk_no", "op", F.md5("text").alias("text_md5"), F.coalesce("old_line", F.lit(0)).alias("old_line"),
        F.coalesce("new_line", F.lit(0)).alias("new_line"), "position")


@query("a1_patch_stats", """select patch_id, count(case when op = '+' then 1 end) added, count(case when op = '-' then 1 end) removed from patch_line_rows group by 1""")
def _(d):
    return H.line_stats(S.patch_lines(rows(d)), ["patch_id"])


@query("s6_hunk_ranges", """select doc_id patch_id, 1 hunk_no, 'before' side, 1 "start", least(n, 2) "end" from patch_split where n > 0
 union all select doc_id, 1, 'after', 1, 1 from patch_split where n > 0 union all select doc_id, case when n = 0 then 1 else 2 end, 'after', tail, tail from patch_split""")
def _(d):
    return S.hunk_ranges(rows(d)).select("patch_id", "hunk_no", "side", "start", "end")


@query("h4_reverse_patch", f"""select patch_id, i old_line, md5(l) text_md5 from (select patch_id, unnest(ls) l, generate_subscripts(ls, 1) i
 from (select patch_id, {duck_lines('before')} ls from patched) p) q""")
def _(d):
    after = explode_lines(d.patched.select("patch_id", "text"))
    old, _wrong = S.reverse_patch(after.withColumn("file_no", F.lit(1).cast("bigint")), S.patch_lines(rows(d)), FILE)
    return old.select("patch_id", "old_line", F.md5("text").alias("text_md5"))


@query("h4_patch_mismatches", """select doc_id patch_id, 1 line_no from patch_split where doc_id % 3 = 0""")
def _(d):
    after = explode_lines(d.patched.select("patch_id", "text"))
    stale = F.when((F.col("patch_id") % 3 == 0) & (F.col("line_no") == 1), F.concat("text", F.lit("?"))).otherwise(F.col("text"))
    _old, wrong = S.reverse_patch(after.withColumn("text", stale).withColumn("file_no", F.lit(1).cast("bigint")), S.patch_lines(rows(d)), FILE)
    return wrong.select("patch_id", "line_no")
