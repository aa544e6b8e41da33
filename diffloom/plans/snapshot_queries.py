"""Registered queries over snapshots, trees and paths."""

from pyspark.sql import functions as F

from diffloom.functions import paths as P
from diffloom.operators import snapshots as S
from diffloom.plans.registry import Data, fragment, oracle_fragment, query

oracle_fragment("changed_files", """
select coalesce(a.diffset_id, b.diffset_id) diffset_id, coalesce(a.path, b.path) path,
       st.status, case when st.status <> 'added' then a.blob_id end "before",
       case when st.status <> 'deleted' then b.blob_id end "after",
       case when st.status = 'deleted' then a.mode else b.mode end mode,
       case when st.status = 'modified' and a.mode <> b.mode then a.mode end old_mode
from snap_before a full outer join snap_after b on a.diffset_id = b.diffset_id and a.path = b.path
cross join (select unnest(['added', 'deleted', 'modified']) status) st
where (a.blob_id is distinct from b.blob_id or a.mode is distinct from b.mode)
  and case when a.path is null then st.status = 'added' when b.path is null then st.status = 'deleted'
           when (a.mode = 57344) <> (b.mode = 57344) then st.status in ('added', 'deleted')
           else st.status = 'modified' end""")

oracle_fragment("rename_sides", """
select *, split_part(path, '/', -1) name from (
  select diffset_id, "before" blob, path, mode, 'a' side from changed_files
  where status = 'deleted' and mode <> 57344 and "before" <> md5('')
  union all
  select diffset_id, "after", path, mode, 'b' from changed_files
  where status = 'added' and mode <> 57344 and "after" <> md5('')) x""")
oracle_fragment("rename_first", """
select a.diffset_id, a.blob, a.path old_path, b.path path, a.mode a_mode, b.mode b_mode
from (select *, row_number() over (partition by diffset_id, blob, name order by path) r from rename_sides where side = 'a') a
join (select *, row_number() over (partition by diffset_id, blob, name order by path) r from rename_sides where side = 'b') b
using (diffset_id, blob, name, r)""")
oracle_fragment("rename_pairs", """
select * from rename_first union all
select a.diffset_id, a.blob, a.path old_path, b.path path, a.mode a_mode, b.mode b_mode
from (select *, row_number() over (partition by diffset_id, blob order by path) r from rename_sides s where side = 'a'
        and not exists (select 1 from rename_first f where f.diffset_id = s.diffset_id and f.old_path = s.path)) a
join (select *, row_number() over (partition by diffset_id, blob order by path) r from rename_sides s where side = 'b'
        and not exists (select 1 from rename_first f where f.diffset_id = s.diffset_id and f.path = s.path)) b
using (diffset_id, blob, r)""")
oracle_fragment("changes", """
select c.diffset_id, c.path, cast(null as varchar) old_path, c.status, c."before", c."after", c.mode, c.old_mode from changed_files c
where not (c.status = 'deleted' and exists (select 1 from rename_pairs p where p.diffset_id = c.diffset_id and p.old_path = c.path))
  and not (c.status = 'added' and exists (select 1 from rename_pairs p where p.diffset_id = c.diffset_id and p.path = c.path))
union all
select diffset_id, path, old_path, 'renamed', blob, blob, b_mode, case when a_mode <> b_mode then a_mode end from rename_pairs""")


def tree_entries(d: Data):
    return d.shared("tree_entries", lambda d: d.tree_entries)


def changed_files(d: Data):
    return S.diff_snapshots(d.snap_before, d.snap_after)


def changes(d: Data):
    return d.shared("changes", lambda d: S.pair_renames(changed_files(d)))


@query("j1_diff_snapshots", """select diffset_id, path, status, coalesce("before", '') "before",
 coalesce("after", '') "after", mode, coalesce(old_mode, 0) old_mode from changed_files""")
def _(d):
    return changed_files(d).select(
        "diffset_id", "path", "status", F.coalesce("before", F.lit("")).alias("before"),
        F.coalesce("after", F.lit("")).alias("after"), "mode", F.coalesce("old_mode", F.lit(0)).alias("old_mode"),
    )


@query("j3_pair_renames", """select diffset_id, path, coalesce(old_path, '') old_path, status,
 coalesce("before", '') "before", coalesce("after", '') "after", mode from changes""")
def _(d):
    return changes(d).select(
        "diffset_id", "path", F.coalesce("old_path", F.lit("")).alias("old_path"), "status",
        F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"), "mode",
    )


_LINE_SNAPS = """
select 'orders' diffset_id, cast(l_orderkey as string)||'/'||cast(l_linenumber as string)||'-'||cast(l_partkey as string) path,
       33188 mode, md5(cast(l_suppkey as string)||'|'||cast(cast(l_quantity as bigint) as string)||'|'||l_returnflag||l_linestatus) blob_id
from {lineitem}"""
fragment("rows_before", _LINE_SNAPS)
fragment("rows_after", _LINE_SNAPS.replace("cast(l_quantity as bigint)", "cast(l_quantity + (case when l_suppkey % 9 = 0 then 1 else 0 end) as bigint)")
         + " where l_partkey % 20 <> 0")


@query("j1_diff_row_snapshots", """select coalesce(a.path, b.path) path,
 case when a.path is null then 'added' when b.path is null then 'deleted' else 'modified' end status, count(*) n
 from rows_before a full outer join rows_after b using (diffset_id, path)
 where a.blob_id is distinct from b.blob_id group by 1, 2""")
def _(d):
    return S.diff_snapshots(d.rows_before, d.rows_after).groupBy("path", "status").agg(F.count("*").alias("n"))


@query("s1_flatten_trees", """select snapshot_id, path, mode, blob_id from (
 with recursive f as (
   select 'root'||cast(v as varchar) snapshot_id, name path, mode, child_id blob_id from tree_entries, (select unnest([1,2]) v) where tree_id = 'root'||cast(v as varchar)
   union all
   select f.snapshot_id, f.path||'/'||e.name, e.mode, e.child_id from f join tree_entries e on e.tree_id = f.blob_id where f.mode = 16384)
 select * from f where mode <> 16384)""")
def _(d):
    roots = d.spark.createDataFrame([("root1", "root1"), ("root2", "root2")], "snapshot_id string, tree_id string")
    return S.flatten_trees(tree_entries(d), roots)


@query("j2_diff_trees", """select coalesce(a.path, b.path) path, case when a.path is null then 'added'
 when b.path is null then 'deleted' else 'modified' end status, coalesce(a.blob_id, '') "before", coalesce(b.blob_id, '') "after"
 from (select g.r_name||'/'||n.n_name||'/'||cast(c_custkey as varchar) path, child_id blob_id from leaf_entries l
       join nation n on n.n_nationkey = l.c_nationkey join region g on g.r_regionkey = n.n_regionkey where v = 1) a
 full outer join (select g.r_name||'/'||n.n_name||'/'||cast(c_custkey as varchar) path, child_id blob_id from leaf_entries l
       join nation n on n.n_nationkey = l.c_nationkey join region g on g.r_regionkey = n.n_regionkey where v = 2) b
 on a.path = b.path where a.blob_id is distinct from b.blob_id""")
def _(d):
    pairs = d.spark.createDataFrame([("v1..v2", "root1", "root2")], "diffset_id string, tree_a string, tree_b string")
    return S.diff_trees(tree_entries(d), pairs).select(
        "path", "status", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after")
    )


# A merge's change rows: order lines as paths, ship modes as parents.
fragment("parent_changes", """
select l_orderkey commit_id, l_partkey % 3 + 1 parent_no, 'f'||cast(l_suppkey % 4 as string) path
from {lineitem} group by l_orderkey, l_partkey % 3 + 1, 'f'||cast(l_suppkey % 4 as string)""")


@query("j4_combined_changes", """select p.commit_id, p.path from parent_changes p
 join (select commit_id, count(distinct parent_no) n from parent_changes group by 1) c using (commit_id)
 join (select commit_id, path, count(*) k from parent_changes group by 1, 2) e using (commit_id, path)
 where p.parent_no = 1 and k = n""")
def _(d):
    rows = d.parent_changes.withColumnRenamed("commit_id", "commit")
    parents = rows.groupBy("commit").agg(F.countDistinct("parent_no").alias("n_parents"))
    return S.combined_changes(rows, parents).select(F.col("commit").alias("commit_id"), "path")


# A base listing that lacks some of the files, so that the error table is not empty.
fragment("partial_base", "select * from snap_before where length(path) % 5 <> 0")
oracle_fragment("looked_up", """select c.*, b.blob_id base from changes c left join partial_base b
 on b.diffset_id = c.diffset_id and b.path = coalesce(c.old_path, c.path)""")


@query("j5_resolve_before", """select diffset_id, path, status, case when status = 'added' then '' else base end base_blob
 from looked_up where status = 'added' or base is not null""")
def _(d):
    ok, _missing = S.resolve_before(changes(d), d.partial_base)
    return ok.select("diffset_id", "path", "status", F.coalesce("base_blob", F.lit("")).alias("base_blob"))


@query("j5_missing_before", """select diffset_id, path, coalesce(old_path, path) missing_path
 from looked_up where status <> 'added' and base is null""")
def _(d):
    _ok, missing = S.resolve_before(changes(d), d.partial_base)
    return missing.select("diffset_id", "path", "missing_path")


@query("j6_merge_type_changes", """select diffset_id, path, coalesce(max("before"), '') "before",
 coalesce(max("after"), '') "after", cast(sum(length(path)) as bigint) added, cast(count(*) as bigint) removed
 from changed_files group by diffset_id, path""")
def _(d):
    rows = changed_files(d).withColumn("added", F.length("path")).withColumn("removed", F.lit(1))
    return S.merge_type_changes(rows).select(
        "diffset_id", "path", F.coalesce("before", F.lit("")).alias("before"),
        F.coalesce("after", F.lit("")).alias("after"), "added", "removed",
    )


@query("t1_sort_changes", "select diffset_id, path, status from changes")
def _(d):
    return S.sort_changes(changes(d)).select("diffset_id", "path", "status")


@query("u1_all_paths", """select diffset_id, path from changes union select diffset_id, old_path from changes where old_path is not null""")
def _(d):
    c = changes(d)
    return S.all_paths(c.filter("status <> 'renamed'"), c.filter("status = 'renamed'"))


@query("u2_common_paths", "select diffset_id, path from snap_before intersect select diffset_id, path from snap_after")
def _(d):
    return S.common_paths(d.snap_before, d.snap_after)


@query("u3_changed_ids", """select coalesce(a.c_custkey, b.c_custkey) c_custkey,
 case when a.c_custkey is null then 'added' else 'removed' end kind
 from (select * from graph_customers where v = 1) a full outer join (select * from graph_customers where v = 2) b
 on a.c_custkey = b.c_custkey where a.c_custkey is null or b.c_custkey is null""")
def _(d):
    g = d.graph_customers
    return S.changed_ids(g.filter("v = 1"), g.filter("v = 2"), ["c_custkey"])


def _all_files(d: Data):
    return d.snap_before.select("diffset_id", "path", "text").union(d.snap_after.select("diffset_id", "path", "text"))


fragment("all_files", "select diffset_id, path, text from snap_before union all select diffset_id, path, text from snap_after")
# Paths of many kinds: the file's folder with the name forms the rules know.
fragment("path_forms", """
select path||form path from all_files cross join (
  select '' form union all select '/Dockerfile.dev' union all select '/.env.local' union all select '/a.yml.liquid'
  union all select '/pnpm-lock.yaml' union all select '.TSX' union all select '/x.min.js' union all select '/meta/0001_snapshot.json'
  union all select '/Makefile' union all select '/test_it.py' union all select '/a.spec.ts' union all select '/FooTest.java'
  union all select '/app.d/config' union all select '/.bashrc') forms""")
_LANG = " ".join(
    f"when {{0}} in ({', '.join(repr(e) for e in exts)}) then '{lang}'" for lang, exts in P.EXTENSIONS.items()
)
_NAMES = " ".join(
    f"when {{0}} in ({', '.join(repr(e) for e in names)}) then '{lang}'" for lang, names in P.FILENAMES.items()
)
_BASE = "split_part(path, '/', -1)"
_EXT = "lower(regexp_extract(split_part(path, '/', -1), '(\\.[^.]*)$', 1))"


@query("f1_path_parts", f"""select path, {_BASE} base_name, regexp_extract(path, '^(.*)/[^/]*$', 1) directory, {_EXT} extension,
 count(*) n from path_forms group by 1, 2, 3, 4""")
def _(d):
    path = F.col("path")
    return d.path_forms.groupBy("path", P.base_name(path).alias("base_name"), P.directory(path).alias("directory"),
                                P.extension(path).alias("extension")).agg(F.count("*").alias("n"))


@query("p1_language_for_path", f"""select path, coalesce(case {_NAMES.format(_BASE)}
 when {_BASE} like 'Dockerfile.%' then 'dockerfile' when {_BASE} like '.env.%' then 'ini'
 when regexp_matches({_BASE}, '(?i)\\.ya?ml\\.liquid$') then 'yaml' {_LANG.format(_EXT)} end, '') language, count(*) n
 from path_forms group by 1, 2""")
def _(d):
    lang = F.coalesce(P.language_for_path(F.col("path")), F.lit(""))
    return d.path_forms.groupBy("path", lang.alias("language")).agg(F.count("*").alias("n"))


_PRODUCED = (
    f"case when {_BASE} in ({', '.join(repr(x) for x in P.LOCKFILES)}) then 'lockfile' "
    f"when regexp_matches({_BASE}, '{P.GENERATED_NAME}') or regexp_matches(path, '{P.GENERATED_META}') then 'generated' "
    f"when regexp_matches(substr(text, 1, 1024), '{P.GENERATED_MARKER}') then 'generated' end"
)
fragment("marked_files", """select diffset_id, path, case when length(path) % 3 = 0 then 'x'||chr(10)||'# Code generated by a tool. DO NOT EDIT.'||chr(10)||text
 when length(path) % 3 = 1 then text||chr(10)||'@generated' else text end text from all_files""")


@query("p2_produced_by", f"select diffset_id, path, coalesce({_PRODUCED}, '') produced, count(*) n from marked_files group by 1, 2, 3")
def _(d):
    made = F.coalesce(P.produced_by(F.col("path"), F.col("text")), F.lit(""))
    return d.marked_files.groupBy("diffset_id", "path", made.alias("produced")).agg(F.count("*").alias("n"))


_TEST = f"(regexp_matches(path, '{P.TEST_FOLDER}') or regexp_matches(path, '{P.TEST_FILE}'))"


@query("p3_is_test_path", f"select path, {_TEST} is_test, count(*) n from path_forms group by 1, 2")
def _(d):
    return d.path_forms.groupBy("path", P.is_test_path(F.col("path")).alias("is_test")).agg(F.count("*").alias("n"))


@query("p4_change_status", """select diffset_id, path, case when "before" is null then 'added' when "after" is null then 'deleted'
 when old_path is not null and old_path <> path then 'renamed' else 'modified' end status from changes""")
def _(d):
    c = changes(d)
    status = P.change_status(F.col("before"), F.col("after"), F.col("old_path"), F.col("path"))
    return c.select("diffset_id", "path", status.alias("status"))


@query("p10_filter_paths", "select diffset_id, path from snap_after where contains(lower(path), lower('LIB/Core'))")
def _(d):
    return d.snap_after.filter(P.path_contains(F.col("path"), F.lit("LIB/Core"))).select("diffset_id", "path")


@query("t2_review_order", f"""select diffset_id, path, row_number() over (partition by diffset_id order by {_TEST}, path) place from snap_after""")
def _(d):
    from diffloom.operators.reports import review_order

    return review_order(d.snap_after).select("diffset_id", "path", "place")
