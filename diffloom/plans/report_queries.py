"""Registered queries over object graphs and reports."""

from pyspark.sql import functions as F

from diffloom.operators import graphs as G
from diffloom.operators import reports as R
from diffloom.plans.registry import Data, fragment, oracle_fragment, query
from diffloom.plans.line_queries import BY, diff_rows, duck_lines
from diffloom.operators import hunks as H
from diffloom.sources.blobs import explode_lines

# Groups are regions and nations, files customers; one group names itself `<group>`.
fragment("graph_objects", """select 'g' graph, 'r'||cast(r_regionkey as string) object_id, case when r_regionkey = 2 then '<group>' else r_name end part, 'group' isa from {region}
 union all select 'g', 'n'||cast(n_nationkey as string), n_name, 'group' from {nation} union all select 'g', 'c'||cast(c_custkey as string), c_name, 'file' from {customer}""")
fragment("graph_edges", """select 'g' graph, 'r'||cast(n_regionkey as string) parent, 'n'||cast(n_nationkey as string) child from {nation}
 union all select 'g', 'n'||cast(c_nationkey as string), 'c'||cast(c_custkey as string) from {customer} union all select 'g', 'c1', 'r4' from {region} where r_regionkey = 4""")
@query("g1_object_paths", """select * from (with recursive up as (
 select object_id, object_id cur, [case when part <> '<group>' then part end] parts, [object_id] seen from graph_objects
 union all select u.object_id, e.parent, [case when o.part <> '<group>' then o.part end] || u.parts, list_append(u.seen, e.parent) from up u join graph_edges e on e.child = u.cur join graph_objects o on o.object_id = e.parent where not list_contains(u.seen, e.parent))
 select object_id, array_to_string(list_filter(arg_max(parts, len(seen)), lambda p: p is not null), '/') path from up group by 1) x""")
def _(d):
    return G.object_paths(d.graph_objects, d.graph_edges).select("object_id", "path")


fragment("memberships", "select v, 'g' graph, 'b'||cast(c_custkey as string) build_file, 'c'||cast(c_custkey as string) file_id, 'p'||c_mktsegment phase_id from graph_customers")
fragment("phases", "select distinct 'g' graph, 'p'||c_mktsegment phase_id, 'Sources '||substr(c_mktsegment, 1, 2) phase, c_mktsegment target from {customer} where c_mktsegment <> 'MACHINERY'")


@query("g2_placements_diff", """select coalesce(a.build_file, b.build_file) build_file, case when a.build_file is null then 'added' else 'removed' end kind, coalesce(a.file_id, b.file_id) path, coalesce(p.target, '') target, coalesce(p.phase, '') phase
 from (select * from memberships where v = 1) a full outer join (select * from memberships where v = 2) b on a.build_file = b.build_file left join phases p on p.phase_id = coalesce(a.phase_id, b.phase_id) where a.build_file is null or b.build_file is null""")
def _(d):
    paths = d.customer.select(F.lit("g").alias("graph"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("object_id")).withColumn("path", F.col("object_id"))
    at = lambda v: G.placements(d.memberships.filter(F.col("v") == v), d.phases, paths)
    return G.placements_diff(at(1), at(2)).select("build_file", "kind", "path", F.coalesce("target", F.lit("")).alias("target"), F.coalesce("phase", F.lit("")).alias("phase"))


fragment("products", "select v, 'g' graph, 'k'||cast(c_custkey as string) package_id, 'Product'||cast(c_custkey as string) name, 's'||cast(c_custkey % 30 as string) reference_id from graph_customers")
fragment("references_", """select 'g' graph, 's'||cast(s_suppkey as string) reference_id, 'https://h/'||s_name||'.git' url, case when s_suppkey % 4 = 0 then null else 'upToNextMajor' end kind, case when s_suppkey % 3 = 0 then null else cast(s_nationkey as string)||'.0' end version,
 case when s_suppkey % 5 = 0 then 'main' end branch, case when s_suppkey % 7 = 0 then 'abc' end revision from {supplier}""")
oracle_fragment("package_rows", """select v, package_id, name, url, requirement from (select r.*, coalesce('branch '||branch, 'revision '||revision, nullif(concat_ws(' ', kind, version), '')) requirement from references_ r) q right join products p using (reference_id)
 union all select v, reference_id, regexp_replace(split_part(url, '/', -1), '\\.git$', ''), url, coalesce('branch '||branch, 'revision '||revision, nullif(concat_ws(' ', kind, version), '')) from references_ r, (select unnest([1, 2]) v) w
 where not (v = 1 and r.reference_id like '%7') and not exists (select 1 from products p where p.v = w.v and p.reference_id = r.reference_id)""")


@query("g3_packages_diff", """select coalesce(a.package_id, b.package_id) package_id, case when a.package_id is null then 'added' else 'removed' end kind, coalesce(a.name, b.name) "name", coalesce(a.url, b.url, '') url, coalesce(a.requirement, b.requirement, '') requirement
 from (select * from package_rows where v = 1) a full outer join (select * from package_rows where v = 2) b using (package_id) where a.v is null or b.v is null""")
def _(d):
    refs = d.references_
    at = lambda v, r: G.packages(d.products.filter(F.col("v") == v).drop("v"), r)
    rows = G.packages_diff(at(1, refs.filter("reference_id not like '%7' or exists(array('s7','s17','s27'), x -> x = reference_id)")), at(2, refs))
    return rows.select("package_id", "kind", "name", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("requirement", F.lit("")).alias("requirement"))


# Targets: nations; phases: the segments of their customers; some targets exist in one version only.
fragment("target_rows", """select distinct v, 'g' graph, 't'||cast(c_nationkey as string) target_id, 'T'||cast(c_nationkey as string) target, case when c_acctbal < 9000 then 'p'||c_mktsegment||cast(c_custkey % 90 as string) end phase_id, case when c_acctbal < 9000 then c_mktsegment||cast(c_custkey % 90 as string) end phase
 from graph_customers where not (v = 1 and c_nationkey % 11 = 3) and not (v = 2 and c_nationkey % 7 = 2)""")


@query("g4_targets_diff", """with a as (select * from target_rows where v = 1), b as (select * from target_rows where v = 2)
 select target_id, target, '' phase, 'removed' kind from (select distinct target_id, target from a) x where target_id not in (select target_id from b)
 union all select target_id, target, '', 'added' from (select distinct target_id, target from b) x where target_id not in (select target_id from a)
 union all select target_id, target, phase, 'removed' from a where phase_id is not null and target_id in (select target_id from b) and not exists (select 1 from b where b.target_id = a.target_id and b.phase_id = a.phase_id)
 union all select target_id, target, phase, 'added' from b where phase_id is not null and target_id in (select target_id from a) and not exists (select 1 from a where b.target_id = a.target_id and b.phase_id = a.phase_id)""")
def _(d):
    t = d.target_rows
    return G.targets_diff(t.filter("v = 1"), t.filter("v = 2")).select("target_id", "target", F.coalesce("phase", F.lit("")).alias("phase"), "kind")


def configurations(d: Data, v: int):
    """A configuration per customer: balance, nation (reshaped from list to string in version 2), a flag
    only one version has."""
    c = d.graph_customers.filter(F.col("v") == v)
    value = lambda text=None, items=None: F.struct((text if text is not None else F.lit(None).cast("string")).alias("text"), (items if items is not None else F.lit(None).cast("array<string>")).alias("list"))
    nation = F.col("c_nationkey").cast("string")
    pair = F.array(F.concat(F.lit("-n "), nation), F.lit("'x y'"))
    joined = F.concat(F.lit("-n "), nation, F.lit(" \"x y\"")) if v == 2 else None
    balance = F.floor("c_acctbal").cast("string") if v == 1 else F.when(F.col("c_custkey") % 6 == 0, F.lit("0")).otherwise(F.floor("c_acctbal").cast("string"))
    entries = F.map_concat(
        F.create_map(F.lit("BALANCE"), value(balance)),
        F.create_map(F.lit("NATION"), value(joined) if v == 2 else value(None, pair)),
        F.when(F.col("c_custkey") % 4 == v, F.create_map(F.lit("FLAG"), value(F.lit("YES")))).otherwise(F.create_map().cast("map<string,struct<text:string,list:array<string>>>")),
    )
    return c.select(F.lit("g").alias("graph"), F.col("c_mktsegment").alias("target"), F.concat(F.lit("cfg"), F.col("c_custkey").cast("string")).alias("configuration"), entries.alias("settings"))


@query("g5_settings_diff", """with b as (select a.c_mktsegment target, 'cfg'||cast(a.c_custkey as varchar) configuration, a.c_custkey k, cast(cast(floor(a.c_acctbal) as bigint) as varchar) bal, a.c_nationkey n from graph_customers a join graph_customers b on b.v = 2 and b.c_custkey = a.c_custkey where a.v = 1)
 select target, configuration, 'NATION' "key", '-n '||cast(n as varchar)||' ''x y''' "before", '-n '||cast(n as varchar)||' "x y"' "after", true noise from b
 union all select target, configuration, 'BALANCE', bal, '0', false from b where k % 6 = 0 and bal <> '0'
 union all select target, configuration, 'FLAG', 'YES', '', false from b where k % 4 = 1 union all select target, configuration, 'FLAG', '', 'YES', false from b where k % 4 = 2""")
def _(d):
    return G.settings_diff(configurations(d, 1), configurations(d, 2)).drop("graph")


@query("g6_project_summary", "select 'g' graph, 0 targets, (select count(*) from customer) files, (select cast(sum(case when c_custkey % 4 = 2 then 3 else 2 end) as bigint) from graph_customers where v = 2) settings")
def _(d):
    return G.project_summary(d.graph_objects, configurations(d, 2))


# --- runs --------------------------------------------------------------------------------------------
@query("a14_outcomes", """select target, fixture, case when bool_or(outcome = 'refused') then 'refused' when bool_and(outcome = 'pass') then 'pass' else 'fail' end outcome, avg(case when outcome = 'pass' then 1.0 else cast(ratio as double) end) ratio, count(*) runs, count(case when outcome = 'pass' then 1 end) passed from runs group by 1, 2""")
def _(d):
    return R.outcomes(d.runs)


fragment("excluded", "select 'quality-'||cast(quality as string) target, cast(doc_id as string) fixture, case when doc_id % 2 = 0 then 'too old' else 'flaky' end reason from {labels} where doc_id % 9 = 4 union all select 'quality-x', 'f', 'none' from {region} where r_regionkey = 0")
oracle_fragment("outcomes", "select target, fixture, case when bool_or(outcome = 'refused') then 'refused' when bool_and(outcome = 'pass') then 'pass' else 'fail' end outcome from runs group by 1, 2")


@query("a14_matrix", """select target, coalesce(total, 0) total, coalesce(passed, 0) passed, coalesce(refused, 0) refused, coalesce(failed, 0) failed, coalesce(n, 0) excluded, coalesce(cast(passed as double) / total, 0) rate
 from (select target, count(*) total, count(case when outcome = 'pass' then 1 end) passed, count(case when outcome = 'refused' then 1 end) refused, count(case when outcome = 'fail' then 1 end) failed from outcomes group by 1) o full outer join (select target, count(*) n from excluded group by 1) e using (target)""")
def _(d):
    return R.matrix(R.outcomes(d.runs), d.excluded)


@query("a14_exclusions", "select target, reason, count(*) fixtures from excluded group by 1, 2")
def _(d):
    return R.exclusions(d.excluded)


# Partial runs: a part per supplier nation; groups are suppliers, the expected ones those under 90 and three more.
fragment("run_parts", "select s_nationkey part, 'grp'||cast(s_suppkey as string) group_id, case when s_nationkey = 3 then 'c2' else 'c1' end commit, 'node' settings, s_acctbal value from {supplier} union all select 99, 'grp'||cast(s_suppkey as string), 'c1', 'node', 0.0 from {supplier} where s_suppkey % 25 = 1")
fragment("run_order", "select 'grp'||cast(s_suppkey as string) group_id, s_suppkey place from {supplier} where s_suppkey % 10 <> 9 union all select 'lost'||cast(r_regionkey as string), 1000 + r_regionkey from {region}")


@query("s15_merge_runs", "select group_id, place, commit, value from run_parts join run_order using (group_id)")
def _(d):
    return R.merge_runs(d.run_parts, d.run_order)[0]


@query("s15_merge_problems", """select 'duplicate' problem, group_id subject from run_parts group by 2 having count(*) > 1 union all select 'missing', group_id from run_order where group_id not in (select group_id from run_parts)
 union all select distinct 'unknown', group_id from run_parts where group_id not in (select group_id from run_order) union all select 'mismatch', 'commit' from (select count(distinct commit) n from run_parts) x where n > 1 union all select 'mismatch', 'settings' from (select count(distinct settings) n from run_parts) x where n > 1""")
def _(d):
    return R.merge_runs(d.run_parts, d.run_order)[1]


fragment("disk_listing", "select cast(o_orderkey as string) path, o_custkey + (case when o_orderkey % 13 = 0 then 1 else 0 end) size, @SECONDS(o_orderdate) mtime, case when o_orderkey % 5 <> 0 then o_orderkey + (case when o_orderkey % 17 = 0 then 1 else 0 end) end inode from {orders} where o_orderkey % 19 <> 0")
fragment("disk_manifest", "select cast(o_orderkey as string) path, o_custkey size, @SECONDS(o_orderdate) + (case when o_orderkey % 11 = 0 then 5 else 0 end) mtime, o_orderkey inode, md5(cast(o_orderkey as string)) blob_id from {orders} where o_orderkey % 23 <> 0")
_INDEX_TIME = 880000000
_SAME = f"coalesce(l.size = m.size and l.mtime = m.mtime and (l.inode is null or l.inode = m.inode) and m.mtime < {_INDEX_TIME}, false)"


@query("s14_stale_files", f"select l.path, l.size from disk_listing l left join disk_manifest m using (path) where not {_SAME}")
def _(d):
    return R.stale_files(d.disk_listing, d.disk_manifest, _INDEX_TIME)[0].select("path", "size")


@query("s14_known_files", f"select l.path, m.blob_id from disk_listing l left join disk_manifest m using (path) where {_SAME}")
def _(d):
    return R.stale_files(d.disk_listing, d.disk_manifest, _INDEX_TIME)[1].select("path", "blob_id")


# Texts that look like code: indents, ends and quotes vary by line length.
fragment("styled", r"""select doc_id, case doc_id % 3 when 0 then chr(9) when 1 then '  ' else '    ' end||replace(replace(text, ', ', case when doc_id % 2 = 0 then ' ''q'' ' else ' "q" ' end), chr(10), case when doc_id % 5 < 3 then ';' else '' end||chr(10)||case doc_id % 4 when 0 then chr(9) when 1 then '  ' when 2 then '// ' else '    ' end) text from {documents}""")
_CODE = r"trim(regexp_replace(l, '[ \t\r\n\f]+//.*$', ''), ' '||chr(9)||chr(13)||chr(10)||chr(12))"


@query("a15_style_profile", rf"""with ls as (select doc_id, text, regexp_split_to_array(text, '\r\n?|\n') ls from styled), c as (select doc_id, text, ls, list_filter(ls, lambda l: {_CODE} <> '' and not regexp_matches({_CODE}, '^(?://|/\*|\*)')) code from ls),
 m as (select doc_id, ls, len(list_filter(code, lambda l: starts_with(l, chr(9)))) tabs, len(list_filter(code, lambda l: starts_with(l, ' '))) spaces, len(list_filter(code, lambda l: starts_with(l, ' ') and (length(l) - length(ltrim(l, ' '))) % 4 = 2)) > 0 two,
   len(list_filter(code, lambda l: ends_with({_CODE}, ';'))) semis, len(list_filter(code, lambda l: not ends_with({_CODE}, ';') and regexp_matches({_CODE}, '[^\s{{}};,.:=+*/%&|!?<>-](?:\+\+|--)?$'))) bare,
   len(regexp_extract_all(text, '''(?:\\.|[^''\\\r\n])*''')) s, len(regexp_extract_all(text, '"(?:\\.|[^"\\\r\n])*"')) q from c),
 t as (select *, tabs > spaces use_tabs, case when tabs > spaces or not two then 4 else 2 end tab_width from m), w as (select *, list_transform(ls, lambda l: length(l) + length(regexp_extract(l, '^(\t*)', 1)) * (tab_width - 1)) ws from t)
 select doc_id, bare <= semis "semi", s > q single_quote, case when len(list_filter(ws, lambda x: x > 80)) * 100 <= len(ls) then 80 when len(list_filter(ws, lambda x: x > 100)) * 100 <= len(ls) then 100 when len(list_filter(ws, lambda x: x > 120)) * 100 <= len(ls) then 120
   when len(list_filter(ws, lambda x: x > 140)) * 100 <= len(ls) then 140 when len(list_filter(ws, lambda x: x > 160)) * 100 <= len(ls) then 160 else 200 end print_width, use_tabs, tab_width from w""")
def _(d):
    return R.style_profile(d.styled)


@query("a16_directory_tree", """with f as (select diffset_id, path, added, removed, string_split(regexp_extract(path, '^(.*)/[^/]*$', 1), '/') ps from stats),
 e as (select diffset_id, path, added, removed, unnest(range(1, len(ps) + 1)) n, ps from f),
 t as (select diffset_id, array_to_string(ps[:n], '/') dir, count(*) files, sum(added) added, sum(removed) removed, count(case when n = len(ps) then 1 end) own from e group by 1, 2),
 k as (select t.*, (select count(*) from t c where c.diffset_id = t.diffset_id and regexp_extract(c.dir, '^(.*)/[^/]*$', 1) = t.dir) dirs from t), s as (select * from k where not (own = 0 and dirs = 1)),
 p as (select s.*, coalesce((select max_by(u.dir, length(u.dir)) from s u where u.diffset_id = s.diffset_id and starts_with(s.dir, u.dir||'/')), '') parent from s)
 select diffset_id, dir path, case when parent = '' then dir else substr(dir, length(parent) + 2) end "name", parent, cast(files as bigint) files, cast(added as bigint) added, cast(removed as bigint) removed from p""")
def _(d):
    return R.directory_tree(H.line_stats(diff_rows(d), BY))


fragment("fenced", "select doc_id, replace(text, '. ', '.'||chr(10)||'```'||case doc_id % 5 when 0 then 'rust' when 1 then 'Shell' when 2 then 'rs' when 3 then 'markdown' else '' end||chr(10)) text from {documents}")
oracle_fragment("fenced_lines", f"select doc_id, i line_no, l text from (select doc_id, unnest(ls) l, generate_subscripts(ls, 1) i from (select doc_id, {duck_lines('text')} ls from fenced) p) q")


@query("h10_fenced_blocks", r"""select doc_id, (n + 1) // 2 block_no, coalesce(max(case when f then case doc_id % 5 when 0 then 'rust' when 1 then 'bash' when 2 then 'rust' end end), '') "language", min(line_no) first_line, count(case when not f then 1 end) lines from (
 select *, count(case when f then 1 end) over (partition by doc_id order by line_no rows between unbounded preceding and current row) n from (select *, regexp_matches(text, '^\s{0,3}(?:```|~~~)') f from fenced_lines) x) y where n % 2 = 1 group by doc_id, (n + 1) // 2""")
def _(d):
    return R.fenced_blocks(explode_lines(d.fenced)).withColumn("language", F.coalesce("language", F.lit("")))


fragment("scripted", "select page_id, html||case page_id % 3 when 0 then '<script type=\"application/ld+json\">{}</script>' when 1 then '<SCRIPT type=module>x</SCRIPT>' else '<script type=\"text/x-other\">y</script>' end html from {pages}")


@query("h10_embedded_blocks", r"""select page_id, i - 1 block_no, case when regexp_matches(b, '(?i)^<style') then 'css' when i = n then case page_id % 3 when 0 then 'json' when 1 then 'javascript' else '' end else 'javascript' end "language",
 md5(regexp_extract(b, '(?is)^<[^>]*>(.*)</[^>]*>$', 1)) content from (select page_id, unnest(bs) b, generate_subscripts(bs, 1) i, len(bs) n from (select page_id, regexp_extract_all(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>') bs from scripted) x) y""")
def _(d):
    return R.embedded_blocks(d.scripted).select("page_id", "block_no", F.coalesce("language", F.lit("")).alias("language"), F.md5("content").alias("content"))


# Nested intervals: aligned powers of four, per supplier and return flag.
fragment("scopes", """select distinct l_suppkey blob_id, l_returnflag name, (l_partkey % cast(256 / size as int)) * size start_, (l_partkey % cast(256 / size as int)) * size + size end_ from (
 select *, case l_linenumber % 3 when 0 then 64 when 1 then 16 else 4 end size from {lineitem}) x""")
fragment("name_uses", "select distinct l_suppkey blob_id, l_returnflag name, l_orderkey use_id, l_orderkey % 256 pos from {lineitem}")
fragment("doubts", "select distinct l_suppkey blob_id, l_returnflag name, l_partkey % 256 start_, l_partkey % 256 + 5 end_ from {lineitem} where l_quantity > 48")


@query("j25_innermost_binding", """select blob_id, name, use_id, coalesce(case when not exists (select 1 from doubts q where q.blob_id = u.blob_id and q.name = u.name and u.pos >= q.start_ and u.pos < q.end_)
 then (select cast(arg_min(s.start_, s.end_ - s.start_) as varchar)||'-'||cast(arg_min(s.end_, s.end_ - s.start_) as varchar) from scopes s where s.blob_id = u.blob_id and s.name = u.name and u.pos >= s.start_ and u.pos < s.end_) end, '') binding from name_uses u""")
def _(d):
    b = d.scopes.select("blob_id", "name", F.concat(F.col("start_").cast("string"), F.lit("-"), F.col("end_").cast("string")).alias("binding"), F.col("start_").alias("start"), F.col("end_").alias("end"))
    doubts = d.doubts.withColumnsRenamed({"start_": "start", "end_": "end"})
    return R.innermost_binding(d.name_uses, b, doubts).withColumn("binding", F.coalesce("binding", F.lit("")))
