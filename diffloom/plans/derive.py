"""Inputs derived from the given tables, in SQL that Spark and DuckDB both take.

``documents`` become three snapshots of a file tree per source: ``snap_before`` (the base), ``snap_after``
(the first iteration of a change) and ``snap_later`` (its second iteration). One change set per source.
"""

from diffloom.plans.registry import fragment

_EXT = "case lang when 'en' then '.py' when 'de' then '.ts' when 'fr' then '.md' else '.txt' end"
_NAME = (
    "(case when doc_id % 97 = 5 then 'locks/'||cast(doc_id as string)||'/Cargo.lock'"
    " when doc_id % 12 = 4 then 'tests/'||cast(doc_id as string)||" + _EXT +
    " when doc_id % 4 = 1 then 'lib/core/'||cast(doc_id as string)||" + _EXT +
    " else 'src/'||cast(doc_id as string)||" + _EXT + " end)"
)

fragment("snap_before", f"""
select source diffset_id, source||'/'||{_NAME} path, case when doc_id % 23 = 7 then 57344 else 33188 end mode,
       md5(text) blob_id, text
from {{documents}} where doc_id % 10 <> 0""")

# One edit per residue: append two lines (one of them another file's first line), drop the first line,
# move the first line to the end, reword, break lines after sentences; the rest keep their text. Some files move or change mode.
fragment("first_iteration", """
select d.doc_id, d.source, d.lang,
       case d.doc_id % 7
         when 0 then d.text||chr(10)||'appended line '||cast(d.doc_id as string)
                     ||coalesce(chr(10)||split_part(p.text, chr(10), 1), '')
         when 1 then substr(d.text, instr(d.text, chr(10)) + 1)
         when 2 then substr(d.text, instr(d.text, chr(10)) + 1)||chr(10)||split_part(d.text, chr(10), 1)
         when 3 then replace(d.text, 'the ', 'teh ')
         when 4 then replace(d.text, '. ', '.'||chr(10))
         else d.text end text
from {documents} d left join {documents} p on p.doc_id = d.doc_id - 20 and p.doc_id % 7 = 1""")

fragment("snap_after", f"""
select source diffset_id, (case when doc_id % 11 = 0 then 'moved' else source end)||'/'||{_NAME} path,
       case when doc_id % 23 = 7 then (case when doc_id % 46 = 7 then 57344 else 33188 end)
            when doc_id % 13 = 0 then 33261 else 33188 end mode, md5(text) blob_id, text
from first_iteration where doc_id % 10 <> 1""")

fragment("snap_later", f"""
select source diffset_id, (case when doc_id % 11 = 0 then 'moved' else source end)||'/'||{_NAME} path,
       case when doc_id % 13 = 0 then 33261 else 33188 end mode, md5(text) blob_id, text
from (select doc_id, source, lang,
             case doc_id % 17 when 0 then text||chr(10)||'second pass '||cast(doc_id as string)
                              when 1 then substr(text, instr(text, chr(10)) + 1)
                              when 2 then 'opening line '||cast(doc_id as string)||chr(10)||text
                              else text end text
      from first_iteration) e
where doc_id % 10 <> 1 and doc_id % 19 <> 3""")

# One repository per customer: its orders are the commits.
fragment("commit_rows", """
select cast(o_orderkey as string) sha, o_custkey repo_id, @SECONDS(o_orderdate) time,
       cast(lag(o_orderkey, 1) over w as string) parent1,
       case when o_orderkey % 5 = 0 then cast(lag(o_orderkey, 2) over w as string) end parent2,
       row_number() over w seq, count(*) over (partition by o_custkey) seq_count
from {orders} window w as (partition by o_custkey order by o_orderdate, o_orderkey)""")

# A content-addressed tree: root holds regions, a region its nations, a nation its customers; the second
# version changes one customer in fifty, and only the trees above it get new ids.
fragment("leaf_entries", """
select v, c_nationkey, c_custkey,
       md5(c_name||(case when v = 2 and c_custkey % 50 = 0 then 'changed' else c_mktsegment end)) child_id
from {customer} cross join (select 1 v union all select 2 v) versions
where not (v = 2 and c_custkey % 77 = 0)""")
fragment("nation_trees", """
select v, c_nationkey nationkey,
       'n'||md5(cast(c_nationkey as string)||'-'||cast(count(*) as string)||'-'||min(child_id)||'-'||max(child_id)||'-'
         ||cast(sum(case when v = 2 and c_custkey % 50 = 0 then c_custkey else 0 end) as string)) tree_id
from leaf_entries group by v, c_nationkey""")
fragment("region_trees", """
select t.v, n.n_regionkey regionkey, 'r'||md5(min(t.tree_id)||max(t.tree_id)||cast(count(*) as string)
         ||cast(max(case when t.v = 2 then 1 else 0 end) as string)) tree_id
from nation_trees t join {nation} n on n.n_nationkey = t.nationkey group by t.v, n.n_regionkey""")
fragment("tree_entries", """
select distinct tree_id, name, mode, child_id from (
  select t.tree_id, cast(l.c_custkey as string) name, 33188 mode, l.child_id
  from leaf_entries l join nation_trees t on t.v = l.v and t.nationkey = l.c_nationkey
  union all
  select r.tree_id, n.n_name name, 16384 mode, t.tree_id child_id
  from nation_trees t join {nation} n on n.n_nationkey = t.nationkey
  join region_trees r on r.v = t.v and r.regionkey = n.n_regionkey
  union all
  select 'root'||cast(r.v as string) tree_id, g.r_name name, 16384 mode, r.tree_id child_id
  from region_trees r join {region} g on g.r_regionkey = r.regionkey) e""")

# Reviewer marks: one row per event.
fragment("marks", """
select 'atom-'||cast(event_id % 500 as string) key, @MICROS(ts) wall, event_id % 3 logical,
       cast(user_id as string) device, event_type in ('view', 'click') viewed,
       case event_type when 'error' then -2 when 'signup' then -1 when 'purchase' then 2 when 'click' then 1 end score
from {events}""")

# Review comments: one thread per conversation.
fragment("comments", """
select conv_id * 1000 + turn id, case when turn > 0 then conv_id * 1000 end in_reply_to_id,
       'src'||cast(conv_id % 20 as string) diffset_id,
       'src'||cast(conv_id % 20 as string)||'/src/'||cast(conv_id as string)||'.py' path,
       1 + conv_id % 20 line, case when conv_id % 3 = 0 then 'LEFT' else 'RIGHT' end side,
       2 + conv_id % 20 original_line, cast(conv_id % 50 as string) original_commit_id,
       turn % 4 = 3 pending, role author, text body, conv_id, turn
from {conversations}""")

# An object graph in two versions: groups are regions and nations, files customers, targets segments.
fragment("graph_customers", """
select v, c_custkey, c_nationkey, c_mktsegment, c_acctbal from {customer}
cross join (select 1 v union all select 2 v) versions
where not (v = 2 and c_custkey % 40 = 0) and not (v = 1 and c_custkey % 45 = 0)""")

# Result runs: one per label and option set.
fragment("runs", """
select 'quality-'||cast(quality as string) target, cast(doc_id as string) fixture, opt option_set,
       case when toxic = 1 and doc_id % 5 = 0 then 'refused' when (doc_id + opt) % 3 = 0 then 'fail'
            else 'pass' end outcome,
       1 - (doc_id % 7) / 8.0 ratio
from {labels} cross join (select 0 opt union all select 1 opt) o""")
