"""Registered queries over commit history."""

from pyspark.sql import functions as F

from diffloom.operators import history as H
from diffloom.plans.registry import Data, fragment, oracle_fragment, query
from diffloom.sources import history as SH


def commits(d: Data):
    return d.shared("commits", lambda d: d.commit_rows.select(
        "sha", "repo_id", "time", "seq", "seq_count",
        F.filter(F.array("parent1", "parent2"), lambda p: p.isNotNull()).alias("parents")))


# Raw commit texts: an order as the header, its priority and status as the message.
fragment("raw_commits", """
select sha, 'tree '||md5(sha)||chr(10)||coalesce('parent '||parent1||chr(10), '')||coalesce('parent '||parent2||chr(10), '')
 ||'author A U Thor <'||cast(repo_id as string)||'@example.com> '||cast(time as string)||' +0100'||chr(10)
 ||'committer Com Mitter <c@example.com> '||cast(time + 60 as string)||' -0330'||chr(10)||chr(10)
 ||'Subject of '||sha||chr(10)||chr(10)||'parent body line'||chr(10) raw
from commit_rows""")


@query("s7_parse_commits", """select c.sha, md5(c.sha) tree, concat_ws(',', parent1, parent2) parents,
 'A U Thor <'||cast(repo_id as varchar)||'@example.com> '||cast(time as varchar)||' +0100' author, time + 60 "time",
 'Subject of '||sha||chr(10)||chr(10)||'parent body line'||chr(10) message from commit_rows c""")
def _(d):
    c = SH.parse_commits(d.raw_commits)
    return c.select("sha", "tree", F.array_join("parents", ",").alias("parents"), "author", "time", "message")


@query("f12_commit_labels", """select sha, substr(md5(sha), 1, 7) short_tree, 'Subject of '||sha subject, 'A U Thor' author_name from commit_rows""")
def _(d):
    from diffloom.functions import text as T

    c = SH.parse_commits(d.raw_commits)
    return c.select("sha", T.short_sha(F.col("tree")).alias("short_tree"), T.subject(F.col("message")).alias("subject"),
                    T.author_name(F.col("author")).alias("author_name"))


fragment("packed_refs", """
select c_custkey % 100 repo_id, case c_custkey % 4 when 0 then 'refs/heads/' when 1 then 'refs/tags/' when 2 then 'refs/remotes/origin/' else 'refs/notes/' end||c_name name,
 md5(c_name)||substr(md5(c_mktsegment), 1, 8) value from {customer}""")
fragment("loose_refs", """
select c_custkey % 100 repo_id, case c_custkey % 4 when 0 then 'refs/heads/' when 1 then 'refs/tags/' when 2 then 'refs/remotes/origin/' else 'refs/notes/' end
 ||c_name||case when c_custkey % 6 = 0 then '-loose' else '' end name,
 case when c_custkey % 10 = 0 then 'ref: refs/heads/main' else md5(c_mktsegment)||substr(md5(c_name), 1, 8) end value from {customer} where c_custkey % 3 = 0""")


@query("s8_list_refs", """select repo_id, name,
 case when name like 'refs/heads/%' then substr(name, 12) when name like 'refs/remotes/%' then substr(name, 14) when name like 'refs/tags/%' then substr(name, 11) else name end short,
 case when name like 'refs/heads/%' then 'branch' when name like 'refs/remotes/%' then 'remote' when name like 'refs/tags/%' then 'tag' else 'other' end kind,
 arg_max(value, rk) sha from (select *, 0 rk from packed_refs union all select *, 1 from loose_refs) r
 where regexp_full_match(value, '[0-9a-f]{40}') group by 1, 2""")
def _(d):
    return SH.list_refs(d.packed_refs, d.loose_refs)


# Pairs: in every repository the newest commit against each of the others by residue.
fragment("commit_pairs", """
select a.sha||'-'||b.sha pair_id, a.sha a, b.sha b from commit_rows a join commit_rows b on a.repo_id = b.repo_id
where a.seq = a.seq_count and b.seq % 3 = 1""")


@query("u5_merge_base", """select pair_id, coalesce(arg_max(sha, (time, sha)), '') merge_base from (
 with recursive up as (select pair_id, a sha, 1 bit from commit_pairs union select pair_id, b, 2 from commit_pairs
  union select u.pair_id, p.parent, u.bit from up u join parents p on p.sha = u.sha),
 common as (select pair_id, sha from up group by 1, 2 having count(distinct bit) = 2),
 above as (select c.pair_id, p.parent sha from common c join parents p on p.sha = c.sha
  union select w.pair_id, p.parent from above w join parents p on p.sha = w.sha)
 select q.pair_id, c.sha, k.time from commit_pairs q left join (select * from common anti join above using (pair_id, sha)) c using (pair_id) left join commit_rows k on k.sha = c.sha) x
 group by pair_id""")
def _(d):
    return H.merge_base(commits(d), d.commit_pairs).select("pair_id", F.coalesce("merge_base", F.lit("")).alias("merge_base"))


oracle_fragment("parents", "select sha, parent1 parent from commit_rows where parent1 is not null union all select sha, parent2 from commit_rows where parent2 is not null")
fragment("branch_heads", """
select h.repo_id branch, h.sha head, b.sha base from commit_rows h left join commit_rows b on b.repo_id = h.repo_id and b.seq = h.seq_count - 8 and h.repo_id % 2 = 0
where h.seq = h.seq_count""")


@query("t3_branch_commits", """select * from (with recursive w as (select branch, head, base, head sha, 1 place from branch_heads
 union all select w.branch, w.head, w.base, c.parent1, place + 1 from w join commit_rows c on c.sha = w.sha where c.parent1 is not null and c.parent1 is distinct from w.base and place < 50)
 select branch, head, sha, place from w) r""")
def _(d):
    return H.branch_commits(commits(d), d.branch_heads)


_SPECS = """select repo_id, sha head, spec from commit_rows cross join (
 select '@' spec union all select 'main~3' union all select 'main^2' union all select 'main~2^2~1' union all select 'main^^' union all select 'main^0~1') t where seq = seq_count"""
fragment("rev_specs", _SPECS)


@query("t5_resolve_specs", """select s.repo_id, s.spec, coalesce(case s.spec when '@' then s.head
 when 'main~3' then c3.sha when 'main^2' then c1.parent2 when 'main^^' then p2.sha when 'main^0~1' then c1.parent1
 when 'main~2^2~1' then m.parent1 end, '') sha
 from rev_specs s left join commit_rows c1 on c1.sha = s.head left join commit_rows p1 on p1.sha = c1.parent1 left join commit_rows p2 on p2.sha = p1.parent1
 left join commit_rows c3 on c3.sha = p2.parent1 left join commit_rows m on m.sha = p2.parent2""")
def _(d):
    specs = d.rev_specs
    names = specs.select("repo_id", "head").distinct()
    names = names.select("repo_id", F.explode(F.array(F.lit("HEAD"), F.lit("main"))).alias("name"), F.col("head").alias("sha"))
    out = H.resolve_specs(commits(d), names, specs.select("repo_id", "spec"))
    return out.select("repo_id", "spec", F.coalesce("sha", F.lit("")).alias("sha"))


fragment("id_prefixes", "select distinct substr(md5(cast(o_orderkey as string)), 1, 4 + cast(o_orderkey % 3 as int)) prefix from {orders} union select 'zzzz'||cast(o_custkey as string) from {orders}")


@query("j24_expand_ids", """select p.prefix, coalesce(case when count(i.id) = 1 then min(i.id) end, '') id, least(count(i.id), 2) matches
 from id_prefixes p left join (select md5(cast(o_orderkey as varchar)) id from orders) i on substr(i.id, 1, length(p.prefix)) = p.prefix group by 1""")
def _(d):
    ids = d.orders.select(F.md5(F.col("o_orderkey").cast("string")).alias("id"))
    return H.expand_ids(d.id_prefixes, ids).select("prefix", F.coalesce("id", F.lit("")).alias("id"), "matches")


# Subjects of several kinds, one per commit.
fragment("subjects", """
select sha, case seq % 7 when 0 then 'Merge branch ''topic'' into main' when 1 then 'Merge pull request #12 from a/b' when 2 then 'Merge topic into main'
 when 3 then 'Merge the queues' when 4 then 'Merge tag ''v1''' when 5 then 'Fix '||sha else 'Merge git@host.example:a/b.git' end subject from commit_rows""")
MERGE = r"^Merge (?:(?:remote-tracking )?branch(?:es)? '|tags? '|commits? '|pull request #\d+ from |(?:(?:[a-z][\w+.-]*://|[\w.-]+(?:@[\w.-]+)?:|/)\S+|\S+ into \S+)$)"


@query("p13_is_merge_subject", f"""select sha, regexp_matches(subject, '{MERGE.replace("'", "''")}') is_merge from subjects""")
def _(d):
    from diffloom.functions.keys import is_merge_subject

    return d.subjects.select("sha", is_merge_subject(F.col("subject")).alias("is_merge"))
