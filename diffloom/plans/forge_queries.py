"""Registered queries over forge payloads."""

from pyspark.sql import functions as F

from diffloom.functions import keys as K
from diffloom.functions import text as T
from diffloom.plans.registry import Data, fragment, query
from diffloom.sources import forge as S

fragment("compare_pages", """
select 'set-'||cast(o_custkey % 100 as string) diffset_id, o_orderkey page, '{"merge_base_commit":'||case when o_custkey % 100 = 7 then 'null' else '{"sha":"'||md5(cast(o_custkey as string))||'"}' end
 ||',"files":[{"sha":"'||md5(cast(o_orderkey as string))||'","filename":"a/'||cast(o_orderkey as string)||'.ts","additions":'||cast(o_orderkey % 9 as string)||',"deletions":2,"status":"'||case o_orderkey % 3 when 0 then 'added' when 1 then 'removed' else 'modified' end||'"}'
 ||',{"sha":"'||md5(cast(o_orderkey + 1 as string))||'","filename":"b/'||cast(o_orderkey as string)||'.ts","previous_filename":"c/'||cast(o_orderkey as string)||'.ts","additions":0,"deletions":0,"status":"renamed"}]}' json
from {orders}""")


@query("s9_read_compare", """select 'set-'||cast(o_custkey % 100 as varchar) diffset_id, 'a/'||cast(o_orderkey as varchar)||'.ts' path, '' old_path, case o_orderkey % 3 when 0 then 'added' when 1 then 'deleted' else 'modified' end status,
 case when o_orderkey % 3 = 1 then md5(cast(o_orderkey as varchar)) else '' end "before", case when o_orderkey % 3 <> 1 then md5(cast(o_orderkey as varchar)) else '' end "after", o_orderkey % 9 added, 2 removed from orders
 union all select 'set-'||cast(o_custkey % 100 as varchar), 'b/'||cast(o_orderkey as varchar)||'.ts', 'c/'||cast(o_orderkey as varchar)||'.ts', 'renamed', '', md5(cast(o_orderkey + 1 as varchar)), 0, 0 from orders""")
def _(d):
    return S.read_compare(d.compare_pages)[0].na.fill("", ["old_path", "before", "after"])


@query("s9_incomplete_sets", """select 'set-'||cast(o_custkey % 100 as varchar) diffset_id, count(*) * 2 files from orders group by 1 having count(*) * 2 >= 310 or 'set-'||cast(any_value(o_custkey) % 100 as varchar) = 'set-7'""")
def _(d):
    return S.read_compare(d.compare_pages, cap=310)[1].select("diffset_id", "files")


fragment("pull_pages",
         """select o_custkey repo_id, '[{"number":'||cast(o_orderkey as string)||',"title":"Order '||o_orderpriority||'","base":{"sha":"b'||cast(o_orderkey as string)||'"},"head":{"sha":"h'||cast(o_orderkey as string)||'"}}]' json from {orders}""")


@query("s10_read_pulls", "select o_custkey repo_id, o_orderkey \"number\", 'Order '||o_orderpriority title, 'b'||cast(o_orderkey as varchar) base, 'h'||cast(o_orderkey as varchar) head from orders")
def _(d):
    return S.read_pulls(d.pull_pages)


fragment("commit_pages", """
select o_orderkey pull_id, '{"payload":{"pullRequestsCommitsRoute":{"metadata":{"commitHeadShaChannel":"'||case when o_orderkey % 2 = 0 then 'eyJjIjoicmVwbzoxOmNvbW1pdDowMTIzNDU2Nzg5MDEyMzQ1Njc4OTAxMjM0NTY3ODkwMTIzNDU2Nzg5In0=--aa' else 'x' end
 ||'"},"commitGroups":[{"commits":[{"oid":"'||md5(cast(o_orderkey as string))||'","shortMessage":"Merge branch ''x''","committedDate":"2024-03-01T10:00:00Z","authors":[{"displayName":"","login":"u'||cast(o_custkey as string)||'"}]}]},{"commits":[{"oid":"'||md5(o_orderpriority)||'","shortMessage":"Fix","committedDate":"2024-03-02T10:00:00Z","authors":[{"displayName":"D E","login":"x"}]}]}]}}}' json
from {orders}""")


@query("s10_read_pr_commits", """select o_orderkey pull_id, case when o_orderkey % 2 = 0 then '0123456789012345678901234567890123456789' else md5(o_orderpriority) end head, i place,
 case i when 0 then md5(cast(o_orderkey as varchar)) else md5(o_orderpriority) end sha, case i when 0 then 'u'||cast(o_custkey as varchar) else 'D E' end author, i = 0 is_merge, 1709287200 + 86400 * i committed from orders, (select unnest([0, 1]) i) x""")
def _(d):
    return S.read_pr_commits(d.commit_pages).select("pull_id", "head", "place", "sha", "author", "is_merge", F.unix_seconds("committed").alias("committed"))


fragment("comment_pages", """
select 'src'||cast(conv_id % 20 as string) diffset_id, '[{"id":'||cast(conv_id * 1000 + turn as string)||case when turn > 0 then ',"in_reply_to_id":'||cast(conv_id * 1000 as string) else '' end||',"path":"p/'||cast(conv_id as string)||'","line":'||case when conv_id % 4 = 0 then 'null' else cast(1 + turn as string) end
 ||',"side":"RIGHT","original_line":3,"original_commit_id":"c","user":'||case when turn = 1 then 'null' else '{"login":"'||role||'"}' end||',"created_at":"2024-01-0'||cast(1 + turn % 9 as string)||'T00:00:00Z","body":"b'||cast(length(text) as string)||'"},{"id":null,"path":"x","body":"dropped"}]' json from {conversations}""")


@query("s10_read_comments", """select 'src'||cast(conv_id % 20 as varchar) diffset_id, conv_id * 1000 + turn id, case when turn > 0 then conv_id * 1000 else 0 end in_reply_to_id, 'p/'||cast(conv_id as varchar) path, case when conv_id % 4 = 0 then 0 else 1 + turn end line,
 case when turn = 1 then '' else role end author, 'b'||cast(length(text) as varchar) body, 1704067200 + 86400 * (turn % 9) created from conversations""")
def _(d):
    c = S.read_comments(d.comment_pages)
    return c.select("diffset_id", "id", F.coalesce("in_reply_to_id", F.lit(0)).alias("in_reply_to_id"), "path", F.coalesce("line", F.lit(0)).alias("line"), "author", "body", F.unix_seconds("created").alias("created"))


# Rendered commit pages: the page's own markup, then a file list; one in seven miscounts, one in five is data.
fragment("commit_html", """
select page_id, html||case when page_id % 5 = 0 then '<script type="application/json" data-target="react-app.embeddedData">{"payload":{"pullRequestsChangesWithRangeRoute":{"diffSummaries":[{"path":"data/'||cast(page_id as string)||'"},{"path":"x > y"}],"commit":{"parents":["a"'||case when page_id % 10 = 0 then ',"b"' else '' end||']}}}}</script>'
 else '<file-filter></file-filter><div data-tagsearch-path="src/'||cast(page_id as string)||'&lt;T&gt;.ts"></div><div data-tagsearch-path="a&amp;amp;b"></div><li data-tree-entry-type="file" class="x"> <span data-filterable-item-text hidden>lib/&quot;q&quot;</span></li><i data-all-file-count-markup="('||case when page_id % 7 = 0 then '9' else '2' end||')"></i><i data-all-file-count-markup="(1)"></i>' end html
from {pages}""")


@query("s11_paths_from_pages", """select page_id, unnest(case when page_id % 5 = 0 then ['data/'||cast(page_id as varchar), 'x > y'] else ['src/'||cast(page_id as varchar)||'<T>.ts', 'a&amp;b', 'lib/"q"'] end) path from pages
 where case when page_id % 5 = 0 then page_id % 10 = 0 else page_id % 7 <> 0 end""")
def _(d):
    return S.paths_from_pages(d.commit_html)


@query("f10_unescape_html", """select page_id, md5(replace(replace(replace(replace(replace(html, '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) plain from pages""")
def _(d):
    return d.pages.select("page_id", F.md5(T.unescape_html(F.col("html"))).alias("plain"))


fragment("ref_texts", """
select o_orderkey, o_custkey % 50 workspace, case o_orderkey % 8 when 0 then 'https://github.com/Own.er/re-po'||cast(o_custkey % 5 as string)||'/pull/'||cast(o_orderkey as string)||'/files?w=1' when 1 then 'owner/repo'||cast(o_custkey % 5 as string)||'#'||cast(o_orderkey as string)
 when 2 then '#'||cast(o_orderkey as string) when 3 then ' '||cast(o_orderkey as string)||' ' when 4 then 'github.com/a/b/pull/'||cast(o_orderkey as string)||'/commits/abcdef1' when 5 then 'not a ref' when 6 then '#0' else 'https://github.com/a/b/issues/3' end ref,
 case o_orderkey % 6 when 0 then 'https://github.com/own/repo.git' when 1 then 'git@github.com:own/repo'||cast(o_custkey as string) when 2 then 'ssh://git@github.com/own/repo.git/' when 3 then 'https://example.com/a/b' when 4 then 'git@github.com:own/' else ' https://github.com/own/re.po/ ' end url from {orders}""")


@query("p11_parse_pull_ref", """select o_orderkey, case o_orderkey % 8 when 0 then 'Own.er' when 1 then 'owner' when 4 then 'a' else '' end "owner", case o_orderkey % 8 when 0 then 're-po'||cast(o_custkey % 5 as varchar) when 1 then 'repo'||cast(o_custkey % 5 as varchar) when 4 then 'b' else '' end repo,
 case when o_orderkey % 8 in (0, 1, 2, 3, 4) and o_orderkey > 0 then o_orderkey else 0 end "number" from orders where o_orderkey > 0""")
def _(d):
    p = K.parse_pull_ref(F.col("ref"))
    return d.ref_texts.filter("o_orderkey > 0").select("o_orderkey", F.coalesce(p["owner"], F.lit("")).alias("owner"), F.coalesce(p["repo"], F.lit("")).alias("repo"), F.coalesce(p["number"], F.lit(0)).alias("number"))


@query("p11_parse_remote", """select o_orderkey, case when o_orderkey % 6 in (0, 1, 2, 5) then 'own' else '' end "owner", case o_orderkey % 6 when 0 then 'repo' when 1 then 'repo'||cast(o_custkey as varchar) when 2 then 'repo' when 5 then 're.po' else '' end repo from orders""")
def _(d):
    p = K.parse_remote(F.col("url"))
    return d.ref_texts.select("o_orderkey", F.coalesce(p["owner"], F.lit("")).alias("owner"), F.coalesce(p["repo"], F.lit("")).alias("repo"))


@query("p12_remotes_for", """select o_orderkey, r.o r_owner, r.p r_repo from orders, (select unnest(['OWNER', 'own.er', 'z']) o, unnest(['Repo1', 'RE-PO2', 'z']) p) r
 where o_orderkey > 0 and (o_orderkey % 8 in (2, 3) or (o_orderkey % 8 = 1 and r.o = 'OWNER' and o_custkey % 5 = 1) or (o_orderkey % 8 = 0 and r.o = 'own.er' and o_custkey % 5 = 2))""")
def _(d):
    p = K.parse_pull_ref(F.col("ref"))
    refs = d.ref_texts.select("o_orderkey", "workspace", p.alias("p")).filter("p is not null and o_orderkey > 0").select("o_orderkey", "workspace", "p.owner", "p.repo")
    known = F.explode(F.array(*[F.struct(F.lit(o).alias("owner"), F.lit(r).alias("repo")) for o, r in (("OWNER", "Repo1"), ("own.er", "RE-PO2"), ("z", "z"))]))
    remotes = refs.select("workspace").distinct().select("workspace", known.alias("r")).select("workspace", "r.*")
    return S.remotes_for(refs, remotes).select("o_orderkey", "r_owner", "r_repo")


@query("p16_blob_ids", """select c_custkey, 'own/'||c_mktsegment||'@'||md5(c_name) blob_id, 'own' "owner", c_mktsegment repo, md5(c_name) sha, 'own/'||c_mktsegment||'@b..'||md5(c_name) diffset_id from customer""")
def _(d):
    c = d.customer.withColumn("sha", F.md5("c_name"))
    blob = K.encode_blob_id(F.lit("own"), F.col("c_mktsegment"), F.col("sha"))
    p = K.decode_blob_id(F.col("blob_id"))
    return c.withColumn("blob_id", blob).select("c_custkey", "blob_id", p["owner"].alias("owner"), p["repo"].alias("repo"), p["sha"].alias("sha"), K.diffset_id(F.lit("own"), F.col("c_mktsegment"), F.lit("b"), F.col("sha")).alias("diffset_id"))


fragment("key_texts", """
select conv_id * 1000 + turn id, conv_id % 12 form, '{"anchor":{"side":"'||case when conv_id % 12 = 1 then 'left' else 'after' end||'","path":"'||case when conv_id % 12 = 2 then '' else 'src/'||cast(conv_id as string) end||'","nodes":'
 ||case conv_id % 12 when 3 then '[]' when 4 then '[[0,-1]]' when 5 then '[[1.5]]' when 6 then '[["x"]]' when 7 then '[[0],[2]]' else '[[0,'||cast(turn as string)||']]' end
 ||case when conv_id % 12 in (7, 8) then ',"chars":{"start":1,"end":4}' when conv_id % 12 = 9 then ',"chars":{"start":5,"end":4}' else '' end||'},"before":'
 ||case when conv_id % 12 = 10 then '"short"' else 'null' end||',"after":"'||md5(role)||'01234567"'||case when conv_id % 12 = 11 then ',"score":3' when turn % 2 = 0 then ',"score":-1' else '' end||'}' json from {conversations}""")


@query("p14_valid_key", "select id, form in (0, 8) is_valid from key_texts")
def _(d):
    return d.key_texts.select("id", K.valid_key(F.col("json")).isNotNull().alias("is_valid"))


@query("f9_verdict_sentence", """select event_id, case s when 2 then '+2: good to merge' when 1 then '+1: looks good' when -1 then '-1: would rather not' when -2 then '-2: must not merge' else '' end sentence, case s when 0 then event_type else
 case s when 2 then '+2: good to merge' when 1 then '+1: looks good' when -1 then '-1: would rather not' else '-2: must not merge' end||chr(10)||chr(10)||event_type end body from (select *, event_id % 5 - 2 s from events) e""")
def _(d):
    s = F.nullif((F.col("event_id") % 5 - 2).cast("int"), F.lit(0))
    return d.events.select("event_id", F.coalesce(K.verdict_sentence(s), F.lit("")).alias("sentence"), K.with_verdict(F.col("event_type"), s).alias("body"))


@query("f11_decode_payloads", """select conv_id, turn, md5(text) text_md5, '0123456789012345678901234567890123456789' head from conversations""")
def _(d):
    c = d.conversations.withColumn("b", F.base64(F.encode("text", "utf-8"))).withColumn(
        "ch", F.concat(F.base64(F.encode(F.lit('{"c":"repo:1:commit:0123456789012345678901234567890123456789"}'), "utf-8")), F.lit("--"), F.md5("text")))
    return c.select("conv_id", "turn", F.md5(K.decode_base64(F.col("b"))).alias("text_md5"), K.head_from_channel(F.col("ch")).alias("head"))


def lowered(d: Data):
    c = d.conversations.select(
        "conv_id", "turn", F.col("text").alias("body"), F.lit("after").alias("side"), F.concat(F.lit("src/a > b/"), F.col("conv_id").cast("string")).alias("path"),
        F.array(F.array(F.lit(0), F.col("turn").cast("int"))).alias("nodes"), F.when(F.col("turn") % 2 == 0, F.struct(F.lit(1).alias("start"), F.lit(4).alias("end"))).alias("chars"),
        F.lit(None).cast("string").alias("before"), F.concat(F.md5("role"), F.lit("01234567")).alias("after"), F.nullif((F.col("conv_id") % 5 - 2).cast("int"), F.lit(0)).alias("score"))
    return S.lower_comments(c)


@query("s16_lowered_comments", """select conv_id, turn, md5(case conv_id % 5 - 2 when 2 then '+2: good to merge'||chr(10)||chr(10) when 1 then '+1: looks good'||chr(10)||chr(10) when -1 then '-1: would rather not'||chr(10)||chr(10) when -2 then '-2: must not merge'||chr(10)||chr(10) else '' end||text) shown,
 'src/a > b/'||cast(conv_id as varchar) path, '0,'||cast(turn as varchar) steps, conv_id % 5 - 2 score from conversations""")
def _(d):
    r = S.read_lowered(lowered(d).select("conv_id", "turn", "posted"))
    steps = F.array_join(F.get("key.anchor.nodes", F.lit(0)).cast("array<string>"), ",")
    return r.select("conv_id", "turn", F.md5("shown").alias("shown"), F.col("key.anchor.path").alias("path"), steps.alias("steps"), F.coalesce("key.score", F.lit(0)).alias("score"))
