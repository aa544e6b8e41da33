"""Registered queries over nodes.

Two inputs: nodes of markup, scanned from pages (a text scan no oracle states; tests check it), and nodes of a parser's
table derived in SQL both engines take: one text per customer, holding orders, their lines, and the lines' fields.
"""

from pyspark.sql import functions as F

from diffloom.operators import moves as M
from diffloom.operators import nodes as N
from diffloom.plans.line_queries import BY, TOKEN, aligned
from diffloom.plans.registry import Data, fragment, oracle_fragment, query
from diffloom.sources import markup as S

# Every node in document order; five characters a node and ten a line, so that lines and nodes differ.
fragment("ledger_lines", """
select o_custkey blob, o_orderkey + 1 o, l_linenumber l, max(cast(l_suppkey as string)) supplier, max(l_returnflag) flag, max(l_linestatus) status
from {lineitem} join {orders} on o_orderkey = l_orderkey group by o_custkey, o_orderkey, l_linenumber""")
fragment("ledger_rows", """
select c_custkey blob, 0 o, 0 l, 0 f, 0 depth, 'customer' kind, c_name label from {customer} union all
select o_custkey, o_orderkey + 1, 0, 0, 1, 'order', o_orderpriority from {orders} join {customer} on c_custkey = o_custkey union all
select blob, o, l, 0, 2, 'line', supplier from ledger_lines join {customer} on c_custkey = blob union all
select blob, o, l, 1, 3, 'text', flag from ledger_lines join {customer} on c_custkey = blob union all
select blob, o, l, 2, 3, case when l % 5 = 0 then 'comment' else 'text' end, status from ledger_lines join {customer} on c_custkey = blob""")
fragment("ledger_numbered", "select *, row_number() over (partition by blob order by o, l, f) - 1 num from ledger_rows")
NUMBERED_NODES = """
select cast(blob as string) blob_id, cast(num as int) idx,
       cast(case depth when 0 then -1 when 1 then 0 when 2 then min(num) over (partition by blob, o) else min(num) over (partition by blob, o, l) end as int) parent,
       cast(case depth when 0 then count(*) over (partition by blob) when 1 then count(*) over (partition by blob, o) when 2 then count(*) over (partition by blob, o, l) else 1 end as int) size,
       depth, kind, label, cast(num * 5 as int) first_char,
       cast((num + case depth when 0 then count(*) over (partition by blob) when 1 then count(*) over (partition by blob, o) when 2 then count(*) over (partition by blob, o, l) else 1 end) * 5 as int) end_char
from """
fragment("ledger_nodes", NUMBERED_NODES + "ledger_numbered")
# The same with faults: a node twice, and a node that ends after its parent.
fragment("ledger_broken", """
select blob_id, idx, parent, size, depth, kind, label, first_char, case when idx = 1 and cast(blob_id as int) % 9 = 4 then end_char + 1000000 else end_char end end_char from ledger_nodes union all
select * from ledger_nodes where idx = 3 and cast(blob_id as int) % 7 = 2""")
fragment("ledger_texts", "select blob_id, repeat('123456789'||chr(10), cast((max(idx) + 2) / 2 as int)) text from ledger_nodes group by blob_id")
oracle_fragment("ledger_below", """select a.blob_id, a.idx anc, a.depth top, a.kind anc_kind, a.label anc_label, d.idx, d.depth, d.kind, d.label, d.size
 from ledger_nodes a join ledger_nodes d on d.blob_id = a.blob_id and d.idx >= a.idx and d.idx < a.idx + a.size""")
oracle_fragment("ledger_steps", """select blob_id, idx, string_agg(cast(i as varchar), '.' order by top) steps from ledger_below
 join (select blob_id, idx anc, row_number() over (partition by blob_id, parent order by idx) - 1 i from ledger_nodes) using (blob_id, anc) where top > 0 group by 1, 2""")
oracle_fragment("ledger_chains", """select n.blob_id, n.idx, coalesce(list(anc_kind||' '||anc_label order by top) filter (anc_kind in ('order', 'line')), cast([] as varchar[])) chain
 from ledger_nodes n left join ledger_below b on b.blob_id = n.blob_id and b.idx = n.idx and b.anc <> n.idx group by 1, 2""")
oracle_fragment("ledger_lined", """select *, first_char // 10 + 1 first_line, (end_char - 1) // 10 + 1 last_line from ledger_nodes""")

# A second version: the lines of every fifth order went to the end of the customer's first order.
fragment("ledger_later_rows", """
select r.blob, case when r.l > 0 and r.o % 5 = 3 then m.o else r.o end o, case when r.l > 0 and r.o % 5 = 3 then r.o * 10 + r.l else r.l end l, r.f, r.depth, r.kind, r.label, r.o was_o, r.l was_l
from ledger_rows r left join (select blob, min(o) o from ledger_rows where o > 0 group by blob) m on m.blob = r.blob""")
fragment("ledger_later_numbered", "select *, row_number() over (partition by blob order by o, l, f) - 1 num from ledger_later_rows")
fragment("ledger_later_nodes", NUMBERED_NODES + "ledger_later_numbered")
for version in ("ledger", "ledger_later"):
    fragment(f"{version}_placed", f"""select blob_id, idx, kind, label, cast(floor(first_char / 10) as int) + 1 first_line, cast(floor((end_char - 1) / 10) as int) + 1 last_line from {version}_nodes""")
fragment("ledger_claims", """
select cast(a.blob as string) blob_id, cast(a.blob as string)||':'||cast(a.num as string) claim_id, x.first_line start_a, x.last_line + 1 end_a, y.first_line start_b, y.last_line + 1 end_b
from ledger_numbered a join ledger_later_numbered b on b.blob = a.blob and b.was_o = a.o and b.was_l = a.l and b.kind = 'line'
 join ledger_placed x on x.blob_id = cast(a.blob as string) and x.idx = a.num join ledger_later_placed y on y.blob_id = cast(b.blob as string) and y.idx = b.num where a.kind = 'line'""")
# Few anchors, so that some lines change their order without passing one.
fragment("ledger_anchors", """
select cast(a.blob as string) blob_id, cast(floor(a.num / 2) as int) + 1 start_a, cast(floor(a.num / 2) as int) + 2 end_a, cast(floor(b.num / 2) as int) + 1 start_b, cast(floor(b.num / 2) as int) + 2 end_b
from ledger_numbered a join ledger_later_numbered b on b.blob = a.blob and b.o = a.o and b.kind = 'order' where a.kind = 'order' and a.o % 4 = 1""")
for version, half in (("ledger", "a"), ("ledger_later", "b")):
    oracle_fragment(f"ledger_chain_{half}", f"""select c.claim_id, coalesce(string_agg(n.kind||' '||n.label, chr(1) order by n.idx), '') chain from ledger_claims c
 left join {version}_placed n on n.blob_id = c.blob_id and n.kind in ('customer', 'order') and n.first_line <= c.start_{half} and n.last_line + 1 >= c.end_{half} group by 1""")


# One tag per line, so that lines and nodes differ; the second version wraps some articles and drops some items.
fragment("page_texts", "select cast(page_id as string) blob_id, replace(html, '>', '>'||chr(10)) text from {pages}")
fragment("page_later", """select cast(page_id as string) blob_id, replace(case page_id % 4 when 0 then replace(replace(html, '<article>', '<section><article>'), '</article>', '</article></section>')
 when 1 then replace(html, '<li>', '<li class="n">') when 2 then html||'<footer><p>page '||cast(page_id as string)||'</p></footer>' else html end, '>', '>'||chr(10)) text from {pages}""")
DECLARED = ["article", "section", "nav", "ul", "div", "footer"]


def placed(rows):
    return rows.withColumnsRenamed({"first_char": "start", "end_char": "end"})


def ledger(d: Data):
    return d.shared("ledger", lambda d: placed(d.written("ledger_lines").ledger_nodes))


def nodes(d: Data):
    return d.shared("nodes", lambda d: S.markup_nodes(d.page_texts))


def later(d: Data):
    return d.shared("later_nodes", lambda d: S.markup_nodes(d.page_later))


def hashed(d: Data):
    return d.shared("hashed", lambda d: N.subtree_hash(nodes(d)))


def hashed_later(d: Data):
    return d.shared("hashed_later", lambda d: N.subtree_hash(later(d)))


def lined(d: Data):
    return d.shared("lined", lambda d: N.with_lines(nodes(d), d.page_texts))


def node_map(d: Data):
    return d.shared("node_map", lambda d: N.match_nodes(hashed(d), hashed_later(d)))


@query("s12_markup_nodes")
def _(d):
    return nodes(d).drop("label")


@query("s13_load_nodes", """select blob_id, count(*) nodes from ledger_nodes n where cast(blob_id as int) % 9 <> 4 and not (cast(blob_id as int) % 7 = 2 and exists (select 1 from ledger_nodes x where x.blob_id = n.blob_id and x.idx = 3))
 or (cast(blob_id as int) % 9 = 4 and cast(blob_id as int) % 7 <> 2 and not exists (select 1 from ledger_nodes x where x.blob_id = n.blob_id and x.idx = 1)) group by 1""")
def _(d):
    good, _bad = S.load_nodes(placed(d.ledger_broken))
    return good.groupBy("blob_id").agg(F.count("*").alias("nodes"))


@query("s13_node_problems", """select distinct blob_id, 'repeated idx' problem from ledger_nodes where idx = 3 and cast(blob_id as int) % 7 = 2
 union all select distinct blob_id, 'outside its parent' from ledger_nodes where idx = 1 and cast(blob_id as int) % 9 = 4""")
def _(d):
    return S.load_nodes(placed(d.ledger_broken))[1]


@query("a3_subtree_stats", """select blob_id, anc idx, count(*) size, max(depth) - min(depth) height, count(case when size = 1 and kind <> 'comment' then 1 end) atoms from ledger_below group by 1, 2""")
def _(d):
    return N.subtree_stats(ledger(d))


@query("a4_subtree_hash", """select blob_id, anc idx, md5(string_agg(cast(depth - top as varchar)||':'||md5(kind||chr(1)||label), ',' order by idx)) hash from ledger_below group by 1, 2""")
def _(d):
    return N.subtree_hash(ledger(d)).select("blob_id", "idx", "hash")


@query("j16_moved_declaration", """select c.blob_id, c.start_a, c.start_b, exists (select 1 from ledger_anchors f where f.blob_id = c.blob_id
   and ((c.end_a <= f.start_a and c.start_b >= f.end_b) or (c.start_a >= f.end_a and c.end_b <= f.start_b))) passed, a.chain <> b.chain rechained
 from ledger_claims c join ledger_chain_a a using (claim_id) join ledger_chain_b b using (claim_id) where passed or rechained""")
def _(d):
    d.written("ledger_lines", "ledger_rows", "ledger_numbered", "ledger_later_numbered", "ledger_placed", "ledger_later_placed", "ledger_claims", "ledger_anchors")
    file = lambda name: getattr(d, name).select("*", F.lit(1).alias("diffset_id"), F.col("blob_id").alias("path"))
    claims, anchors = file("ledger_claims"), file("ledger_anchors")
    chains = [
        M.claim_chains(claims.select("blob_id", "claim_id", F.col(f"start_{h}").alias("first"), (F.col(f"end_{h}") - 1).alias("last")), placed_nodes, ["customer", "order"])
        for h, placed_nodes in (("a", d.ledger_placed), ("b", d.ledger_later_placed))
    ]
    return M.moved_how(claims, anchors, *chains).select("blob_id", "start_a", "start_b", "passed", "rechained")


@query("f7_steps", """select n.blob_id, n.idx, coalesce(s.steps, '') steps, coalesce(t.outermost, 0) outermost from ledger_nodes n left join ledger_steps s using (blob_id, idx) left join (
 select p.blob_id, count(*) outermost from ledger_nodes p where p.idx % 3 = 1 and not exists (
   select 1 from ledger_below b where b.blob_id = p.blob_id and b.idx = p.idx and b.anc <> p.idx and b.anc % 3 = 1) group by 1) t using (blob_id)""")
def _(d):
    rows = N.steps_of(ledger(d))
    pairs = rows.filter("idx % 3 = 1").groupBy("blob_id").agg(N.normalize_steps(F.collect_list("steps")).alias("s"))
    tops = pairs.select("blob_id", F.size("s").alias("outermost"))
    out = rows.select("blob_id", "idx", F.array_join(F.col("steps").cast("array<string>"), ".").alias("steps")).join(tops, "blob_id", "left")
    return out.na.fill(0, ["outermost"])


@query("f18_content_atoms", """select n.blob_id, n.idx, n.size = 1 and n.kind <> 'comment' is_atom, true is_unit, md5(coalesce(arg_min(k.label, k.idx), '')) name_md5
 from ledger_nodes n left join ledger_nodes k on k.blob_id = n.blob_id and k.parent = n.idx and k.kind = 'text' group by n.blob_id, n.idx, n.size, n.kind""")
def _(d):
    rows = N.declaration_names(N.content_atoms(ledger(d)), ["text"])
    return rows.select("blob_id", "idx", "is_atom", "is_unit", F.md5(F.coalesce("name", F.lit(""))).alias("name_md5"))


@query("j18_nodes_on_lines", """with r as (select blob_id, unnest(range(1, n + 1, 3)) "first" from (select blob_id, max(last_line) n from ledger_lined group by 1) x),
 w as (select r.blob_id, r."first", x.idx from r join ledger_lined x on x.blob_id = r.blob_id and x.first_line >= r."first" and x.last_line <= r."first" + 2
   left join ledger_lined u on u.blob_id = x.blob_id and u.idx = x.parent where u.idx is null or u.first_line < r."first" or u.last_line > r."first" + 2)
 select blob_id, "first" range_id, idx from w union all
 select r.blob_id, r."first", arg_min(x.idx, x.size * 1000000 + x.idx) from r join ledger_lined x on x.blob_id = r.blob_id and x.first_line <= r."first" and x.last_line >= r."first" + 2
 where not exists (select 1 from w where w.blob_id = r.blob_id and w."first" = r."first") group by 1, 2""")
def _(d):
    lines = N.with_lines(ledger(d), d.ledger_texts)
    ranges = lines.groupBy("blob_id").agg(F.max("last_line").alias("_n")).select(
        "blob_id", F.explode(F.sequence(F.lit(1), F.col("_n"), F.lit(3))).alias("first")).select("blob_id", F.col("first").alias("range_id"), "first", (F.col("first") + 2).alias("last"))
    return N.nodes_on_lines(lines, ranges)


@query("j18_line_ranges", """select blob_id, anchor_id, min(first_line) "start", max(last_line) "end" from (select *, sum(fresh) over (partition by blob_id, anchor_id order by first_line, last_line, idx) run from (
 select *, case when max(last_line) over (partition by blob_id, anchor_id order by first_line, last_line, idx rows between unbounded preceding and 1 preceding) + 1 >= first_line then 0 else 1 end fresh
 from (select blob_id, idx, idx % 7 anchor_id, first_line, last_line from ledger_lined where depth > 1) a) b) c group by blob_id, anchor_id, run""")
def _(d):
    anchors = ledger(d).filter("depth > 1").select("blob_id", "idx", (F.col("idx") % 7).alias("anchor_id"))
    return N.line_ranges(N.with_lines(ledger(d), d.ledger_texts), anchors)


UNITS = ["order", "line"]


@query("w9_declaration_chain", "select blob_id, idx, len(chain) depth, md5(array_to_string(chain, '>')) chain_md5 from ledger_chains")
def _(d):
    return N.declaration_chain(ledger(d), UNITS).select("blob_id", "idx", F.size("chain").alias("depth"), F.md5(F.array_join("chain", ">")).alias("chain_md5"))


@query("w10_section_events", """with r as (select *, coalesce(lag(chain) over w, cast([] as varchar[])) prev, lead(idx) over w is null ends from ledger_chains window w as (partition by blob_id order by idx)),
 k as (select *, list_max([x for x in range(0, least(len(prev), len(chain)) + 1) if prev[:x] = chain[:x]]) k from r)
 select blob_id, idx row_no, 'end' kind, len(prev) - p i, prev[p] label from (select *, unnest(range(k + 1, len(prev) + 1)) p from k) a
 union all select blob_id, idx, 'begin', p - k - 1, chain[p] from (select *, unnest(range(k + 1, len(chain) + 1)) p from k) b
 union all select blob_id, idx + 1, 'end', len(chain) - p, chain[p] from (select *, unnest(range(1, len(chain) + 1)) p from k where ends) c""")
def _(d):
    rows = N.declaration_chain(ledger(d), UNITS).select("blob_id", F.col("idx").alias("row_no"), "chain")
    return N.section_events(rows, ["blob_id"])


@query("j27_match_nodes")
def _(d):
    return node_map(d)


@query("j28_match_containers")
def _(d):
    return N.match_containers(node_map(d), hashed(d), hashed_later(d))


@query("p9_move_eligible", """select blob_id, idx from ledger_nodes n where cast(blob_id as int) % 9 <> 0 and not exists (
 select 1 from ledger_below b where b.blob_id = n.blob_id and b.idx = n.idx and b.anc_kind = 'order' and b.anc_label = '1-URGENT')""")
def _(d):
    rows = ledger(d).withColumns({
        "language": F.when(F.col("blob_id").cast("int") % 9 == 0, "json").otherwise("html"),
        "kind": F.when((F.col("kind") == "order") & (F.col("label") == "1-URGENT"), "import_statement").otherwise(F.col("kind"))})
    return M.move_eligible(rows).select("blob_id", "idx")


@query("h5_whole_units")
def _(d):
    matched = node_map(d).select("blob_id", F.col("idx_b").alias("idx"))
    changed = later(d).filter(F.col("kind").isin(DECLARED)).select("blob_id", "idx").join(matched.hint("merge"), ["blob_id", "idx"], "left_anti")
    return N.whole_units(later(d), changed, DECLARED, ["body", "html", *DECLARED]).drop("label")


oracle_fragment("changed_lines", f"""select *, md5(array_to_string([regexp_replace(t, '^([\\p{{L}}\\p{{N}}_]+)([\"''`])$', '\\1' || chr(1) || '\\2') for t in regexp_extract_all(text, '{TOKEN}')], chr(1))) hash
 from aligned where mate is null and trim(text, ' ') <> ''""")


@query("h6_edit_outline", """select diffset_id, path, gap frag_no, case side when 'a' then 'before' else 'after' end side, line_no node_no, 'line' kind, length(text) "columns", hash,
 md5(path||chr(0)||''||chr(0)||case when side = 'a' then '='||hash else '' end||chr(0)||case when side = 'b' then '='||hash else '' end) atom from changed_lines""")
def _(d):
    return N.edit_outline(aligned(d), BY)
