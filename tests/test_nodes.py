"""Markup nodes, rollups and matching against brute force."""

import re

import pytest
from pyspark.sql import functions as F

from diffloom.operators import nodes as N
from diffloom.sources import markup as S

PAGE = (
    '<!DOCTYPE html><html><head><meta charset="u"><title>x <b> y</title></head><body><nav><ul><li>one</li><li>two</li></ul></nav>'
    '<!-- <p>not</p> --><div class="ad">ad</div><article><h1>Head</h1><p>a<b>bold<br><p>second</p></article></i><script>var t="</p>";</script></body></html>'
)
CROSSED = "<html><b>x<p>y</b>z</p><ul><li>k</li></ul></html>"


@pytest.fixture(scope="module")
def nodes(spark):
    df = spark.createDataFrame([("p", PAGE), ("c", CROSSED), ("e", ""), ("t", "plain text")], "blob_id string, text string")
    return S.markup_nodes(df).cache()


def table(nodes, blob):
    return sorted((r.asDict() for r in nodes.filter(F.col("blob_id") == blob).collect()), key=lambda r: r["idx"])


def test_nodes_nest_and_number_in_preorder(nodes):
    for blob in "pcet":
        rows = table(nodes, blob)
        assert [r["idx"] for r in rows] == list(range(len(rows)))
        for r in rows:
            kids = [k for k in rows if r["idx"] < k["idx"] < r["idx"] + r["size"]]
            assert all(r["start"] <= k["start"] and k["end"] <= r["end"] for k in kids)
            if r["parent"] >= 0:
                up = rows[r["parent"]]
                assert up["depth"] == r["depth"] - 1 and up["idx"] < r["idx"] < up["idx"] + up["size"]
    _good, bad = S.load_nodes(nodes)
    assert bad.count() == 0


def test_pairs_by_name_and_leaves_the_rest(nodes):
    rows = table(nodes, "p")
    by_kind = {}
    for r in rows:
        by_kind.setdefault(r["kind"], []).append(r)
    assert len(by_kind["li"]) == 2 and all(r["size"] == 2 for r in by_kind["li"])
    assert by_kind["meta"][0]["size"] == 1 and by_kind["b"][0]["size"] == 1 and by_kind["br"][0]["size"] == 1
    # Of two open <p> the inner one takes the close; the other is a leaf, as is <b>, which never closes.
    assert sorted(r["size"] for r in by_kind["p"]) == [1, 2]
    assert "script" not in by_kind and "title" not in by_kind and "i" not in by_kind
    article = by_kind["article"][0]
    assert PAGE[article["start"]:article["end"]].startswith("<article>") and PAGE[article["start"]:article["end"]].endswith("</article>")


def test_crossing_pairs_become_leaves(nodes):
    rows = {r["kind"]: r for r in table(nodes, "c")}
    assert rows["b"]["size"] == 1 and rows["p"]["size"] == 1 and rows["ul"]["size"] == 3


def test_load_nodes_reports_what_does_not_nest(spark):
    df = spark.createDataFrame([("a", 0, -1, 2, 0, 9), ("a", 1, 0, 1, 3, 12), ("b", 0, -1, 1, 0, 1), ("b", 0, -1, 1, 0, 1), ("c", 0, -1, 1, 0, 1)],
                               "blob_id string, idx int, parent int, size int, start int, end int")
    good, bad = S.load_nodes(df)
    assert {r["blob_id"] for r in good.collect()} == {"c"} and {r["blob_id"] for r in bad.collect()} == {"a", "b"}


def brute(rows):
    """Subtree content, by recursion over parents."""
    kids = {}
    for r in rows:
        kids.setdefault(r["parent"], []).append(r)

    def shape(r):
        return (r["kind"], r["label"], tuple(shape(k) for k in kids.get(r["idx"], [])))

    def height(r):
        return max((1 + height(k) for k in kids.get(r["idx"], [])), default=0)

    def atoms(r):
        below = kids.get(r["idx"], [])
        return sum(map(atoms, below)) if below else int(r["end"] > r["start"])

    return {r["idx"]: (shape(r), height(r), atoms(r)) for r in rows}


def test_rollups_and_hashes_agree_with_recursion(nodes):
    stats = {(r["blob_id"], r["idx"]): r for r in N.subtree_stats(nodes).collect()}
    hashes = {(r["blob_id"], r["idx"]): r["hash"] for r in N.subtree_hash(nodes).collect()}
    shapes = {}
    for blob in "pct":
        for idx, (shape, height, atoms) in brute(table(nodes, blob)).items():
            assert stats[blob, idx]["height"] == height and stats[blob, idx]["atoms"] == atoms
            shapes.setdefault(shape, set()).add(hashes[blob, idx])
    assert all(len(h) == 1 for h in shapes.values())
    assert len({h for hs in shapes.values() for h in hs}) == len(shapes)


def test_steps_lead_to_their_node_and_order_the_document(nodes):
    rows = {r["idx"]: r for r in N.steps_of(nodes).filter("blob_id = 'p'").collect()}
    kids = {}
    for i in sorted(rows):
        kids.setdefault(rows[i]["parent"], []).append(i)
    for i, r in rows.items():
        at = 0
        for s in r["steps"]:
            at = kids[at][s]
        assert at == i
    assert [r["idx"] for r in sorted(rows.values(), key=lambda r: r["steps"])] == sorted(rows)


def test_normalize_steps(spark):
    df = spark.createDataFrame([([[1, 2], [0], [1], [1, 2, 3], [0]],)], "s array<array<int>>")
    assert df.select(N.normalize_steps(F.col("s")).alias("s")).first()["s"] == [[0], [1]]


def test_nodes_on_lines_matches_a_walk(spark):
    text = re.sub(r">", ">\n", PAGE)
    texts = spark.createDataFrame([("p", text)], "blob_id string, text string")
    nodes = N.with_lines(S.markup_nodes(texts), texts).cache()
    rows = sorted((r.asDict() for r in nodes.collect()), key=lambda r: r["idx"])
    starts = [0] + [m.end() for m in re.finditer("\n", text) if m.end() < len(text)]
    line = lambda o: sum(s <= o for s in starts)
    assert all(r["first_line"] == line(r["start"]) and r["last_line"] == line(max(r["start"], r["end"] - 1)) for r in rows)
    n = max(r["last_line"] for r in rows)
    ranges = [(i, a, min(n, a + w)) for i, (a, w) in enumerate((a, w) for a in range(1, n + 1, 2) for w in (0, 2, 5))]
    df = spark.createDataFrame([("p", *r) for r in ranges], "blob_id string, range_id int, first int, last int")
    got = {}
    for r in N.nodes_on_lines(nodes, df, width=4).collect():
        got.setdefault(r["range_id"], set()).add(r["idx"])
    for i, first, last in ranges:
        inside = [r for r in rows if r["first_line"] >= first and r["last_line"] <= last]
        outer = {r["idx"] for r in inside if not any(o["idx"] < r["idx"] < o["idx"] + o["size"] for o in inside)}
        if not outer:
            holds = [r for r in rows if r["first_line"] <= first and r["last_line"] >= last]
            outer = {min(holds, key=lambda r: (r["size"], r["idx"]))["idx"]}
        assert got[i] == outer, (i, first, last)


def test_matching_is_one_to_one_and_pairs_equal_nodes(spark):
    later = PAGE.replace("<article>", "<section><article>").replace("</article>", "</article></section>").replace("one", "three")
    a = N.subtree_hash(S.markup_nodes(spark.createDataFrame([("p", PAGE)], "blob_id string, text string")).cache()).cache()
    b = N.subtree_hash(S.markup_nodes(spark.createDataFrame([("p", later)], "blob_id string, text string")).cache()).cache()
    pairs = N.match_nodes(a, b).cache()
    rows = pairs.collect()
    assert len({r["idx_a"] for r in rows}) == len(rows) == len({r["idx_b"] for r in rows})
    ha, hb = ({r["idx"]: r["hash"] for r in x.collect()} for x in (a, b))
    assert rows and all(ha[r["idx_a"]] == hb[r["idx_b"]] for r in rows)
    kinds_a, kinds_b = ({r["idx"]: r["kind"] for r in x.collect()} for x in (a, b))
    boxes = N.match_containers(pairs, a, b).collect()
    assert boxes and all(kinds_a[r["idx_a"]] == kinds_b[r["idx_b"]] == r["kind"] and r["dice"] >= 0.5 for r in boxes)


def test_section_events_balance(spark):
    chains = [["a"], ["a", "b"], ["a", "b"], ["a", "c"], [], ["d"]]
    df = spark.createDataFrame([("x", i, c) for i, c in enumerate(chains)], "doc string, row_no int, chain array<string>")
    events = sorted(N.section_events(df, ["doc"]).collect(), key=lambda e: (e["row_no"], e["kind"] == "begin", e["i"]))
    stack, seen = [], {}
    for e in events:
        if e["kind"] == "begin":
            stack.append(e["label"])
        else:
            assert stack.pop() == e["label"]
        seen[e["row_no"]] = list(stack)
    assert not stack
    state = []
    for i, chain in enumerate(chains):
        state = seen.get(i, state)
        assert state == chain


def test_whole_units_are_top_level_or_members(spark):
    rows = [  # root > class > (method > local), function
        ("f", 0, -1, 5, 0, "program", "", 0, 50), ("f", 1, 0, 3, 1, "class", "C", 0, 30), ("f", 2, 1, 2, 2, "method", "m", 5, 25),
        ("f", 3, 2, 1, 3, "function", "inner", 10, 20), ("f", 4, 0, 1, 1, "function", "g", 31, 40),
        ("g", 0, -1, 4, 0, "program", "", 0, 50), ("g", 1, 0, 3, 1, "function", "h", 0, 30), ("g", 2, 1, 1, 2, "function", "local", 1, 9), ("g", 3, 1, 1, 2, "call", "", 10, 20),
    ]
    nodes = spark.createDataFrame(rows, "blob_id string, idx int, parent int, size int, depth int, kind string, label string, start int, end int")
    changed = spark.createDataFrame([("f", 2), ("f", 3), ("f", 4), ("g", 2)], "blob_id string, idx int")
    got = {(r["blob_id"], r["label"]) for r in N.whole_units(nodes, changed, ["class", "method", "function"], ["class"]).collect()}
    assert got == {("f", "m"), ("f", "g")}


def test_content_atoms_skip_comments_and_containers(spark):
    rows = [("f", 0, -1, 5, 0, "call", "", 0, 9, True, None), ("f", 1, 0, 1, 1, "identifier", "f", 0, 1, True, "function"), ("f", 2, 0, 1, 1, "(", "(", 1, 2, False, None),
            ("f", 3, 0, 1, 1, "comment", "# x", 2, 5, True, None), ("f", 4, 0, 1, 1, "<", "<", 5, 6, False, "operator")]
    df = spark.createDataFrame(rows, "blob_id string, idx int, parent int, size int, depth int, kind string, label string, start int, end int, named boolean, field string")
    got = {r["idx"]: (r["is_atom"], r["is_unit"]) for r in N.content_atoms(df).collect()}
    assert got == {0: (False, True), 1: (True, False), 2: (False, False), 3: (False, True), 4: (True, False)}


def test_nodes_above_at_any_depth_by_brute_force(spark):
    rows, rng = [], __import__("random").Random(5)
    for blob, deepest in (("deep", 30), ("flat", 3), ("edge", 9)):
        depths = [0]
        while len(depths) < 120:
            depths.append(rng.randint(max(1, min(depths[-1], deepest) - 3), min(depths[-1] + 1, deepest)) if rng.random() < 0.3 else min(depths[-1] + 1, deepest))
        up = [max((j for j in range(i) if depths[j] == dep - 1), default=-1) for i, dep in enumerate(depths)]
        size = [next((j for j in range(i + 1, len(depths)) if depths[j] <= dep), len(depths)) - i for i, dep in enumerate(depths)]
        rows += [(blob, i, up[i], size[i], dep, "order" if i % 3 else "line", str(i)) for i, dep in enumerate(depths)]
    df = spark.createDataFrame(rows, "blob_id string, idx int, parent int, size int, depth int, kind string, label string").cache()
    want = {(b, i, d, j) for b, j, _, n, d, _, _ in rows for x, i, *_ in rows if x == b and j < i < j + n}
    assert {tuple(r) for r in N.ancestors(df).select("blob_id", "idx", "level", "anc").collect()} == want
    chains = {(r["blob_id"], r["idx"]): r["chain"] for r in N.declaration_chain(df, ["order"]).collect()}
    for b, i, *_ in rows:
        assert chains[b, i] == [f"order {j}" for x, y, _, j in sorted(want) if (x, y) == (b, i) and j % 3]
    heights = {(r["blob_id"], r["idx"]): r["height"] for r in N.subtree_stats(df.withColumns({"start": F.col("idx"), "end": F.col("idx") + F.col("size")})).collect()}
    assert heights == {(b, i): max(e for x, j, _, _, e, *_ in rows if x == b and i <= j < i + n) - d for b, i, _, n, d, *_ in rows}


def test_rollups_shuffle_nodes_once_and_by_their_text(spark):
    rows = [("f", 0, -1, 3, 0, "order", "a", 0, 9), ("f", 1, 0, 2, 1, "line", "b", 1, 5), ("f", 2, 1, 1, 2, "text", "c", 2, 4)]
    df = spark.createDataFrame(rows, "blob_id string, idx int, parent int, size int, depth int, kind string, label string, start int, end int")
    for out in (N.subtree_stats(df), N.subtree_hash(df), N.declaration_chain(df, ["order"]), N.steps_of(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(blob_id") == plan.count("Exchange ") == 1 and "Join" not in plan


def test_nodes_that_fill_a_range_meet_only_ranges_around_them(spark):
    nodes = spark.createDataFrame([("f", 0, -1, 101, 0, 1, 300), *[("f", i, 0, 1, 1, 3 * i - 2, 3 * i) for i in range(1, 101)]],
                                  "blob_id string, idx int, parent int, size int, depth int, first_line int, last_line int")
    ranges = spark.createDataFrame([("f", 7 * a + n, a, a + n - 1) for a in range(1, 300, 5) for n in (1, 3, 6)], "blob_id string, range_id int, first int, last int")
    got = {tuple(r) for r in N.nodes_on_lines(nodes, ranges).collect()}
    want = set()
    for _, r, first, last in ranges.collect():
        inside = [i for i in range(1, 101) if first <= 3 * i - 2 and 3 * i <= last]
        want |= {("f", r, i) for i in inside} or {("f", r, next((i for i in range(1, 101) if 3 * i - 2 <= first and last <= 3 * i), 0)) } if last <= 300 else {("f", r, i) for i in inside}
    assert got == want


def test_matching_shuffles_nodes_once(spark):
    a = N.subtree_hash(S.markup_nodes(spark.createDataFrame([("p", PAGE)], "blob_id string, text string"))).localCheckpoint()
    plan = N.match_nodes(a, a)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    # Versions that share all: every node meets itself, copies (two equal items) through their neighbours where these tell.
    rows = N.match_nodes(a, a).collect()
    assert rows and all(r["idx_a"] == r["idx_b"] for r in rows) and {r["rule"] for r in rows} <= {"unique", "neighbours"}


def test_wrappers_do_not_make_a_unit_local(spark):
    """A declaration below a chain of only children is a unit, whatever their kind; one beside others in a call is not."""
    rows = [("w", 0, -1, 3, 0, "program", "", 0, 9), ("w", 1, 0, 2, 1, "call", "", 0, 9), ("w", 2, 1, 1, 2, "function", "only", 0, 9),
            ("v", 0, -1, 4, 0, "program", "", 0, 9), ("v", 1, 0, 3, 1, "call", "", 0, 9), ("v", 2, 1, 1, 2, "function", "one", 0, 4), ("v", 3, 1, 1, 2, "name", "", 5, 9)]
    rows += [("d", i, i - 1, 30 - i, i, "program" if i == 0 else "function" if i == 29 else "wrap", f"n{i}", 0, 9) for i in range(30)]
    nodes = spark.createDataFrame(rows, "blob_id string, idx int, parent int, size int, depth int, kind string, label string, start int, end int")
    got = {(r["blob_id"], r["label"]) for r in N.whole_units(nodes, nodes.select("blob_id", "idx"), ["function"], []).collect()}
    assert got == {("w", "only"), ("d", "n29")}
    flat = nodes.filter("blob_id <> 'd'")
    plan = N.whole_units(flat, flat.select("blob_id", "idx"), ["function"], [])._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Join") == 1


def test_containers_pair_without_a_join_that_sends_the_map_through_the_driver(spark):
    box = lambda n, *inner: f"<div>{'<p>x</p>' * n}{''.join(inner)}</div>"
    wrapped = lambda page: "<main>" * 9 + page + "</main>" * 9
    pages = [("flat", box(1, "<ul><li>a</li><li>b</li><li>c</li></ul>", "<ol><li>d</li><li>e</li></ol>")), ("deep", wrapped(box(0, "<ul><li>f</li><li>g</li></ul>", "<ol><li>h</li></ol>")))]
    versions = [pages, [(n, p.replace("<li>c</li>", "<li>z</li><li>y</li>").replace("<li>h</li>", "<li>h</li><li>i</li>")) for n, p in pages]]
    a, b = (N.subtree_hash(S.markup_nodes(spark.createDataFrame(v, "blob_id string, text string"))).localCheckpoint() for v in versions)
    pairs = N.match_nodes(a, b).localCheckpoint()
    out = N.match_containers(pairs, a, b)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan  # nodes deeper than a band are looked up by a join of their own, over what is found
    flat = lambda df: df.filter("blob_id = 'flat'")
    plan = N.match_containers(flat(pairs), flat(a), flat(b))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan

    met = {}
    mates = {(r["blob_id"], r["idx_a"], r["idx_b"]) for r in pairs.collect()}
    na, nb = a.collect(), b.collect()
    taken = [{(p, i) for p, i, _ in mates}, {(p, j) for p, _, j in mates}]
    for x in (r for r in na if r["size"] > 1 and (r["blob_id"], r["idx"]) not in taken[0]):
        for y in (r for r in nb if r["size"] > 1 and (r["blob_id"], r["idx"]) not in taken[1] and (r["blob_id"], r["kind"]) == (x["blob_id"], x["kind"])):
            n = sum(p == x["blob_id"] and x["idx"] < i < x["idx"] + x["size"] and y["idx"] < j < y["idx"] + y["size"] for p, i, j in mates)
            if n and (dice := round(2 * n / (x["size"] + y["size"] - 2), 6)) >= 0.5:
                met[x["blob_id"], x["idx"], y["idx"]] = (dice, n, x["kind"])
    best = lambda k, own: max((m for m in met if m[0] == k[0] and m[own] == k[own]), key=lambda m: (met[m][:2], -m[3 - own])) == k
    want = {(*k, met[k][2], met[k][0]) for k in met if best(k, 1) and best(k, 2)}
    assert {tuple(r) for r in out.collect()} == want and {k[0] for k in want} == {"flat", "deep"}
