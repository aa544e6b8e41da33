"""Laws of the merge, truth tables of the approval, and moves that must not be claimed."""

import random

from pyspark.sql import functions as F

from diffloom.functions import keys as K
from diffloom.operators import history as Hi
from diffloom.operators import interdiff as I
from diffloom.operators import moves as M
from diffloom.operators import review as R
from diffloom.sources import forge as Fo
from diffloom.sources import patches as P


def state(spark, rows):
    df = spark.createDataFrame(rows, "key string, viewed boolean, wall bigint, logical int, device string")
    return {tuple(r) for r in R.lww_state(df, "viewed").collect()}


def test_merge_is_commutative_associative_and_idempotent(spark):
    rng = random.Random(5)
    log = [(f"k{rng.randint(0, 5)}", rng.random() < 0.5, rng.randint(0, 5), rng.randint(0, 2), f"d{rng.randint(0, 2)}") for _ in range(80)]
    whole = state(spark, log)
    shuffled = list(log)
    rng.shuffle(shuffled)
    assert state(spark, shuffled) == whole and state(spark, log + log) == whole
    halves = [tuple((k, v, w, lo, d) for k, v, w, lo, d in state(spark, part)) for part in (log[:40], log[40:])]
    assert state(spark, list(halves[0]) + list(halves[1])) == whole


OUTLINE = [  # diffset, path, frag, side, node, parent, key, atom
    ("s", "f", 0, "after", 0, -1, "root", None), ("s", "f", 0, "after", 1, 0, "n1", "a1"), ("s", "f", 0, "after", 2, 0, "n2", "a2"),
]
ROW = ("s", "f", 0, "after", 3, 0, "n3", "row:1")


CASES = [
    (OUTLINE, {}, {}, ("pending", None, 0, 2)),
    (OUTLINE, {"root": 2}, {}, ("approved", 2, 2, 2)),
    (OUTLINE, {"root": 1}, {}, ("pending", 1, 2, 2)),
    (OUTLINE, {"n1": 2}, {}, ("pending", 2, 1, 2)),
    (OUTLINE, {"n1": 2}, {"a2"}, ("pending", 1, 2, 2)),
    (OUTLINE, {"n1": 2, "n2": 2}, {"a2"}, ("approved", 2, 2, 2)),
    (OUTLINE, {"root": 2, "n2": -2}, {}, ("blocked", -2, 2, 2)),
    (OUTLINE, {"elsewhere": -2, "root": 2}, {}, ("approved", 2, 2, 2)),
    (OUTLINE, {}, {"a1", "a2"}, ("pending", 1, 2, 2)),
    ([*OUTLINE, ROW], {"n1": 2, "n2": 2}, {"row:1"}, ("approved", 2, 3, 3)),
]


def test_approval_truth_table(spark):
    """Every case is a change set of its own, its keys and atoms prefixed apart (row atoms keep their mark)."""
    outline, scores, viewed = [], [], []
    name = lambda n, x: x and (f"row:{n}:{x[4:]}" if x.startswith("row:") else f"{n}:{x}")
    for n, (nodes, scored, seen, _want) in enumerate(CASES):
        outline += [(f"set{n}", *r[1:6], name(n, r[6]), name(n, r[7])) for r in nodes]
        scores += [(name(n, k), v) for k, v in scored.items()]
        viewed += [(name(n, a), True) for a in seen]
    o = spark.createDataFrame(outline, "diffset_id string, path string, frag_no int, side string, node_no int, parent int, key string, atom string")
    s = spark.createDataFrame(scores, "key string, score int")
    got = R.approval(o, s, spark.createDataFrame(viewed, "atom string, viewed boolean")).collect()
    assert {r["diffset_id"]: (r["state"], r["heaviest"], r["read"], r["edits"]) for r in got} == {f"set{n}": c[3] for n, c in enumerate(CASES)}


def test_coverage_of_deep_and_broken_outlines(spark):
    """A chain of 500 nodes under a score, a parent that comes after its node, and one that is not there."""
    deep = [("deep", "f", 0, "after", i, i - 1, f"k{i}", f"e{i}" if i in (3, 499) else None) for i in range(500)]
    broken = [("odd", "g", 0, "after", 0, 1, "u", "late"), ("odd", "g", 0, "after", 1, -1, "v", None), ("odd", "g", 0, "after", 2, 9, "w", "lost"), ("odd", "g", 0, "after", 3, 1, "x", "fine")]
    o = spark.createDataFrame(deep + broken, "diffset_id string, path string, frag_no int, side string, node_no int, parent int, key string, atom string")
    s = o.filter("key in ('k4', 'v')").select("diffset_id", "path", "frag_no", "side", "node_no")
    assert {r["atom"] for r in R.covered_atoms(o, s).collect()} == {"e499", "fine"}
    assert R.covered_atoms(o, s.limit(0)).count() == 0


def blocks(spark, rows):
    return spark.createDataFrame(rows, "diffset_id string, path string, hash string, open boolean")


def test_unique_moves_drop_two_pastes_and_copies_that_stayed(spark):
    before = blocks(spark, [("s", "a", "h1", True), ("s", "a", "h2", True), ("s", "a", "h3", True), ("s", "a", "h4", True), ("s", "c", "h4", False)])
    after = blocks(spark, [("s", "b", "h1", True), ("s", "b", "h2", True), ("s", "d", "h2", True), ("s", "b", "h3", False), ("s", "b", "h4", True)])
    assert [r["hash"] for r in M.unique_moves(before, after).collect()] == ["h1"]


def test_claims_move_past_anchors_or_into_another_declaration(spark):
    claims = spark.createDataFrame(
        [("stays", 5, 7, 5, 7), ("passes", 1, 2, 40, 41), ("enters", 8, 9, 8, 9), ("outside", 60, 61, 60, 61)],
        "claim_id string, start_a int, end_a int, start_b int, end_b int",
    ).selectExpr("*", "'s' diffset_id", "'f' path", "'v' blob_id")
    anchors = spark.createDataFrame([("s", "f", 20, 21, 20, 21)], "diffset_id string, path string, start_a int, end_a int, start_b int, end_b int")
    nodes = "blob_id string, idx int, kind string, label string, first_line int, last_line int"
    before = spark.createDataFrame([("v", 0, "file", "", 1, 99), ("v", 1, "class", "A", 1, 50), ("v", 2, "def", "f", 4, 9)], nodes)
    after = spark.createDataFrame([("v", 0, "file", "", 1, 99), ("v", 1, "class", "A", 1, 50), ("v", 2, "def", "f", 4, 7), ("v", 3, "def", "g", 8, 9)], nodes)

    def chains(half, rows):
        halves = claims.select("blob_id", "claim_id", F.col(f"start_{half}").alias("first"), (F.col(f"end_{half}") - 1).alias("last"))
        return M.claim_chains(halves, rows, ["class", "def"], width=8)

    ids = lambda df: {r["claim_id"] for r in df.collect()}
    a, b = chains("a", before), chains("b", after)
    assert ids(M.moved(claims, anchors)) == {"passes"}
    assert ids(M.moved(claims, anchors, a, b)) == {"passes", "enters"}
    held = {r["claim_id"]: r["chain"] for r in a.collect()}
    assert held["outside"] == "" and held["stays"] == held["enters"] != held["passes"]
    assert ids(M.moved(claims, anchors.limit(0), a, b)) == {"enters"}
    assert M.claim_chains(claims.selectExpr("blob_id", "claim_id", "start_a first", "end_a last").limit(0), before, ["class"]).count() == 0


def test_rivals_by_brute_force(spark):
    rng = random.Random(11)
    bags = {(side, i): [f"w{int(rng.random() ** 2 * 12)}" for _ in range(rng.randint(4, 9))] for side in "ab" for i in range(25)}
    bags["b", 3] = list(bags["b", 4])  # a copy
    rows = [("s", "k", side, f"{side}{i}", w, ws.count(w)) for (side, i), ws in bags.items() for w in set(ws)]
    df = spark.createDataFrame(rows, "diffset_id string, kind string, side string, owner string, atom string, n bigint")
    claims = spark.createDataFrame([(f"c{i}", "s", "k", f"a{i}", f"b{i}") for i in range(25)], "claim_id string, diffset_id string, kind string, own string, partner string")
    shared = lambda x, y: sum(min(x.count(w), y.count(w)) for w in set(x))
    want = set()
    for i in range(25):
        own = bags["a", i]
        if not any(j != i and 2 * shared(own, o) >= len(own) and 2 * shared(own, o) >= len(o) for j, o in ((j, bags["b", j]) for j in range(25))):
            want.add(f"c{i}")
    assert {r["claim_id"] for r in M.without_rivals(claims, df).collect()} == want
    assert want and len(want) < 25


def test_sets_of_words_give_the_same_rivals_and_overlaps_as_bags(spark):
    rng = random.Random(5)
    words = {(side, i): [f"w{int(rng.random() ** 2 * 40)}" for _ in range(rng.choice([4, 9, 60, 300]))] for side in "ab" for i in range(30)}
    words["b", 3], words["b", 7] = list(words["b", 4]), list(words["a", 9])  # copies on one side and on both
    df = spark.createDataFrame([("s", "k", side, f"{side}{i}", ws) for (side, i), ws in words.items()], "diffset_id string, kind string, side string, owner string, words array<string>")
    sets = M.word_sets(df, ["diffset_id", "kind", "side", "owner"])
    assert {r["owner"]: len(set(r["elements"])) for r in sets.collect()} == {f"{side}{i}": len(ws) for (side, i), ws in words.items()}
    shared = lambda x, y: sum(min(x.count(w), y.count(w)) for w in set(x))
    claims = spark.createDataFrame([(f"c{i}", "s", "k", f"a{i}", f"b{i}") for i in range(30)], "claim_id string, diffset_id string, kind string, own string, partner string")
    want = {f"c{i}" for i in range(30) if not any(
        j != i and 2 * shared(words["a", i], words["b", j]) >= max(len(words["a", i]), len(words["b", j])) for j in range(30))}
    assert {r["claim_id"] for r in M.undisputed(claims, sets).collect()} == want and 0 < len(want) < 30
    pairs = claims.selectExpr("diffset_id", "own owner_a", "partner owner_b")
    assert {r["owner_a"]: r["shared"] for r in M.set_overlap(pairs, sets).collect()} == {f"a{i}": shared(words["a", i], words["b", i]) for i in range(30)}


def test_touches_by_brute_force(spark):
    rng = random.Random(2)
    frags = [(f, i, s, s + rng.randint(0, 3)) for f in range(20) for i, s in enumerate(rng.sample(range(30), 4))]
    regions = [(f, s, s + rng.randint(0, 3)) for f in range(20) for s in rng.sample(range(30), 3)]
    hit = lambda p, q: (p[0] <= q[1] and q[0] <= p[1]) if p[0] == p[1] or q[0] == q[1] else (p[0] < q[1] and q[0] < p[1])
    want = {(f, i) for f, i, s, e in frags if any(g == f and hit((s, e), (a, b)) for g, a, b in regions)}
    got = I.touches(spark.createDataFrame(frags, "f int, frag_no bigint, start int, end int"), spark.createDataFrame(regions, "f int, start int, end int"), ["f"])
    assert {(r["f"], r["frag_no"]) for r in got.collect()} == want


def test_a_moved_base_leaves_an_unlisted_file_unknown(spark):
    columns = "diffset_id string, path string, old_path string, before string, after string"
    one = spark.createDataFrame([("s", "x", None, "b1", "a1"), ("t", "x", None, "b1", "a1")], columns)
    two = spark.createDataFrame([("s", "x", None, "b2", "a2"), ("s", "y", None, "q", "r"), ("t", "x", None, "b1", "a2"), ("t", "y", None, "q", "r")], columns)
    threads = spark.createDataFrame([("s", "after", "y"), ("t", "after", "y"), ("t", "before", "x")], "diffset_id string, side string, path string")
    got = {(r["diffset_id"], r["side"], r["path"]): r["blob"] for r in I.blob_in(threads, one, two).collect()}
    assert got == {("s", "after", "y"): None, ("t", "after", "y"): "q", ("t", "before", "x"): "b1"}


def test_ported_and_lost_threads_add_up(spark):
    threads = spark.createDataFrame([("same", "a", "a", [1]), ("kept", "a", "b", [1, 2]), ("lost", "a", "b", [1, 9])], "thread_id string, old_blob string, new_blob string, nodes array<int>")
    node_map = spark.createDataFrame([("a", "b", 1, 5), ("a", "b", 2, 6)], "old_blob string, new_blob string, node_a int, node_b int")
    ported, lost = I.port_threads(threads, node_map)
    assert {r["thread_id"]: r["nodes"] for r in ported.collect()} == {"same": [1], "kept": [5, 6]}
    assert [r["thread_id"] for r in lost.collect()] == ["lost"]


def test_merge_base_of_criss_cross_and_long_histories(spark):
    rows = [("r", [], 0), ("x", ["r"], 1), ("y", ["r"], 2), ("m1", ["x", "y"], 3), ("m2", ["y", "x"], 4), ("lone", [], 9)]
    rows += [(f"c{i}", [f"c{i - 1}"] if i else ["m1"], 10 + i) for i in range(40)]
    commits = spark.createDataFrame(rows, "sha string, parents array<string>, time bigint")
    pairs = [("criss", "m1", "m2"), ("self", "x", "x"), ("far", "c39", "y"), ("none", "x", "lone"), ("line", "c39", "c3")]
    got = {r["pair_id"]: r["merge_base"] for r in Hi.merge_base(commits, spark.createDataFrame(pairs, "pair_id string, a string, b string")).collect()}
    assert got == {"criss": "y", "self": "x", "far": "y", "none": None, "line": "c3"}


PATCH = """diff --git a/one.txt b/one.txt
index 1111111..2222222 100644
--- a/one.txt
+++ b/one.txt
@@ -1,3 +1,3 @@ ctx
 a
--- b
+++ c
 d
diff --git a/old name b/new name
similarity index 100%
rename from old name
rename to new name
diff --git a/sub b/sub
new file mode 160000
index 0000000..3333333
--- /dev/null
+++ b/sub
@@ -0,0 +1 @@
+Subproject
\\ No newline at end of file
"""


def test_patch_lines_that_look_like_headers(spark):
    rows = P.patch_rows(spark.createDataFrame([(1, PATCH)], "patch_id int, text string"))
    files = {r["file_no"]: r for r in P.patch_files(rows).collect()}
    assert [(f["old_path"], f["new_path"], f["status"]) for _, f in sorted(files.items())] == [
        ("one.txt", "one.txt", "modified"), ("old name", "new name", "renamed"), ("sub", "sub", "added")]
    assert files[3]["mode"] == "160000" and files[3]["old_blob"] is None
    lines = [(r["op"], r["text"], r["old_line"], r["new_line"]) for r in P.patch_lines(rows).filter("file_no = 1").orderBy("line_no").collect()]
    assert lines == [(" ", "a", 1, 1), ("-", "-- b", 2, None), ("+", "++ c", None, 2), (" ", "d", 3, 3)]


def test_lowered_comment_round_trip_and_forged_keys(spark):
    df = spark.createDataFrame(
        [("body <!-- x -->", "after", "a>b", [[0, 1]], (1, 4), None, "0" * 40, 2), ("plain", "before", "p", [[], [2]], None, "1" * 40, None, None)],
        "body string, side string, path string, nodes array<array<int>>, chars struct<start:int,end:int>, before string, after string, score int")
    rows = Fo.read_lowered(Fo.lower_comments(df)).collect()
    assert rows[0]["shown"] == "+2: good to merge\n\nbody <!-- x -->" and rows[0]["key"]["anchor"]["path"] == "a>b" and rows[0]["key"]["score"] == 2
    assert rows[1]["shown"] == "plain" and rows[1]["key"]["anchor"]["nodes"] == [[], [2]] and rows[1]["key"]["before"] == "1" * 40
    bad = ['{"anchor":1}', "[]", "nope", '{"anchor":{"side":"after","path":"p","nodes":[[0]]},"before":null,"after":null}',
           '{"anchor":{"side":"after","path":"p","nodes":[[0]]},"after":"%s"}' % ("0" * 40), '{"anchor":{"side":"after","path":"p","nodes":[[0]],"chars":null},"before":null,"after":"%s"}' % ("0" * 40)]
    got = spark.createDataFrame([(b,) for b in bad], "j string").select(K.valid_key(F.col("j")).isNull().alias("n")).collect()
    assert all(r["n"] for r in got)


def test_hlc_never_runs_behind(spark):
    w = spark.createDataFrame([("d", i, wall) for i, wall in enumerate([5, 3, 3, 7, 7, 6])], "device string, seq int, wall bigint")
    got = [(r["hlc_wall"], r["hlc_logical"]) for r in R.assign_hlc(w).orderBy("seq").collect()]
    assert got == [(5, 0), (5, 1), (5, 2), (7, 0), (7, 1), (7, 2)]


def test_ported_threads_align_no_pairs_but_those_between_the_iterations(spark):
    import __spark_entry__ as entry
    from diffloom.plans import registry

    registry.forget()
    lost = entry.queries()["j23_lost_threads"](spark, "/root/testdata/sf0.001")
    names = {name for _, _, name in registry._SHARED}
    assert lost.count() > 0 and "between_aligned" in names and "three_aligned" not in names


def test_extract_candidates_judge_pairs_by_word_hashes_in_the_row(spark):
    added = spark.createDataFrame([("d", "b1", "total", ["total", "price", "tax", "tax"]), ("d", "b2", "twice", ["twice", "x"]), ("d", "b3", "twice", ["twice", "y"])],
                                  "diffset_id string, block string, name string, words array<string>")
    removed = spark.createDataFrame([("d", "s1", "r1", ["price", "price", "other"]), ("d", "s1", "r2", ["a", "b", "c", "d"]), ("d", "s1", "r3", []), ("d", "s2", "r4", ["price", "tax"])],
                                    "diffset_id string, site string, removed string, words array<string>")
    calls = spark.createDataFrame([("d", "s1", "total", "c1"), ("d", "s1", "total", "c2"), ("d", "s2", "twice", "c3"), ("d", "s0", "total", "b1")],
                                  "diffset_id string, site string, name string, block string")
    got = M.extract_candidates(added, removed, calls)
    assert [tuple(r) for r in got.collect()] == [("d", "b1", "s1", 2, 3, 1)]
    assert "explode(words" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_touches_align_no_file_that_is_equal_in_both_iterations(spark):
    import __spark_entry__ as entry
    from diffloom.plans import registry

    registry.forget()
    folder = "/root/testdata/sf0.001"
    assert entry.queries()["j10_touches"](spark, folder).count() > 0
    shared = {name: df for (_, _, name), df in registry._SHARED.items()}
    key = ["diffset_id", "path"]
    assert shared["three_texts"].join(shared["iteration_pairs"], key, "left_anti").count() == 0
    lengths = shared["three_texts"].groupBy("kind").count().count()
    assert lengths == 3


def test_moved_tells_how_in_one_pass_over_its_claims(spark):
    claims = spark.createDataFrame([("both", 1, 2, 40, 41), ("passes", 3, 4, 42, 43), ("enters", 8, 9, 8, 9), ("stays", 5, 6, 5, 6)],
                                   "claim_id string, start_a int, end_a int, start_b int, end_b int").selectExpr("*", "'s' diffset_id", "'f' path")
    anchors = spark.createDataFrame([("s", "f", 20, 21, 20, 21)], "diffset_id string, path string, start_a int, end_a int, start_b int, end_b int")
    chain = lambda changed: spark.createDataFrame([(c, "y" if c in changed else "x") for c in ("both", "passes", "enters", "stays")], "claim_id string, chain string")
    got = {r["claim_id"]: (r["passed"], r["rechained"]) for r in M.moved_how(claims, anchors, chain([]), chain(["both", "enters"])).collect()}
    assert got == {"both": (True, True), "passes": (True, False), "enters": (False, True)}


def test_index_judges_like_the_outline(spark):
    """One index, many states of the marks: deep ways, broken parents, and several keys and atoms on a way."""
    deep = [("deep", "f", 0, "after", i, i - 1, f"k{i}", f"e{i}" if i in (3, 20, 40) else None) for i in range(41)]
    broken = [("odd", "g", 0, "after", 0, 1, "u", "late"), ("odd", "g", 0, "after", 1, -1, "v", None), ("odd", "g", 0, "after", 2, 9, "w", "lost"), ("odd", "g", 0, "after", 3, 1, "x", "fine")]
    o = spark.createDataFrame(deep + broken, "diffset_id string, path string, frag_no int, side string, node_no int, parent int, key string, atom string").cache()
    index, sets = R.ApprovalIndex(o), o.select("diffset_id").distinct()
    for scores, viewed in (({}, {}), ({"k4": 2, "v": 2}, {}), ({"k40": 2, "w": -2}, {"e3": True, "late": True}), ({"k0": 2, "k30": 1, "u": None}, {"fine": False})):
        s = spark.createDataFrame(list(scores.items()), "key string, score int")
        v = spark.createDataFrame(list(viewed.items()), "atom string, viewed boolean")
        got, want = ({tuple(r) for r in df.collect()} for df in (index.approval(sets, s, v), R.approval(o, s, v)))
        assert got == want and len(got) == 2
    assert {tuple(r) for r in index.holders.filter("diffset_id = 'odd'").select("atom", "key").collect()} == {("late", "u"), ("lost", "w"), ("fine", "x"), ("fine", "v")}


def test_next_stop_is_the_queues_first_past_the_place(spark):
    rows = [("d1", "f", 0, "after", 1, "x"), ("d1", "f", 2, "after", 1, "x"), ("d1", "f", 2, "before", 3, "y"), ("d1", "g", 0, "after", 2, "z"), ("d2", "a", 0, "after", 1, "x"), ("d0", "z", 9, "after", 1, "q"), ("d1", "f", 2, "after", 0, None)]
    o = spark.createDataFrame(rows, "diffset_id string, path string, frag_no int, side string, node_no int, atom string")
    reviewers = spark.createDataFrame([(r, s) for r in (1, 2, 3, 4) for s in ("d0", "d1", "d2")], "reviewer int, diffset_id string")
    seen = spark.createDataFrame([(2, "y"), (3, "x"), (3, "y"), (3, "z"), (4, "y"), (4, "x")], "reviewer int, atom string")
    at = spark.createDataFrame([(r, "d1", "f", 0) for r in (1, 2, 3, 4)], "reviewer int, diffset_id string, path string, frag_no int")
    got = {tuple(r) for r in R.next_stop(o, reviewers, seen, at).collect()}
    queue = [r for r in sorted(R.review_queue(o, reviewers, seen).collect(), key=lambda r: r["place"]) if (r["diffset_id"], r["path"], r["frag_no"]) > ("d1", "f", 0)]
    first = {}
    for r in queue:
        first.setdefault(r["reviewer"], (r["reviewer"], r["diffset_id"], r["path"], r["frag_no"], r["atom"]))
    assert got == set(first.values()) and len(got) == 3
    assert (1, "d1", "f", 2, "y") in got and (2, "d1", "f", 2, "x") in got and (4, "d1", "g", 0, "z") in got


def test_bags_are_counted_in_their_row_and_align_nothing(spark):
    import __spark_entry__ as entry
    from diffloom.plans import registry

    df = spark.createDataFrame([("b1", ["x", "y", "x", "x"]), ("b2", ["z"]), ("b3", []), ("b4", ["x"] * 300 + ["é", "E", "e"])], "owner string, words array<string>")
    got = M.word_bags(df, ["owner"])
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = M.content_bag(df.select("owner", F.explode("words").alias("atom")), ["owner"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.schema["n"].dataType == want.schema["n"].dataType

    registry.forget()
    assert entry.queries()["a5_content_bags"](spark, "/root/testdata/sf0.001").count() > 0
    assert not {"aligned", "bags", "side_texts"} & {name for _, _, name in registry._SHARED}


def test_pairs_of_one_name_bring_their_words(spark):
    rows = [("d", "f", "b1", True, "line", "n", 4, ["n", "x", "x", "y"]), ("d", "f", "b2", True, "line", "m", 4, ["m", "p", "q", "r"]), ("d", "f", "b3", False, "line", "n", 4, ["n", "a", "b", "c"])]
    after = [("d", "g", "c1", True, "line", "n", 5, ["n", "x", "y", "y", "z"]), ("d", "g", "c2", True, "line", "m", 4, ["m", "p", "q", "r"]), ("d", "g", "c3", True, "line", "m", 4, ["m", "p", "q", "s"])]
    schema = "diffset_id string, path string, block_id string, open boolean, kind string, name string, size int, words array<string>"
    got = M.same_name_overlap(spark.createDataFrame(rows, schema), spark.createDataFrame(after, schema)).collect()
    assert [(r["block_id_a"], r["block_id_b"], r["shared"], len(r["elements_a"])) for r in got] == [("b1", "c1", 3, 4)]
