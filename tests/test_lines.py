"""Alignment, tokens, ranges and hunks on small texts."""

import random
from difflib import SequenceMatcher

import regex
from pyspark.sql import functions as F

from diffloom.functions import text as T
from diffloom.operators import align as A
from diffloom.operators import hunks as H
from diffloom.sources import blobs as B


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], (prev + 1 if x == y else max(row[j], row[j - 1]))
    return row[-1]


def edited(lines, rng):
    out = list(lines)
    for _ in range(rng.randint(1, 5)):
        at = rng.randrange(len(out) + 1)
        kind = rng.random()
        if kind < 0.4:
            out.insert(at, f"new {rng.randint(0, 9)}")
        elif kind < 0.7 and out:
            out.pop(min(at, len(out) - 1))
        elif out:
            moved = out.pop(min(at, len(out) - 1))
            out.insert(rng.randrange(len(out) + 1), moved)
    return out


def aligned(spark, pairs, rounds=5):
    rows = [(i, side, n, line) for i, (a, b) in enumerate(pairs) for side, lines in (("a", a), ("b", b)) for n, line in enumerate(lines, 1)]
    return A.align_lines(spark.createDataFrame(rows, "pair int, side string, line_no int, key string"), ["pair"], rounds)


def test_alignment_is_one_to_one_increasing_and_near_the_longest(spark):
    rng = random.Random(7)
    pairs = []
    for i in range(60):
        a = [f"line {rng.randint(0, 400 if i % 2 else 12)}" for _ in range(rng.randint(1, 40))]
        pairs.append((a, edited(a, rng)))
    found = {}
    for r in A.line_map(aligned(spark, pairs), ["pair"]).collect():
        found.setdefault(r["pair"], []).append((r["line_a"], r["line_b"]))
    kept = longest = 0
    for i, (a, b) in enumerate(pairs):
        at = sorted(found.get(i, []))
        assert all(a[x - 1] == b[y - 1] for x, y in at)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(at, at[1:]))
        best = lcs(a, b)
        assert len(at) <= best
        kept, longest = kept + len(at), longest + best
    assert kept >= 0.95 * longest


def test_both_sides_of_an_alignment_agree(spark):
    rows = aligned(spark, [(list("abcabcx"), list("bcaxabc"))])
    a = {(r["line_no"], r["mate"]) for r in rows.filter("side = 'a' and mate is not null").collect()}
    b = {(r["mate"], r["line_no"]) for r in rows.filter("side = 'b' and mate is not null").collect()}
    assert a == b and a


def test_rows_rebuild_both_texts(spark):
    rng = random.Random(3)
    a = [f"l{rng.randint(0, 9)}" for _ in range(30)]
    b = edited(a, rng)
    rows = H.diff_rows(aligned(spark, [(a, b)]), ["pair"]).orderBy("row_no").collect()
    assert [r["key"] for r in rows if r["op"] != "+"] == a
    assert [r["key"] for r in rows if r["op"] != "-"] == b


def test_hunks_cover_both_sides_and_never_elide_one_line(spark):
    a = [f"l{i}" for i in range(40)]
    b = a[:10] + ["x"] + a[10:17] + ["y"] + a[17:]  # seven lines between: three shown, one hidden, three shown
    frags = H.fragments(H.diff_rows(aligned(spark, [(a, b)]), ["pair"]), ["pair"]).orderBy("frag_no").collect()
    assert sum(f["before_n"] for f in frags) == len(a) and sum(f["after_n"] for f in frags) == len(b)
    assert [f["kind"] for f in frags] == ["elided", "unchanged", "diff", "unchanged", "unchanged", "unchanged", "diff", "unchanged", "elided"]


def test_blank_lines_open_no_context(spark):
    a = [f"l{i}" for i in range(20)]
    frags = H.fragments(H.diff_rows(aligned(spark, [(a, a[:10] + [""] + a[10:])]), ["pair"]), ["pair"]).orderBy("frag_no").collect()
    assert [f["kind"] for f in frags] == ["elided", "diff", "elided"]


PY_TOKEN = regex.compile(
    r"""(?<![\p{L}\p{N}_])(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`)|[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"""
)


def test_tokens_match_the_pattern_and_their_offsets(spark):
    texts = ["a  b", "isnot is not", "don't 'a b' \"x\\\" y\"", "f(`t ${x}`)", "é_1 + ü", "", "   ", " x y"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = B.explode_tokens(df).collect()
    for i, text in enumerate(texts):
        got = sorted((r["tok_no"], r["token"], r["start"]) for r in rows if r["id"] == i)
        assert got == [(n, m.group(), m.start()) for n, m in enumerate(PY_TOKEN.finditer(text), 1)]


def test_line_key_ignores_spacing_only_between_and_inside_tokens(spark):
    df = spark.createDataFrame([("a  b", "a b", "isnot", "is not", "'x y'", "'xy'")], "a string, b string, c string, d string, e string, f string")
    keys = df.select(*[T.line_key(F.col(c)).alias(c) for c in df.columns]).first()
    assert keys["a"] == keys["b"] and keys["c"] != keys["d"] and keys["e"] == keys["f"]


def test_lines_of_texts(spark):
    df = spark.createDataFrame([(0, ""), (1, "a"), (2, "a\n"), (3, "a\n\n"), (4, "\n")], "id int, text string")
    got = {r["id"]: r["n"] for r in df.select("id", F.size(T.line_array(F.col("text"))).alias("n")).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 2, 4: 1}


def test_paint_ranges_joins_across_spaces_and_cuts_at_newlines(spark):
    lines = spark.createDataFrame([(1, 0, "a, b  c"), (1, 8, "  next"), (1, 15, "z")], "doc int, start int, text string")
    ranges = spark.createDataFrame([(1, 0, 1), (1, 3, 4), (1, 4, 5), (1, 6, 12), (1, 15, 16)], "doc int, start int, end int")
    got = sorted((r["start"], r["end"]) for r in H.paint_ranges(ranges, lines, ["doc"]).collect())
    assert got == [(0, 1), (3, 7), (10, 12), (15, 16)]


def test_display_range_is_the_inverse_of_chars_of(spark):
    text = " ab  c\td "
    df = spark.createDataFrame([(text,)], "t string")
    solid = text.replace(" ", "").replace("\t", "")
    for start in range(len(solid)):
        for end in range(start + 1, len(solid) + 1):
            r = df.select(T.display_range(F.col("t"), F.lit(start), F.lit(end)).alias("d")).first()["d"]
            assert text[r["start"]:r["end"]].replace(" ", "").replace("\t", "") == solid[start:end]
        if start == 1:
            break


def test_decimal_values(spark):
    raws = {"1.50": "15e-1", "15e-1": "15e-1", "0.15E+1": "15e-1", "1.6": "16e-1", "0": "0e0", "-0.0": "-0e0", ".5": "5e-1", "100": "1e2", "0x1f": None, "": None, ".": None}
    df = spark.createDataFrame([(r,) for r in raws], "r string")
    assert {r["r"]: r["v"] for r in df.select("r", T.decimal_value(F.col("r")).alias("v")).collect()} == raws


def test_revealing_every_gap_rebuilds_the_after_text(spark):
    a = [f"l{i}" for i in range(60)]
    b = a[:20] + ["x"] + a[20:]
    al = aligned(spark, [(a, b)])
    frags = H.fragments(H.diff_rows(al, ["pair"]), ["pair"])
    none = spark.createDataFrame([], "pair int, frag_no bigint, top int, bottom int")
    after = al.filter("side = 'b'").select("pair", "line_no", F.col("key").alias("text"))
    hidden = {r["line_no"]: r["text"] for r in H.expand_gap(H.gaps(frags, none, ["pair"]), after, ["pair"], "all").collect()}
    shown = {}
    for f in frags.filter("kind <> 'elided'").collect():
        shown.update({n: b[n - 1] for n in range(f["after_start"], f["after_start"] + f["after_n"])})
    assert not set(hidden) & set(shown)
    assert [{**hidden, **shown}[n] for n in range(1, len(b) + 1)] == b
    assert SequenceMatcher(None, a, b).ratio() < 1


def test_alignment_without_its_key_says_the_same_in_one_exchange_of_texts(spark):
    rows = [(p, s, i + 1, t, t) for p, a, b in (("x", "abcad", "bcaed"), ("y", "aa", "aaa"), ("z", "", "ab"), ("w", "abc", "cab"))
            for s, text in (("a", a), ("b", b)) for i, t in enumerate(text)]
    lines = spark.createDataFrame(rows, "path string, side string, line_no int, text string, key string")
    full, bare = A.align_lines(lines, ["path"]), A.align_lines(lines, ["path"], keep_key=False)
    assert full.columns == [*lines.columns, "mate", "gap"] and bare.columns == [c for c in full.columns if c != "key"]
    assert sorted(map(tuple, full.drop("key").collect()), key=str) == sorted(map(tuple, bare.collect()), key=str)
    assert bare.count() == len(rows)
    plan = bare._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # mates reach their lines by order, so no text is shuffled for a join


def test_rescue_asks_no_more_of_a_line_than_its_marks(spark):
    rows = [("f", s, i + 1, t) for s, ts in (("a", ["x = 1", "", "return y", "((", "z"]), ("b", ["return  y", "((", "q", "", "x=1"])) for i, t in enumerate(ts)]
    lines = spark.createDataFrame(rows, "path string, side string, line_no int, text string").withColumn("key", T.compare_key(F.col("text")))
    pairs = lambda df: sorted(tuple(r) for r in H.rescue_lines(H.diff_rows(A.align_lines(df, ["path"], rounds=0), ["path"]), ["path"]).collect())
    marked = H.rescue_marks(lines)
    assert pairs(marked) == pairs(lines) != []
    assert {r["text"] for r in marked.collect()} == {"", "w"} and max(len(r["key"]) for r in marked.collect()) == 24


def test_lines_of_a_pair_are_exchanged_once(spark):
    """A round's windows agree on the file pair, so the plan of a round holds the one exchange that lays rows by it."""
    rows = [("p", s, i, k) for s, ks in (("a", "xayb"), ("b", "xbya")) for i, k in enumerate(ks, 1)]
    df = spark.createDataFrame(rows, "path string, side string, line_no int, key string")
    open_ = df.select("path", "side", "line_no", F.xxhash64("key").alias("_k1"), F.xxhash64(F.lit(1), "key").alias("_k2"), F.lit("0").alias("_gap"))
    plan = A._settled(A._round(open_.repartition("path"), ["path"], False), ["path"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_sides_of_an_alignment_are_deleted_once_its_lines_are_written(spark):
    import __spark_entry__ as entry
    from diffloom import session
    from diffloom.plans import registry

    registry.forget()
    before = set(session._CUTS)
    assert entry.queries()["w1_align_lines"](spark, "/root/testdata/sf0.001").count() > 0
    made = [spark.read.parquet(path) for _, path in session._CUTS if (_, path) not in before]
    texts = [df for df in made if "text" in df.columns]
    assert len(texts) == 1 and "mate" in texts[0].columns  # the lines alone
    registry.forget()
    assert entry.queries()["w13_rescue_lines"](spark, "/root/testdata/sf0.001").count() > 0
    entry.queries()["w1_align_lines"](spark, "/root/testdata/sf0.001")
    sides = next(df for (_, _, name), df in registry._SHARED.items() if name == "side_texts")
    assert sides.count() > 0  # another query's stay
