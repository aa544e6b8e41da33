"""Search against brute force; language and toxicity by held-out accuracy."""

import random
from collections import Counter

import numpy as np
from llm_tables import documents
from pyspark.sql import functions as F

from diffloom.llm import language, queries, topk, toxicity

SF = "/root/testdata/sf0.01"


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(400)]
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (404, []), (None, [1.0] * 6), (405, [1.0, 2.0]), (420, [1.0, -2.0]), (7, rows[7][1]), (406, rows[40][1]), (407, rows[40][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x"))
    out = topk.top_k(frame, F.col("id") % 20 == 0, k=5, shard=60, block=7).collect()
    good = [(i, tuple(int(np.floor(64 * x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = Counter()
    for q, v in good:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))[:5]
            want.update((q, n, i, -s) for n, (s, i) in enumerate(scored, 1))
    assert Counter(map(tuple, out)) == want
    assert topk.top_k(frame.limit(0), F.col("id") % 20 == 0).count() == 0


def test_search_prunes_and_stays_exact():
    rng = np.random.default_rng(4)
    centres = rng.integers(-300, 300, (30, 8))
    points = (centres[rng.integers(0, 30, 4000)] + rng.integers(-9, 9, (4000, 8))).astype(np.int64)
    tree = topk.build_tree(np.arange(4000), points, leaf=16)
    low, high = tree["low"], tree["high"]
    for (a, b), lo, hi in zip(tree["spans"], low, high, strict=True):
        assert (tree["points"][a:b].min(axis=0) == lo).all() and (tree["points"][a:b].max(axis=0) == hi).all()
    got = topk.search(tree, np.arange(5), points[:5], np.full(5, -(1 << 62)), 10)
    for q in range(5):
        scores = points @ points[q]
        order = [i for i in np.lexsort((np.arange(4000), -scores)) if i != q][:10]
        assert [(i, s) for x, i, s in got if x == q] == [(i, scores[i]) for i in order]


def test_language_of_held_out_documents(spark):
    out = queries.op2_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in out]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def mixed(rng, pools, n):
    return " ".join(rng.choice(pools) for _ in range(n))


def test_language_follows_code_switching_and_defined_cases(spark):
    rng = random.Random(1)
    pools = {"aa": ["kato", "nimo", "resu", "talka", "minoka"], "bb": ["schwert", "brunz", "eichl", "krampf", "zwirn"]}
    docs = [(i, mixed(rng, pools[x], 60), x) for i, x in enumerate(["aa", "bb"] * 20)]
    frame = documents(spark, [*docs, (90, None, "aa"), (91, "", None), (92, "12 !! 34", "bb"), (93, "——", None), (94, mixed(rng, pools["aa"], 30) + " " + mixed(rng, pools["bb"], 90), None)])
    model = language.fit(frame, F.col("doc_id") < 30)
    out = {r["doc_id"]: (r["_lang"], r["_score"]) for r in language.identify(frame, model).collect()}
    assert all(out[i][0] == x for i, _, x in docs)
    assert out[90] == out[91] == out[92] == out[93] == ("und", 0.0)
    assert out[94][0] == "bb" and abs(out[94][1] - 0.75) < 0.1
    assert language.identify(frame.limit(0), model).count() == 0
    assert {r["_lang"] for r in language.identify(frame, language.fit(frame, F.lit(False))).collect()} == {"und"}


def test_every_language_can_be_named(spark):
    """Seventy languages; the rarest have two documents to learn from, and the most frequent are no limit."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    pools = {f"l{i:02}": [word() for _ in range(8)] for i in range(70)}
    rows = [(x, mixed(rng, pools[x], 80)) for i, x in enumerate(pools) for _ in range(2 if i >= 64 else 4)]
    frame = documents(spark, [(i, t, x) for i, (x, t) in enumerate(rows)] + [(1000 + i, mixed(rng, p, 80), None) for i, p in enumerate(pools.values())])
    model = language.fit(frame, F.col("doc_id") < 1000)
    assert model.labels == list(pools)
    out = {r["doc_id"]: r["_lang"] for r in language.identify(frame, model).collect()}
    assert np.mean([out[1000 + i] == x for i, x in enumerate(pools)]) > 0.95
    assert [out[1000 + i] for i in range(64, 70)] == list(pools)[64:]
    # A total below the number of languages shrinks the samples, not the languages.
    assert language.fit(frame, F.col("doc_id") < 1000, sample_docs=20).labels == list(pools)


def test_many_labels_do_not_change_the_probabilities():
    rng = np.random.default_rng(1)
    k = language.WIDE + 8
    model = language.Model([str(i) for i in range(k)], None, None, None, None, None, 2 * rng.normal(size=(k, k)), rng.normal(size=k))
    counts = [65, 0, 130, 30, 128]
    e, doc = 2 * rng.normal(size=(sum(counts), k)), np.repeat(np.arange(5), counts)
    got, a = language.document_mass(model, e, doc, 5), np.exp(model.transitions)
    for d in (0, 2, 3, 4):
        own = np.exp(e[doc == d])
        ahead, back = [np.exp(model.start) * own[0]], [np.ones(k)]
        for x in own[1:]:
            ahead.append((ahead[-1] / ahead[-1].sum()) @ a * x)
        for x in own[:0:-1]:
            back.append(a @ (x * back[-1] / back[-1].sum()))
        p = np.array(ahead) * np.array(back[::-1])
        assert np.allclose(got[d], (p / p.sum(axis=1, keepdims=True)).sum(axis=0))
    assert (got[1] == 0).all()


def test_segments_do_not_change_the_probabilities():
    rng = np.random.default_rng(0)
    k, n = 3, 500
    model = language.Model(["a", "b", "c"], None, None, None, None, None, rng.normal(size=(k, k)), rng.normal(size=k))
    e = rng.normal(size=(n, k)) * 2
    doc = np.repeat(np.arange(3), [310, 0, 190])
    got = language.document_mass(model, e, doc, 3)
    for d in (0, 2):
        own = e[doc == d]
        alpha = np.zeros_like(own)
        a = np.exp(model.transitions)
        now = np.exp(model.start)
        for i in range(len(own)):
            alpha[i] = now * np.exp(own[i])
            alpha[i] /= alpha[i].sum()
            now = alpha[i] @ a
        beta = np.ones_like(own)
        for i in range(len(own) - 2, -1, -1):
            beta[i] = a @ (np.exp(own[i + 1]) * beta[i + 1])
            beta[i] /= beta[i].sum()
        p = alpha * beta
        p /= p.sum(axis=1, keepdims=True)
        assert np.allclose(got[d], p.sum(axis=0))
    assert (got[1] == 0).all()


def test_toxicity(spark):
    rng = random.Random(3)
    common, bad = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(5)], ["vilest", "rotten", "filthy"]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(common) for _ in range(50)]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(50)], words[rng.randrange(50)] = rng.choice(bad), rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    labels += [(3, None), (None, 1), (999, 1)]
    docs = documents(spark, [*rows, (500, None), (501, ""), (None, "rotten vilest words")])
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    index = toxicity.fit(docs, table, F.col("doc_id") % 3 != 1)
    out = {r["doc_id"]: r for r in toxicity.score(docs, index).collect()}
    held = [i for i in range(400) if i % 3 == 1]
    assert np.mean([(out[i]["_score"] >= 0.7) == (i % 4 == 0) for i in held]) > 0.95
    assert out[500]["_score"] == out[501]["_score"] == index.rate and out[None]["_score"] >= 0.7
    nothing = toxicity.score(docs, toxicity.fit(docs, table.limit(0), F.lit(True))).collect()
    assert {r["_score"] for r in nothing} == {0.0}
    assert toxicity.score(docs.limit(0), index).count() == 0


def test_toxicity_of_rare_words(spark):
    """Each toxic word is in at most three examples, none in a clean one; no word tells the label by its count."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    common, bad = [word() for _ in range(60)], [word() for _ in range(60)]
    rows = []
    for i in range(480):
        words = [rng.choice(common) for _ in range(30)]
        if i % 4 == 0:  # words 0 to 59, each in three texts of examples and one held out
            words += [bad[i // 4 % 60], bad[(i // 4 + 7) % 60]]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    held = {i for i in range(480) if (i // 4 // 60 == 1 and i // 4 % 2 == 0)}
    docs, table = documents(spark, rows), spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    index = toxicity.fit(docs, table, ~F.col("doc_id").isin(*held))
    out = {r["doc_id"]: r["_score"] >= 0.7 for r in toxicity.score(docs, index).collect()}
    assert np.mean([out[i] for i in held if i % 4 == 0]) > 0.9
    assert np.mean([out[i] for i in held if i % 4]) < 0.1


def test_an_example_is_one_row_of_term_counts(spark):
    """Sixty rows of one labelled id leave the other examples in; a repeated word is sent once, with its count."""
    docs = documents(spark, [(0, f"vile {chr(97 + i % 26)}{chr(97 + i // 26)} " + "again " * 9) for i in range(60)] + [(i, "kind words") for i in range(1, 5)] + [(1, None)])
    table = spark.createDataFrame([(i, int(i == 0)) for i in range(5)], "doc_id long, toxic int")
    rows, rate = toxicity._sample(docs, table, F.lit(True), 4, "text", "doc_id", "toxic")
    assert rows["_id"].to_pylist() == [0, 1, 2, 3, 4] and rate == 0.2
    assert sorted(rows["_found"][0].as_py()) == [1, 1, 9, 9]  # vile, a name, again and its stem
    assert all(r.as_py() for r in rows["_terms"])
    index = toxicity.fit(docs, table, F.lit(True), per_class=4)
    assert index.ids.tolist() == [0, 1, 2, 3, 4]


def test_block_max_neighbours_are_exact():
    rng = np.random.default_rng(6)
    docs, terms = 300, 40
    cells = rng.random((docs, terms)) < 0.15
    d, t = np.nonzero(cells)
    toxic = rng.integers(0, 2, docs)
    index = toxicity.Index(np.arange(terms).astype(np.uint64), np.ones(terms), np.arange(docs), toxic, *[np.zeros(0)] * 4)
    index.vectors = [(d, t, rng.integers(1, 4, len(d)))]
    cell = index.vectors[0]
    toxicity.weigh(index, cells.sum(axis=0), docs, 0.5, 7)
    dense = np.zeros((docs, terms))
    dense[d, t] = toxicity._vectors(*cell, index.idf, docs)
    for i in range(20):
        own = np.flatnonzero(dense[i])
        best, cosine = toxicity.neighbours(index, own, dense[i][own], 7)
        want = dense @ dense[i]
        order = np.lexsort((np.arange(docs), -want.round(12)))[:7]
        assert np.allclose(cosine, want[order])


def test_languages_without_blanks_differ_after_equal_heads(spark):
    """Sentences without a blank that begin alike: only what stands far inside a run tells the languages apart."""
    rng = random.Random(5)
    head = "".join(chr(0x4E00 + i) for i in range(10))
    text = lambda base: "\n".join(head + "".join(chr(base + rng.randrange(40)) for _ in range(30)) for _ in range(6))
    rows = [(i, text(0x5000 + 0x800 * (i % 2)), "aa" if i % 2 == 0 else "bb") for i in range(160)]
    frame = documents(spark, rows)
    out = {r["doc_id"]: r["_lang"] for r in language.identify(frame, language.fit(frame, F.col("doc_id") < 100)).collect()}
    assert np.mean([out[i] == x for i, _, x in rows[100:]]) > 0.95


def test_long_runs_are_cut_between_characters():
    text = ("ab " + "漢" * 50 + " " + "x" * 24 + " " + "é" * 13 + "z").encode()
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = language._words(data, np.array([0, len(data)]))
    parts = [text[a:b].decode() for a, b in zip(starts, ends, strict=True)]
    assert "".join(parts) == text.decode().replace(" ", "") and parts[0] == "ab" and "x" * 24 in parts
    assert all(len(p.encode()) <= language.WORD_BYTES for p in parts)


def test_labels_are_looked_through_once_not_per_text():
    """Whether both labels have examples is told with the weights; scoring a text reads no list of labels."""
    d, t = np.array([0, 0, 1, 2]), np.array([0, 1, 1, 2])
    for toxic, both in (([0, 1, 0], True), ([1, 1, 1], False)):
        index = toxicity.Index(np.arange(3).astype(np.uint64), np.ones(3), np.arange(3), np.array(toxic, np.int32), *[np.zeros(0)] * 4)
        index.vectors = [(d, t, np.ones(4, np.int64))]
        toxicity.weigh(index, np.array([1, 2, 1]), 3, 0.25, 2)
        assert index.both is both
        best, cosine = toxicity.neighbours(index, np.array([0]), np.ones(1), 2)
        assert (toxicity.score_of(index, best, cosine) == 0.25) is not both
        assert toxicity.score_of(index, best[:0], cosine[:0]) == 0.25
