"""Each operator on a small messy table against a plain version of its contract."""

import hashlib
from collections import Counter

import numpy as np
import xxhash
from llm_tables import documents

from diffloom.llm import decontaminate, line_dedup, packing, phrase_dedup, privacy, simhash, suffix_dedup

UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").encode().translate(UPPER)


def place(row):
    return (row[0] is not None, row[0] or 0, row[1] or "")


def test_line_dedup(spark, messy):
    docs = documents(spark, messy)
    out = line_dedup.dedup_lines(docs, min_docs=10).collect()
    counts = Counter(k for _, k in {(i, key_of(x)) for i, t in messy for x in (t or "").split("\n")} if k)
    want = Counter()
    for i, t in messy:
        lines = (t or "").split("\n")
        kept = [x for x in lines if counts[key_of(x)] < 10]
        want[(i, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    assert Counter((r["doc_id"], r["_lines"], r["_dropped"], r["_kept"]) for r in out) == want
    assert sum(r["_dropped"] for r in out) >= 24
    empty = line_dedup.dedup_lines(docs.limit(0))
    assert empty.count() == 0 and empty.columns[-3:] == ["_lines", "_dropped", "_kept"]


def test_rows_of_one_id_are_one_document(spark):
    """Twelve rows of one id do not make a line frequent; nine of other ids and that one do."""
    rows = [(1, f"shared line\nown {i}\nnoise") for i in range(12)] + [(1, "shared line\nnoise")] * 2 + [(10 + i, f"NOISE \nrow {i}") for i in range(9)]
    out = line_dedup.dedup_lines(documents(spark, rows), min_docs=10).collect()
    assert len(out) == len(rows) and {r["_kept"] for r in out if r["doc_id"] == 1} == {f"shared line\nown {i}" for i in range(12)} | {"shared line"}
    assert all(r["_dropped"] == 1 for r in out)
    assert {r["_kept"] for r in line_dedup.dedup_lines(documents(spark, rows[:-1]), min_docs=10).collect() if r["doc_id"] == 17} == {"NOISE \nrow 7"}


def test_line_runs_are_the_same_for_any_batching(spark, messy):
    docs = documents(spark, messy)
    found = [{tuple(r) for r in line_dedup.frequent_lines(line_dedup.build_runs(docs, min_docs=3, batches=b, fan_in=f), 3).collect()} for b, f in ((1, 2), (5, 2), (4, 3))]
    assert found[0] == found[1] == found[2] and found[0]


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def parts(values, radius):
    root = {v: v for v in values}
    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= radius:
                x, y = a, b
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                root[max(x, y)] = min(x, y)
    for v in values:
        while root[root[v]] != root[v]:
            root[v] = root[root[v]]
    return root


def test_simhash(spark, messy):
    out = simhash.near_duplicates(documents(spark, messy)).collect()
    prints = {row: fingerprint(row[1]) for row in messy}
    root = parts(sorted(set(prints.values())), 2)
    low = {}
    for (i, _), f in prints.items():
        if i is not None:
            low[root[f]] = min(low.get(root[f], i), i)
    want = Counter((i, f, low.get(root[f])) for (i, t) in messy for f in [prints[(i, t)]])
    assert Counter((r["_id"], r["fp"] % (1 << 64), r["component_id"]) for r in out) == want
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_links_of_a_crowded_bucket_are_whole(spark):
    """Slots of 8 fingerprints, words of 64 lanes, chains of single bits: components as by brute force."""
    rng = np.random.default_rng(3)
    values = set()
    for _ in range(12):
        v = int(rng.integers(0, 1 << 63))
        for _ in range(40):
            v ^= 1 << int(rng.integers(20))
            values.add(v)
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    for bucket in (8, 4096):
        edges = simhash.links(frame, 2, bucket)
        roots = {r["v"]: r["root"] for r in simhash.components(edges).collect()}
        want = parts(sorted(values), 2)
        groups = {}
        for v in values:
            groups.setdefault(want[v], set()).add(roots.get(v, v))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_one_document_of_each_group_stays(spark, messy):
    kept = simhash.keep_one(documents(spark, messy).select("doc_id", "text")).collect()
    root = parts(sorted({fingerprint(t) for _, t in messy}), 2)
    stays = Counter(root[fingerprint(r["text"])] for r in kept)
    assert set(stays.values()) == {1} and len(stays) == len(set(root.values()))


def test_decontamination(spark, messy):
    items = [(1, " ".join(messy[7][1].split()[:20])), (2, "lost, AND found!"), (10, messy[-6][1] and " ".join(messy[-4][1].split()[50:90])), (3, None), (4, " ,. "), (None, messy[2][1]), (11, "zz yy"), (1, messy[9][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.decontaminate(documents(spark, messy), bench).collect()
    cut = lambda t: "".join(c if c >= "\x80" or c.isascii() and c.isalnum() else " " for c in (t or "").encode().translate(UPPER).decode()).split(" ")
    words = lambda t: [w for w in cut(t) if w]
    want = Counter()
    for i, t in messy:
        own, hit, ids = words(t), set(), set()
        for item, text in items:
            w = words(text)
            n = min(13, len(w))
            windows = {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if n and item is not None else set()
            for a in range(len(own) - n + 1 if n else 0):
                if tuple(own[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    ids.add(str(item))
        want[(i, len(own), len(hit), ",".join(sorted(ids)), bool(hit) and 20 * len(hit) >= len(own))] += 1
    assert Counter((r["doc_id"], r["_n_words"], r["_n_hit"], ",".join(r["_items"]), r["_contaminated"]) for r in out) == want
    assert sum(r["_contaminated"] for r in out) >= 3
    clean = decontaminate.decontaminate(documents(spark, messy[:5]), bench.limit(0)).collect()
    assert not any(r["_contaminated"] for r in clean) and len(clean) == 5


def repeats(rows, tokens, width):
    first = {}
    order = sorted({r: None for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0, th(r[1])))
    for r in order:
        t = tokens(r[1])
        for s in range(len(t) - width + 1):
            first.setdefault(t[s : s + width], (r, s))
    out = {}
    for r in order:
        t = tokens(r[1])
        gone = [False] * len(t)
        for s in range(len(t) - width + 1):
            if first[t[s : s + width]] != (r, s):
                gone[s : s + width] = [True] * width
        out[r] = gone
    return out


def th(text):
    """Spark's hash of the text: seed 42, signed; of null the seed itself."""
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >= 1 << 63 else h


def test_phrase_dedup(spark, messy):
    out = phrase_dedup.drop_repeats(documents(spark, messy), batch_bytes=2000).collect()
    tokens = lambda t: tuple((t or "").encode().split())
    gone = repeats(messy, tokens, 20)
    want = Counter((r[0], len(g), sum(g), b" ".join(w for w, x in zip(tokens(r[1]), g, strict=True) if not x).decode()) for r in messy for g in [gone[r]])
    assert Counter((r["doc_id"], r["_n_words"], r["_n_removed"], r["_kept"]) for r in out) == want
    assert sum(r["_n_removed"] for r in out) > 700
    assert phrase_dedup.drop_repeats(documents(spark, [])).count() == 0


def test_suffix_dedup(spark, messy):
    out = suffix_dedup.drop_repeats(documents(spark, messy), range_rows=50).collect()
    gone = repeats(messy, lambda t: (t or "").encode(), 100)
    want = Counter()
    for r in messy:
        g = gone[r]
        spans = sum(x and (i == 0 or not g[i - 1]) for i, x in enumerate(g))
        want[(r[0], len(g), sum(g), spans, bytes(b for b, x in zip((r[1] or "").encode(), g, strict=True) if not x))] += 1
    assert Counter((r["doc_id"], r["_n_bytes"], r["_n_removed"], len(r["_spans"]), bytes(r["_kept"])) for r in out) == want
    assert suffix_dedup.drop_repeats(documents(spark, [])).count() == 0


def test_merge_of_runs_is_a_sort_with_prefix_lengths():
    rng = np.random.default_rng(1)
    for runs in (1, 2, 3, 7, 8):
        given = [sorted(bytes(rng.integers(0, 3, rng.integers(1, 40)).astype(np.uint8)) for _ in range(rng.integers(0, 30))) for _ in range(runs)]
        coded = [suffix_dedup.decoded(suffix_dedup.front_coded(k, np.zeros((len(k), 6), np.int64))) for k in given]
        assert [c[0] for c in coded] == given
        got = list(suffix_dedup.merged([(c[0], c[1]) for c in coded]))
        keys = [given[r][i] for r, i, _ in got]
        assert keys == sorted(k for g in given for k in g)
        assert all(shared == suffix_dedup.common(a, b, 0) for a, b, (_, _, shared) in zip(keys, keys[1:], got[1:], strict=False))


def test_privacy_base_and_disguises(spark):
    rows = [
        (1, "a.b@c.de, x@y @z@ q@r.s.t."), (2, "10.0.0.256 1.2.3.4.5.6.7.8 010.1.1.1"), (3, "4111 1111 1111 1111 and 4111111111111112"), (4, "+49 (0)30 1234-567 +1 +123"),
        (5, None), (6, ""), (7, "mail joe [at] ex [dot] com"), (8, "ｊｏｅ＠ｅｘ．ｃｏｍ"), (9, "plus four nine three zero one two three four five"), (10, "meet me at example.com, two or three of us"),
        (11, "9" * 50000), (12, "a" * 50000 + "@"), (None, "joe@ex.com"), (None, "joe@ex.com"),
    ]
    out = {(r["doc_id"], r["text"]): r for r in privacy.find_personal_data(documents(spark, rows)).collect()}
    spans = {i: out[(i, t)]["_spans"] for i, t in rows}
    assert spans[1] == "email:0:8,email:19:24" or spans[1].startswith("email:0:8")
    assert spans[2] == "ip:11:18,ip:19:26,ip:27:36" and spans[3] == "card:0:19" and spans[4] == "phone:0:18"
    assert spans[5] == spans[6] == spans[10] == spans[11] == spans[12] == ""
    assert spans[7] == "email:5:26" and spans[8] == "email:0:10" and spans[9] == "phone:0:49"
    assert all(out[(i, t)]["_base"] == "" for i, t in rows[6:9]) and out[rows[12]]["_n_email"] == 1
    assert privacy.find_personal_data(documents(spark, [])).count() == 0


def test_packing_fills_bins_whole_and_within_capacity(spark, messy):
    out = packing.pack_documents(documents(spark, messy), capacities=(16, 64, 256), shard=20).collect()
    words = Counter()
    bins = {}
    for r in out:
        words[r["doc_id"]] += r["n_tokens"]
        if r["n_tokens"]:
            bins.setdefault((r["shard"], r["bin"]), []).append(r)
    want = Counter()
    for i, t in messy:
        want[i] += len((t or "").encode().split())
    assert words == want
    for rows in bins.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist()
        held = sum(r["n_tokens"] for r in rows)
        assert {r["capacity"] for r in rows} == {min(c for c in (16, 64, 256) if c >= held)}
    assert packing.pack_documents(documents(spark, [])).count() == 0


def test_packing_wastes_little():
    rng = np.random.default_rng(0)
    lengths = np.sort(np.minimum(8192, rng.lognormal(5.5, 1, 4000).astype(np.int64) + 1))[::-1]
    bins, capacity, _ = packing.pack(lengths, packing.CAPACITIES, packing.OVERHEAD)
    opened = {b: c for b, c in zip(bins.tolist(), capacity.tolist(), strict=True)}
    assert lengths.sum() / sum(opened.values()) > 0.97
    assert hashlib.sha256(bins.tobytes()).digest() == hashlib.sha256(packing.pack(lengths, packing.CAPACITIES, packing.OVERHEAD)[0].tobytes()).digest()
