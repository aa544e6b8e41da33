"""The Jaccard join, periodic runs and token alignment, held against plain versions of their contracts."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_tables import documents
from test_text_operators import UPPER

from diffloom.llm import jaccard_join, periodic, queries, tokenizers_align
from diffloom.llm.common import mix

SF = "/root/testdata/sf0.001"


def shingles(text, k=4):
    w = (text or "").encode().translate(UPPER).split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def plain_components(rows, percent=85):
    """(size of the set, component) per row, by comparing all pairs of distinct sets that share a token."""
    own = [shingles(t) for _, t in rows]
    sets = sorted({s for s in own if s}, key=sorted)
    by_token, root = defaultdict(list), list(range(len(sets)))

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, s in enumerate(sets):
        for j in {j for t in s for j in by_token[t]}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                root[top(i)] = top(j)
        for t in s:
            by_token[t].append(i)
    place, low = {s: i for i, s in enumerate(sets)}, {}
    for (i, _), s in zip(rows, own, strict=True):
        if s and i is not None:
            low[top(place[s])] = min(low.get(top(place[s]), i), i)
    return [(len(s), low.get(top(place[s])) if s else i) for (i, _), s in zip(rows, own, strict=True)]


def near_copies(rng, n):
    """Chains of edits, a crowd of copies of one text with other edits each, and a passage that others share."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    crowd, passage, texts = [word() for _ in range(120)], [word() for _ in range(60)], []
    for i in range(n):
        own = list(crowd) if i % 2 else [word() for _ in range(40)] + passage
        for _ in range(rng.randrange(6)):
            own[rng.randrange(len(own))] = word()
        texts.append(" ".join(own[: rng.randint(len(own) - 8, len(own))]))
    chain = [word() for _ in range(100)]
    for _ in range(12):
        chain[rng.randrange(100)] = word()
        texts.append(" ".join(chain).upper())
    return texts


@pytest.mark.parametrize("bucket", [4096, 16])
def test_jaccard_components(spark, messy, bucket):
    rows = [*messy, *[(1000 + i, t) for i, t in enumerate(near_copies(random.Random(bucket), 120))]]
    out = jaccard_join.join(documents(spark, rows), bucket=bucket, parts=5).collect()
    want = Counter((i, n, c) for (i, _), (n, c) in zip(rows, plain_components(rows), strict=True))
    assert Counter((r["_id"], r["n"], r["component_id"]) for r in out) == want
    assert max(Counter(c for _, c in plain_components(rows)).values()) > 10
    assert jaccard_join.join(documents(spark, []), parts=2).count() == 0


def test_links_are_true_and_connect(spark):
    """Every link reported reaches the threshold, and lone tokens and common ones change nothing."""
    rows = [(i, t) for i, t in enumerate(near_copies(random.Random(7), 80))]
    named, links = jaccard_join.linked(documents(spark, rows), parts=3)
    text_of = {r["name"]: rows[r["_id"]][1] for r in named.collect()}
    for u, v in links.collect():
        a, b = shingles(text_of[u]), shingles(text_of[v])
        assert 100 * len(a & b) >= 85 * len(a | b)


def test_sets_without_partner_send_a_sample_only(spark, monkeypatch):
    """All tokens are exchanged of sets that may have a partner, the rest answers for a sample; slices of a few texts
    and a passage that a third share tell common tokens between slices."""
    rng, given, pairs = random.Random(11), [], []
    passage = " ".join(f"common{i}" for i in range(12))
    lone = [" ".join([passage] * (i % 3 == 0) + [f"w{rng.randrange(10**9)}" for _ in range(90)]) for i in range(200)]
    rows = list(enumerate([*lone, *near_copies(random.Random(12), 60), *lone[:3], None, "", "a b", "a b c d e"]))
    before, crossing = jaccard_join._tokens_by_range, jaccard_join._crossing
    monkeypatch.setattr(jaccard_join, "PACK_BYTES", 1 << 14)
    monkeypatch.setattr(jaccard_join, "_tokens_by_range", lambda texts, *rest: given.append(texts.count()) or before(texts, *rest))
    monkeypatch.setattr(jaccard_join, "_crossing", lambda *args: pairs.append(crossing(*args)) or pairs[-1])
    out = jaccard_join.join(documents(spark, rows), parts=9).collect()
    want = Counter((i, n, c) for (i, _), (n, c) in zip(rows, plain_components(rows), strict=True))
    assert Counter((r["_id"], r["n"], r["component_id"]) for r in out) == want
    assert given[0] < 100


def test_a_crowd_is_connected_by_hubs(spark, monkeypatch):
    """Members of a crowd share rare tokens with texts outside of it; they still find its hub, not each other."""
    rng, found = random.Random(13), []
    base = [f"b{i}" for i in range(400)]
    rare = [[f"r{k}_{i}" for i in range(6)] for k in range(150)]
    rows = []
    for k in range(150):  # the crowd: the text with a short run replaced by one of two members' own
        at = rng.randrange(10, 380)
        rows.append((k, " ".join(base[:at] + rare[k // 2] + base[at + 6 :])))
    before = jaccard_join._crossing
    monkeypatch.setattr(jaccard_join, "_crossing", lambda *args: found.append(before(*args).count()) or before(*args))
    out = jaccard_join.join(documents(spark, rows), parts=4).collect()
    assert {r["component_id"] for r in out} == {0}
    assert found[0] < 150


def plain_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_digest(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None,) * 3
    sha = lambda b: hashlib.sha256(b).hexdigest()
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(listed), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_query_against_its_contract(spark, messy, tmp_path):
    rng = random.Random(2)
    rows = list(messy)
    for i in range(300, 420):
        unit = [rng.choice(["ab", "c", "D", "é"]) for _ in range(rng.randint(1, 30))]
        rows.append((i, rng.choice(["\t", " ", "\n\n"]).join((unit * 9)[: rng.randint(1, 9 * len(unit))] + ["x"] * rng.choice([0, 1, 12, 13]))))
    rows.append(rows[-1])
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, out)) == Counter(plain_digest(i, t) for i, t in rows)
    assert sum(r["n_runs"] for r in out) > 100
    kept = periodic.find_runs(documents(spark, rows[:5]))
    assert kept.columns[-2:] == ["_runs", "_kept"] and periodic.find_runs(documents(spark, [])).count() == 0


def test_runs_on_random_words(monkeypatch):
    rng = random.Random(1)
    for cells in (1 << 8, 1 << 20):
        monkeypatch.setattr(periodic, "CELLS", cells)
        for _ in range(60):
            texts = []
            for _ in range(rng.randint(1, 4)):
                n, k = rng.choice([0, 3, 12, 13, 60, 400]), rng.choice([1, 2, 3, 30])
                w = [rng.randrange(k) for _ in range(n)]
                a = rng.randrange(n) if n else 0
                p = rng.randint(1, max(1, (n - a) // 2))
                texts.append(w[:a] + [w[a + (i - a) % p] for i in range(a, n)])
            values = mix(np.array([x * 1000003 + d for d, w in enumerate(texts) for x in w], dtype=np.uint64))
            doc = np.array([d for d, w in enumerate(texts) for _ in w], dtype=np.int64)
            least, base, want = rng.choice([5, 6, 12]), 0, []
            for w in texts:
                want += [(base + s, base + s + n, q) for s, n, q in plain_runs(w, least)]
                base += len(w)
            assert [tuple(map(int, r)) for r in periodic.runs_of(values, doc, len(texts), least)] == want


def test_transforms_are_exact():
    rng = np.random.default_rng(3)
    for prime in (periodic.FERMAT, periodic.LARGE):
        a, b = rng.integers(0, 20, (64, 3)), rng.integers(0, 20, (64, 3))
        x = periodic.reduced(periodic.spectrum(a, prime) * periodic.spectrum(b, prime), prime)
        got = periodic.sequence(x, prime) % prime * pow(128, -1, prime) % prime
        want = np.stack([np.convolve(a[:, i], b[:, i]) for i in range(3)], axis=1)
        assert (got[:127] == want).all() and (got[127] == 0).all()


def test_a_period_of_a_very_long_text():
    """Blocks beyond the small prime's transforms."""
    rng = np.random.default_rng(5)
    unit = rng.integers(0, 1 << 63, 140_000).astype(np.uint64)
    values = np.concatenate((rng.integers(0, 1 << 63, 777).astype(np.uint64), unit, unit[:], unit[:5]))
    assert periodic.runs_of(values, np.zeros(len(values), np.int64), 1).tolist() == [[777, len(values), 140_000]]


@pytest.fixture(scope="module")
def encoders():
    files = [open(f"{tokenizers_align.TOKENIZERS}/{f}", "rb").read() for f in (tokenizers_align.A_FILE, tokenizers_align.B_FILE)]
    return tokenizers_align.Encoders(*files)


def test_a_is_encoded_as_by_its_file(encoders):
    """The file's own library gives the same ids, with any character between letters, digits, signs and blanks."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(f"{tokenizers_align.TOKENIZERS}/{tokenizers_align.A_FILE}")
    own.encode_special_tokens = True
    points = [c for c in [*range(0x3000), *range(0x3000, 0x110000, 97)] if not 0xD800 <= c < 0xE000]
    texts = [f" x{chr(c)}x1{chr(c)}1 !{chr(c)}! {chr(c)}{chr(c)}  {chr(c)}'s{chr(c)}" for c in points] + [" <|endoftext|>a"]
    assert [e.ids for e in own.encode_batch(texts, add_special_tokens=False)] == [encoders.a.encode_ordinary(t) for t in texts]


def plain_alignment(encoders, text):
    """Groups as lists of ids, by walking over both token sequences."""
    raw = b" " + (text or "").encode()
    a, b = encoders.a.encode_ordinary(" " + (text or "")), encoders.b.encode(text or "")
    if not text or b"".join(encoders.bytes_a[i] for i in a) != raw or b"".join(encoders.bytes_b[i] for i in b) != raw:
        return [], []
    groups, x, y, at_a, at_b, own_a, own_b = [], 0, 0, 0, 0, [], []
    while x < len(a) or y < len(b):
        if at_a <= at_b and x < len(a):
            own_a.append(a[x])
            at_a += len(encoders.bytes_a[a[x]])
            x += 1
        else:
            own_b.append(b[y])
            at_b += len(encoders.bytes_b[b[y]])
            y += 1
        if at_a == at_b and own_a and own_b:
            groups.append((own_a, own_b))
            own_a, own_b = [], []
    return groups, [(i, j) for p, q in groups for i in p for j in q]


def test_alignment_query_against_its_contract(spark, messy, encoders, tmp_path):
    rng = random.Random(4)
    odd = ["", "▁", "a ▁ b", "<|endoftext|><s></s><unk>", "\0nul", "  ", " " * 700, "x" * 900, "𝔘𝔫𝔦 ☃☃", "ab" * 500 + " " + "ba" * 200, "".join(chr(rng.randrange(1, 0x3000)) for _ in range(900))]
    rows = [*messy, *[(500 + i, t) for i, t in enumerate(odd)]]
    documents(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op13_token_alignment(spark, str(tmp_path)).collect()
    made = [(i, *plain_alignment(encoders, t)) for i, t in rows]
    counts = Counter(p for _, _, links in made for p in set(links))
    most = defaultdict(int)
    for (a, _), c in counts.items():
        most[a] = max(most[a], c)
    want = Counter()
    for i, groups, links in made:
        listed = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        sums = (sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links))
        want[(i, sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), len(links), *sums, hashlib.sha256(listed.encode()).hexdigest() if groups else "")] += 1
    assert Counter(map(tuple, out)) == want
    told = tokenizers_align.align_tokens(documents(spark, [(1, "two words"), (2, None)]), slice_bytes=4).collect()
    groups = {r["_id"]: r["groups"] for r in told}
    assert groups[2] == "" and groups[1] == ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in plain_alignment(encoders, "two words")[0])
    assert tokenizers_align.align_tokens(documents(spark, [])).count() == 0


def test_pieces_of_the_merge_path_do_not_change_it(monkeypatch, encoders):
    rng = np.random.default_rng(1)
    for _ in range(100):
        a, b = (np.unique(rng.integers(0, rng.integers(1, 300), rng.integers(0, 200))).astype(np.int64) for _ in range(2))
        i, j = tokenizers_align.merge_path(a, b, int(rng.choice([1, 3, 16, 256])))
        assert a[i].tolist() == b[j].tolist() == np.intersect1d(a, b).tolist()
    texts = ["some words, and more", "", "ab" * 99, "é" * 50]
    whole = tokenizers_align.align(encoders, texts)
    for piece, wide in ((2, 4096), (7, 1), (64, 3)):
        monkeypatch.setattr(tokenizers_align, "WIDE_GROUP", wide)
        got = tokenizers_align.align(encoders, texts, piece)
        assert all(np.array_equal(got[k], whole[k]) for k in whole)
