"""Merge bases over the chain index against plain walks of random histories."""

import random

from diffloom.operators import history as H

COMMITS = "sha string, parents array<string>, time bigint"


def ancestors(parents, sha):
    seen, todo = set(), [sha] if sha in parents else []
    while todo:
        c = todo.pop()
        if c not in seen:
            seen.add(c)
            todo += [p for p in parents[c] if p in parents]
    return seen


def plain_base(parents, times, a, b):
    common = ancestors(parents, a) & ancestors(parents, b)
    best = {c for c in common if not any(c in ancestors(parents, p) for d in common for p in parents[d] if p in parents)}
    return max(best, key=lambda c: (times[c], c)) if best else None


def histories(rng):
    """Forests with forks, merges of any two commits, criss-cross merges, a long trunk, missing parents, several roots."""
    parents = {}
    for r in range(4):
        names = []
        for i in range(45):
            sha = f"{r}-{i:02}"
            if not names or rng.random() < 0.04:
                own = [] if rng.random() < 0.7 else ["missing"]
            else:
                own = [names[-1] if rng.random() < 0.6 else rng.choice(names)]
                if rng.random() < 0.4:
                    own += rng.sample(names, rng.randint(1, min(2, len(names))))
            parents[sha] = list(dict.fromkeys(own))
            names.append(sha)
    trunk = [f"t{i:03}" for i in range(300)]
    parents |= {t: trunk[max(0, i - 1) : i] for i, t in enumerate(trunk)}
    parents |= {"x1": ["t100"], "x2": ["t100"], "y1": ["x1", "x2"], "y2": ["x2", "x1"], "z1": ["y1"], "z2": ["y2"], "far": ["t299"], "side": ["t010"], "joined": ["side", "t250"]}
    return parents, {s: rng.randrange(40) for s in parents}


def test_merge_bases_of_random_histories(spark):
    rng = random.Random(11)
    parents, times = histories(rng)
    commits = spark.createDataFrame([(s, p, times[s]) for s, p in parents.items()], COMMITS)
    names = list(parents)
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(60)]
    pairs += [(f"{r}-{rng.randrange(45):02}", f"{r}-{rng.randrange(45):02}") for r in range(4) for _ in range(40)]
    pairs += [("z1", "z2"), ("z2", "far"), ("joined", "far"), ("joined", "t249"), ("joined", "side"), ("t000", "far"), ("far", "far"), ("far", "nobody"), ("missing", "missing")]
    rows = [(str(i), a, b) for i, (a, b) in enumerate(pairs)]
    index = H.chains(commits)
    got = {r["pair_id"]: r["merge_base"] for r in H.merge_base(commits, spark.createDataFrame(rows, "pair_id string, a string, b string"), index).collect()}
    assert got == {i: plain_base(parents, times, a, b) for i, a, b in rows}
    places = {r["sha"]: (r["chain"], r["place"]) for r in index.collect()}
    assert len(places) == len(set(places.values())) == len(parents)
    first = {s: p[0] for s, p in parents.items() if p and p[0] in parents}
    assert all(places[p] == (places[s][0], places[s][1] - 1) for s, p in first.items() if places[s][1] > 0)
    assert len({places[t][0] for t in names if t.startswith("t")}) == 1


def test_no_commits_and_no_pairs(spark):
    commits = spark.createDataFrame([], COMMITS)
    pairs = spark.createDataFrame([("p", "a", "b")], "pair_id string, a string, b string")
    assert [r["merge_base"] for r in H.merge_base(commits, pairs).collect()] == [None]
    assert H.merge_base(commits, pairs.limit(0)).count() == 0
