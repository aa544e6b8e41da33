"""Streams over many micro-batches, with late and repeated rows and a restart between any two."""

import random

import pytest
from pyspark.sql import functions as F

from diffloom.operators import review as R
from diffloom.streaming import marks as M
from diffloom.streaming.runs import LevelledRuns


def deliver(spark, folder, parts, schema, start):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        start(spark.readStream.schema(schema).parquet(f"{folder}/in"), str(folder)).awaitTermination()


def test_value_changes_are_told_once(spark, tmp_path):
    rows = [("k", 5, 0, "a", "x"), ("k", 4, 0, "b", "y"), ("k", 6, 0, "a", "x"), ("k", 7, 1, "a", None), ("n", 1, 0, "a", None), ("k", 8, 0, "a", "none"), ("k", 7, 1, "a", None)]
    parts = [[rows[0], rows[1], rows[4]], [rows[1], rows[2]], [rows[0]], [rows[3]], [rows[5], rows[5]], [rows[6]]]
    deliver(spark, tmp_path, parts, "key string, wall bigint, logical int, device string, v string", lambda s, f: M.updates_to(M.lww_changes(s, "v"), f))
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r["batch"], r["key"], r["value"]) for r in out) == [(0, "k", "x"), (0, "n", None), (3, "k", None), (4, "k", "none")]


def clock(events):
    """Event by event: (device, seq) -> reading."""
    last, out = {}, {}
    for dev, seq, wall, received, logical in sorted(events):
        w, n = last.get(dev, (None, -1))
        if received:
            w, n = (wall, logical) if w is None or (wall, logical) > (w, n) else (w, n)
        else:
            w, n = (wall, 0) if w is None or wall > w else (w, n + 1)
        last[dev] = out[dev, seq] = (w, n)
    return out


def test_clocks_move_past_received_stamps(spark, tmp_path):
    rng = random.Random(3)
    events = [(f"d{rng.randrange(4)}", i, rng.randrange(6) + i // 20, rng.random() < 0.3, rng.randrange(5)) for i in range(200)]
    schema = "device string, seq bigint, wall bigint, received boolean, logical int"
    want = clock(events)
    batch = R.assign_hlc(spark.createDataFrame(events, schema), received="received").collect()
    assert {(r["device"], r["seq"]): (r["hlc_wall"], r["hlc_logical"]) for r in batch} == want
    parts = [rng.sample(events[i : i + 40] + events[max(0, i - 10) : i], len(events[i : i + 40] + events[max(0, i - 10) : i])) for i in range(0, 200, 40)]
    deliver(spark, tmp_path, parts, schema, lambda s, f: M.updates_to(M.hlc_stream(s, received="received"), f, "append"))
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(out) == 200 and {(r["device"], r["seq"]): (r["hlc_wall"], r["hlc_logical"]) for r in out} == want


def test_notes_find_their_submit_in_any_order_of_arrival(spark, tmp_path):
    rng = random.Random(5)
    events = [(i % 3, i, rng.choice(["note", "note", "note", "single", "submit"]), i) for i in range(150)]
    schema = "review_id bigint, seq bigint, kind string, note_id bigint"
    batch = {(r["review_id"], r["note_id"]): r["published"] for r in M.review_lifecycle(spark.createDataFrame(events, schema)).collect()}
    for name, mixed in (("kept", sorted(events, key=lambda e: rng.random())), ("bounded", sorted(events, key=lambda e: e[1] + 20 * rng.random()))):
        parts = [mixed[i : i + 30] + mixed[max(0, i - 9) : i] for i in range(0, 150, 30)]
        lateness = 60 if name == "bounded" else None
        deliver(spark, tmp_path / name, parts, schema, lambda s, f, n=lateness: M.updates_to(M.lifecycle_stream(s, n), f))
        out = M.latest(f"{tmp_path}/{name}", spark, ["review_id", "note_id"]).collect()
        assert {(r["review_id"], r["note_id"]): r["published"] for r in out} == {k: v for k, v in batch.items() if v is not None}


def test_state_of_a_review_is_bounded():
    """What is far behind the newest row leaves the state."""

    class Held(dict):
        keys = lambda self: list(dict.keys(self))
        iterator = lambda self: list(self.items())
        containsKey, updateValue, removeKey = dict.__contains__, dict.__setitem__, dict.pop

    class Value:
        now = None
        exists = lambda self: self.now is not None
        get = lambda self: self.now
        update = lambda self, v: setattr(self, "now", v)

    life = M.Lifecycle(100)
    life.notes, life.submits, life.newest = Held(), Held(), Value()
    sizes = []
    for at in range(0, 5000, 50):
        rows = [{"seq": s, "kind": "submit" if s % 10 == 9 else "note", "note_id": s} for s in range(at, at + 50)]
        list(life.handleInputRows((1,), iter(rows), None))
        sizes.append(len(life.notes) + len(life.submits))
    assert max(sizes[10:]) <= 160 and sizes[-1] <= sizes[10]


def test_levelled_runs_hold_the_newest_rows(spark, tmp_path):
    rng, want = random.Random(1), {}
    schema = spark.createDataFrame([], "k bigint, v bigint").schema
    held = LevelledRuns(spark, str(tmp_path), schema, ["k"], fan_in=2, buckets=4)
    assert held.read(0).count() == 0
    for n in range(9):
        rows = {rng.randrange(12): 100 * n + i for i in range(4)} if n != 4 else {}
        frame = spark.createDataFrame(list(rows.items()), schema)
        held.add(frame, n)
        if n % 3 == 0:
            held.add(frame, n)  # a batch run again
        want |= rows
        assert {(r["k"], r["v"]) for r in held.read(n + 1).collect()} == set(want.items())
    like = spark.createDataFrame([(3,)], "k bigint")
    assert {r["v"] for r in held.read(9, like).filter("k = 3").collect()} == {want[3]} if 3 in want else True
    assert len(held.blocks(9)) == 2 and held.blocks(21) == [(0, 16), (16, 4), (20, 1)]
    assert len([p for p in tmp_path.iterdir() if p.name.startswith("run-")]) <= 2 + len(held._merged(9))


@pytest.mark.parametrize("order", [0, 1])
def test_snapshots_count_when_they_are_whole(spark, tmp_path, order):
    """Halves emit nothing; equal content is not given again; sources may hold the sign that names use."""
    schema = "source string, token bigint, path string, mode int, blob_id string, ended boolean"
    snap = lambda s, t, files: [(s, t, p, 33188, b, False) for p, b in files.items()]
    end = lambda s, t: (s, t, None, None, None, True)
    a1, a2, a3 = snap("a@1", 1, {"x": "1", "y": "1"}), snap("a@1", 2, {"x": "2", "z": "1"}), snap("a@1", 3, {"x": "1", "y": "1"})
    a4 = snap("a@1", 4, {"x": "2", "z": "1"})
    b1, b2 = snap("a", 1, {"x": "1"}), snap("a", 2, {"x": "1"})
    parts = [[a1[0]], [a1[1], a1[0], end("a@1", 1), *b1], [a2[0], end("a", 1), *b2], [a2[1], end("a@1", 2), end("a", 2)], [*a3, end("a@1", 3), *a4], [end("a@1", 4), a1[0]]]
    if order:
        parts = [*parts[:3], [*parts[3], *parts[4]], parts[5], [end("a@1", 2), *a2]]
    deliver(spark, tmp_path, parts, schema, M.watch_snapshots)
    got = sorted((r["batch"], r["source"], r["diffset_id"], r["path"], r["status"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    first = [(3, "a@1", "a@1@2", "x", "modified"), (3, "a@1", "a@1@2", "y", "deleted"), (3, "a@1", "a@1@2", "z", "added")]
    back = [(3 if order else 4, "a@1", "a@1@3", p, s) for p, s in (("x", "modified"), ("y", "added"), ("z", "deleted"))]
    assert got == first + back


def test_approval_follows_marks_over_batches(spark, tmp_path):
    outline = spark.createDataFrame([("d1", "f", 0, "after", 0, -1, "n0", None), ("d1", "f", 0, "after", 1, 0, "n1", "e1"), ("d1", "f", 0, "after", 2, 0, "n2", "e2"), ("d2", "g", 0, "after", 0, -1, "m0", "e3")],
                                    "diffset_id string, path string, frag_no int, side string, node_no int, parent int, key string, atom string")
    parts = [[("n0", 1, None, 2)], [("e1", 2, True, None)], [("n0", 3, None, -2)], [("n0", 1, None, 2), ("e3", 4, True, None)], [("n0", 5, None, 2)]]
    parts = [[(k, w, 0, "a", v, s) for k, w, v, s in p] for p in parts]
    schema = "key string, wall bigint, logical int, device string, viewed boolean, score int"
    deliver(spark, tmp_path, parts, schema, lambda s, f: M.approval_stream(s, outline, f))
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r["batch"], r["diffset_id"], r["state"]) for r in out) == [(0, "d1", "approved"), (1, "d1", "approved"), (2, "d1", "blocked"), (3, "d1", "blocked"), (3, "d2", "pending"), (4, "d1", "approved")]
    assert {r["diffset_id"]: r["state"] for r in M.latest(str(tmp_path), spark, ["diffset_id"]).collect()} == {"d1": "approved", "d2": "pending"}
