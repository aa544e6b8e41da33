"""Suffix-array dedup by a common-prefix-aware distributed merge sort.

A byte goes when a string of ``WINDOW`` bytes covers it that also starts earlier. Sorting every suffix of a corpus
moves it a hundred times over, so the suffix array is sparse, in a way that loses no repeat:

1. Every window picks its smallest hash of ``GRAM`` neighbouring bytes; equal windows pick the same gram at the same
   place. Neighbouring windows that share their pick are one context: the bytes before the gram (its left side) and
   the suffix from the gram to the end of the last window (its right side). Grams seen once in the corpus settle all
   windows that picked them; only contexts of recurring grams go on.
2. Tasks sort their contexts by right side, then left side, into runs; equal ones collapse to the earliest. Runs are
   cut at splitters taken from a sample and front-coded (length of the common prefix with the one before, then the
   rest), and the pieces are exchanged by range.
3. Each range merges its pieces with a loser tree that carries, for every head, its common prefix with the last
   winner. Two heads with different prefixes are decided without a look at a byte; equal ones are compared from
   there on. The merge gives a sorted suffix array with its common-prefix lengths.
4. Equal neighbours: all but the earliest are covered whole. Of the rest, a window can only repeat if the suffix
   shares what the window needs of the right side with one of its neighbours in the array; these few windows meet by
   128-bit hash, and all but the earliest of each are covered. Their equals are neighbours too, so they meet inside
   the range; where their neighbourhood reaches its end, the earliest is exchanged once more.

Defined results: null texts are empty; order is by doc_id (null first), then by hash of the text, then by position;
repeated rows, alike in id and text, do not cover each other and share one answer. A window may cut a character.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.llm.common import OTHER_BASE, anchors, discard, extended, later_windows, lists, mix, own_names, rolling_hashes, settle, signed, slices, span_hashes, union_of, with_spans

WINDOW, GRAM = 100, 32
#: Bytes of contexts that a task sorts into one run, and contexts of a range, about.
RUN_BYTES, RANGE_ROWS = 8 << 20, 1 << 17
#: Sampled suffixes for each range.
OVERSAMPLE = 16

#: Longer than any key: what lies beyond a range is not known.
_BEYOND = 1 << 30
_FOUND = "_id long, _th long, lo int, hi int, w1 long, w2 long"
#: How a piece holds right length, whether there is an id, id, text hash, lo, and hi less lo.
_KINDS = (np.uint16, np.uint8, np.int64, np.int64, np.int32, np.uint16)
_PIECE = "range int, piece binary, _id long, _th long, lo int, hi int"


def _packed(at: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: np.ndarray) -> np.ndarray:
    """A context as one number: the place of its gram in the text, the bytes before it, the number of further windows."""
    return (at - base) << 32 | (at - lo) << 16 | (hi - lo)


def picked_grams(named: DataFrame, share: float, window: int, gram: int) -> DataFrame:
    """The only pass that hashes the corpus: _id, _th, the hashes ``hs`` of the grams that windows picked, their contexts
    ``ps`` and, of a ``share`` of the contexts, ``drawn`` by what they hold, the key they are sorted by."""
    limit = np.uint64(min((1 << 64) - 1, int(share * (1 << 64))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in slices(batch, "_text"):
                grams = rolling_hashes(data, gram)
                doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
                at, lo, hi = anchors(grams, doc, window, gram)
                h, of = grams[at], doc[at]
                # Many that share a right side are parted by their left sides, so both ends of the context decide.
                chosen = np.flatnonzero(mix(h + np.uint64(3) * grams[lo] + np.uint64(5) * grams[hi + window - gram]) <= limit)
                keys = [data[a:b].tobytes() + data[c:a].tobytes() for a, b, c in zip(at[chosen].tolist(), (hi[chosen] + window).tolist(), lo[chosen].tolist(), strict=True)]
                counts, many = np.bincount(of, minlength=end - row), np.bincount(of[chosen], minlength=end - row)
                own = [batch.column(c).slice(row, end - row) for c in ("_id", "_th")]
                made = [lists(signed(h), counts, pa.int64()), lists(_packed(at, lo, hi, offsets[of]), counts, pa.int64())]
                yield pa.RecordBatch.from_arrays([*own, *made, lists(keys, many, pa.binary())], names=["_id", "_th", "hs", "ps", "drawn"])

    return settle(named.select("_id", "_th", "_text").mapInArrow(work, "_id long, _th long, hs array<bigint>, ps array<bigint>, drawn array<binary>"))


def recurring_grams(picked: DataFrame) -> DataFrame:
    return settle(picked.select(F.explode("hs").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"))


def recurring_places(picked: DataFrame, recurring: DataFrame) -> DataFrame:
    """_id, _th, _at: contexts of picked grams that recur, for each row that has any."""
    places = picked.select("_id", "_th", F.explode(F.arrays_zip("hs", "ps")).alias("x")).select("_id", "_th", F.col("x.hs").alias("h"), F.col("x.ps").alias("at"))
    return settle(places.join(recurring, "h", "left_semi").groupBy("_id", "_th").agg(F.collect_set("at").alias("_at")))


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b``, known to be at least ``at``."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    while a[at : at + 16] == b[at : at + 16]:
        at += 16
    x, y = a[at : at + 16], b[at : at + 16]
    differing = int.from_bytes(x.ljust(16, b"\0"), "big") ^ int.from_bytes(y.ljust(16, b"\0"), "big")
    return min(n, at + (128 - differing.bit_length()) // 8)


def front_coded(keys: list[bytes], meta: np.ndarray) -> bytes:
    """A piece of a sorted run: key and prefix lengths, what each key adds to the one before, and the keys' numbers (right
    length, id known, id, text hash, lo, hi), each kind by itself and in as few bytes as it needs, all of it compressed."""
    prefix = np.zeros(len(keys), dtype=np.uint16)
    for i in range(1, len(keys)):
        prefix[i] = common(keys[i - 1], keys[i], 0)
    length = np.fromiter(map(len, keys), np.uint16, len(keys))
    rest = b"".join(k[p:] for k, p in zip(keys, prefix.tolist(), strict=True))
    numbers = np.column_stack((meta[:, :5], meta[:, 5] - meta[:, 4]))
    numbers = [numbers[:, i].astype(kind).tobytes() for i, kind in enumerate(_KINDS)]
    plain = b"".join((np.int64(len(keys)).tobytes(), prefix.tobytes(), length.tobytes(), *numbers, rest))
    return np.int64(len(plain)).tobytes() + pa.compress(plain, codec="zstd", asbytes=True)


def decoded(packed: bytes) -> tuple[list[bytes], list[int], np.ndarray]:
    piece = pa.decompress(packed[8:], int(np.frombuffer(packed, np.int64, 1)[0]), "zstd", asbytes=True)
    n = int(np.frombuffer(piece, np.int64, 1)[0])
    prefix = np.frombuffer(piece, np.uint16, n, 8).tolist()
    length = np.frombuffer(piece, np.uint16, n, 8 + 2 * n).tolist()
    meta, at = np.empty((n, 6), dtype=np.int64), 8 + 4 * n
    for i, kind in enumerate(_KINDS):
        meta[:, i] = np.frombuffer(piece, kind, n, at)
        at += n * np.dtype(kind).itemsize
    meta[:, 5] += meta[:, 4]
    keys, last = [], b""
    for p, size in zip(prefix, length, strict=True):
        last = last[:p] + piece[at : at + size - p]
        keys.append(last)
        at += size - p
    return keys, prefix, meta


def merged(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, number in it, common prefix with the one before) in order of the keys, by a loser tree.

    Each node keeps the loser of its match and that loser's common prefix with the winner it lost to. A head's prefix
    with the last output is known at every match on its way up: the longer prefix wins unseen."""
    k = 1
    while k < len(runs):
        k *= 2
    keys = [r[0] for r in runs] + [[]] * (k - len(runs))
    pre = [r[1] for r in runs] + [[]] * (k - len(runs))
    at, shared = [0] * k, [0] * k
    loser = [-1] * k  # node 1 is the root; leaves are k .. 2k - 1

    def match(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix becomes that with the winner."""
        if at[a] >= len(keys[a]):
            return b, a
        if at[b] >= len(keys[b]):
            return a, b
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        x, y = keys[a][at[a]], keys[b][at[b]]
        n = common(x, y, shared[a])
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    winner = [-1] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winner[node], loser[node] = match(winner[2 * node], winner[2 * node + 1])
    head = winner[1] if k > 1 else 0
    while at[head] < len(keys[head]):
        yield head, at[head], shared[head]
        at[head] += 1
        shared[head] = pre[head][at[head]] if at[head] < len(keys[head]) else 0
        node = (head + k) // 2
        while node:
            head, loser[node] = match(head, loser[node])
            node //= 2


def joined_spans(rows: np.ndarray) -> np.ndarray:
    """Rows (id known, id, text hash, lo, hi) with touching and overlapping spans of one text made one."""
    rows = rows[np.lexsort(rows.T[::-1])]
    if len(rows) < 2:
        return rows
    same = (rows[1:, :3] == rows[:-1, :3]).all(axis=1) & (rows[1:, 3] <= rows[:-1, 4] + 1)
    head = np.concatenate(([True], ~same))
    out = rows[head]
    out[:, 4] = np.maximum.reduceat(rows[:, 4], np.flatnonzero(head))
    return out


def _runs(batches: Iterator[pa.RecordBatch], splitters: list[bytes], window: int) -> Iterator[pa.RecordBatch]:
    """Sorted, front-coded pieces of runs by range; contexts that repeat within a run come out as covered."""
    held: list[tuple[bytes, int, int, int, int, int, int]] = []  # key, right length, id is known, id, th, lo, hi
    size = 0

    def emptied() -> Iterator[pa.RecordBatch]:
        held.sort()
        covered, keys, meta, last = [], [], [], None
        for x in held:
            if last is not None and x[:2] == last[:2]:
                if x[2:6] > last[2:6]:
                    covered.append(x)
                continue
            last = x
            keys.append(x[0]), meta.append(x[1:])
        numbers = np.array(meta, dtype=np.int64).reshape(-1, 6)
        held.clear()
        cuts = [0, *(bisect_right(keys, s) for s in splitters), len(keys)]
        filled = [i for i in range(len(cuts) - 1) if cuts[i] < cuts[i + 1]]
        pieces = [front_coded(keys[cuts[i] : cuts[i + 1]], numbers[cuts[i] : cuts[i + 1]]) for i in filled]
        whole = joined_spans(np.array([x[2:] for x in covered], dtype=np.int64).reshape(-1, 5))
        nulls, n = [None] * len(filled), len(whole)
        ids = pa.array(whole[:, 1], pa.int64(), mask=whole[:, 0] == 0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(filled + (np.arange(n) % (len(splitters) + 1)).tolist(), pa.int32()),  # any range passes these on
                pa.array([*pieces, *[None] * n], pa.binary()),
                pa.concat_arrays([pa.array(nulls, pa.int64()), ids]),
                *[pa.concat_arrays([pa.array(nulls, t), pa.array(whole[:, i].astype(k))]) for i, t, k in ((2, pa.int64(), np.int64), (3, pa.int32(), np.int32), (4, pa.int32(), np.int32))],
            ],
            names=["range", "piece", "_id", "_th", "lo", "hi"],
        )

    for batch in batches:
        for row, end, data, offsets in slices(batch, "_text"):
            ids, ths, places = (batch.column(c).slice(row, end - row) for c in ("_id", "_th", "_at"))
            packed = places.flatten().to_numpy()
            doc = np.repeat(np.arange(end - row), places.value_lengths().to_numpy())
            at = offsets[doc] + (packed >> 32)
            lo = at - (packed >> 16 & 0xFFFF)
            raw, ids, ths = data.tobytes(), ids.to_pylist(), ths.to_pylist()
            for d, a, first, last in zip(doc.tolist(), at.tolist(), lo.tolist(), (lo + (packed & 0xFFFF)).tolist(), strict=True):
                base, own = int(offsets[d]), ids[d]
                right = raw[a : last + window]
                held.append((right + raw[first:a], len(right), own is not None, own or 0, ths[d], first - base, last - base))
                size += last - first + window
            if size >= RUN_BYTES:
                yield from emptied()
                size = 0
    if held:
        yield from emptied()


def _merge(rows: pa.Table, window: int) -> pa.Table:
    """One range: covered contexts, and windows that may repeat."""
    passed = rows.filter(rows["piece"].is_null())
    parts = [decoded(p.as_py()) for p in rows["piece"].drop_null()]
    order, depth = [], []
    for run, i, shared in merged([(p[0], p[1]) for p in parts]):
        order.append((run, i)), depth.append(shared)
    covered: list[tuple] = []
    firsts: list[tuple] = []  # (key, right length, id known, id, th, lo, hi, depth before)
    i, n = 0, len(order)
    while i < n:
        key = parts[order[i][0]][0][order[i][1]]
        j = i + 1
        while j < n and depth[j] == len(key) and len(parts[order[j][0]][0][order[j][1]]) == len(key):
            j += 1
        same: dict[int, list[tuple]] = {}
        for run, number in order[i:j]:
            m = parts[run][2][number].tolist()
            same.setdefault(m[0], []).append(tuple(m[1:]))
        for right, members in same.items():
            members.sort()
            covered += [x for x in members if x[:4] > members[0][:4]]
            firsts.append((key, right, *members[0], depth[i] if len(same) == 1 else len(key)))
        i = j
    ends = np.array([len(f[0]) for f in firsts], dtype=np.int64)
    above = np.array([f[7] for f in firsts], dtype=np.int64)
    if len(above):
        above[0] = _BEYOND
    below = np.append(above[1:], _BEYOND)
    base = np.cumsum(ends) - ends
    # Each key as it stands in its text: left side, then right side.
    data = np.frombuffer(b"".join(f[0][f[1] :] + f[0][: f[1]] for f in firsts), dtype=np.uint8)
    right, known, ids, ths, lo, hi = (np.array([f[i] for f in firsts], dtype=np.int64) for i in (1, 2, 3, 4, 5, 6))
    left = ends - right
    # Window number w of a context starts at lo + w, w bytes into the key, and needs window - (left - w) of the right.
    count = np.clip(np.maximum(above, below) - window + left, -1, hi - lo) + 1
    owner = np.repeat(np.arange(len(firsts)), count)
    w = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = base[owner] + w
    w1, w2 = span_hashes(data, begin, begin + window), span_hashes(data, begin, begin + window, OTHER_BASE)
    # All that share what a window needs are neighbours in the array. Unless they reach an end of the range, the
    # window's equals are all here; else the earliest of them meets those of the next range later.
    reach = np.maximum(np.minimum.accumulate(above), np.minimum.accumulate(below[::-1])[::-1])
    open_ = window - (left[owner] - w) <= reach[owner]
    order = np.lexsort((lo[owner] + w, ths[owner], ids[owner], known[owner], w2, w1))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (w1[order[1:]] != w1[order[:-1]]) | (w2[order[1:]] != w2[order[:-1]])
    first_of = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
    place = [known[owner], ids[owner], ths[owner], lo[owner] + w]
    alike = np.logical_and.reduce([x[order] == x[first_of] for x in place])  # repeated rows are one place
    again = np.sort(order[~alike])
    # Neighbouring windows of one context make one span.
    new = np.ones(len(again), dtype=bool)
    new[1:] = (owner[again[1:]] != owner[again[:-1]]) | (w[again[1:]] != w[again[:-1]] + 1)
    heads = again[new]
    tails = again[np.append(np.flatnonzero(new)[1:] - 1, len(again) - 1)] if len(again) else heads

    def table(at: np.ndarray, first: np.ndarray, last: np.ndarray, hashes: tuple | None) -> pa.Table:
        pair = [pa.nulls(len(at), pa.int64())] * 2 if hashes is None else [pa.array(signed(h)) for h in hashes]
        places = [pa.array(ids[at], mask=known[at] == 0), pa.array(ths[at]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))]
        return pa.table(dict(zip(("_id", "_th", "lo", "hi", "w1", "w2"), [*places, *pair], strict=True)))

    local = table(owner[heads], lo[owner[heads]] + w[heads], lo[owner[heads]] + w[tails], None)
    far = np.sort(order[fresh & open_[order]])  # one of each window; the others here start later
    opened = table(owner[far], lo[owner[far]] + w[far], lo[owner[far]] + w[far], (w1[far], w2[far]))
    whole = pa.table(
        {
            "_id": pa.array([x[1] if x[0] else None for x in covered], pa.int64()),
            "_th": pa.array([x[2] for x in covered], pa.int64()),
            **{c: pa.array([x[i] for x in covered], pa.int32()) for i, c in ((3, "lo"), (4, "hi"))},
            **{c: pa.nulls(len(covered), pa.int64()) for c in ("w1", "w2")},
        }
    )
    through = passed.select(["_id", "_th", "lo", "hi"])
    for c in ("w1", "w2"):
        through = through.append_column(c, pa.nulls(through.num_rows, pa.int64()))
    return pa.concat_tables([opened, local, whole, through])


def _splitters(picked: DataFrame, ranges: int) -> list[bytes]:
    """Keys that part the contexts into about even ranges, from the drawn ones: of more than the ranges need, those with
    the smallest hashes, wherever they lie."""
    keys = picked.select(F.explode("drawn").alias("key")).distinct()
    drawn = sorted(bytes(r["key"]) for r in keys.orderBy(F.xxhash64("key")).limit(4 * ranges * OVERSAMPLE).collect())
    return [drawn[len(drawn) * i // ranges] for i in range(1, ranges)] if len(drawn) >= ranges else drawn


def repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, gram: int = GRAM, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(_id, _th, lo, hi): windows starting at bytes lo to hi also start earlier."""
    spark = docs.sparkSession
    least = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = docs.select(F.col(doc_id).cast("long").alias("_id"), F.xxhash64(F.col(text)).alias("_th"), F.col(text).alias("_text"))
    expected = 1 + 2 * (docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // (window - gram + 2)  # contexts of random text
    picked = picked_grams(named, max(expected / range_rows, least) * OVERSAMPLE / expected, window, gram)
    recurring = recurring_grams(picked)
    places = recurring_places(picked, recurring)
    total = places.agg(F.sum(F.size("_at"))).first()[0] or 0
    splitters = _splitters(picked, max(-(-total // range_rows), least))
    discard(picked, recurring)
    joined = named.join(places, named["_id"].eqNullSafe(places["_id"]) & (named["_th"] == places["_th"])).select(named["_id"], named["_th"], "_text", "_at")
    pieces = joined.mapInArrow(lambda batches: _runs(batches, splitters, window), _PIECE)
    found = settle(pieces.groupBy("range").applyInArrow(lambda rows: _merge(rows, window), _FOUND))
    windows = found.filter("w1 is not null").select("_id", "_th", "lo", "w1", "w2")
    covered = found.filter("w1 is null").select("_id", "_th", "lo", "hi")
    later = later_windows(windows, ["w1", "w2"]).withColumn("hi", F.col("lo"))
    spans = settle(covered.unionByName(later))
    discard(places, found)
    return spans


def drop_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, gram: int = GRAM, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All columns of ``docs``; ``_n_bytes``, ``_n_removed``, ``_spans`` (removed byte ranges, end exclusive) and
    ``_kept`` (the remaining bytes)."""
    docs = own_names(docs)
    spans = repeated_spans(docs, text, doc_id, window, gram, range_rows)
    joined = with_spans(docs, spans, text, doc_id)
    kept = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, runs, texts = [], [], [], []
            for value, found in zip(batch.column("_text"), batch.column("_covered"), strict=True):
                data = np.frombuffer((value.as_py() or "").encode(), dtype=np.uint8)
                out = union_of(found.as_py() or [], window, len(data))
                edge = np.flatnonzero(np.diff(np.concatenate(([0], out.view(np.int8), [0])))).tolist()
                total.append(len(data)), gone.append(int(out.sum())), texts.append(data[~out].tobytes())
                runs.append([{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2], strict=True)])
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            made = [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, span), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *made], names=[*kept, "_n_bytes", "_n_removed", "_spans", "_kept"])

    return joined.mapInArrow(work, extended(docs, "_n_bytes long, _n_removed long, _spans array<struct<start:int,end:int>>, _kept binary"))
