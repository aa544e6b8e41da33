"""Documents linked by n-gram Jaccard similarity, filtered by several global orders of the tokens.

A document is the set of its distinct shingles ("tokens"). If two sets reach the threshold t, they share a token among
the first |x| - ceil(t |x|) + 1 of x and the like of y, in any order of tokens that both obey. An order that puts rare
tokens first is selective; a second and a third that shuffle tokens of like rarity keep out most pairs that meet by
chance under the first. A pair is verified only if it meets under all of them.

1. Equal sets are one set. Of every set one token in ``SAMPLE``, by its hash, is exchanged by range and looked up: a set
   with more sampled tokens of its own alone than the threshold forgives for all of them has no partner and leaves
   here. Only counts come back. One text of each set that stays is read again, and only these send all their tokens.
2. They are exchanged by token range, packed by slice of text, and each range counts in how many sets a token is. A
   token that ``COMMON`` sets of one slice hold is common; it is told once a slice with its count and goes straight to
   its sets, so a token that a third of the sets share does not gather in one task. Tokens in one set only can be
   shared with nobody: they come first in every order. A set with more of them than the threshold forgives leaves too.
   The shared tokens of the rest meet again by set and are put in order: by rarity (common last), then by one of
   ``ORDERS`` hashes.
3. Hubs: of the sets that begin alike, by an order or by hash alone, the one with the fewest lone tokens; its links to
   the others, verified, make first components. Groups of near copies are connected here, by a star and not by all
   pairs. A crowd needs the hashes alone: rare tokens that a member shares by chance come first by rarity and lead
   it past the crowd's hub, and every pair of the parts that a crowd falls into would be verified.
4. The join: only sets of different components meet, on every prefix token of the first order, and bring their
   prefixes by the others. A pair is formed at its first common token alone, if sizes and positions allow it and it
   meets under every order, and verified exactly by its shared tokens. A token with more than ``BUCKET`` sets is dealt
   into slots, every pair of slots a group of its own.
5. Links of both steps give the components.

Components are exact: a link left unverified joins sets already connected. Sets and tokens are known by 64-bit hashes.

Defined results: no words or null: no shingles, linked with nothing, the document is its own component; fewer words than
a shingle: the whole sequence is one; repeated rows and copies share a component, named by its smallest non-null doc_id
(null if it has none); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffloom.llm.common import NOT_SPACE, fold_bytes, gram_hashes, mix, settle, signed, slices, span_hashes, word_bounds
from diffloom.llm.simhash import components

#: Global orders under which a candidate pair must meet.
ORDERS = 3

#: One token of so many, by its hash, is looked up for every set before any set sends all of its tokens.
SAMPLE = 4

#: A set's hubs are named by so many of its first tokens by each order, and by the least of them by so many hashes alone.
AHEAD, LEAST = 3, 4

#: Sets of one slice, or of all, from which on a token is common; common tokens are ordered by hash alone.
COMMON = 16

#: Sets of a token that are compared in one group.
BUCKET = 4096

#: Bytes of text whose tokens are packed together.
PACK_BYTES = 1 << 22

_SALTS = [np.uint64(s) for s in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_HUB_SALTS = mix(np.arange(1, LEAST + 1, dtype=np.uint64))
_PACK = "dest int, kind int, sets binary, sizes binary, counts binary, tokens binary, ranks binary"
_PACK_SCHEMA = pa.schema([("dest", pa.int32()), ("kind", pa.int32()), *[(c, pa.binary()) for c in ("sets", "sizes", "counts", "tokens", "ranks")]])
_SOME, _DIRECT, _NOTICE = 0, 1, 2


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text of a slice."""
    data = fold_bytes(data)
    starts, ends, doc = word_bounds(data, offsets, NOT_SPACE)
    words = span_hashes(data, starts, ends)
    first = np.searchsorted(doc, np.arange(len(offsets)))
    grams = gram_hashes(words, shingle)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(np.unique(grams[a : b - shingle + 1]))
        else:  # the whole sequence, told apart from shingles by its length
            out.append(mix(gram_hashes(words[a:b], b - a) + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def _names(sets: list[np.ndarray]) -> np.ndarray:
    """One hash for each set, of its tokens in any order and its size."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    sums = np.cumsum(np.concatenate([np.zeros(1, np.uint64), *[mix(s ^ _SALTS[1]) for s in sets]]), dtype=np.uint64)
    ends = np.cumsum(sizes)
    return mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64) * _SALTS[2])


def _dealt(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


def _sampled(tokens: np.ndarray) -> np.ndarray:
    return tokens % np.uint64(SAMPLE) == 0


def _short(tokens: np.ndarray) -> np.ndarray:
    """32 bits of each token below those that deal it to a range, without those by which it is sampled."""
    return ((tokens >> np.uint64(8)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _packs(dest: np.ndarray, names: np.ndarray, sizes: np.ndarray, of: np.ndarray, tokens: np.ndarray, ranks: np.ndarray | None, kind: int) -> Iterator[pa.RecordBatch]:
    """One row for each destination; ``of`` (the set of each token) ascends inside a destination."""
    if not len(tokens):
        return
    order = np.argsort(dest.astype(np.uint16) if dest.max(initial=0) < 1 << 16 else dest, kind="stable")
    dest, of, tokens = dest[order], of[order], tokens[order]
    new = np.flatnonzero(np.concatenate(([True], (dest[1:] != dest[:-1]) | (of[1:] != of[:-1]))))
    counts = np.diff(np.concatenate((new, [len(dest)]))).astype(np.int32)
    cut = np.flatnonzero(np.concatenate(([True], dest[new][1:] != dest[new][:-1])))
    ends, rows = np.concatenate((cut[1:], [len(new)])), {c: [] for c in _PACK_SCHEMA.names}
    ranks = ranks[order] if ranks is not None else None
    for a, b in zip(cut.tolist(), ends.tolist(), strict=True):
        lo, hi = new[a], new[b] if b < len(new) else len(dest)
        sets = of[new[a:b]]
        values = (int(dest[lo]), kind, names[sets].tobytes(), sizes[sets].astype(np.int32).tobytes(), counts[a:b].tobytes(), tokens[lo:hi].tobytes(), ranks[lo:hi].tobytes() if ranks is not None else b"")
        for c, v in zip(rows, values, strict=True):
            rows[c].append(v)
    yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in _PACK_SCHEMA], schema=_PACK_SCHEMA)


def _named(docs: DataFrame, text: str, doc_id: str, shingle: int) -> DataFrame:
    """(_id, _th, name, n, m): the set of every row, its size and how many of its tokens are sampled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in slices(batch, "_text"):
                sets = shingle_sets(data, offsets, shingle)
                own = batch.slice(row, end - row)
                counts = [pa.array([len(s) for s in sets], pa.int64()), pa.array([_sampled(s).sum() for s in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays([own.column("_id"), own.column("_th"), pa.array(signed(_names(sets))), *counts], names=["_id", "_th", "name", "n", "m"])

    given = docs.select(F.col(doc_id).cast("long").alias("_id"), F.xxhash64(F.col(text)).alias("_th"), F.col(text).alias("_text"))
    return given.mapInArrow(work, "_id long, _th long, name long, n long, m long")


def _distinct_sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The distinct sets of every slice of text: names, sizes, all tokens and the set of each."""
    for batch in batches:
        for _, _, data, offsets in slices(batch, "_text", PACK_BYTES):
            sets = [s for s in shingle_sets(data, offsets, shingle) if len(s)]
            names, at = np.unique(_names(sets), return_index=True)
            sets = [sets[i] for i in at.tolist()]
            if sets:
                sizes = np.array([len(s) for s in sets])
                yield names, sizes, np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)


def _sampled_shared(docs: DataFrame, text: str, shingle: int, parts: int) -> DataFrame:
    """(name, shared): how many sampled tokens of a set another set has too. A number may be too
    large (copies of a set in several slices, tokens alike in half their bits), never too small."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, sizes, tokens, of in _distinct_sets(batches, shingle):
            taken = _sampled(tokens)
            tokens, of = tokens[taken], of[taken]
            distinct, inverse, found = np.unique(tokens, return_inverse=True, return_counts=True)
            common = (found >= COMMON)[inverse]
            some, told = ~common, distinct[found >= COMMON]
            yield from _packs(_dealt(tokens[some], parts), names, sizes, of[some], _short(tokens[some]), None, _SOME)
            if len(told):
                own, counts = np.unique(of[common], return_counts=True)
                columns = {"dest": pa.array([int(_dealt(mix(names[:1]), parts)[0])], pa.int32()), "kind": pa.array([_DIRECT], pa.int32())}
                columns |= {"sets": pa.array([names[own].tobytes()]), "counts": pa.array([counts.astype(np.int32).tobytes()])}
                yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.array([b""])) for f in _PACK_SCHEMA], schema=_PACK_SCHEMA)
                yield from _packs(_dealt(told, parts), names, sizes, np.zeros(len(told), np.int64), _short(told), None, _NOTICE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts, tokens, noticed, told, sums = [[np.zeros(0, k)] for k in (np.uint64, np.int32, np.uint32, np.uint32, np.uint64, np.int32)]
        for batch in batches:
            for row in batch.select(["kind", "sets", "counts", "tokens"]).to_pylist():
                own, many, some = np.frombuffer(row["sets"], np.uint64), np.frombuffer(row["counts"], np.int32), np.frombuffer(row["tokens"], np.uint32)
                if row["kind"] == _DIRECT:
                    told.append(own), sums.append(many)
                elif row["kind"] == _NOTICE:
                    noticed.append(some)
                else:
                    names.append(own), counts.append(many), tokens.append(some)
        names, first, inverse = np.unique(np.concatenate(names), return_index=True, return_inverse=True)
        counts, tokens = np.concatenate(counts), np.concatenate(tokens)
        stays = np.zeros(len(counts), dtype=bool)
        stays[first] = True  # copies of a set bring the same tokens
        tokens, of = tokens[np.repeat(stays, counts)], np.repeat(inverse[stays], counts[stays])
        distinct, back, found = np.unique(tokens, return_inverse=True, return_counts=True)
        shared = ((found > 1) | np.isin(distinct, np.concatenate(noticed)))[back]
        found = np.bincount(of[shared], minlength=len(names)).astype(np.int32)
        told, sums = np.concatenate([*told, names[found > 0]]), np.concatenate([*sums, found[found > 0]])
        dest = _dealt(told, parts)
        order = np.argsort(dest, kind="stable")
        cuts = np.searchsorted(dest[order], np.arange(parts + 1))
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            part = order[cuts[i] : cuts[i + 1]]
            columns = [pa.array([i], pa.int32()), pa.array([told[part].tobytes()]), pa.array([sums[part].tobytes()])]
            yield pa.RecordBatch.from_arrays(columns, names=["dest", "sets", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        for batch in batches:
            names += [np.frombuffer(p.as_buffer(), np.uint64) for p in batch.column("sets")]
            counts += [np.frombuffer(p.as_buffer(), np.int32) for p in batch.column("counts")]
        names, inverse = np.unique(np.concatenate(names), return_inverse=True)
        sums = np.zeros(len(names), np.int64)
        np.add.at(sums, inverse, np.concatenate(counts))
        yield pa.RecordBatch.from_arrays([pa.array(signed(names)), pa.array(sums)], names=["name", "shared"])

    packed = docs.select(F.col(text).alias("_text")).mapInArrow(send, _PACK)
    counted = packed.repartitionById(parts, F.col("dest")).mapInArrow(count, "dest int, sets binary, counts binary")
    return counted.repartitionById(parts, F.col("dest")).mapInArrow(total, "name long, shared long")


def _suspects(docs: DataFrame, named: DataFrame, text: str, doc_id: str, shingle: int, percent: int, parts: int) -> DataFrame:
    """(_text): one text of every set that may have a partner. Such a set has all but n - ceil(percent n / 100) of its
    tokens in common with it, so at most as many of its sampled tokens are in no other set. The list of them grows
    with the input, so texts and list are exchanged at any size and nothing is broadcast."""
    sums = _sampled_shared(docs, text, shingle, max(1, parts // SAMPLE))
    sets = named.filter("n > 0").groupBy("name").agg(F.min(F.struct("_id", "_th")).alias("row"), F.max("n").alias("n"), F.max("m").alias("m"))
    may = F.col("m") - F.coalesce("shared", F.lit(0)) <= F.floor((100 - percent) * F.col("n") / 100)
    rows = settle(sets.join(sums, "name", "left").filter(may).select("row._id", "row._th"))
    given = docs.select(F.col(doc_id).cast("long").alias("_i"), F.xxhash64(F.col(text)).alias("_t"), F.col(text).alias("_text"))
    return given.join(rows.hint("merge"), given["_i"].eqNullSafe(rows["_id"]) & (given["_t"] == rows["_th"]), "left_semi").select("_text")


def _tokens_by_range(texts: DataFrame, shingle: int, parts: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, sizes, tokens, of in _distinct_sets(batches, shingle):
            distinct, inverse, found = np.unique(tokens, return_inverse=True, return_counts=True)
            common = (found >= COMMON)[inverse]
            some = ~common
            yield from _packs(_dealt(tokens[some], parts), names, sizes, of[some], tokens[some], None, _SOME)
            if common.any():
                yield from _packs(_dealt(names[of[common]], parts), names, sizes, of[common], tokens[common], np.full(common.sum(), COMMON, np.uint8), _DIRECT)
                told = distinct[found >= COMMON]
                yield from _packs(_dealt(told, parts), names, sizes, np.zeros(len(told), np.int64), told, None, _NOTICE)

    return texts.mapInArrow(work, _PACK)


class _Gathered:
    """The packs that came to one task, side by side."""

    def __init__(self) -> None:
        self.rows: dict[str, list[np.ndarray]] = {c: [] for c in ("sets", "sizes", "counts", "tokens", "ranks")}

    def add(self, row: dict) -> None:
        for c, kind in (("sets", np.uint64), ("sizes", np.int32), ("counts", np.int32), ("tokens", np.uint64), ("ranks", np.uint8)):
            self.rows[c].append(np.frombuffer(row[c], kind))

    def columns(self) -> tuple[np.ndarray, ...]:
        kinds = (np.uint64, np.int32, np.int32, np.uint64, np.uint8)
        return tuple(np.concatenate([*v, np.zeros(0, k)]) for v, k in zip(self.rows.values(), kinds, strict=True))


def _shared_by_set(packed: DataFrame, parts: int) -> DataFrame:
    """Each range of tokens tells the sets their tokens that are in another set too, and how rare these are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, notices = _Gathered(), []
        for batch in batches:
            kinds = np.asarray(batch.column("kind"))
            if (kinds == _DIRECT).any():
                yield batch.filter(pa.array(kinds == _DIRECT))
            for row in batch.filter(pa.array(kinds != _DIRECT)).to_pylist():
                if row["kind"] == _NOTICE:
                    notices.append(np.frombuffer(row["tokens"], np.uint64))
                else:
                    held.add(row)
        names, sizes, counts, tokens, _ = held.columns()
        _, once = np.unique(names, return_index=True)  # copies of a set bring the same tokens
        stays = np.zeros(len(names), dtype=bool)
        stays[once] = True
        tokens, of = tokens[np.repeat(stays, counts)], np.repeat(np.cumsum(stays) - 1, np.where(stays, counts, 0))
        names, sizes = names[stays], sizes[stays]
        distinct, inverse, found = np.unique(tokens, return_inverse=True, return_counts=True)
        ranks = np.minimum(found, COMMON)
        ranks[np.isin(distinct, np.concatenate([*notices, np.zeros(0, np.uint64)]))] = COMMON
        ranks = ranks[inverse].astype(np.uint8)
        shared = ranks > 1
        yield from _packs(_dealt(names[of[shared]], parts), names, sizes, of[shared], tokens[shared], ranks[shared], _DIRECT)

    return packed.repartitionById(parts, F.col("dest")).mapInArrow(work, _PACK)


def _sets(shared: DataFrame, percent: int, parts: int) -> DataFrame:
    """(name, n, lone, tokens, prefix, others, begins) of the sets that may have a partner: ``tokens`` are those that
    another set has too, ``prefix`` the first of them by the first order, without the lone tokens that precede them,
    ``others`` 32 bits of each of the first by the other orders, ``begins`` the tokens that name hubs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Gathered()
        for batch in batches:
            for row in batch.to_pylist():
                held.add(row)
        names, sizes, counts, tokens, ranks = held.columns()
        if not len(tokens):
            return
        of = np.repeat(np.arange(len(names)), counts)
        order = np.lexsort((tokens, names[of]))
        of, tokens, ranks = of[order], tokens[order], ranks[order]
        name = names[of]
        new = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (name[1:] != name[:-1])))
        of, tokens, ranks, name = of[new], tokens[new], ranks[new], name[new]
        first = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
        ends = np.concatenate((first[1:], [len(name)]))
        n, mine = sizes[of[first]].astype(np.int64), ends - first
        may = np.flatnonzero(100 * mine >= percent * n)
        for part in np.array_split(may, len(may) // 256 + 1):
            texts, prefix, others, begins = [], [], [], []
            for i in part.tolist():
                own, rank = tokens[first[i] : ends[i]], ranks[first[i] : ends[i]]
                long = mine[i] + percent * n[i] // -100 + 1
                texts.append(own.tobytes())
                by_order = [own[np.lexsort((mix(own ^ salt), rank))[:long]] for salt in _SALTS[:ORDERS]]
                prefix.append(signed(by_order[0]).tolist())
                others.append([p.astype(np.uint32).tobytes() for p in by_order[1:]])
                least = [own[[np.argmin(mix(own ^ salt))]] for salt in _HUB_SALTS]
                begins.append([signed(p[:AHEAD]).tolist() for p in by_order + least])
            columns = [pa.array(signed(name[first[part]])), pa.array(n[part]), pa.array(n[part] - mine[part]), pa.array(texts, pa.binary())]
            columns += [pa.array(prefix, pa.list_(pa.int64())), pa.array(others, pa.list_(pa.binary())), pa.array(begins, pa.list_(pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, names=["name", "n", "lone", "tokens", "prefix", "others", "begins"])

    schema = "name long, n long, lone long, tokens binary, prefix array<long>, others array<binary>, begins array<array<long>>"
    return shared.repartitionById(parts, F.col("dest")).mapInArrow(work, schema)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (u, v) of ``pairs`` whose similarity reaches the threshold. Shared tokens are all that two sets can share."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.asarray(batch.column("n_u")) + np.asarray(batch.column("n_v"))
            both = [len(np.intersect1d(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), assume_unique=True)) for a, b in zip(batch.column("t_u"), batch.column("t_v"), strict=True)]
            both = np.array(both, dtype=np.int64)
            linked = pa.array(100 * both >= percent * (n - both))
            yield batch.select(["u", "v"]).filter(linked)

    for side in ("u", "v"):
        pairs = pairs.join(sets.select(F.col("name").alias(side), F.col("n").alias(f"n_{side}"), F.col("tokens").alias(f"t_{side}")), side)
    return pairs.mapInArrow(work, "u long, v long")


def _stars(sets: DataFrame) -> DataFrame:
    """(u, v): a set and the hub of the sets that have one of its first tokens, by any order or by hash alone, as a
    first token too. Tokens of one rarity come first in a crowd of near copies only if no member has a rarer one;
    by hash alone two sets begin alike about as often as they are alike."""
    begins = F.flatten(F.transform("begins", lambda p, i: F.transform(p, lambda t: F.struct(i.alias("o"), t.alias("token")))))
    rows = sets.select("name", "lone", F.explode(begins).alias("k")).select("name", "lone", "k.o", "k.token")
    hubs = rows.groupBy("o", "token").agg(F.min(F.struct("lone", "name")).alias("hub"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    met = rows.join(hubs, ["o", "token"]).select(F.col("name").alias("u"), F.col("hub.name").alias("v")).filter("u <> v")
    return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _sharing(prefixes: list[np.ndarray], lo: int, hi: int) -> np.ndarray:
    """Which of the sets lo..hi share a token of ``prefixes`` with which of all, as a matrix."""
    sizes = [len(p) for p in prefixes]
    distinct, inverse, found = np.unique(np.concatenate(prefixes), return_inverse=True, return_counts=True)
    twice = found > 1
    member, column = np.repeat(np.arange(len(sizes)), sizes)[twice[inverse]], (np.cumsum(twice) - 1)[inverse][twice[inverse]]
    out = np.zeros((hi - lo, len(sizes)), dtype=bool)
    for first in range(0, int(twice.sum()), 1024):
        part = (column >= first) & (column < first + 1024)
        has = np.zeros((len(sizes), 1024), dtype=np.float32)
        has[member[part], column[part] - first] = 1
        out |= has[lo:hi] @ has.T > 0
    return out


def _pairs(name: np.ndarray, root: np.ndarray, n: np.ndarray, place: np.ndarray, prefixes: list[list[np.ndarray]], percent: int) -> list[np.ndarray]:
    """Candidates (u, v) among sets with one token in common. The first of ``prefixes`` ends before that token: a pair
    is formed at its first common token only. The others are whole: the pair must meet in each of them."""
    found = []
    for lo in range(0, len(name), 256):
        at = slice(lo, lo + 256)
        hi = min(lo + 256, len(name))
        left = np.minimum.outer((n - place)[at], n - place)  # the most that they can share from this token on
        may = (root[at, None] != root) & ((100 + percent) * left >= percent * (n[at, None] + n)) & (name[at, None] < name)
        for i, own in enumerate(prefixes):
            if may.any():
                may &= _sharing(own, lo, hi) == (i > 0)
        x, y = np.nonzero(may)
        found.append(np.stack((name[x + lo], name[y])))
    return found


def _crossing(sets: DataFrame, roots: DataFrame, percent: int, bucket: int) -> DataFrame:
    """(u, v): sets of different components that share a prefix token under every order. The first order finds them,
    the prefixes by the others come along, so that the filters are intersected before a pair is formed. Of a token by
    another order 32 bits are enough: equal ones of unequal tokens let a pair pass that verification drops."""
    known = sets.join(roots.select(F.col("v").alias("name"), "root"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    rows = known.select("name", "root", F.posexplode("prefix").alias("j", "token"))
    opened = rows.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("c")).filter("a <> b")
    opened = opened.select("token", F.ceil(F.col("c") / bucket).cast("int").alias("m"))
    open_rows = rows.join(opened, "token").withColumn("i", F.pmod(F.xxhash64("name"), F.col("m")))
    dealt = open_rows.select("name", "token", "j", "i", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("k"))
    group = F.xxhash64("token", F.least("i", "k"), F.greatest("i", "k"))  # a shared hash only mixes in pairs that verification drops
    joined = dealt.select("name", "j", group.alias("g")).join(known.select("name", "root", "n", "lone", "prefix", "others"), "name")
    place, before = (F.col("lone") + F.col("j")).alias("place"), F.slice("prefix", 1, F.col("j")).alias("before")
    grouped = joined.select("g", "name", "root", "n", place, before, "others").repartition("g").sortWithinPartitions("g")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(rows: np.ndarray, prefixes: list[list[np.ndarray]]) -> pa.RecordBatch:
            starts = np.flatnonzero(np.concatenate(([True], rows[0, 1:] != rows[0, :-1]))).tolist()
            found = [p for a, b in zip(starts, [*starts[1:], rows.shape[1]], strict=True) if b - a > 1 for p in _pairs(*rows[1:, a:b], [q[a:b] for q in prefixes], percent)]
            u, v = np.concatenate([*found, np.zeros((2, 0), np.int64)], axis=1)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        held, tokens = np.zeros((5, 0), np.int64), [[] for _ in range(ORDERS)]
        for batch in batches:
            held = np.concatenate((held, np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("g", "name", "root", "n", "place")])), axis=1)
            before, others = batch.column("before"), batch.column("others").flatten()
            tokens[0] += np.split(np.asarray(before.flatten()), np.cumsum(np.asarray(before.value_lengths()))[:-1]) if len(before) else []
            for i in range(1, ORDERS):
                tokens[i] += [np.frombuffer(p.as_buffer(), np.uint32) for p in others[i - 1 :: ORDERS - 1]]
            end = int(np.searchsorted(held[0], held[0, -1], "left")) if held.size else 0  # the last group may go on in the next batch
            if end:
                yield answer(held[:, :end], [t[:end] for t in tokens])
            held, tokens = held[:, end:], [t[end:] for t in tokens]
        if held.size:
            yield answer(held, tokens)

    return grouped.mapInArrow(work, "u long, v long").distinct()


def linked(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, percent: int = 85, bucket: int = BUCKET, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The sets of the rows (_id, _th, name, n), and verified links (u, v) between sets that connect all that are
    connected. ``parts``: ranges of tokens, by default as many as the session's shuffle partitions, so that one task's
    tokens fit its memory."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = settle(_named(docs, text, doc_id, shingle))
    packed = _tokens_by_range(_suspects(docs, named, text, doc_id, shingle, percent, parts), shingle, parts)
    sets = settle(_sets(_shared_by_set(packed, parts), percent, parts))
    near = settle(_verified(_stars(sets), sets, percent))
    rest = settle(_verified(settle(_crossing(sets, components(near), percent, bucket)), sets, percent))
    return named.drop("m"), near.unionByName(rest)


def join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, percent: int = 85, bucket: int = BUCKET, parts: int | None = None) -> DataFrame:
    """Per row of ``docs``: _id, _th (hash of the text), n (size of its set), name and root (its set and one that stands
    for the component) and component_id."""
    named, links = linked(docs, text, doc_id, shingle, percent, bucket, parts)
    roots = components(links).select(F.col("v").alias("name"), "root")
    distinct = named.filter("n > 0").groupBy("name").agg(F.min("_id").alias("low"))
    known = settle(distinct.join(roots, "name", "left").select("name", "low", F.coalesce("root", "name").alias("root")))
    ids = known.groupBy("root").agg(F.min("low").alias("component_id"))
    table = known.join(ids, "root").select("name", "root", "component_id")
    lone: Column = F.col("n") == 0
    return named.join(table, "name", "left").select("_id", "_th", "n", "name", F.when(~lone, F.col("root")).alias("root"), F.when(lone, F.col("_id")).otherwise(F.col("component_id")).alias("component_id"))
