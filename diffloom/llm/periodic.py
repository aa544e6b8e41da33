"""Periodic runs of words by block convolution.

A run is a stretch of words with smallest period q, at least ``max(min_length, 2 q)`` long, that no neighbouring word
extends. At the scale of blocks of B words the periods from 2 B to 4 B - 1 are looked for (B = 2: from 1). Such a run
holds an aligned block of B words whose copy q words later is in the run as well, so:

1. The texts of a slice are one sequence of words; a word's value depends on its text and document, so nothing matches
   across documents. Words get small codes, so small that a block's sum of squared differences stays below the
   transform's prime: it is exact, and zero only if all codes agree.
2. Every segment of B words is transformed once (number-theoretic, length 2 B). The products of a block's transform
   with those of two neighbouring segments, transformed back, are its correlations with B shifts at once; with running
   sums of squares they give the sum of squared differences. Zeros are the block's occurrences in the windows that
   follow, and their distances are candidate periods.
3. Candidates inside a run already known by a divisor of their distance are left out. The others are compared word by
   word, neighbouring blocks of one distance join, and what is left grows both ways to the first mismatch.
4. Stretches found by a multiple of their period have the same ends as the run itself: of equal ends the smallest
   distance stays.

Documents shorter than 4 B words leave before scale B; there is no longest period. The work is per row: nothing is
shuffled.

Defined results: a null or empty text has no runs and an empty collapsed text; repeated rows and ids are judged each by
itself; an empty table gives an empty result. Words are compared by a 64-bit hash inside one slice of text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffloom.llm.common import NOT_SPACE, extended, mix, own_names, slices, span_hashes, word_bounds

#: 2**16 + 1, whose remainders are two shifts away, serves transforms up to 2**16; the other prime, 15 * 2**27 + 1, longer ones.
FERMAT, LARGE = 65537, 2013265921
_GENERATOR = {FERMAT: 3, LARGE: 31}

#: Numbers of one transform that are worked on together.
CELLS = 1 << 20

RUN = "array<struct<start: long, length: long, period: long>>"
_RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def reduced(x: np.ndarray, prime: int) -> np.ndarray:
    """Congruent to ``x`` and small; for the Fermat prime not always the least remainder."""
    return (x & 0xFFFF) - (x >> 16) if prime == FERMAT else x % prime


@lru_cache(maxsize=64)
def _roots(half: int, prime: int, back: bool) -> np.ndarray:
    """The first ``half`` powers of a root of unity of order 2 * half, as a column."""
    root = pow(_GENERATOR[prime], (prime - 1) // (2 * half), prime)
    if back:
        root = pow(root, -1, prime)
    out = np.ones(1, dtype=np.int64)
    while len(out) < half:
        out = np.concatenate((out, out * pow(root, len(out), prime) % prime))
    return out[:, None]


@lru_cache(maxsize=64)
def _negated(size: int) -> np.ndarray:
    """Where the bit-reversed spectrum has the frequency -k, for each place of frequency k."""
    places, rev, half = np.arange(size), np.zeros(size, dtype=np.int64), size >> 1
    for b in range(size.bit_length() - 1):
        rev |= (places >> b & 1) * (half >> b)
    return rev[-rev % size]


def spectrum(segments: np.ndarray, prime: int) -> np.ndarray:
    """Transforms of the columns of ``segments`` (B, n), each followed by B zeros; frequencies in bit-reversed order."""
    half, n = segments.shape
    x = np.concatenate((segments, reduced(segments * _roots(half, prime, False), prime)))
    while half > 1:
        half //= 2
        pairs = x.reshape(-1, 2, half, n)
        low = pairs[:, 0] - pairs[:, 1]
        pairs[:, 0] += pairs[:, 1]
        if prime == LARGE:
            low, pairs[:, 0] = low % prime, pairs[:, 0] % prime
        pairs[:, 1] = reduced(low * _roots(half, prime, False), prime) if half > 1 else low
    return reduced(x, prime)


def sequence(x: np.ndarray, prime: int) -> np.ndarray:
    """Undoes ``spectrum``, without the division by the length: (size, n) in natural order. Works in place."""
    size, n = x.shape
    half = 1
    while half < size:
        pairs = x.reshape(-1, 2, half, n)
        high = pairs[:, 1] if half == 1 else reduced(pairs[:, 1] * _roots(half, prime, True), prime)
        pairs[:, 1], pairs[:, 0] = pairs[:, 0] - high, pairs[:, 0] + high
        if prime == LARGE:
            x %= prime
        half *= 2
    return x


def block_matches(values: np.ndarray, block: int, windows: range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, d): the aligned block of ``values`` at x has all its codes again d places on, d in [w, w + 1) * block for
    the w of ``windows``. Equal values have equal codes; different values may."""
    prime = FERMAT if 2 * block <= 1 << 16 else LARGE
    levels = isqrt((prime - 1) // block) + 1 if prime == FERMAT else 2
    codes = ((values >> np.uint64(40)) * np.uint64(levels) >> np.uint64(24)).astype(np.int64)
    last = windows[-1] + 2
    n = -(-len(codes) // block)
    step = max(1, CELLS // (2 * block) - last)
    undo = pow(2 * block, -1, prime)
    for first in range(0, n, step):
        upto = min(n, first + step)
        part = np.zeros((upto - first + last) * block, dtype=np.int64)
        own = codes[first * block : (upto + last) * block]
        part[: len(own)] = own
        segments = np.ascontiguousarray(part.reshape(-1, block).T)
        seen = spectrum(segments, prime)
        width = upto - first
        mirrored = seen[_negated(2 * block), :width]
        pair = seen[:, :-1].copy()  # of two neighbouring segments: the second is shifted by half the length
        pair[:block] += seen[:block, 1:]
        pair[block:] -= seen[block:, 1:]
        if prime == LARGE:
            pair %= prime
        squares = np.concatenate(([0], np.cumsum(part * part)))
        sums = np.ascontiguousarray((squares[block:] - squares[:-block])[:-1].reshape(-1, block).T)
        for w in windows:
            product = reduced(mirrored * pair[:, w : w + width], prime)
            same = reduced(sequence(product, prime)[:block] * undo, prime)
            left = sums[0, :width] + sums[:, w : w + width] - 2 * same
            left = reduced(left, prime)
            zero = (left == 0) | (left == FERMAT) if prime == FERMAT else left == 0
            shift, at = np.nonzero(zero)
            d = w * block + shift
            x = (first + at) * block
            good = (d > 0) & (x + d + block <= len(codes))
            if good.any():
                yield x[good], d[good]


def _reach(values: np.ndarray, at: np.ndarray, d: np.ndarray, sign: int) -> np.ndarray:
    """How many neighbouring places from ``at`` on, in the direction of ``sign``, have their value again d places on."""
    out = np.zeros(len(at), dtype=np.int64)
    going, width = np.arange(len(at)), 8
    while len(going):
        again = []
        for part in np.array_split(going, len(going) * width // CELLS + 1):
            places = (at[part] + sign * out[part])[:, None] + sign * np.arange(width)
            inside = (places >= 0) & (places + d[part, None] < len(values))
            safe = np.where(inside, places, 0)
            differs = ~inside | (values[safe] != values[np.where(inside, safe + d[part, None], 0)])
            found = differs.any(axis=1)
            out[part] += np.where(found, differs.argmax(axis=1), width)
            again.append(part[~found])
        going, width = np.concatenate(again), min(width * 4, 1 << 14)
    return out


def _equal_blocks(values: np.ndarray, x: np.ndarray, d: np.ndarray, block: int) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for lo in range(0, block, 64):
        alive = np.flatnonzero(out)
        for part in np.array_split(alive, len(alive) * 64 // CELLS + 1):
            places = x[part, None] + np.arange(lo, min(lo + 64, block))
            out[part] = (values[places] == values[places + d[part, None]]).all(axis=1)
    return out


def runs_of(values: np.ndarray, doc: np.ndarray, n_docs: int, min_length: int = 12) -> np.ndarray:
    """Rows (start, end, period) of all runs in ``values``, by start, then period. ``doc`` ascends; values of different
    documents differ."""
    sizes = np.bincount(doc, minlength=n_docs)
    known = np.zeros((0, 3), dtype=np.int64)
    block, need = 2, min_length
    while len(values) and sizes.max() >= need:
        live = np.flatnonzero(sizes[doc] >= need)
        own = values[live]
        if block < 1 << 26:
            windows = range(0, 4) if block == 2 else range(2, 4)
        else:  # no longer transform: more windows instead
            windows = range(2, int(sizes.max()) // (2 * block) + 1)
        for x, d in block_matches(own, block, windows):
            if len(known):
                order = np.argsort(known[:, 0], kind="stable")
                ends = known[order, 1]
                furthest = np.maximum.accumulate(ends)
                which = np.maximum.accumulate(np.where(ends == furthest, np.arange(len(ends)), 0))
                place = np.searchsorted(known[order, 0], live[x], "right") - 1
                over = order[which[np.maximum(place, 0)]]
                new = ~((place >= 0) & (known[over, 1] >= live[x] + block + d) & (d % known[over, 2] == 0))
                x, d = x[new], d[new]
            good = _equal_blocks(own, x, d, block)
            order = np.lexsort((x[good], d[good]))
            x, d = x[good][order], d[good][order]
            if not len(x):
                continue
            head = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (x[1:] != x[:-1] + block))))
            tail = x[np.concatenate((head[1:] - 1, [len(x) - 1]))] + block
            x, d = x[head], d[head]
            start = x - _reach(own, x - 1, d, -1)
            end = tail + _reach(own, tail, d, 1) + d
            long = end - start >= np.maximum(min_length, 2 * d)
            start, end, d = start[long], end[long], d[long]
            found = np.stack((live[start], live[end - 1] + 1, d), axis=1)
            known = np.concatenate((known, found))
            known = known[np.lexsort((known[:, 2], known[:, 1], known[:, 0]))]
            known = known[np.concatenate(([True], (known[1:, :2] != known[:-1, :2]).any(axis=1)))[: len(known)]]
        block, need = block * 2, block * 8
    return known[np.lexsort((known[:, 2], known[:, 0]))]


def find_runs(docs: DataFrame, text: str = "text", min_length: int = 12) -> DataFrame:
    """All columns of ``docs``; ``_runs``: (start, length, period) of every run in words, by start, then period; and
    ``_kept``: the words that are in no run after its first period, joined by one blank. Runs shorter than 5 words
    would escape the smallest blocks, so ``min_length`` is 5 at least."""
    if min_length < 5:
        raise ValueError("min_length must be 5 or more")
    docs = own_names(docs)
    kept = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in slices(batch, "_text"):
                starts, ends, doc = word_bounds(data, offsets, NOT_SPACE)
                values = mix(span_hashes(data, starts, ends) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                runs = runs_of(values, doc, end - row, min_length)
                first = np.searchsorted(doc, np.arange(end - row + 1))
                steps = np.zeros(len(doc) + 1, dtype=np.int64)
                np.add.at(steps, runs[:, 0] + runs[:, 2], 1), np.add.at(steps, runs[:, 1], -1)
                stays = np.cumsum(steps[:-1]) == 0
                of = doc[runs[:, 0]]
                offset = np.searchsorted(of, np.arange(end - row + 1)).astype(np.int32)
                columns = [runs[:, 0] - first[of], runs[:, 1] - runs[:, 0], runs[:, 2]]
                listed = pa.ListArray.from_arrays(pa.array(offset), pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(_RUN_TYPE)))
                texts, raw = [], data.tobytes()
                for i in range(end - row):
                    words, stay = raw[offsets[i] : offsets[i + 1]].split(), stays[first[i] : first[i + 1]]
                    texts.append(b" ".join(words if stay.all() else [w for w, s in zip(words, stay.tolist(), strict=True) if s]))
                own = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([*[own.column(c) for c in kept], listed, pa.array(texts, pa.binary()).cast(pa.string())], names=[*kept, "_runs", "_kept"])

    return docs.withColumn("_text", F.col(text)).mapInArrow(work, extended(docs, f"_runs {RUN}, _kept string"))


def words_of(text: Column) -> Column:
    """The words of a text, for column expressions; no words: an empty array."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def planted(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` in which one id of ten (by crc32) gets a periodic end: from word a on, word i becomes word
    a + (i - a) % p. Rows with a null id stay as they are. Works in the JVM, on the words of one row."""
    h = F.crc32(F.col(doc_id).cast("string"))
    g = F.floor(h / 10)
    chosen = docs.withColumn("_words", F.when(h % 10 == 0, words_of(F.col(text))))
    n = F.size("_words")
    chosen = chosen.withColumn("_a", F.when(n > 0, g % n).cast("int"))
    chosen = chosen.withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + g % 8))).cast("int"))
    turned = F.transform(F.col("_words"), lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get(F.col("_words"), F.col("_a") + (i - F.col("_a")) % F.col("_p"))))
    new = F.when(n > 0, F.array_join(turned, " ")).otherwise(F.col(text))
    return chosen.withColumn(text, new).drop("_words", "_a", "_p")
