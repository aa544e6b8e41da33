"""Benchmark decontamination by winnowing.

Both sides are cut into words; of every ``width`` neighbouring k-word hashes the smallest is kept as a fingerprint.
Since k + width - 1 is the window length, any shared run of that many words holds a fingerprint that both sides
keep: no shared window is missed. Fingerprints are joined (Spark chooses how: the benchmark's side is broadcast only
while its measured size is under the session's threshold), each meeting names a document, an item and how far they
are shifted, and every such alignment is extended word by word over the whole item. Runs of at least a window are
hits.

An item shorter than a window is one window of its own length, and is looked up by the hash of all its words: the
document side then also emits the hashes of its n-word runs, for the lengths n that such items have.

Defined results: null or empty texts have no words; a document without words is not contaminated; items whose id is
null take no part; items that share an id count once; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.llm.common import ALNUM, extended, fold_ascii, fold_bytes, gram_hashes, lists, own_names, row_id, settle, signed, slices, span_hashes, text_or_empty, winnow, word_bounds

WINDOW, GRAM = 13, 5


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = fold_bytes(data)
    starts, ends, doc = word_bounds(data, offsets, ALNUM)
    return span_hashes(data, starts, ends), doc


def _marks(tokens: np.ndarray, doc: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and their word numbers within the slice. Windows that cross documents choose nothing."""
    grams = gram_hashes(tokens, gram)
    chosen = winnow(grams, window - gram + 1)
    at = np.unique(chosen[doc[: len(chosen)] == doc[window - 1 :]]) if len(chosen) else chosen
    return grams[at], at


def _prints(df: DataFrame, ids: list[str], window: int, gram: int, short: list[int]) -> DataFrame:
    """``ids``, h, pos: fingerprints of ``_text`` and their word positions in it; for the lengths in ``short``, of
    every run of so many words too."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in slices(batch, "_text"):
                tokens, doc = _words(data, offsets)
                first = np.searchsorted(doc, np.arange(end - row + 1))
                hashes, at = _marks(tokens, doc, window, gram)
                found = [(hashes, at)]
                for n in short:
                    runs = gram_hashes(tokens, n) ^ np.uint64(n)
                    inside = np.flatnonzero(doc[: len(runs)] == doc[n - 1 :]) if len(runs) else np.zeros(0, np.int64)
                    found.append((runs[inside], inside))
                h, at = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
                order = np.argsort(doc[at], kind="stable")
                h, at = h[order], at[order]
                counts = np.bincount(doc[at], minlength=end - row)
                keys = [batch.column(c).slice(row, end - row) for c in ids]
                pos = (at - first[doc[at]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*keys, lists(signed(h), counts, pa.int64()), lists(pos, counts, pa.int32())], names=[*ids, "hs", "ps"])

    schema = ", ".join(f"{c} {t}" for c, t in df.dtypes if c in ids) + ", hs array<bigint>, ps array<int>"
    out = df.select(*ids, "_text").mapInArrow(work, schema)
    return out.select(*ids, F.explode(F.arrays_zip("hs", "ps")).alias("x")).select(*ids, F.col("x.hs").alias("h"), F.col("x.ps").alias("pos"))


def _runs(same: np.ndarray, least: int) -> np.ndarray:
    """Marks the members of every run of at least ``least`` neighbouring trues."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    out = np.zeros(len(same), dtype=bool)
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        if b - a >= least:
            out[a:b] = True
    return out


def _one_text(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    return _words(data, np.array([0, len(data)]))[0]


def _judge(df: DataFrame, window: int) -> DataFrame:
    """``df`` has the columns of documents, ``_text`` and ``_met``: items with the shifts at which they meet the text."""
    extra = "_n_words long, _n_hit long, _items array<string>, _spans array<struct<first:int,last:int>>"
    kept = [c for c in df.columns if c not in ("_text", "_met")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met_all = batch.column("_met")
            n_words, n_hit, items, spans = [], [], [], []
            for row, end, data, offsets in slices(batch, "_text"):
                tokens, doc = _words(data, offsets)
                first = np.searchsorted(doc, np.arange(end - row + 1))
                for d in range(end - row):
                    own = tokens[first[d] : first[d + 1]]
                    hit, ids = np.zeros(len(own), dtype=bool), set()
                    for met in met_all[row + d].as_py() or ():
                        item = _one_text(met["text"])
                        for shift in set(met["shifts"]):
                            lo, hi = max(0, shift), min(len(own), shift + len(item))
                            marked = _runs(own[lo:hi] == item[lo - shift : hi - shift], min(window, len(item)))
                            if marked.any():
                                hit[lo:hi] |= marked
                                ids.add(met["item"])
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                    n_words.append(len(own)), n_hit.append(int(hit.sum())), items.append(sorted(ids))
                    spans.append([{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)])
            span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            made = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *made], names=[*kept, "_n_words", "_n_hit", "_items", "_spans"])

    return df.mapInArrow(work, extended(df.select(*kept), extra))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """All columns of ``docs``, and ``_n_words``, ``_n_hit``, ``_items`` (ids as sorted strings), ``_spans`` (hit word
    ranges), ``_contaminated`` (at least a twentieth of the words are hit)."""
    docs = own_names(docs)
    given = benchmark.filter(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("_text"))
    items = settle(given.distinct())
    # Items may share an id but not a text, so a text has a number of its own.
    items = items.withColumn("_no", F.xxhash64("item", "_text"))
    words = F.filter(F.split(fold_ascii(text_or_empty("_text")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    items = items.withColumn("_n", F.size(words))
    short = sorted(r["_n"] for r in items.select("_n").filter(F.col("_n").between(1, window - 1)).distinct().collect())  # fewer than ``window``
    marks = _prints(items, ["_no"], window, gram, [])
    for n in short:  # an item of n words is one run of n words
        marks = marks.union(_prints(items.filter(F.col("_n") == n), ["_no"], window, gram, [n]))
    marks = settle(marks.distinct().withColumnRenamed("pos", "item_pos"))
    named = docs.select(*row_id(doc_id, text), F.col(text).alias("_text"))
    found = _prints(named, ["_id", "_th"], window, gram, short).join(marks, "h")
    shifts = found.groupBy("_id", "_th", "_no").agg(F.collect_set(F.col("pos") - F.col("item_pos")).alias("shifts"))
    met = shifts.join(items, "_no").groupBy("_id", "_th").agg(F.collect_list(F.struct("item", F.col("_text").alias("text"), "shifts")).alias("_met"))
    known = docs.withColumns({"_i": F.col(doc_id), "_t": F.xxhash64(F.col(text)), "_text": F.col(text)})
    joined = known.join(met, known["_i"].eqNullSafe(met["_id"]) & (known["_t"] == met["_th"]), "left")
    judged = _judge(joined.select(*[known[c] for c in docs.columns], "_text", "_met"), window)
    return judged.withColumn("_contaminated", (F.col("_n_hit") > 0) & (F.col("_n_hit") * 20 >= F.col("_n_words")))
