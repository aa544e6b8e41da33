"""Substring dedup with repeated-phrase automata.

A word goes when a window of ``WINDOW`` words covers it whose words also start earlier. The way there:

1. Every window picks its smallest hash of ``GRAM`` neighbouring words; equal windows pick the same phrase at the same
   place. Phrases are counted over the corpus; those seen once settle all windows that picked them.
2. Documents are dealt into batches of about ``BATCH_BYTES``; each batch is told which of its phrases recur
   and finds their places among its own by hash. An Aho-Corasick automaton of the phrases at these places is streamed
   over the same slice of text and only checks them again. It is as large as a slice, however many phrases the corpus
   repeats.
3. Neighbouring windows that pick the same occurrence form a context. Equal contexts are collapsed by 128-bit hash:
   all but the earliest are covered. Only phrases with several contexts are opened into windows, of which all but the
   earliest of each hash are covered.

A group of copies of any size is an aggregate with partial sums, never a list.

Defined results: null texts have no words; order is by doc_id (null first), then by hash of the text, then by
position; repeated rows, alike in id and text, do not cover each other and share one answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.llm.common import (
    NOT_SPACE, OTHER_BASE, anchors, discard, extended, gram_hashes, later_than, later_windows, lists, own_names, settle, signed, slices, span_hashes, union_of, with_spans, word_bounds,
)

WINDOW, GRAM = 20, 8
BATCH_BYTES = 4 << 20


def _phrases(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """h, low, high, n: phrase hashes picked in ``_text``, the extremes of their contexts' hashes, and how often they
    occur, pre-counted per slice."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch, "_text"):
                starts, ends, doc = word_bounds(data, offsets, NOT_SPACE)
                tokens = span_hashes(data, starts, ends)
                grams = gram_hashes(tokens, gram)
                at, lo, hi = anchors(grams, doc, window, gram)
                order = np.argsort(grams[at], kind="stable")
                h, first, n = np.unique(grams[at[order]], return_index=True, return_counts=True)
                around = signed(span_hashes(tokens, lo, hi + window))[order]
                low, high = (f.reduceat(around, first) if len(first) else around for f in (np.minimum, np.maximum))
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(low), pa.array(high), pa.array(n)], names=["h", "low", "high", "n"])

    return docs.select("_text").mapInArrow(work, "h long, low long, high long, n long")


def _told(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """_batch, h: which phrases the documents of a batch pick; once per slice."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in slices(batch, "_text"):
                starts, ends, doc = word_bounds(data, offsets, NOT_SPACE)
                grams = gram_hashes(span_hashes(data, starts, ends), gram)
                at, _, _ = anchors(grams, doc, window, gram)
                group = batch.column("_batch").slice(row, end - row).to_numpy()[doc[at]]
                pairs = np.unique(np.stack((signed(grams[at]), group.astype(np.int64))), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[1], pa.int64()), pa.array(pairs[0])], names=["_batch", "h"])

    return docs.select("_batch", "_text").mapInArrow(work, "_batch long, h long")


def _automaton(texts: list[list[bytes]], doc: np.ndarray, at: np.ndarray, base: np.ndarray, gram: int) -> ahocorasick.Automaton:
    """Of the phrases that start at words ``at``; a phrase is its words with one blank after each."""
    machine = ahocorasick.Automaton()
    for d, i in zip(doc[at].tolist(), (at - base[doc[at]]).tolist(), strict=True):
        phrase = (b" ".join(texts[d][i : i + gram]) + b" ").decode()
        machine.add_word(phrase, len(phrase))
    machine.make_automaton()
    return machine


def _located(texts: list[list[bytes]], machine: ahocorasick.Automaton) -> np.ndarray:
    """Numbers of the words (over all texts) where a phrase starts."""
    words = np.fromiter((len(w.decode()) for t in texts for w in t), np.int64, sum(map(len, texts)))
    # One blank after each word and one line feed after each document, which no phrase contains.
    counts = np.array([len(t) for t in texts])
    begin = np.cumsum(words + 1) - words - 1 + np.repeat(np.arange(len(texts)), counts)
    stream = "".join((b" ".join(t) + b" \n" if t else b"\n").decode() for t in texts)
    if not len(begin):
        return begin
    hits = np.array(list(machine.iter(stream)), dtype=np.int64).reshape(-1, 2)
    starts = np.unique(hits[:, 0] - hits[:, 1] + 1)
    at = np.searchsorted(begin, starts).clip(max=len(begin) - 1)
    return at[begin[at] == starts]


def _contexts(docs: DataFrame, recurring: DataFrame, window: int, gram: int) -> DataFrame:
    """h, c, _id, _th, lo, n, ws: contexts of located phrases: their hash, place, windows and, where a phrase has
    several contexts, the hashes of these windows."""

    def work(rows: pa.Table, told: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        wanted = np.unique(told["h"].to_numpy()).view(np.uint64)
        several = np.unique(told.filter(told["several"])["h"].to_numpy()).view(np.uint64)
        made = [[] for _ in range(7)]
        for batch in rows.to_batches():
            for row, end, data, offsets in slices(batch, "_text"):
                starts, ends, doc = word_bounds(data, offsets, NOT_SPACE)
                tokens = span_hashes(data, starts, ends)
                grams = gram_hashes(tokens, gram)
                at, lo, hi = anchors(grams, doc, window, gram)
                known = np.flatnonzero(np.isin(grams[at], wanted))
                if not len(known):
                    continue
                base = np.searchsorted(doc, np.arange(end - row + 1))
                texts = [bytes(data[offsets[d] : offsets[d + 1]]).split() for d in range(end - row)]
                _, once = np.unique(grams[at[known]], return_index=True)
                found = _located(texts, _automaton(texts, doc, at[known[once]], base, gram))
                keep = np.isin(at, found)
                at, lo, hi = at[keep], lo[keep], hi[keep]
                c = span_hashes(tokens, lo, hi + window)
                counts = np.where(np.isin(grams[at], several), hi - lo + 1, 0)
                starts_of = np.repeat(lo - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                ws = span_hashes(tokens, starts_of, starts_of + window, OTHER_BASE)
                ids, ths = (batch.column(c).slice(row, end - row).take(pa.array(doc[lo])) for c in ("_id", "_th"))
                for column, values in zip(made, (pa.array(signed(grams[at])), pa.array(signed(c)), ids, ths, pa.array((lo - base[doc[lo]]).astype(np.int32)), pa.array((hi - lo + 1).astype(np.int32)), lists(signed(ws), counts, pa.int64())), strict=True):
                    column.append(values)
        kinds = (pa.int64(),) * 4 + (pa.int32(), pa.int32(), pa.list_(pa.int64()))
        return pa.table({n: pa.chunked_array(c, type=k) for n, c, k in zip(("h", "c", "_id", "_th", "lo", "n", "ws"), made, kinds, strict=True)})

    told = _told(docs, window, gram).join(recurring, "h").select(*[F.col(c).alias(c) for c in ("_batch", "h", "several")])
    own = docs.select(F.col("_batch").alias("_batch"), "_id", "_th", "_text")
    schema = "h long, c long, _id long, _th long, lo int, n int, ws array<bigint>"
    return own.groupBy("_batch").cogroup(told.groupBy("_batch")).applyInArrow(work, schema)


def repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, gram: int = GRAM, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(_id, _th, lo, hi): windows starting at words lo to hi also start earlier."""
    spark = docs.sparkSession
    named = docs.select(F.col(doc_id).cast("long").alias("_id"), F.xxhash64(F.col(text)).alias("_th"), F.col(text).alias("_text"))
    size = named.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    batches = max(-(-size // batch_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    named = named.withColumn("_batch", F.pmod(F.xxhash64("_id", "_th"), F.lit(batches)))
    counted = _phrases(named, window, gram).groupBy("h").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    recurring = settle(counted.filter("n > 1").select("h", (F.col("low") < F.col("high")).alias("several")))
    contexts = settle(_contexts(named, recurring, window, gram))
    # Phrase and context hash together have 128 bits.
    key = ["h", "c"]
    distinct = settle(contexts.groupBy(*key).agg(F.min(F.struct("_id", "_th", "lo")).alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("ws").alias("ws")))
    copies = contexts.select(*key, "_id", "_th", "lo", "n").join(distinct.filter("copies > 1").select(*key, "first"), key).filter(later_than(F.col("first")))
    covered = settle(copies.select("_id", "_th", "lo", (F.col("lo") + F.col("n") - 1).alias("hi")))
    opened = distinct.select("h", "first", F.posexplode("ws").alias("i", "w"))
    windows = settle(opened.select("h", "w", F.col("first._id").alias("_id"), F.col("first._th").alias("_th"), (F.col("first.lo") + F.col("i")).alias("lo")))
    discard(recurring, contexts, distinct)
    later = settle(later_windows(windows, ["h", "w"]).withColumn("hi", F.col("lo")))
    discard(windows)
    return covered.unionByName(later)


def drop_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, gram: int = GRAM, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """All columns of ``docs``, ``_n_words``, ``_n_removed`` and ``_kept``: the words that stay, joined by one blank."""
    docs = own_names(docs)
    spans = repeated_spans(docs, text, doc_id, window, gram, batch_bytes)
    joined = with_spans(docs, spans, text, doc_id)
    kept = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, texts = [], [], []
            for value, found in zip(batch.column("_text"), batch.column("_covered"), strict=True):
                words = (value.as_py() or "").encode().split()
                out = union_of(found.as_py() or [], window, len(words))
                total.append(len(words)), gone.append(int(out.sum()))
                texts.append(b" ".join(w for w, o in zip(words, out.tolist(), strict=True) if not o) if out.any() else b" ".join(words))
            made = [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *made], names=[*kept, "_n_words", "_n_removed", "_kept"])

    return joined.mapInArrow(work, extended(docs, "_n_words long, _n_removed long, _kept string"))
