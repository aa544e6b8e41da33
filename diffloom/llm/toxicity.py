"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found with block-max inverted indexes.

Terms are lower-cased runs of letters and their first four bytes (which catches inflected forms). The index holds a
bounded sample of labelled examples, about ``PER_CLASS`` of either label, with every term of theirs. Document
frequencies, and with them the inverse frequencies, which damp common terms, are counted over all documents. Examples
are in blocks of ``BLOCK``; each term knows its largest weight in every block that it stands in.
For a text, the sum of these maxima bounds the cosine of every example of a block: blocks are read best bound first,
and those whose bound is below the kth cosine found are skipped, so neighbours are exact.

The k neighbours vote with their cosine. A logistic curve, fitted on the examples' own votes with themselves left
out and weighted to the labels' true shares, turns vote and cosine into a probability. The neighbours are kept as
evidence.

Defined results: a null or empty text, and one without a known term, scores the labels' base rate; so does every text
when there is no example of both labels (0 without any label); repeated rows score alike; ties between neighbours go
to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffloom.llm.common import extended, lists, mix, own_names, signed, slices, span_hashes, word_bounds

PER_CLASS = 1000
BLOCK, NEIGHBOURS = 64, 15
STEM = 4
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_EXAMPLE = pa.schema([("_id", pa.int64()), ("_y", pa.int32()), ("_terms", pa.list_(pa.int64())), ("_found", pa.list_(pa.int64()))])


@dataclass
class Index:
    terms: np.ndarray  # sorted hashes
    idf: np.ndarray
    ids: np.ndarray  # of the examples
    toxic: np.ndarray
    start: np.ndarray  # where the cells of a term begin; a cell is a term and a block it stands in
    example: np.ndarray  # postings: example, by term, then example
    weight: np.ndarray
    most: np.ndarray  # cell: the largest weight
    block: np.ndarray | None = None  # cell: its block
    begin: np.ndarray | None = None  # cell: where its postings begin
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    rate: float = 0.0
    both: bool = False  # whether there are examples of both labels
    vectors: list = field(default_factory=list)  # of the examples, for the curve only


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes and their documents; words first, then stems."""
    starts, ends, doc = word_bounds(data, offsets, _LETTER)
    words = span_hashes(data, starts, ends)
    long = ends - starts > STEM
    stems = mix(span_hashes(data, starts[long], starts[long] + STEM) + np.uint64(5))
    return np.concatenate((words, stems)), np.concatenate((doc, doc[long]))


def lowered(texts: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pc.utf8_lower(texts)], names=["t"])


def _counts(hashes: np.ndarray, doc: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term number, occurrences), by document; unknown terms fall away."""
    if not len(terms) or not len(hashes):
        none = np.zeros(0, np.int64)
        return none, none, none
    at = np.searchsorted(terms, hashes).clip(max=len(terms) - 1)
    known = terms[at] == hashes
    both, n = np.unique(doc[known].astype(np.int64) * len(terms) + at[known], return_counts=True)
    return both // len(terms), both % len(terms), n


def _vectors(d: np.ndarray, t: np.ndarray, n: np.ndarray, idf: np.ndarray, docs: int) -> np.ndarray:
    """Unit weights of (document, term) cells."""
    w = (1 + np.log(n)) * idf[t]
    norm = np.sqrt(np.bincount(d, weights=w * w, minlength=docs))
    return w / np.where(norm > 0, norm, 1)[d]


def _ranges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each a to before its b, one range after the other, and the ranges' lengths."""
    n = b - a
    return np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum()), n


def neighbours(index: Index, t: np.ndarray, w: np.ndarray, k: int, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """The k examples with the largest cosine (above 0) and these cosines; ``leave`` is left out."""
    if not len(t):
        return np.zeros(0, np.int64), np.zeros(0)
    cell, n = _ranges(index.start[t], index.start[t + 1])
    of, block = np.repeat(w, n), index.block[cell]
    bound = np.bincount(block, weights=of * index.most[cell], minlength=-(-len(index.ids) // BLOCK))
    order = np.argsort(-bound, kind="stable")
    scores = np.zeros(len(index.ids))
    kth, at, step = 0.0, 0, 4
    while at < len(order):
        blocks = order[at : at + step]
        blocks = blocks[bound[blocks] * (1 + 1e-9) >= kth]
        if not len(blocks):
            break
        read = np.zeros(len(bound), dtype=bool)
        read[blocks] = True
        read = read[block]
        posting, n = _ranges(index.begin[cell[read]], index.begin[cell[read] + 1])
        scores += np.bincount(index.example[posting], weights=np.repeat(of[read], n) * index.weight[posting], minlength=len(scores))
        if leave >= 0:
            scores[leave] = 0
        if len(scores) > k:
            kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at, step = at + step, 1 << 20
    best = np.lexsort((index.ids, -scores))[:k] if len(scores) <= 4 * k else _best(scores, index.ids, k)
    best = best[scores[best] > 0]
    return best, scores[best]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    close = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return close[np.lexsort((ids[close], -scores[close]))[:k]]


def _signs(index: Index, best: np.ndarray, cosine: np.ndarray) -> tuple[float, float]:
    total = cosine.sum()
    vote = float((cosine * index.toxic[best]).sum() / total) if total > 0 else 0.0
    return vote, float(cosine.mean()) if len(cosine) else 0.0


def build_index(ids: np.ndarray, toxic: np.ndarray, hashes: np.ndarray, doc: np.ndarray, n: np.ndarray) -> Index:
    """Terms, examples and their counts; weights wait for the document frequencies. ``hashes``, ``doc`` (ascending)
    and ``n`` are the examples' distinct terms and how often each occurs."""
    terms, place = np.unique(hashes, return_inverse=True)
    index = Index(terms, np.ones(len(terms)), ids, toxic, *[np.zeros(0)] * 4)
    index.vectors = [(doc, place, n)]
    return index


def weigh(index: Index, frequency: np.ndarray, total: int, rate: float, k: int = NEIGHBOURS) -> Index:
    """Gives the index its weights, block maxima and curve."""
    n_docs, n_terms = len(index.ids), len(index.terms)
    index.idf = np.log((1 + total) / (1 + frequency))
    index.rate = rate
    d, t, n = index.vectors.pop()
    w = _vectors(d, t, n, index.idf, n_docs)
    order = np.lexsort((d, t))
    index.example, index.weight = d[order], w[order]
    blocks = max(1, -(-n_docs // BLOCK))
    cells, first = np.unique(t[order] * blocks + d[order] // BLOCK, return_index=True)
    index.block = (cells % blocks).astype(np.int32)
    index.begin = np.append(first, len(order))
    index.start = np.searchsorted(cells, np.arange(n_terms + 1) * blocks)
    index.most = np.maximum.reduceat(index.weight, first) if len(first) else np.zeros(0)
    index.both = len(np.unique(index.toxic)) == 2
    if index.both:
        first = np.searchsorted(d, np.arange(n_docs + 1))
        x = np.array([_signs(index, *neighbours(index, t[first[i] : first[i + 1]], w[first[i] : first[i + 1]], k, i)) for i in range(n_docs)])
        index.curve = _logistic(x, index.toxic, rate)
    return index


def _logistic(x: np.ndarray, y: np.ndarray, rate: float) -> tuple[float, float, float]:
    """Weighted logistic regression by Newton steps with a small ridge; classes weigh what they weigh in the labels."""
    a = np.column_stack((np.ones(len(x)), x))
    weight = np.where(y == 1, rate / max(1e-9, y.mean()), (1 - rate) / max(1e-9, 1 - y.mean()))
    c = np.zeros(a.shape[1])
    ridge = np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a @ c).clip(-30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (weight * (y - p)) - ridge @ c)
        c += step.clip(-5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(c.tolist())


def score_of(index: Index, best: np.ndarray, cosine: np.ndarray) -> float:
    if not len(best) or not index.both:
        return index.rate
    vote, mean = _signs(index, best, cosine)
    c = index.curve
    return float(1 / (1 + np.exp(-np.clip(c[0] + c[1] * vote + c[2] * mean, -30, 30))))


def _sample(docs: DataFrame, labels: DataFrame, trainable: Column, per_class: int, text: str, doc_id: str, label: str) -> tuple[pa.Table, float]:
    """Examples as (_id, _y, _terms, _found: their counts), by id, one for each, and the share of toxic labels among all trainable ones."""
    known = labels.filter(trainable & F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_y"))
    sizes = {r["_y"]: r["n"] for r in known.filter(F.col("_y").isin(0, 1)).groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return pa.table({"_id": [], "_y": [], "_terms": [], "_found": []}, schema=_EXAMPLE), 0.0
    draw = F.pmod(F.xxhash64(F.lit("example"), F.col("_id")), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("_y") == 1, min(1.0, per_class / sizes.get(1, 1))).otherwise(min(1.0, per_class / sizes.get(0, 1)))
    # About per_class of each, so this side is small by the bound itself.
    drawn = known.filter(F.col("_y").isin(0, 1) & (draw < share))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in slices(lowered(batch.column("_text")), "t"):
                h, d = terms_of(data, offsets)
                order = np.lexsort((h, d))
                h, d = h[order], d[order]
                first = np.flatnonzero(np.diff(h, prepend=0).astype(bool) | np.diff(d, prepend=-1).astype(bool))
                per_doc = np.bincount(d[first], minlength=end - row)
                made = [lists(x, per_doc, pa.int64()) for x in (signed(h[first]), np.diff(first, append=len(h)))]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(row, end - row) for c in ("_id", "_y")], *made], names=_EXAMPLE.names)

    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")).join(F.broadcast(drawn), "_id")
    # Of the texts of one id, a row drawn by hash; a null only if there is no other.
    one = rows.groupBy("_id", "_y").agg(F.min_by("_text", F.struct(F.col("_text").isNull(), F.xxhash64("_text"))).alias("_text"))
    found = one.mapInArrow(work, "_id long, _y int, _terms array<bigint>, _found array<bigint>").toArrow().cast(_EXAMPLE).sort_by("_id").combine_chunks()
    return found, sizes.get(1, 0) / sum(sizes.values())


def _frequencies(docs: DataFrame, index: Index, text: str) -> tuple[np.ndarray, int]:
    """Of each index term, in how many of all documents it stands; and how many documents there are. A task adds up
    its own documents and sends one row per term."""
    terms = index.terms

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, _, data, offsets in slices(lowered(batch.column("_text")), "t"):
                total += np.bincount(_counts(*terms_of(data, offsets), terms)[1], minlength=len(terms))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *found], pa.int32()), pa.array([rows, *total[found]], pa.int64())], names=["t", "n"])

    counted = docs.select(F.col(text).alias("_text")).mapInArrow(work, "t int, n long").groupBy("t").agg(F.sum("n").alias("n"))
    out, total = np.zeros(len(terms)), 0
    for r in counted.collect():  # the index's terms, which the sample bounds
        if r["t"] < 0:
            total = r["n"]
        else:
            out[r["t"]] = r["n"]
    return out, total


def fit(docs: DataFrame, labels: DataFrame, trainable: Column, per_class: int = PER_CLASS, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", k: int = NEIGHBOURS) -> Index:
    """An index of about ``per_class`` examples of either label among the label rows where ``trainable`` holds."""
    rows, rate = _sample(docs, labels, trainable, per_class, text, doc_id, label)
    hashes, n = (pc.list_flatten(rows[c]).to_numpy() for c in ("_terms", "_found"))
    doc = np.repeat(np.arange(len(rows)), pc.list_value_length(rows["_terms"]).to_numpy())
    index = build_index(rows["_id"].to_numpy(), rows["_y"].to_numpy(), hashes.view(np.uint64), doc, n)
    return weigh(index, *_frequencies(docs, index, text), rate, k)


def score(docs: DataFrame, index: Index, text: str = "text", k: int = NEIGHBOURS) -> DataFrame:
    """All columns of ``docs``, ``_score`` and ``_evidence`` (the neighbours: id, cosine, toxic)."""
    docs = own_names(docs)
    kept = docs.columns
    evidence = pa.list_(pa.struct([("id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, seen = [], []
            for row, end, data, offsets in slices(lowered(batch.column("_text")), "t"):
                d, t, n = _counts(*terms_of(data, offsets), index.terms)
                w = _vectors(d, t, n, index.idf, end - row)
                first = np.searchsorted(d, np.arange(end - row + 1))
                for a, b in zip(first[:-1], first[1:], strict=True):
                    best, cosine = neighbours(index, t[a:b], w[a:b], k)
                    scores.append(score_of(index, best, cosine))
                    seen.append([{"id": int(index.ids[i]), "cosine": float(c), "toxic": int(index.toxic[i])} for i, c in zip(best, cosine, strict=True)])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(scores, pa.float64()), pa.array(seen, evidence)], names=[*kept, "_score", "_evidence"])

    return docs.withColumn("_text", F.col(text)).mapInArrow(work, extended(docs, "_score double, _evidence array<struct<id:bigint,cosine:double,toxic:int>>"))
