"""Two tokenizers' tokens of the same text, aligned by merge-path partitioning.

Tokenizer A (byte-level BPE) encodes a blank and the text, tokenizer B (pieces with byte fallback) the text, to which it
puts a blank itself; both then cover the same bytes. The byte offsets at which tokens end are two ascending sequences,
and where both end the text falls into groups.

* Merge path: merging the ends of A and B is a path through a grid; its point on every diagonal is found by binary
  search, so the path falls into pieces of equal work that need nothing of each other. All pieces of a slice of texts
  advance in step, whatever the length of one text. A piece emits the places where both end; these, in the order of
  the pieces, close the groups, those that reach over pieces as well.
* Links are the pairs of A and B token within a group. Each slice tells once in how many of its documents it has an id
  pair; sums over slices are the pair's count in the corpus. The counts return to the slices by a join on the pair and
  meet the slice's own list of links, so that no table of pairs is broadcast and no text is read twice.

A is encoded by the merge ranks and the splitting pattern of its file, which must be the plain form in which ids ascend
with the merges; anything else is an error. The files are read by the driver and sent to the executors (2 MB).

Defined results: texts that are null or empty, or that either tokenizer does not give back byte for byte, have no tokens
and an empty listing; repeated rows count as documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.llm.common import settle, slices

TOKENIZERS, A_FILE, B_FILE = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"

#: What splits a text before the merges, as the byte-level tokenizer of A defines it (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Steps of one piece of the merge path.
PIECE = 256

#: Bytes of text that are aligned, and whose pairs are counted, together.
SLICE = 1 << 20

#: Links of a group beyond which its distinct ids are paired instead of its tokens.
WIDE_GROUP = 4096

MEASURES = ["n_a", "n_b", "n_groups", "n_links"]


def byte_letters() -> dict[str, int]:
    """The letters in which a byte-level vocabulary writes bytes: printable ones stand for themselves, the others are
    the code points from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def vocabulary_a(raw: bytes) -> list[bytes]:
    """The bytes of every id of a byte-level BPE file, special tokens left out."""
    file = json.loads(raw)
    model, first = file["model"], file["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space") and file["normalizer"] is None
    letters, special = byte_letters(), {t["content"] for t in file["added_tokens"]}
    ids = {t: i for t, i in model["vocab"].items() if t not in special}
    merged = [ids.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if not plain or None in merged or any(a >= b for a, b in zip(merged, merged[1:], strict=False)) or sorted(ids.values()) != list(range(len(ids))):
        raise ValueError("not a plain byte-level BPE whose ids ascend with its merges")
    return [bytes(letters[c] for c in t) for t, _ in sorted(ids.items(), key=lambda x: x[1])]


class Encoders:
    def __init__(self, a: bytes, b: bytes) -> None:
        import sentencepiece
        import tiktoken

        self.bytes_a = vocabulary_a(a)
        self.a = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks={t: i for i, t in enumerate(self.bytes_a)}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.bytes_b = [piece(i) for i in range(self.b.vocab_size())]
        self.length_a, self.length_b = (np.array([len(t) for t in v], dtype=np.int64) for v in (self.bytes_a, self.bytes_b))
        written_a, written_b = ([str(i).encode() for i in range(len(v))] for v in (self.bytes_a, self.bytes_b))
        #: Ids as they are listed: after a token of A comes "," or "|", after one of B ",", ";" or nothing.
        self.listed = [x + s for v, signs in ((written_a, (b",", b"|")), (written_b, (b",", b";", b""))) for s in signs for x in v]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B of every text; none for texts that are not given back."""
        a, b = [self.a.encode_ordinary(" " + t) if t else [] for t in texts], self.b.encode(texts, num_threads=1) if texts else []
        for i, t in enumerate(texts):
            raw = b" " + t.encode()
            if not t or b"".join(map(self.bytes_a.__getitem__, a[i])) != raw or b"".join(map(self.bytes_b.__getitem__, b[i])) != raw:
                a[i], b[i] = [], []
        return a, b


@lru_cache(maxsize=1)
def _encoders(a: bytes, b: bytes) -> Encoders:
    return Encoders(a, b)


def merge_path(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), ascending, with a[i] == b[j], of two strictly ascending sequences."""
    total = len(a) + len(b)
    diagonal = np.arange(0, total, piece)
    low, high = np.maximum(0, diagonal - len(b)), np.minimum(diagonal, len(a))
    while (low < high).any():  # the path's point on each diagonal; of equals a's comes first
        mid = (low + high) // 2
        going = low < high
        ahead = going & (a[np.minimum(mid, len(a) - 1)] <= b[np.clip(diagonal - 1 - mid, 0, len(b) - 1)]) if len(a) and len(b) else going & (len(b) == 0)
        low, high = np.where(ahead, mid + 1, low), np.where(going & ~ahead, mid, high)
    i, j = low, diagonal - low
    top = np.iinfo(np.int64).max
    a, b = np.concatenate((a, np.full(piece + 1, top))), np.concatenate((b, np.full(piece + 1, top - 1)))
    met, at = np.zeros((piece, len(diagonal)), dtype=bool), np.zeros((piece, len(diagonal)), dtype=np.int64)
    for step in range(min(piece, total)):
        x, y = a[i], b[j]
        met[step], at[step] = x == y, i
        first = x <= y
        i, j = i + first, j + ~first
    i = at.T[met.T]
    return i, np.searchsorted(b[: len(b) - piece - 1], a[i])


def listing(encoders: Encoders, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, last: np.ndarray) -> list[bytes]:
    """The ids of A and B in the order in which groups list them, with the signs between; ``last`` marks the groups
    that end a document."""
    ends_a = np.concatenate((group_a[1:] != group_a[:-1], [True]))[: len(a)]
    ends_b = np.concatenate((group_b[1:] != group_b[:-1], [True]))[: len(b)]
    size_a, size_b = len(encoders.bytes_a), len(encoders.bytes_b)
    code_a = a + size_a * ends_a
    code_b = 2 * size_a + b + size_b * np.where(ends_b, np.where(last[group_b], 2, 1), 0)
    order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
    return list(map(encoders.listed.__getitem__, np.concatenate((code_a, code_b))[order].tolist()))


def _products(a: np.ndarray, b: np.ndarray, count_a: np.ndarray, count_b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (document, A id, B id in one number) of the links of all groups, and how many links each stands for."""
    first_a, first_b = np.cumsum(count_a) - count_a, np.cumsum(count_b) - count_b
    links = count_a * count_b
    small = np.flatnonzero(links <= WIDE_GROUP)
    group = np.repeat(small, links[small])
    inner = np.arange(len(group)) - np.repeat(np.cumsum(links[small]) - links[small], links[small])
    i, j = first_a[group] + inner // count_b[group], first_b[group] + inner % count_b[group]
    keys, weights = [doc[group] << 34 | a[i] << 17 | b[j]], [np.ones(len(group), dtype=np.int64)]
    for g in np.flatnonzero(links > WIDE_GROUP).tolist():
        x, times_x = np.unique(a[first_a[g] : first_a[g] + count_a[g]], return_counts=True)
        y, times_y = np.unique(b[first_b[g] : first_b[g] + count_b[g]], return_counts=True)
        keys.append((doc[g] << 34 | x[:, None] << 17 | y).ravel()), weights.append(np.multiply.outer(times_x, times_y).ravel())
    keys, weights = np.concatenate(keys), np.concatenate(weights)
    if len(links) == len(small):
        keys.sort()
    else:
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)])
    return keys[new], np.add.reduceat(weights, new) if len(new) else weights


def align(encoders: Encoders, texts: list[str], piece: int = PIECE, digest: bool = False) -> dict[str, np.ndarray | list]:
    """The alignment of a slice of texts: measures and ``groups`` per text, and the links as a sparse matrix: ``pairs``
    (A id << 17 | B id), ``held`` (texts that have the pair), and per text ``entries`` of ``pair_at`` and ``times``."""
    ids_a, ids_b = encoders.encode(texts)
    n_a, n_b = (np.array([len(x) for x in ids], dtype=np.int64) for ids in (ids_a, ids_b))
    a, b = (np.array([i for x in ids for i in x], dtype=np.int64) for ids in (ids_a, ids_b))
    at_a, at_b = merge_path(np.cumsum(encoders.length_a[a]), np.cumsum(encoders.length_b[b]), piece)
    count_a, count_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
    doc = np.searchsorted(np.cumsum(n_a), at_a, "right")  # both tokenizers end where a text ends: no group crosses texts
    n_groups = np.bincount(doc, minlength=len(texts))
    links = np.zeros(len(texts), dtype=np.int64)
    np.add.at(links, doc, count_a * count_b)
    groups = np.arange(len(at_a))
    last = np.concatenate((doc[1:] != doc[:-1], [True]))[: len(doc)]
    written = listing(encoders, a, b, np.repeat(groups, count_a), np.repeat(groups, count_b), last)
    ends = np.cumsum(n_a + n_b).tolist()
    listed = [b"".join(written[e - n : e]) for e, n in zip(ends, (n_a + n_b).tolist(), strict=True)]
    if digest:
        listed = [hashlib.sha256(x).hexdigest().encode() if x else b"" for x in listed]
    keys, times = _products(a, b, count_a, count_b, doc)
    pairs, pair_at = np.unique(keys & ((1 << 34) - 1), return_inverse=True)
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": links, "groups": listed, "pairs": pairs,
        "held": np.bincount(pair_at, minlength=len(pairs)), "entries": np.bincount(keys >> 34, minlength=len(texts)), "pair_at": pair_at, "times": times,
    }


def _one(values: np.ndarray | list, kind: pa.DataType) -> pa.Array:
    """A list column of one row."""
    values = pa.array(values, kind) if not isinstance(values, pa.Array) else values
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


_SLICES = ", ".join(["slice long", "ids array<long>", "hashes array<long>", *[f"{m} array<long>" for m in MEASURES], "groups array<string>", "pairs array<long>", "held array<int>", "entries binary", "pair_at binary", "times binary"])
_RESULT = ", ".join(["_id long", "_th long", *[f"{m} long" for m in MEASURES], "groups string", "n_best long", "count_sum long"])


def aligned_slices(docs: DataFrame, text: str, doc_id: str, folder: str, digest: bool, slice_bytes: int) -> DataFrame:
    """One row for each slice of text: what ``align`` gives, with the ids and text hashes of its rows."""
    files = docs.sparkSession.sparkContext.broadcast(tuple(open(f"{folder}/{f}", "rb").read() for f in (A_FILE, B_FILE)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders, number = None, TaskContext.get().partitionId() << 32
        for batch in batches:
            for row, end, _, _ in slices(batch, "_text", slice_bytes):
                encoders = encoders or _encoders(*files.value)
                own = batch.slice(row, end - row)
                made = align(encoders, [t or "" for t in own.column("_text").to_pylist()], digest=digest)
                wide = [pa.array([made[c].astype("<i4").tobytes()], pa.binary()) for c in ("entries", "pair_at", "times")]
                columns = [pa.array([number]), _one(own.column("_id"), pa.int64()), _one(own.column("_th"), pa.int64()), *[_one(made[m], pa.int64()) for m in MEASURES]]
                columns += [_one(pa.array(made["groups"], pa.binary()).cast(pa.string()), pa.string()), _one(made["pairs"], pa.int64()), _one(made["held"], pa.int32()), *wide]
                yield pa.RecordBatch.from_arrays(columns, names=["slice", "ids", "hashes", *MEASURES, "groups", "pairs", "held", "entries", "pair_at", "times"])
                number += 1

    given = docs.select(F.col(doc_id).cast("long").alias("_id"), F.xxhash64(F.col(text)).alias("_th"), F.col(text).alias("_text"))
    return given.mapInArrow(work, _SLICES)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, count, best): in how many documents an id pair is linked, and whether no pair of its A id is in more."""
    counts = pairs.groupBy("pair").agg(F.sum("held").alias("count"))
    most = counts.groupBy(F.shiftright("pair", 17).alias("a")).agg(F.max("count").alias("most"))
    return counts.join(most, F.shiftright("pair", 17) == F.col("a")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align_tokens(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", folder: str = TOKENIZERS, digest: bool = False, slice_bytes: int = SLICE) -> DataFrame:
    """Per row of ``docs``: _id, _th (hash of the text), n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2``, with
    ``digest`` its SHA-256, without tokens empty), n_best (links whose pair is the most frequent of its A id) and
    count_sum (documents that have the pair, summed over the links)."""
    made = settle(aligned_slices(docs, text, doc_id, folder, digest, slice_bytes))
    own = made.select("slice", F.posexplode(F.arrays_zip("pairs", "held")).alias("at", "p")).select("slice", "at", F.col("p.pairs").alias("pair"), F.col("p.held").alias("held"))
    counts = settle(pair_counts(own.select("pair", "held")))
    found = own.select("slice", "at", "pair").join(counts, "pair").groupBy("slice").agg(F.collect_list(F.struct("at", "count", "best")).alias("found"))
    joined = made.drop("pairs", "held").join(found, "slice", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                entries, pair_at, times = (np.frombuffer(batch.column(c)[r].as_buffer(), "<i4").astype(np.int64) for c in ("entries", "pair_at", "times"))
                count, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if len(pair_at):
                    values = batch.column("found")[r].values
                    at = np.asarray(values.field("at"))
                    count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                    count[at], best[at] = np.asarray(values.field("count")), np.asarray(values.field("best")).astype(np.int64)
                ends = np.cumsum(entries)
                sums = []
                for per_pair in (best, count):
                    running = np.concatenate(([0], np.cumsum(per_pair[pair_at] * times)))
                    sums.append(pa.array(running[ends] - running[ends - entries], pa.int64()))
                columns = [batch.column(c)[r].values for c in ("ids", "hashes", *MEASURES, "groups")]
                yield pa.RecordBatch.from_arrays([*columns, *sums], names=["_id", "_th", *MEASURES, "groups", "n_best", "count_sum"])

    return joined.mapInArrow(work, _RESULT)
