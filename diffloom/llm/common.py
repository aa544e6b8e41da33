"""What the operators share: row identity, lineage cuts, and whole-batch text arithmetic with numpy.

Text arithmetic works on the bytes of many documents at once. A slice of an Arrow batch is one byte buffer; a
table of 256 flags says which bytes belong to words; word hashes come from one running sum, so no word is ever a
Python object. Documents never share a word, k-gram or window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from diffloom.session import cut

SPACE = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text worked on at once; a single longer document is worked on alone.
SLICE_BYTES = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32  # A-Z
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[list(SPACE)] = False
ALNUM = np.zeros(256, dtype=bool)  # digits, a-z and every byte of a non-ASCII character
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_OWN = set(
    "_id _th _i _t _n _no _text _all _hit _cuts _lines _dropped _kept _met _covered _batch _lang _score _evidence _base _spans _items _contaminated "
    "_n_words _n_hit _n_removed _n_bytes _n_email _n_ip _n_card _n_phone".split()
)

_BASE, OTHER_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # any two odd numbers


def settle(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back. The finished job's shuffle files are of no more use;
    a hint to the driver's collector lets Spark's cleaner remove them now rather than at some later time."""
    out = cut(df)
    del df
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def discard(*settled: DataFrame) -> None:
    """Deletes tables that ``settle`` wrote. Only for those that nothing unsettled is built on any more."""
    for df in settled:
        context = df.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def own_names(docs: DataFrame) -> DataFrame:
    """``docs`` without the columns whose names the operators use for themselves: all begin with an underscore. A
    caller that must keep such a column packs its row into one struct first, as the pipeline does."""
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in _OWN])


def extended(docs: DataFrame, ddl: str) -> StructType:
    """The schema of ``docs`` followed by the columns of ``ddl``."""
    return StructType(docs.schema.fields + StructType.fromDDL(ddl).fields)


def fold_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def row_id(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """``_id`` and ``_th``: a row of documents is known by its id and a hash of its text, so rows that share an id
    but not the text stay apart, and repeated rows share one answer."""
    return [F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_th")]


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on ``_id`` and ``_th``; a null id equals a null id."""
    return left["_id"].eqNullSafe(right["_id"]) & (left["_th"] == right["_th"])


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, bytes, offsets) for runs of rows of about ``limit`` bytes. Null texts are empty."""
    texts = batch.column(column)
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64 over all others (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def fold_bytes(data: np.ndarray) -> np.ndarray:
    return _FOLD[data]


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and document (0, 1, ... within the slice) of every word."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = is_word[data]
    breaks = np.zeros(n + 1, dtype=bool)
    breaks[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | breaks[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | breaks[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hasher(data: np.ndarray, base: int = _BASE) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function from spans to 64-bit hashes of data[start:end], all from one running sum. Another odd ``base``, another
    hash."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), base), out=sums[1:], dtype=np.uint64)
    undo = powers(len(data) + 1, pow(base, -1, 1 << 64))
    return lambda starts, ends: mix((sums[ends] - sums[starts]) * undo[starts] + (ends - starts).astype(np.uint64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    return span_hasher(data, base)(starts, ends)


def rolling_hashes(data: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
    """A 64-bit hash of data[i:i+width] for each i: strings of twice the length are made of two halves, log2(width) times."""
    if len(data) < width:
        return np.zeros(0, dtype=np.uint64)
    part, out, taken, size = data.astype(np.uint64) + np.uint64(1), None, 0, 1
    while size <= width:
        if width & size:
            out = part if out is None else out[:-size] * np.uint64(pow(base, size, 1 << 64)) + part[taken:]
            taken += size
        if 2 * size <= width:
            part = part[:-size] * np.uint64(pow(base, size, 1 << 64)) + part[size:]
        size *= 2
    return mix(out)


def gram_hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    """A hash of tokens[i:i+k] for each i; the caller masks grams that cross documents."""
    n = len(tokens) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(_BASE) + tokens[j : j + n]
    return mix(out)


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """min(values[i:i+width]) for each i, in log2(width) passes."""
    done, out = 1, values
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of every ``width`` neighbouring gram hashes. The order is that of the
    hash's upper half, then of the position, which the lower half holds."""
    if len(grams) < width:
        return np.zeros(0, dtype=np.int64)
    packed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    return (window_min(packed, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from concatenated values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def anchors(grams: np.ndarray, doc: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window dedup's common ground. Every window of ``window`` tokens inside a document picks its smallest gram;
    equal windows pick it at the same place. Returns the picked positions and the first and last window start that
    pick each: neighbouring windows that share their pick are one context."""
    chosen = winnow(grams, window - gram + 1)
    starts = np.flatnonzero(doc[: len(chosen)] == doc[window - 1 :]) if len(chosen) else np.zeros(0, np.int64)
    if not len(starts):
        return starts, starts, starts
    at = chosen[starts]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1))))
    return at[new], starts[new], starts[np.concatenate((new[1:] - 1, [len(starts) - 1]))]


def later_than(first: Column) -> Column:
    """The row's place (_id, _th, lo) comes after ``first``."""
    return F.struct("_id", "_th", "lo") > first


def later_windows(windows: DataFrame, keys: list[str]) -> DataFrame:
    """(_id, _th, lo) of the windows that do not start first among those with equal ``keys``."""
    firsts = windows.groupBy(*keys).agg(F.min(F.struct("_id", "_th", "lo")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return windows.join(firsts.drop("n"), keys).filter(later_than(F.col("first"))).select("_id", "_th", "lo")


def union_of(spans: list, width: int, length: int) -> np.ndarray:
    """Marks the tokens that windows starting in any of the (lo, hi) spans cover."""
    steps = np.zeros(length + 1, dtype=np.int64)
    if spans:
        lo, hi = np.array([s["lo"] for s in spans]), np.array([s["hi"] for s in spans])
        np.add.at(steps, lo, 1), np.add.at(steps, np.minimum(hi + width, length), -1)
    return np.cumsum(steps[:-1]) > 0


def with_spans(docs: DataFrame, spans: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``docs``, ``_text`` and ``_covered``: the (lo, hi) spans of window starts found for each row."""
    found = spans.groupBy("_id", "_th").agg(F.collect_list(F.struct("lo", "hi")).alias("_covered"))
    known = docs.withColumns({"_i": F.col(doc_id).cast("long"), "_t": F.xxhash64(F.col(text)), "_text": F.col(text)})
    joined = known.join(found, known["_i"].eqNullSafe(found["_id"]) & (known["_t"] == found["_th"]), "left")
    return joined.select(*[known[c] for c in docs.columns], "_text", "_covered")
