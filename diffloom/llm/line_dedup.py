"""Line dedup over levelled sorted runs of line hashes. DataFrame operations only.

The index of lines is a set of runs, each a table of (128-bit line hash, number of documents) sorted by hash.
Documents come in batches. A new batch counts its own lines, merge-anti-joins the runs' settled lines (those that
a run already knows to be in enough documents: more sightings change nothing), and adds the rest as a run of level
0. When a level holds ``fan_in`` runs they are compacted into one of the next level, which sums their counts. A
line that fills a third of a corpus is therefore counted once per task and leaves the stream after the first
compaction.

Defined results: a null or empty text is one empty line; empty keys are never dropped; rows that share a doc_id count as
one document; a null doc_id is a value like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffloom.llm.common import fold_ascii, own_names, row_id, settle, text_or_empty

KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return F.btrim(fold_ascii(line), F.lit(" \t\n\x0b\x0c\r"))


def hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def lines_of(text: Column) -> Column:
    return F.split(text_or_empty(text), "\n")


def _merged(runs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, runs).groupBy(*KEY).agg(F.sum("n").alias("n"))


def _run(df: DataFrame) -> DataFrame:
    return settle(df.sortWithinPartitions(*KEY))


def _sightings(docs: DataFrame, text: str, doc_id: str, batches: int) -> DataFrame:
    """(batch, h1, h2): one row for each line of each document. Rows that share an id are one document: theirs are made
    distinct, the others need no exchange before they are counted."""
    repeated = settle(docs.groupBy(F.col(doc_id).alias("_id")).count().filter("count > 1").select("_id"))
    same = docs[doc_id].eqNullSafe(repeated["_id"])
    keys = F.explode(F.array_distinct(F.transform(lines_of(F.col(text)), line_key))).alias("key")
    lone = docs.join(repeated, same, "left_anti").select(F.pmod(F.xxhash64(F.col(text)), F.lit(batches)).alias("batch"), keys)
    shared = docs.join(repeated, same, "left_semi").select(F.col(doc_id).alias("_id"), F.pmod(F.xxhash64(F.col(doc_id)), F.lit(batches)).alias("batch"), keys)
    of_row = lone.filter("key <> ''").select("batch", *hashed(F.col("key")))
    of_id = shared.filter("key <> ''").select("_id", "batch", *hashed(F.col("key"))).distinct().drop("_id")
    return of_row.unionByName(of_id)


def build_runs(docs: DataFrame, text: str = "text", min_docs: int = 10, batches: int = 4, fan_in: int = 2, doc_id: str = "doc_id") -> list[DataFrame]:
    """The runs after all batches. ``batches`` stands for the deliveries of a growing corpus."""
    counted = settle(_sightings(docs, text, doc_id, batches).groupBy("batch", *KEY).agg(F.count(F.lit(1)).alias("n")))
    levels: list[list[DataFrame]] = [[]]
    for batch in range(batches):
        own = counted.filter(F.col("batch") == batch).select(*KEY, "n")
        runs = [r for level in levels for r in level]
        if runs:
            settled = reduce(DataFrame.unionByName, runs).filter(F.col("n") >= min_docs).select(*KEY)
            own = own.join(settled.hint("merge"), KEY, "left_anti")
        levels[0].append(_run(own))
        for depth in range(len(levels)):
            if len(levels[depth]) < fan_in:
                break
            if depth + 1 == len(levels):
                levels.append([])
            levels[depth + 1].append(_run(_merged(levels[depth])))
            levels[depth] = []
    return [r for level in levels for r in level]


def frequent_lines(runs: list[DataFrame], min_docs: int = 10) -> DataFrame:
    return settle(_merged(runs).filter(F.col("n") >= min_docs).select(*KEY))


def drop_lines(docs: DataFrame, frequent: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All columns of ``docs``, and ``_lines`` (how many), ``_dropped`` (how many), ``_kept`` (the text that stays)."""
    lines = docs.select(*row_id(doc_id, text), F.posexplode(lines_of(F.col(text))).alias("pos", "line"))
    keyed = lines.select("_id", "_th", "pos", *hashed(line_key(F.col("line"))))
    hits = keyed.join(frequent, KEY, "left_semi").groupBy("_id", "_th").agg(F.sort_array(F.collect_set("pos")).alias("_hit"))
    known = docs.withColumns({"_i": F.col(doc_id), "_t": F.xxhash64(F.col(text))})
    joined = known.join(hits, known["_i"].eqNullSafe(hits["_id"]) & (known["_t"] == hits["_th"]), "left")
    joined = joined.withColumns({"_all": lines_of(F.col(text)), "_hit": F.coalesce("_hit", F.array().cast("array<int>"))})
    cuts = F.concat(F.array(F.lit(-1)), F.col("_hit"), F.array(F.size("_all")))
    # What stays lies between neighbouring cuts, so the work is linear in the lines.
    between = F.transform(
        F.sequence(F.lit(0), F.size("_hit")),
        lambda i: F.slice("_all", F.get(F.col("_cuts"), i) + 2, F.get(F.col("_cuts"), i + 1) - F.get(F.col("_cuts"), i) - 1),
    )
    joined = joined.withColumn("_cuts", cuts)
    return joined.select(
        *[known[c] for c in docs.columns],
        F.size("_all").cast("long").alias("_lines"),
        F.size("_hit").cast("long").alias("_dropped"),
        F.array_join(F.flatten(between), "\n").alias("_kept"),
    )


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = 10, batches: int = 4, fan_in: int = 2) -> DataFrame:
    """``docs`` and what line dedup makes of each row: ``_lines``, ``_dropped``, ``_kept``."""
    docs = own_names(docs)
    runs = build_runs(docs, text, min_docs, batches, fan_in, doc_id)
    return drop_lines(docs, frequent_lines(runs, min_docs), text, doc_id)
