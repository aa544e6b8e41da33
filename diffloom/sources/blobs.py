"""Blobs and text: decoding, content ids, lines and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from diffloom.functions import text as T

BINARY_HEAD = 8000  # fixed value: a NUL byte this early makes a blob binary


def read_blobs(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Files under a folder as blobs: ``(path, content, size, modified)``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return files.option("pathGlobFilter", glob).load(folder).select(
        "path", "content", F.col("length").alias("size"), F.col("modificationTime").alias("modified")
    )


def decode_blobs(blobs: DataFrame) -> DataFrame:
    """Adds ``is_binary`` (a NUL byte early on, or not UTF-8) and ``text`` (null when binary)."""
    nul = F.coalesce(F.expr(f"locate(x'00', substring(content, 1, {BINARY_HEAD}))"), F.lit(0)) > 0
    binary = nul | ~F.expr("is_valid_utf8(cast(content as string))")
    return blobs.withColumn("is_binary", binary).withColumn(
        "text", F.when(~F.col("is_binary"), F.col("content").cast("string"))
    )


def blob_id(content: Column) -> Column:
    """The id git gives bytes stored as a blob."""
    header = F.concat(
        F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "utf-8"),
        F.unhex(F.lit("00")),
    )
    return F.sha1(F.concat(header, content))


def with_blob_id(blobs: DataFrame) -> DataFrame:
    return blobs.withColumn("blob_id", blob_id(F.col("content")))


def check_blob_id(blobs: DataFrame, expected: str = "expected") -> DataFrame:
    """Adds ``matches``: the bytes are the ones an abbreviated id names; a missing id matches anything."""
    wanted = F.col(expected)
    return blobs.withColumn("matches", wanted.isNull() | blob_id(F.col("content")).startswith(wanted))


def explode_lines(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row per line, ``line_no`` from 1. The text column is not carried along."""
    rest = [c for c in texts.columns if c != text]
    return texts.select(*rest, F.posexplode(T.line_array(F.col(text))).alias("_at", "line")).select(
        *rest, (F.col("_at") + 1).alias("line_no"), F.col("line").alias("text")
    )


def _pieces(lines: DataFrame, pattern: str, measure) -> DataFrame:
    """The matches of a pattern in each line, ``_at`` from 0, with ``_start``: the measured length of all
    text before the match, by a running sum over the line."""
    rest = [c for c in lines.columns if c != "text"]
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    between = F.split("text", pattern, -1)
    zipped = F.posexplode(F.arrays_zip(found.alias("m"), between.alias("g"))).alias("_at", "_p")
    rows = lines.select(*rest, zipped).filter("_p.m is not null")
    upto = Window.partitionBy(*rest).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    length = measure(F.col("_p.g")) + measure(F.col("_p.m"))
    return rows.select(*rest, "_at", F.col("_p.m").alias("match"), (F.sum(length).over(upto) - measure(F.col("_p.m"))).alias("_start"))


def explode_tokens(lines: DataFrame) -> DataFrame:
    """One row per token of a line: ``tok_no`` from 1, ``token`` and its 0-based ``start``. The columns
    beside ``text`` identify the line."""
    rest = [c for c in lines.columns if c != "text"]
    rows = _pieces(lines, T.TOKEN, F.length)
    return rows.select(*rest, (F.col("_at") + 1).alias("tok_no"), F.col("match").alias("token"), F.col("_start").alias("start"))


def explode_words(lines: DataFrame) -> DataFrame:
    """One row per word of a line: its range in the line's whitespace-skipped characters."""
    rest = [c for c in lines.columns if c != "text"]
    rows = _pieces(lines, T.DISPLAY_WORD, lambda c: F.length(T.solid(c)))
    return rows.select(*rest, (F.col("_at") + 1).alias("place"), F.col("match").alias("word"), F.col("_start").alias("start"), (F.col("_start") + F.length("match")).alias("end"))
