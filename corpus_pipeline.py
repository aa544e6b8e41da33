"""The training-data pipeline: every stage takes (spark, docs, folder) and works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom.llm import decontaminate, language, line_dedup, packing, simhash
from diffloom.llm.common import settle

#: A document in which no language has this share of the words is rejected.
LEAST_LANGUAGE_SHARE = 0.4


def packed(docs: DataFrame) -> DataFrame:
    """What the stages read, and the whole row beside it: no name in it can meet a name of the operators."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops documents without a letter, and those in which no language stands out. Learns from the rows with a
    language, except the quarter held out for judging the operator."""
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    model = language.fit(docs, ~held_out & F.col("doc_id").isNotNull())
    judged = language.identify(packed(docs), model)
    return judged.filter((F.col("_lang") != "und") & (F.col("_score") >= LEAST_LANGUAGE_SHARE)).select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Takes lines found in ten documents or more out of all of them."""
    out = line_dedup.dedup_lines(packed(docs))
    new = {"text": F.col("_kept"), "n_chars": F.length("_kept").cast("long")}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest (doc_id, text hash) stays."""
    return simhash.keep_one(packed(docs)).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops documents of which a twentieth or more is benchmark text."""
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    return decontaminate.decontaminate(packed(docs), benchmark).filter(~F.col("_contaminated")).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row per piece of a document, with its place in a sequence."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near_duplicates", dedup_near),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Language and fingerprints are beyond SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, folder)
        if number < len(STAGES):
            docs = settle(docs)
    return docs
