"""Sink and source of result tables, and content-addressed ids of change sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def diffset_digests(changes: DataFrame) -> DataFrame:
    """An id per change set made from its changes alone: the same changes give the same id. The digest adds up the
    four words of each row's MD5, so a set of any size reduces by partial aggregates instead of being collected."""
    row = F.md5(F.concat_ws("\u0001", "path", F.coalesce("old_path", F.lit("")), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))))
    words = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return changes.groupBy("diffset_id").agg(F.md5(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *words)).alias("digest"))


def write_tables(tables: dict[str, DataFrame], path: str, buckets: int = 64) -> None:
    """Writes tables partitioned by a bucket of ``diffset_id``. Rows are range-partitioned by bucket and row hash, so
    a bucket spreads over as many tasks as its share of the table asks for, and a change set that holds a large share
    is no single writer's."""
    for name, df in tables.items():
        rows = df.withColumn("bucket", F.pmod(F.xxhash64("diffset_id"), F.lit(buckets)).cast("int"))
        rows.repartitionByRange("bucket", F.xxhash64(*df.columns)).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")


def read_table(spark: SparkSession, path: str, name: str, diffset_ids: list[str] | None = None, buckets: int = 64) -> DataFrame:
    """A table back; given change sets read only their buckets."""
    df = spark.read.parquet(f"{path}/{name}")
    if diffset_ids is not None:
        wanted = F.array(*[F.pmod(F.xxhash64(F.lit(i)), F.lit(buckets)).cast("int") for i in diffset_ids])
        numbers = spark.range(1).select(wanted.alias("b")).first()["b"]
        df = df.filter(F.col("bucket").isin(numbers) & F.col("diffset_id").isin(diffset_ids))
    return df.drop("bucket")
