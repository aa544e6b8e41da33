"""A keyed table that grows by micro-batches, kept as levelled runs.

Micro-batch n adds the run [n, n + 1). Whenever ``fan_in`` runs of one length lie side by side they are merged into one
of ``fan_in`` times the length, which keeps the newest row of a key; so after n batches the table is a handful of runs
(the digits of n to the base ``fan_in``), a row is rewritten once a level, and no batch reads what was merged away.
Which runs exist follows from the number of batches alone: a batch run again after a failure writes the same runs.
Runs that a batch has merged are deleted by the next one, when no reader of a failed attempt can need them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType


class LevelledRuns:
    """Rows of ``schema`` by ``keys``; ``spread`` (columns of the key) names what decides a row's bucket, so that a
    reader that wants few keys reads few buckets."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: list[str], spread: list[str] | None = None, fan_in: int = 4, buckets: int = 32):
        self.spark, self.folder, self.keys, self.spread = spark, folder, keys, spread or keys
        self.names, self.fan_in, self.buckets = schema.names, fan_in, buckets
        self.stored = StructType(list(schema.fields)).add("_at", LongType()).add("_bucket", IntegerType())

    def blocks(self, n: int) -> list[tuple[int, int]]:
        """(first batch, batches) of the runs that hold the first ``n`` batches, oldest first."""
        out, first = [], 0
        while first < n:
            size = 1
            while first % (size * self.fan_in) == 0 and first + size * self.fan_in <= n:
                size *= self.fan_in
            out.append((first, size))
            first += size
        return out

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.spread), F.lit(self.buckets)).cast("int")

    def _path(self, block: tuple[int, int]) -> str:
        return f"{self.folder}/run-{block[1]}-{block[0]}"

    def _newest(self, blocks: list[tuple[int, int]], buckets: list[int] | None) -> DataFrame:
        runs = [self.spark.read.schema(self.stored).parquet(self._path(b)) for b in blocks]
        rows = reduce(DataFrame.unionByName, runs) if runs else self.spark.createDataFrame([], self.stored)
        if buckets is not None:
            rows = rows.filter(F.col("_bucket").isin(buckets))
        rest = [c for c in self.names if c not in self.keys]
        best = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest, "_at"), "_at").alias("_b"))
        return best.select(*self.keys, *[F.col(f"_b.`{c}`").alias(c) for c in [*rest, "_at"]])

    def read(self, n: int, like: DataFrame | None = None) -> DataFrame:
        """The newest row of every key after the first ``n`` batches. ``like`` has the ``spread`` columns: only buckets
        that it touches are read (at most ``buckets`` numbers come to the driver)."""
        touched = None
        if like is not None:
            touched = [r["_bucket"] for r in like.select(self.bucket().alias("_bucket")).distinct().collect()]
        return self._newest(self.blocks(n), touched).select(*self.names)

    def _write(self, rows: DataFrame, block: tuple[int, int]) -> None:
        rows.select(*self.names, "_at", self.bucket().alias("_bucket")).write.mode("overwrite").partitionBy("_bucket").parquet(self._path(block))

    def add(self, rows: DataFrame, number: int) -> None:
        """Adds micro-batch ``number`` (0, 1, ...), one row per key at most, and merges what is full."""
        for child in self._merged(number):  # of the batch before, which has been committed
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(child))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self._write(rows.withColumn("_at", F.lit(number).cast("long")), (number, 1))
        size, n = self.fan_in, number + 1
        while n % size == 0:
            step = size // self.fan_in
            self._write(self._newest([(first, step) for first in range(n - size, n, step)], None), (n - size, size))
            size *= self.fan_in

    def _merged(self, n: int) -> list[tuple[int, int]]:
        """The runs that were merged when the first ``n`` batches were complete."""
        out, size = [], self.fan_in
        while n and n % size == 0:
            step = size // self.fan_in
            out += [(first, step) for first in range(n - size, n, step)]
            size *= self.fan_in
        return out
