"""Running aggregates over spread groups give what a plain window gives."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from diffloom.functions import scan


def test_spread_equals_window_with_hot_null_and_tied_keys(spark):
    # One key holds most rows and null many, so both span partitions; values tie.
    key = F.when(F.col("id") % 3 == 0, F.lit(None).cast("string")).when(F.col("id") % 50 == 1, F.lit("cold")).otherwise("hot")
    rows = spark.range(4000).select(key.alias("key"), ((F.col("id") * 7919) % 4001).alias("at"), (F.col("id") % 13).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([("one", 1, 5), ("nothing", 2, None)], "key string, at bigint, v bigint"))
    aggs = {"total": ("sum", F.col("v")), "top": ("max", F.col("v")), "low": ("min", F.col("v")), "n": ("count", F.col("v"))}
    spread = rows.repartitionByRange(8, "key", "at").select("key", F.spark_partition_id().alias("p"))
    used = spread.groupBy(F.col("key").isNull().alias("null")).agg(F.countDistinct("p").alias("n"))
    assert spread.select("p").distinct().count() >= 8 and all(r["n"] > 1 for r in used.collect())
    got = scan.running(rows, ["key"], ["at"], aggs, partitions=8)
    w = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select("*", F.sum("v").over(w).alias("total"), F.max("v").over(w).alias("top"), F.min("v").over(w).alias("low"), F.count("v").over(w).alias("n"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_rank_of_one_group_over_many_partitions(spark):
    rows = spark.range(1000).select(F.lit(None).cast("int").alias("k"), F.col("id"))
    out = scan.ranked(rows, ["k"], [F.desc("id")], "r", partitions=8)
    assert out.filter("r <> 1000 - id").count() == 0 and out.count() == 1000
    assert out.columns == ["k", "id", "r"]
