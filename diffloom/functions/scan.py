"""Running aggregates that do not put a whole group into one task.

``Window.partitionBy(keys)`` sends a group to one task. That is fine where a group is the lines of one
file (its text already is one row of the input), but not where a group is a change set, a reviewer or a
device that may hold a third of all rows. ``running`` spreads groups of any size, on one path:

1. range-partition by ``(keys, order)``, so a group's rows lie on neighbouring partitions in order;
2. a window per (partition, keys) gives the running value inside the partition;
3. per-partition totals of the groups that span partitions give each partition's starting value.

Only the first group of a partition can continue from the partition before it, so step 3 is at most one
row per partition, and that table may be broadcast whatever the data's size. A null key is a key like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffloom.session import cut

_FOLD = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


def _join_values(op: str, offset: Column, local: Column) -> Column:
    if op in ("sum", "count"):
        return F.coalesce(offset, F.lit(0)) + local
    pick = F.greatest if op == "max" else F.least
    return F.when(offset.isNull(), local).when(local.isNull(), offset).otherwise(pick(offset, local))


def running(
    df: DataFrame, keys: list[str], order: list[str | Column], aggs: dict[str, tuple[str, Column]], partitions: int | None = None
) -> DataFrame:
    """Adds inclusive running aggregates ``{name: (op, column)}`` per ``keys`` in ``order``.

    ``order`` must be a total order inside a group for the result to be deterministic. ``partitions`` fixes how many
    tasks share the rows; by default the session does.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    inputs = [c.alias(f"_in_{name}") for name, (_, c) in aggs.items()]
    by = [*[F.col(k) for k in keys], *order]
    spread = df.select("*", *inputs)
    spread = spread.repartitionByRange(partitions, *by) if partitions else spread.repartitionByRange(*by)
    # The partition number is data from here on, so it is fixed once in shared storage.
    spread = cut(spread.withColumn("_part", F.spark_partition_id()))
    upto = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = spread.select(
        "*", *[_FOLD[op](f"_in_{n}").over(upto).alias(f"_run_{n}") for n, (op, _) in aggs.items()]
    )
    totals = spread.groupBy("_part", *keys).agg(
        *[_FOLD[op](f"_in_{n}").alias(f"_tot_{n}") for n, (op, _) in aggs.items()]
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    fold_totals = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
    starts = totals.select(
        "_part",
        *keys,
        F.count(F.lit(1)).over(before).alias("_earlier"),
        *[fold_totals[op](f"_tot_{n}").over(before).alias(f"_off_{n}") for n, (op, _) in aggs.items()],
    ).filter("_earlier > 0")
    starts = starts.select(*[F.col(c).alias(f"_at_{c}") for c in ["_part", *keys]], *[f"_off_{n}" for n in aggs])
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in keys], F.col("_part") == F.col("_at__part"))
    joined = local.join(F.broadcast(starts), same, "left")
    return joined.select(
        *[joined[c] for c in df.columns],
        *[
            _join_values(op, F.col(f"_off_{n}"), F.col(f"_run_{n}")).alias(n)
            for n, (op, _) in aggs.items()
        ],
    )


def ranked(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """``row_number()`` per ``keys`` for groups of any size."""
    return running(df, keys, order, {name: ("sum", F.lit(1).cast("bigint"))}, partitions)


def spans(first: Column, last: Column, width: int = 64) -> Column:
    """The buckets of ``width`` positions that ``first..last`` touches, for an equi-join on overlap."""
    return F.explode(F.sequence(F.floor(first / width).cast("int"), F.floor(last / width).cast("int")))
