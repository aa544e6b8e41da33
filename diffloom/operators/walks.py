"""Following links to their end in a logarithmic number of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from diffloom.session import cut

HOPS = 4  # links of the round before that one round of pointer jumping follows


def to_ends(links: DataFrame) -> DataFrame:
    """``(at, end, steps)``: where the path of ``links`` (at, to, steps) from each place ends, and the sum of its steps.
    A round follows ``HOPS`` links of the round before, so a path of n links takes log n rounds. Links that go round for
    ever meet no end and have none."""
    now = cut(links.select("at", "to", F.col("steps").cast("bigint").alias("steps")))
    left, was = -1, None
    while left and left != was:
        far, rows = now.select(F.col("at").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_more")), now
        for _ in range(HOPS - 1):
            rows = rows.join(far, "to", "left").select("at", F.coalesce("_to", "to").alias("to"), (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps"), F.col("_to").isNotNull().alias("goes_on"))
        seen = Observation()
        now = cut(rows.observe(seen, F.count_if("goes_on").alias("left")))
        left, was = seen.get["left"] or 0, left
    ends = now.filter("not goes_on")
    return ends.select("at", F.col("to").alias("end"), "steps")
