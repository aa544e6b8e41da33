"""Commit graphs: first-parent chains, n-th ancestors, merge bases over a chain index, abbreviated ids.

``commits`` has ``sha``, ``parents`` (ordered array) and ``time``. Chains are walked by pointer doubling:
a table of jumps of length 1, 2, 4, … each made by one self-join of the one before, so a walk of n commits
takes log n joins and no step follows one commit at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from diffloom.operators.walks import to_ends
from diffloom.session import cut

CROSSING_BLOCK = 64  # places of a chain whose crossings are found together

BRANCH_CAP = 50  # fixed value: commits listed per branch


def _jumps(commits: DataFrame) -> DataFrame:
    return commits.filter(F.size("parents") > 0).select(
        F.col("sha").alias("at"), F.get("parents", F.lit(0)).alias("to")
    )


def _double(jumps: DataFrame) -> DataFrame:
    far = jumps.select(F.col("at").alias("to"), F.col("to").alias("_to"))
    return cut(jumps.join(far, "to").select("at", F.col("_to").alias("to")))


def branch_commits(commits: DataFrame, heads: DataFrame, cap: int = BRANCH_CAP) -> DataFrame:
    """First-parent commits newest first from ``head`` down to, not including, ``base``; at most ``cap``
    per ``(branch, head)``. A base equal to the head, or none, bounds nothing."""
    base = F.when(~F.col("base").eqNullSafe(F.col("head")), F.col("base"))
    walk = heads.select("branch", "head", base.alias("base"), F.col("head").alias("sha"), F.lit(1).alias("place"))
    jumps, reach = _jumps(commits), 1
    while reach < cap:
        step = walk.join(jumps, walk["sha"] == jumps["at"]).select(
            "branch", "head", "base", F.col("to").alias("sha"), (F.col("place") + reach).alias("place")
        )
        # After this join the walk holds the first 2·reach commits of every chain.
        walk = cut(walk.unionByName(step))
        reach *= 2
        if reach < cap:
            jumps = _double(jumps)
    stop = walk.filter("sha = base").groupBy("branch", "head").agg(F.min("place").alias("_stop"))
    kept = walk.filter(F.col("place") <= cap).join(stop, ["branch", "head"], "left")
    return kept.filter("_stop is null or place < _stop").select("branch", "head", "sha", "place")


SPEC = r"^(.*?)((?:[~^]\d*)*)$"


def parse_specs(specs: DataFrame) -> DataFrame:
    """``name~n^m`` into its name and its steps: ``(op, n)`` in order, ``n`` 1 where none is written."""
    steps = F.regexp_extract_all(F.regexp_extract("spec", SPEC, 2), F.lit(r"[~^]\d*"), F.lit(0))
    step = lambda s: F.struct(
        F.substring(s, 1, 1).alias("op"),
        F.when(F.length(s) == 1, 1).otherwise(F.substring(s, F.lit(2), F.length(s)).try_cast("int")).alias("n"),
    )
    name = F.regexp_extract("spec", SPEC, 1)
    return specs.select(
        "*",
        F.when(name.isin("", "@"), "HEAD").otherwise(name).alias("name"),
        F.transform(steps, step).alias("steps"),
    )


def resolve_specs(commits: DataFrame, names: DataFrame, specs: DataFrame) -> DataFrame:
    """Each spec's commit, null where it names none. ``names`` maps ``(repo_id, name)`` to ``sha``.

    The steps of all specs run in lock-step: one round per step, and inside a round the n-th ancestor is
    reached through the jump tables of the bits of n.
    """
    parsed = cut(
        parse_specs(specs).join(names, ["repo_id", "name"], "left").select("repo_id", "spec", "steps", "sha")
    )
    bounds = parsed.agg(
        F.max(F.size("steps")), F.max(F.array_max(F.transform("steps", lambda s: s["n"])))
    ).first()
    rounds, longest = bounds[0] or 0, bounds[1] or 0
    tables, jumps = [], _jumps(commits)
    while (1 << len(tables)) <= longest:
        tables.append(jumps)
        jumps = _double(jumps)
    nth = commits.select(F.col("sha").alias("at"), F.posexplode("parents").alias("_i", "to")).select(
        "at", (F.col("_i") + 1).alias("_n"), "to"
    )
    rows = parsed
    for i in range(rounds):
        step = F.get("steps", F.lit(i))
        rows = rows.withColumns({"_op": step["op"], "_k": step["n"]})
        for bit, table in enumerate(tables):
            far = F.coalesce((F.col("_op") == "~") & (F.shiftright("_k", bit).bitwiseAND(1) == 1), F.lit(False))
            hop = table.withColumnRenamed("to", "_to")
            rows = (
                rows.withColumn("_from", F.when(far, F.col("sha")))
                .join(hop, F.col("_from") == hop["at"], "left")
                .withColumn("sha", F.when(far, F.col("_to")).otherwise(F.col("sha")))
                .drop("_from", "at", "_to")
            )
        up = F.coalesce((F.col("_op") == "^") & (F.col("_k") > 0), F.lit(False))
        hop = nth.withColumnRenamed("to", "_to")
        rows = (
            rows.withColumn("_from", F.when(up, F.col("sha")))
            .join(hop, (F.col("_from") == hop["at"]) & (F.col("_k") == hop["_n"]), "left")
            .withColumn("sha", F.when(up, F.col("_to")).otherwise(F.col("sha")))
            .drop("_from", "at", "_to", "_n", "_op", "_k")
        )
        rows = cut(rows)
    return rows.select("repo_id", "spec", "sha")


def _weights(parts: DataFrame) -> DataFrame:
    """``(part, weight)``: commits in each part and all above it, of parts ``(part, up, length)`` that form a forest. After
    k rounds a part has those less than 2**k parts above it."""
    now = cut(parts.select("part", "up", F.col("length").cast("bigint").alias("weight")))
    while not now.filter("up is not null").isEmpty():
        more = now.filter("up is not null").groupBy(F.col("up").alias("part")).agg(F.sum("weight").alias("_more"))
        far = now.select(F.col("part").alias("up"), F.col("up").alias("_up"))
        now = cut(now.join(more, "part", "left").join(far, "up", "left").select("part", F.col("_up").alias("up"), (F.col("weight") + F.coalesce("_more", F.lit(0))).alias("weight")))
    return now.select("part", "weight")


def chains(commits: DataFrame) -> DataFrame:
    """``(sha, chain, place)``: the first-parent forest cut into chains, ``place`` counted from a chain's oldest commit, so
    that what a commit reaches of a chain is all up to one place. At a fork the chain goes on where most commits are, so a
    way to the root changes its chain at most log n times.

    Stretches without a fork are found by pointer jumping; only they, not the commits, are weighed and joined."""
    first = cut(_jumps(commits).join(commits.select(F.col("sha").alias("to")), "to", "left_semi").select("at", "to"))
    forks = cut(first.groupBy("to").count().filter("count > 1").select("to"))
    straight = first.join(forks, "to", "left_anti").withColumn("steps", F.lit(1))
    found = to_ends(straight).groupBy("at").agg(F.first("end").alias("end"), F.first("steps").alias("steps"))
    ids = commits.select("sha").distinct().join(found, F.col("sha") == F.col("at"), "left")
    placed = cut(ids.select("sha", F.coalesce("end", "sha").alias("part"), F.coalesce("steps", F.lit(0)).cast("bigint").alias("place")))
    over = first.join(forks, "to", "left_semi").join(placed.select(F.col("sha").alias("to"), F.col("part").alias("up")), "to")
    parts = placed.groupBy("part").agg((F.max("place") + 1).alias("length")).join(over.select(F.col("at").alias("part"), "up"), "part", "left")
    parts = cut(parts)
    if parts.filter("up is not null").isEmpty():
        return placed.withColumnRenamed("part", "chain")
    heavy = parts.filter("up is not null").join(_weights(parts), "part").groupBy("up").agg(F.max_by("part", F.struct("weight", "part")).alias("part"))
    lengths = parts.select(F.col("part").alias("to"), F.col("length").alias("steps"))
    base = to_ends(heavy.select(F.col("part").alias("at"), F.col("up").alias("to")).join(lengths, "to").select("at", "to", "steps"))
    joined = placed.join(base.select(F.col("at").alias("part"), "end", "steps"), "part", "left")
    return cut(joined.select("sha", F.coalesce("end", "part").alias("chain"), (F.col("place") + F.coalesce("steps", F.lit(0))).alias("place")))


def _crossings(commits: DataFrame, index: DataFrame) -> DataFrame:
    """``(chain, block, place, to_chain, to_place)``: the parents that lie on another chain."""
    up = commits.select("sha", F.explode("parents").alias("parent")).join(index, "sha")
    to = index.select(F.col("sha").alias("parent"), F.col("chain").alias("to_chain"), F.col("place").alias("to_place"))
    rows = up.join(to, "parent").filter("chain <> to_chain")
    return cut(rows.select("chain", F.floor(F.col("place") / CROSSING_BLOCK).alias("block"), "place", "to_chain", "to_place"))


def _follow(reach: DataFrame, crossings: DataFrame, by: list[str], bounds: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Grows ``reach`` (by, chain, top) along crossings until nothing is new: the highest place reached of every chain.
    A chain is only followed down to ``bounds(reach)``, and no place of it twice."""
    now = cut(reach.groupBy(*by, "chain").agg(F.max("top").alias("top")).withColumn("done", F.lit(-1).cast("bigint")))
    while True:
        low = bounds(now) if bounds else now.withColumn("low", F.col("done"))
        todo = low.withColumn("low", F.greatest("low", "done")).filter("top > low")
        if todo.isEmpty():
            return now.drop("done")
        spread = F.sequence(F.floor((F.col("low") + 1) / CROSSING_BLOCK), F.floor(F.col("top") / CROSSING_BLOCK))
        asks = todo.select(*by, "chain", "low", "top", F.explode(spread).alias("block"))
        new = asks.join(crossings, ["chain", "block"]).filter("place > low and place <= top").select(*by, F.col("to_chain").alias("chain"), F.col("to_place").alias("top"), F.lit(-1).cast("bigint").alias("done"))
        now = cut(now.withColumn("done", F.col("top")).unionByName(new).groupBy(*by, "chain").agg(F.max("top").alias("top"), F.max("done").alias("done")))


def merge_base(commits: DataFrame, pairs: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """The best common ancestor of each pair ``(pair_id, a, b)``: a common ancestor that is no ancestor of another one;
    the newest of several, null of none. ``index`` is ``chains(commits)``, which may be kept.

    What a commit reaches is one place for each chain, so a pair holds chains, not commits. On a chain that both sides
    reach, the lower of the two places is a common ancestor; what lies below is an ancestor of it and is not followed.
    Only a pair with common ancestors on several chains (a criss-cross history) walks on, from each of them, to see
    which of the others it reaches."""
    index = chains(commits) if index is None else index
    crossings = _crossings(commits, index)
    ends = F.array(F.struct(F.col("a").alias("sha"), F.lit(1).alias("bit")), F.struct(F.col("b").alias("sha"), F.lit(2).alias("bit")))
    start = pairs.select("pair_id", F.explode(ends).alias("s")).select("pair_id", "s.*").join(index, "sha").select("pair_id", "bit", "chain", F.col("place").alias("top"))

    def common_floor(now: DataFrame) -> DataFrame:
        met = now.groupBy("pair_id", "chain").agg(F.min("top").alias("low"), F.count(F.lit(1)).alias("c")).filter("c = 2").drop("c")
        return now.join(met, ["pair_id", "chain"], "left").withColumn("low", F.coalesce("low", F.lit(-1)))

    if crossings.isEmpty():  # no history leaves its chain
        reached = start.groupBy("pair_id", "bit", "chain").agg(F.max("top").alias("top"))
    else:
        reached = _follow(start, crossings, ["pair_id", "bit"], common_floor)
    common = reached.groupBy("pair_id", "chain").agg(F.min("top").alias("place"), F.count(F.lit(1)).alias("c")).filter("c = 2").drop("c")
    if not crossings.isEmpty():
        common = cut(common)
        several = common.groupBy("pair_id").count().filter("count > 1").select("pair_id")
        rivals = cut(common.join(several, "pair_id", "left_semi"))
        walked = _follow(rivals.select("pair_id", F.col("chain").alias("of"), "chain", F.col("place").alias("top")), crossings, ["pair_id", "of"], None)
        beneath = walked.join(rivals, ["pair_id", "chain"]).filter("of <> chain and place <= top").select("pair_id", "chain").distinct()
        common = common.join(beneath, ["pair_id", "chain"], "left_anti")
    best = common.join(index, ["chain", "place"]).join(commits.select("sha", "time"), "sha")
    newest = best.groupBy("pair_id").agg(F.max_by("sha", F.struct("time", "sha")).alias("merge_base"))
    return pairs.join(newest, "pair_id", "left").select("pair_id", "a", "b", "merge_base")


def expand_ids(prefixes: DataFrame, ids: DataFrame) -> DataFrame:
    """Abbreviated ids to full ones: ``id`` when one id begins so, ``matches`` counts them up to two. Prefixes are
    counted once however many rows ask for them; each length asked for is an equi-join on so many characters."""
    asked = prefixes.select(F.lower("prefix").alias("prefix")).filter("prefix <> ''").distinct()
    lengths = sorted(r["n"] for r in asked.select(F.length("prefix").alias("n")).distinct().collect())  # at most an id's length
    if not lengths:
        return asked.select("prefix", F.lit(None).cast("string").alias("id"), F.lit(0).alias("matches"))
    heads = F.array(*[F.substring("id", 1, n) for n in lengths])
    known = ids.select("id").distinct().select("id", F.explode(F.array_distinct(heads)).alias("prefix"))
    # A short prefix may fit a large share of all ids: counted before the shuffle, never listed.
    found = known.join(asked, "prefix", "left_semi").groupBy("prefix").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_id"))
    return asked.join(found, "prefix", "left").select(
        "prefix",
        F.when(F.col("_n") == 1, F.col("_id")).alias("id"),
        F.least(F.coalesce("_n", F.lit(0)), F.lit(2)).cast("int").alias("matches"),
    )
