"""Commit and ref sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_commits(raw: DataFrame) -> DataFrame:
    """Raw commit text ``(sha, raw)`` to rows. A commit without a tree gets ``valid`` false."""
    head = F.substring_index("raw", "\n\n", 1)
    cut_at = F.instr("raw", "\n\n")
    field = lambda key: F.regexp_extract(head, rf"(?m)^{key} (.*)$", 1)
    committer = field("committer")
    tree = field("tree")
    return raw.select(
        *[c for c in raw.columns if c != "raw"],
        tree.alias("tree"),
        F.regexp_extract_all(head, F.lit(r"(?m)^parent (.*)$"), F.lit(1)).alias("parents"),
        field("author").alias("author"),
        committer.alias("committer"),
        F.coalesce(F.regexp_extract(committer, r" (\d+) [+-]\d{4}$", 1).try_cast("bigint"), F.lit(0)).alias("time"),
        F.when(cut_at > 0, F.substring("raw", cut_at + 2, F.length("raw"))).otherwise("").alias("message"),
        (tree != "").alias("valid"),
    )


# The name prefixes of the ref kinds.
_KINDS = {"refs/heads/": "branch", "refs/remotes/": "remote", "refs/tags/": "tag"}


def list_refs(packed: DataFrame, loose: DataFrame) -> DataFrame:
    """Refs of every repository by name: a loose ref overrides a packed one, a symbolic or malformed one is
    skipped. Both have ``(repo_id, name, value)``."""
    rows = packed.withColumn("_rank", F.lit(0)).unionByName(loose.withColumn("_rank", F.lit(1)))
    rows = rows.filter(F.col("value").rlike("^[0-9a-f]{40}$"))
    refs = rows.groupBy("repo_id", "name").agg(F.max_by("value", "_rank").alias("sha"))
    kind, short = F.lit("other"), F.col("name")
    for prefix, value in _KINDS.items():
        kind = F.when(F.col("name").startswith(prefix), value).otherwise(kind)
        short = F.when(F.col("name").startswith(prefix), F.substring("name", F.lit(len(prefix) + 1), F.length("name"))).otherwise(short)
    return refs.select("repo_id", "name", short.alias("short"), kind.alias("kind"), "sha")
