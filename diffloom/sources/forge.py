"""Forge payloads: compare pages, pull requests, commits, comments, rendered pages, lowered comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffloom.functions import keys as K
from diffloom.functions import text as T

MAX_COMPARE_FILES = 3000  # fixed value: a compare answer stops here

_COMPARE = (
    "struct<merge_base_commit: struct<sha: string>, files: array<struct<sha: string, filename: string, "
    "additions: bigint, deletions: bigint, previous_filename: string, status: string, patch: string>>>"
)


def read_compare(pages: DataFrame, cap: int = MAX_COMPARE_FILES) -> tuple[DataFrame, DataFrame]:
    """Compare pages ``(diffset_id, page, json)`` to changed files, and the sets that hit the cap or lack a
    merge base, whose file list may be incomplete."""
    parsed = pages.select("diffset_id", "page", F.from_json("json", _COMPARE).alias("j"))
    files = parsed.select("diffset_id", F.explode("j.files").alias("f")).select(
        "diffset_id", F.col("f.filename").alias("path"), F.col("f.previous_filename").alias("old_path"),
        F.when(F.col("f.status") == "removed", "deleted").otherwise(F.col("f.status")).alias("status"),
        F.when(F.col("f.status") == "removed", F.col("f.sha")).alias("before"),
        F.when(F.col("f.status") != "removed", F.col("f.sha")).alias("after"),
        F.col("f.additions").alias("added"), F.col("f.deletions").alias("removed"),
    )
    counts = parsed.groupBy("diffset_id").agg(
        F.sum(F.coalesce(F.size("j.files"), F.lit(0))).alias("files"), F.min_by("j.merge_base_commit.sha", "page").alias("merge_base")
    )
    return files, counts.filter((F.col("files") >= cap) | F.col("merge_base").isNull())


_PULL = "struct<number: bigint, title: string, base: struct<sha: string>, head: struct<sha: string>>"


def read_pulls(answers: DataFrame) -> DataFrame:
    """Pages of pull requests ``(repo_id, json)`` to rows."""
    rows = answers.select("repo_id", F.explode(F.from_json("json", f"array<{_PULL}>")).alias("p"))
    return rows.select("repo_id", "p.number", "p.title", F.col("p.base.sha").alias("base"), F.col("p.head.sha").alias("head"))


_COMMITS = (
    "struct<payload: struct<pullRequestsCommitsRoute: struct<metadata: struct<commitHeadShaChannel: string>, "
    "commitGroups: array<struct<commits: array<struct<oid: string, shortMessage: string, committedDate: string, "
    "authors: array<struct<displayName: string, login: string>>>>>>>>>"
)


def read_pr_commits(pages: DataFrame) -> DataFrame:
    """A pull request's commits page ``(pull_id, json)`` to its commits in order, merges marked, and the head
    its channel names, else the last commit listed."""
    route = pages.select("pull_id", F.from_json("json", _COMMITS)["payload"]["pullRequestsCommitsRoute"].alias("r"))
    listed = F.flatten(F.transform("r.commitGroups", lambda g: g["commits"]))
    route = route.select("pull_id", listed.alias("_c"), K.head_from_channel(F.col("r.metadata.commitHeadShaChannel")).alias("_head"))
    route = route.withColumn("head", F.coalesce("_head", F.try_element_at("_c", F.lit(-1))["oid"]))
    rows = route.select("pull_id", "head", F.posexplode("_c").alias("place", "c"))
    author = F.get("c.authors", F.lit(0))
    name = F.coalesce(F.nullif(author["displayName"], F.lit("")), author["login"], F.lit(""))
    return rows.select(
        "pull_id", "head", "place", F.col("c.oid").alias("sha"), F.col("c.shortMessage").alias("subject"), name.alias("author"),
        F.to_timestamp("c.committedDate").alias("committed"), K.is_merge_subject(F.col("c.shortMessage")).alias("is_merge"),
    )


_COMMENT = (
    "struct<id: bigint, in_reply_to_id: bigint, path: string, line: int, side: string, original_line: int, "
    "original_commit_id: string, user: struct<login: string>, created_at: string, body: string>"
)


def read_comments(pages: DataFrame) -> DataFrame:
    """Pages of flat review comments ``(diffset_id, json)``; entries without id, path or body are dropped."""
    rows = pages.select("diffset_id", F.explode(F.from_json("json", f"array<{_COMMENT}>")).alias("c"))
    return rows.select(
        "diffset_id", "c.id", "c.in_reply_to_id", "c.path", "c.line", "c.side", "c.original_line", "c.original_commit_id",
        F.coalesce("c.user.login", F.lit("")).alias("author"), F.to_timestamp("c.created_at").alias("created"), "c.body",
    ).filter("id is not null and path is not null and body is not null")


# Where a rendered commit page names its files.
TAG_PATH = r'data-tagsearch-path="([^"]*)"'
TREE_PATH = r'data-tree-entry-type="file"[^>]*>\s*<span data-filterable-item-text hidden>([^<]*)</span>'
TYPE_COUNT = r'data-all-file-count-markup="\((\d+)\)"'
EMBEDDED = r'(?s)<script type="application/json" data-target="react-app\.embeddedData">(.*?)</script>'
_ROUTE = (
    "struct<payload: struct<pullRequestsChangesWithRangeRoute: struct<diffSummaries: array<struct<path: string>>, "
    "commit: struct<parents: array<string>>, pageLimits: struct<filesLimitExceeded: boolean>>>>"
)


def paths_from_pages(pages: DataFrame) -> DataFrame:
    """The paths a merge commit's page lists, one row each. A page with embedded data is trusted unless it
    is of no merge or was cut short; a rendered one only when its paths are as many as its filter counts."""
    embedded = F.from_json(F.nullif(F.regexp_extract("html", EMBEDDED, 1), F.lit("")), _ROUTE)
    rows = pages.select(
        "page_id", embedded["payload"]["pullRequestsChangesWithRangeRoute"].alias("_r"),
        F.array_distinct(F.transform(
            F.concat(F.regexp_extract_all("html", F.lit(TAG_PATH), F.lit(1)), F.regexp_extract_all("html", F.lit(TREE_PATH), F.lit(1))),
            T.unescape_html,
        )).alias("_paths"),
        F.aggregate(F.regexp_extract_all("html", F.lit(TYPE_COUNT), F.lit(1)), F.lit(0).cast("bigint"), lambda a, n: a + n.cast("bigint")).alias("_total"),
        F.contains("html", F.lit("<file-filter")).alias("_filter"),
    )
    data = F.col("_r.diffSummaries").isNotNull()
    merge = (F.coalesce(F.size("_r.commit.parents"), F.lit(2)) >= 2) & ~F.coalesce("_r.pageLimits.filesLimitExceeded", F.lit(False))
    listed = F.when(data, F.when(merge, F.array_distinct(F.transform("_r.diffSummaries", lambda s: s["path"])))).when(
        F.col("_filter") & (F.col("_total") == F.size("_paths")), F.col("_paths")
    )
    return rows.select("page_id", F.explode(listed).alias("path"))


MARKER = "diffloom"


def _quoted(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit('"'), value, F.lit('"')), F.lit("null"))


def lower_comments(comments: DataFrame, marker: str = MARKER) -> DataFrame:
    """Adds ``posted``: the body with its verdict sentence, the provenance, and the key as JSON in a hidden
    comment. Columns: ``body, side, path, nodes`` (arrays of indices), ``chars, before, after, score``."""
    anchor = F.to_json(F.struct("side", "path", "nodes", "chars"))
    score = F.coalesce(F.concat(F.lit(',"score":'), F.col("score").cast("string")), F.lit(""))
    json = F.concat(F.lit('{"anchor":'), anchor, F.lit(',"before":'), _quoted(F.col("before")), F.lit(',"after":'), _quoted(F.col("after")), score, F.lit("}"))
    json = F.replace(json, F.lit(">"), F.lit("\\u003e"))
    nodes = F.array_join(F.transform("nodes", lambda s: F.concat(F.lit("["), F.array_join(s.cast("array<string>"), ", "), F.lit("]"))), ", ")
    chars = F.when(F.col("chars").isNull(), "").otherwise(F.concat(F.lit(", characters "), F.col("chars.start").cast("string"), F.lit("-"), F.col("chars.end").cast("string")))
    short = lambda c: F.coalesce(T.short_sha(F.col(c)), F.lit("none"))
    where = F.concat(F.lit("Written on node "), nodes, chars, F.lit(" of `"), "path", F.lit("` ("), "side", F.lit(" side), blobs "), short("before"), F.lit(" → "), short("after"), F.lit("."))
    details = F.concat(F.lit(f"\n\n<details>\n<summary>{marker}</summary>\n\n"), where, F.lit("\n\n</details>"))
    posted = F.concat(K.with_verdict(F.col("body"), F.col("score")), details, F.lit(f"\n\n<!-- {marker} "), json, F.lit(" -->"))
    return comments.withColumn("posted", posted)


def read_lowered(posted: DataFrame, marker: str = MARKER) -> DataFrame:
    """Adds ``key`` (null unless a valid one is hidden at the end) and ``shown``, the body a reader sees:
    provenance and key dropped when the key is valid, else as posted."""
    hidden = rf"(?s)(?:^|\n\n)<!-- {marker} (\{{[^\n]*\}}) -->\s*$"
    key = K.valid_key(F.regexp_extract("posted", hidden, 1))
    body = F.regexp_replace("posted", hidden, "")
    summary = rf"\n\n<details>\n<summary>{marker}</summary>\n\n"
    cut_body = F.regexp_replace(body, rf"(?s){summary}(?:(?!{summary}).)*\n\n</details>$", "")
    rows = posted.withColumn("key", key)
    return rows.withColumn("shown", F.when(F.col("key").isNull(), F.col("posted")).otherwise(cut_body))


def remotes_for(refs: DataFrame, remotes: DataFrame) -> DataFrame:
    """The remotes each pull reference can mean: the one it names, case aside, or all when it names none.
    A session's remotes are the few of its ``workspace``, which both sides share."""
    name = lambda: F.lower(F.concat("owner", F.lit("/"), "repo"))
    r = remotes.select("workspace", F.col("owner").alias("r_owner"), F.col("repo").alias("r_repo"), name().alias("_name"))
    named = refs.filter("owner is not null and repo is not null").withColumn("_name", name()).join(r, ["workspace", "_name"])
    free = refs.filter("owner is null or repo is null").join(r, "workspace")
    columns = [*refs.columns, "r_owner", "r_repo"]
    return named.select(*columns).unionByName(free.select(*columns))
