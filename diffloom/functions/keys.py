"""Identifiers, keys and forms that arrive as text: ids, marks, references, payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\u0000"

# Default merge subjects, reference forms, sentences of the scores.
MERGE_SUBJECT = (
    r"^Merge (?:(?:remote-tracking )?branch(?:es)? '|tags? '|commits? '|pull request #\d+ from "
    r"|(?:(?:[a-z][\w+.-]*://|[\w.-]+(?:@[\w.-]+)?:|/)\S+|\S+ into \S+)$)"
)
PULL_FORMS = (
    r"^(?:(?i:(?:https?://)?(?:www\.)?github\.com/([\w.-]+)/([\w.-]+)/pull/(\d+)"
    r"(?:/(?:files|commits(?:/[0-9a-f]{7,40})?))?/?(?:[?#].*)?)"
    r"|([\w.-]+)/([\w.-]+)#(\d+)|#?(\d+))$"
)
REMOTES = [
    r"^https://github\.com/([^/]+)/([^/]+?)(?:\.git)?/?$",
    r"^git@github\.com:([^/]+)/([^/]+?)(?:\.git)?/?$",
    r"^ssh://git@github\.com/([^/]+)/([^/]+?)(?:\.git)?/?$",
]
SCORE_WORDS = {2: "good to merge", 1: "looks good", -1: "would rather not", -2: "must not merge"}
SHA = r"^[0-9a-f]{40}([0-9a-f]{24})?$"
SAFE_INTEGER = 2**53 - 1


def is_merge_subject(subject: Column) -> Column:
    return subject.rlike(MERGE_SUBJECT)


def _matched(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def parse_pull_ref(ref: Column) -> Column:
    """``owner``, ``repo`` (null when none is named) and ``number`` of a pull request; null of anything else."""
    text = F.trim(ref)
    # One match of all forms; the groups of the forms that did not match are empty.
    parts = F.split(F.regexp_replace(text, PULL_FORMS, "$1$4\t$2$5\t$3$6$7"), "\t")
    named = F.transform(
        F.filter(F.array(parts), lambda p: (F.size(p) == 3) & text.rlike(PULL_FORMS)),
        lambda p: F.struct(
            F.nullif(F.get(p, F.lit(0)), F.lit("")).alias("owner"),
            F.nullif(F.get(p, F.lit(1)), F.lit("")).alias("repo"),
            F.get(p, F.lit(2)).try_cast("bigint").alias("number"),
        ),
    )
    return F.get(F.filter(named, lambda n: (n["number"] > 0) & (n["number"] <= SAFE_INTEGER)), F.lit(0))


def parse_remote(url: Column) -> Column:
    """``owner`` and ``repo`` of a remote's URL, null of a host other than the one supported."""
    text = F.trim(url)
    owner = F.coalesce(*[_matched(text, p, 1) for p in REMOTES])
    repo = F.coalesce(*[_matched(text, p, 2) for p in REMOTES])
    return F.when(owner.isNotNull() & repo.isNotNull(), F.struct(owner.alias("owner"), repo.alias("repo")))


def encode_blob_id(owner: Column, repo: Column, sha: Column) -> Column:
    return F.concat(owner, F.lit("/"), repo, F.lit("@"), sha)


BLOB_ID = r"^([^/@]*)/(.*)@([^@]*)$"


def decode_blob_id(blob_id: Column) -> Column:
    """Owner, repository and sha, null when the text is no such id."""
    parts = [F.regexp_extract(blob_id, BLOB_ID, i) for i in (1, 2, 3)]
    named = F.struct(*[p.alias(n) for p, n in zip(parts, ("owner", "repo", "sha"))])
    return F.when(blob_id.rlike(BLOB_ID), named)


def diffset_id(owner: Column, repo: Column, base: Column, head: Column) -> Column:
    return F.concat(owner, F.lit("/"), repo, F.lit("@"), base, F.lit(".."), head)


def atom_key(path: Column, ancestors: Column, before: Column, after: Column) -> Column:
    """A position-free identity of an edit: the same edit keeps it when code above shifts."""
    parts = F.array(
        path,
        F.coalesce(F.array_join(ancestors, "\u0001"), F.lit("")),
        F.coalesce(F.concat(F.lit("="), before), F.lit("")),
        F.coalesce(F.concat(F.lit("="), after), F.lit("")),
    )
    return F.md5(F.array_join(parts, NUL))


def _or_null(value: Column) -> Column:
    return F.coalesce(value, F.lit("null"))


def file_mark(path: Column, before: Column, after: Column) -> Column:
    return F.concat_ws(NUL, F.lit("file"), path, _or_null(before), _or_null(after))


def atom_mark(atom: Column) -> Column:
    return F.concat_ws(NUL, F.lit("atom"), atom)


def node_mark(path: Column, side: Column, steps: Column, node_hash: Column) -> Column:
    return F.concat_ws(NUL, F.lit("node"), path, side, F.array_join(steps, "."), node_hash)


def move_half(path: Column, first: Column, last: Column, text: Column) -> Column:
    where = F.concat(path, F.lit(":"), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(":"))
    return F.concat(where, F.md5(text))


def move_mark(before_half: Column, after_half: Column) -> Column:
    """Both halves of a move share one key."""
    return F.concat_ws(
        NUL, F.lit("move"), F.coalesce(before_half, F.lit("")), F.coalesce(after_half, F.lit(""))
    )


def verdict_sentence(score: Column) -> Column:
    word = F.lit(None).cast("string")
    for value, sentence in SCORE_WORDS.items():
        word = F.when(score == value, f"{value:+d}: {sentence}").otherwise(word)
    return word


def with_verdict(body: Column, score: Column) -> Column:
    return F.when(score.isNull(), body).otherwise(F.concat(verdict_sentence(score), F.lit("\n\n"), body))


def hlc(wall: Column, logical: Column) -> Column:
    """A hybrid logical clock reading; structs order field by field."""
    return F.struct(wall.cast("bigint").alias("wall"), logical.cast("int").alias("logical"))


def stamp_order(wall: Column, logical: Column, device: Column, rank: Column) -> Column:
    """The order a last-writer-wins merge keeps: larger clock, then device, then rank."""
    return F.struct(
        wall.cast("bigint").alias("wall"), logical.cast("int").alias("logical"), device.alias("device"),
        F.coalesce(rank, F.lit(0)).cast("int").alias("rank"),
    )


def decode_base64(content: Column) -> Column:
    return F.unbase64(F.regexp_replace(content, r"\s+", ""))


def head_from_channel(channel: Column) -> Column:
    """The head commit a page's live-update channel names, or null."""
    payload = F.try_to_binary(F.substring_index(channel, "--", 1), F.lit("base64"))
    name = F.get_json_object(payload.cast("string"), "$.c")
    return _matched(name, r":commit:([0-9a-f]{40})$", 1)


def valid_key(json: Column) -> Column:
    """An untrusted key, parsed, or null when any of its fields is malformed.

    The text parses to a variant, so a fraction is seen rather than cut off, and a field of a wrong type is
    told apart from an absent one.
    """
    raw = F.try_parse_json(json)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(raw, path, "variant"))
    present = lambda path: F.try_variant_get(raw, path, "variant").isNotNull()
    number = lambda c: (c >= 0) & (c <= SAFE_INTEGER) & (c == F.floor(c))
    text = lambda path: F.when(kind(path) == "STRING", F.try_variant_get(raw, path, "string"))
    nodes = F.try_variant_get(raw, "$.anchor.nodes", "array<array<double>>")
    start, end = (F.try_variant_get(raw, f"$.anchor.chars.{p}", "double") for p in ("start", "end"))
    numeric = lambda path: kind(path).rlike("^(BIGINT|DECIMAL|DOUBLE|INT)")
    side, path = text("$.anchor.side"), text("$.anchor.path")
    before, after = text("$.before"), text("$.after")
    sha = lambda path, value: F.when(present(path), F.coalesce(kind(path) == "VOID", F.lit(False)) | F.coalesce(value.rlike(SHA), F.lit(False))).otherwise(False)
    score = F.try_variant_get(raw, "$.score", "double")
    ok = (
        side.isin("before", "after")
        & (path != "")
        & (F.size(nodes) > 0)
        & F.coalesce(kind("$.anchor.nodes").rlike(r"^ARRAY<ARRAY<(BIGINT|DECIMAL.*|DOUBLE|VOID)>>$"), F.lit(False))
        & F.forall(nodes, lambda s: s.isNotNull() & F.forall(s, lambda i: i.isNotNull() & number(i)))
        & (
            ~present("$.anchor.chars")
            | ((F.size(nodes) == 1) & numeric("$.anchor.chars.start") & numeric("$.anchor.chars.end") & number(start) & number(end) & (start <= end))
        )
        & sha("$.before", before)
        & sha("$.after", after)
        & (before.isNotNull() | after.isNotNull())
        & (~present("$.score") | (numeric("$.score") & score.isin(-2.0, -1.0, 1.0, 2.0)))
    )
    anchor = F.struct(
        side.alias("side"),
        path.alias("path"),
        F.transform(nodes, lambda s: s.cast("array<int>")).alias("nodes"),
        F.when(present("$.anchor.chars"), F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))).alias("chars"),
    )
    value = F.struct(anchor.alias("anchor"), before.alias("before"), after.alias("after"), score.cast("int").alias("score"))
    return F.when(F.coalesce(ok, F.lit(False)), value)
