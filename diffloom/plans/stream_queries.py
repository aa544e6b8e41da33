"""Registered queries that run as streams over the given tables, and their batch forms."""

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from diffloom.operators import review as R
from diffloom.plans.registry import Data, fragment, oracle_fragment, query
from diffloom.plans.review_queries import outline
from diffloom.plans.snapshot_queries import changes
from diffloom.session import shared_folder
from diffloom.sources import tables as S17
from diffloom.streaming import marks as M


#: Micro-batches in which a query gets its table; the stream is started anew for each, from its checkpoint.
BATCHES = 5


def run_folder(d: Data) -> str:
    return f"{shared_folder(d.spark)}/stream-{uuid.uuid4().hex}"


def fed(d: Data, parts: Iterable[DataFrame], start: Callable[[DataFrame, str], StreamingQuery]) -> str:
    """Delivers the parts one after another to a stream that is stopped and restarted between them; returns its folder."""
    folder = run_folder(d)
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        start(d.spark.readStream.schema(part.schema).parquet(f"{folder}/in"), folder).awaitTermination()
    return folder


def deliveries(df: DataFrame, order: str, late: Column | None = None, twice: Column | None = None) -> list[DataFrame]:
    """``df`` in ``BATCHES`` parts by ranges of ``order``. Rows that are ``late`` come one part after their own (if there
    is one), rows that are ``twice`` once more with the next part."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    width = ((high or 0) - (low or 0)) // BATCHES + 1
    own = F.floor((F.col(order) - (low or 0)) / width)
    delay = F.when(late, F.least(own + 1, F.lit(BATCHES - 1))).otherwise(own) if late is not None else own
    again = F.lit(False) if twice is None else twice
    return [df.filter((delay == i) | (again & (delay == i - 1))) for i in range(BATCHES)]


def marks_of(e: DataFrame) -> DataFrame:
    score = F.when(F.col("event_type") == "error", -2).when(F.col("event_type") == "signup", -1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1)
    return e.select(F.concat(F.lit("atom-"), (F.col("event_id") % 500).cast("string")).alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("wall"),
                    (F.col("event_id") % 3).alias("logical"), F.col("user_id").cast("string").alias("device"), F.col("event_type").isin("view", "click").alias("viewed"), score.alias("score"))


def mark_parts(d: Data) -> list[DataFrame]:
    """The marks of all events, a tenth late and a seventh delivered twice."""
    parts = deliveries(d.events, "event_id", F.col("event_id") % 10 == 3, F.col("event_id") % 7 == 0)
    return [marks_of(p) for p in parts]


@query("x1_lww_stream", "select key, viewed from viewed_marks")
def _(d):
    folder = fed(d, mark_parts(d), lambda s, f: M.updates_to(M.lww_stream(s, "viewed"), f))
    return M.latest(folder, d.spark, ["key"]).select("key", "viewed")


@query("x2_hlc_stream", """select user_id, event_id, hlc_wall, cast(row_number() over (partition by user_id, hlc_wall order by event_id) - 1 as int) hlc_logical from (
 select event_id, user_id, max(w) over (partition by user_id order by event_id rows between unbounded preceding and current row) hlc_wall
 from (select event_id, user_id, epoch_us(ts) // 1000000 - (event_id * 7919) % 4000 w from events) e) x""")
def _(d):
    wall = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000) - (F.col("event_id") * 7919) % 4000
    writes = d.events.select("user_id", "event_id", wall.alias("wall"))
    parts = deliveries(writes, "event_id", twice=F.col("event_id") % 7 == 0)
    folder = fed(d, parts, lambda s, f: M.updates_to(M.hlc_stream(s, "user_id", "event_id"), f, "append"))
    return d.spark.read.parquet(f"{folder}/out").drop("batch")


# Every fifth event is a stamp received from another device. The clock, stated event by event.
fragment("clock_rows", """select user_id, event_id, @SECONDS(ts) - (event_id * 7919) % 4000 wall, event_id % 5 = 2 received, event_id % 13 logical from {events}""")
_RECEIVED = """with recursive n as (
 select *, row_number() over (partition by user_id order by event_id) k from clock_rows
), c as (
 select user_id, event_id, k, wall hlc_wall, case when received then logical else 0 end hlc_logical from n where k = 1
 union all
 select n.user_id, n.event_id, n.k,
  case when n.wall > c.hlc_wall then n.wall else c.hlc_wall end,
  case when n.received and (n.wall > c.hlc_wall or n.wall = c.hlc_wall and n.logical > c.hlc_logical) then n.logical
       when n.received then c.hlc_logical when n.wall > c.hlc_wall then 0 else c.hlc_logical + 1 end
 from c join n on n.user_id = c.user_id and n.k = c.k + 1
) select event_id, hlc_wall, cast(hlc_logical as int) hlc_logical from c"""


@query("x2_received_stamps", _RECEIVED)
def _(d):
    return R.assign_hlc(d.clock_rows, "user_id", "event_id", "received").select("event_id", "hlc_wall", "hlc_logical")


@query("x2_received_stream", _RECEIVED)
def _(d):
    parts = deliveries(d.clock_rows, "event_id", twice=F.col("event_id") % 7 == 0)
    folder = fed(d, parts, lambda s, f: M.updates_to(M.hlc_stream(s, "user_id", "event_id", received="received"), f, "append"))
    return d.spark.read.parquet(f"{folder}/out").select("event_id", "hlc_wall", "hlc_logical")


@query("x3_lww_changes", "select key, cast(viewed as varchar) \"value\" from viewed_marks")
def _(d):
    folder = fed(d, mark_parts(d), lambda s, f: M.updates_to(M.lww_changes(s, "viewed"), f))
    return M.latest(folder, d.spark, ["key"]).select("key", "value")


_LIFE = """select conv_id % 37 review_id, conv_id * 1000 + turn seq, case when role = 'assistant' and turn % 3 = 0 then 'submit' when turn % 5 = 4 then 'single' else 'note' end kind, conv_id * 1000 + turn note_id from {conversations}"""
fragment("review_events", _LIFE)
oracle_fragment("published_notes", """select review_id, note_id, case when kind = 'single' then seq else (select min(s.seq) from review_events s where s.kind = 'submit' and s.review_id = e.review_id and s.seq >= e.seq) end published from review_events e where kind <> 'submit'""")


@query("x4_review_lifecycle", "select review_id, note_id, coalesce(published, 0) published from published_notes")
def _(d):
    return M.review_lifecycle(d.review_events).withColumn("published", F.coalesce("published", F.lit(0)))


@query("x4_lifecycle_stream", "select * from published_notes where published is not null")
def _(d):
    """Rows come up to two parts late or twice; the state reaches three parts back."""
    events = d.review_events
    parts = deliveries(events, "seq", F.col("seq") % 10 == 3, F.col("seq") % 7 == 0)
    low, high = events.agg(F.min("seq"), F.max("seq")).first()
    lateness = 3 * ((high or 0) - (low or 0)) // BATCHES + 3
    folder = fed(d, parts, lambda s, f: M.updates_to(M.lifecycle_stream(s, lateness), f))
    return M.latest(folder, d.spark, ["review_id", "note_id"])


# Snapshots of one source per nation; a token per third of the customers' keys, each holding all files.
_TOKENS = """select cast(c_nationkey as string) source, token, cast(c_custkey as string) path, 33188 mode,
 case when token >= 2 and c_custkey % 5 = 0 then md5(c_name) else md5(c_mktsegment) end blob_id from {customer} cross join (select 1 token union all select 2 union all select 3) t where not (token = 3 and c_custkey % 11 = 0)"""
fragment("token_rows", _TOKENS)


@query("x5_watch_snapshots", """select coalesce(a.source, b.source)||'@'||cast(coalesce(b.token, a.token + 1) as varchar) diffset_id, coalesce(a.path, b.path) path, case when b.path is null then 'deleted' else 'modified' end status
 from (select * from token_rows where token < 3) a full outer join (select * from token_rows where token > 1) b on a.source = b.source and a.token + 1 = b.token and a.path = b.path where a.blob_id is distinct from b.blob_id""")
def _(d):
    """Every snapshot arrives in two halves, the mark of its end with the second."""
    files = d.token_rows.select("source", "token", "path", "mode", "blob_id", F.lit(False).alias("ended"))
    none = F.lit(None)
    marks = files.select("source", "token", none.cast("string").alias("path"), none.cast("int").alias("mode"), none.cast("string").alias("blob_id"), F.lit(True).alias("ended")).distinct()
    halves = [files.filter((F.col("token") == t) & (F.col("path").cast("bigint") % 2 == h)) for t in (1, 2, 3) for h in (0, 1)]
    parts = [p.unionByName(marks.filter(F.col("token") == i // 2 + 1)) if i % 2 else p for i, p in enumerate(halves)]
    folder = fed(d, parts, M.watch_snapshots)
    return d.spark.read.parquet(f"{folder}/out").select("diffset_id", "path", "status")


@query("x6_approval_stream", "select diffset_id, state, coalesce(heaviest, 0) heaviest, read, edits from approvals")
def _(d):
    nodes = outline(d)
    index = R.ApprovalIndex(nodes)
    folder = fed(d, mark_parts(d), lambda s, f: M.approval_stream(s, nodes, f, index))
    return M.latest(folder, d.spark, ["diffset_id"]).withColumn("heaviest", F.coalesce("heaviest", F.lit(0))).select("diffset_id", "state", "heaviest", "read", "edits")


@query("s17_write_tables", """select diffset_id, path, status from changes""")
def _(d):
    """Written partitioned by bucket, and read back."""
    folder = run_folder(d)
    S17.write_tables({"changes": changes(d)}, folder)
    return S17.read_table(d.spark, folder, "changes").select("diffset_id", "path", "status")


@query("s17_read_buckets", """select diffset_id, path, status from changes where diffset_id in ('src3', 'src7')""")
def _(d):
    folder = run_folder(d)
    S17.write_tables({"changes": changes(d)}, folder)
    return S17.read_table(d.spark, folder, "changes", ["src3", "src7"]).select("diffset_id", "path", "status")


_WORDS = "||':'||".join(f"cast(sum(cast('0x'||substr(m, {1 + 8 * i}, 8) as hugeint)) as varchar)" for i in range(4))


@query("s17_diffset_digests", f"""select diffset_id, md5(cast(count(*) as varchar)||':'||{_WORDS}) digest
 from (select diffset_id, md5(path||chr(1)||coalesce(old_path, '')||chr(1)||coalesce("before", '')||chr(1)||coalesce("after", '')) m from changes) r group by 1""")
def _(d):
    return S17.diffset_digests(changes(d))
