"""Streams of reviewer marks and notes.

State that a key keeps goes through ``transformWithState``: processors read a micro-batch's rows of a key one by one
and hold values, maps and no frames. A last write never expires: a late one must still merge, so no watermark drops
one. Views over many keys (approval, moving snapshots) keep their tables as levelled runs; no batch reads history again.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from diffloom.functions.scan import running
from diffloom.operators.review import ApprovalIndex, lww_state
from diffloom.session import cut
from diffloom.streaming.runs import LevelledRuns

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed(rows: DataFrame, by: str, processor: StatefulProcessor, schema: str, mode: str) -> DataFrame:
    """``processor`` over the rows of each key. Its maps and values need the RocksDB state store, which keeps state on
    the executors' disks and its changes in the checkpoint."""
    rows.sparkSession.conf.set(_PROVIDER, _ROCKS)
    return rows.groupBy(by).transformWithState(processor, schema, mode, "None")


def updates_to(stream: DataFrame, folder: str, mode: str = "update", transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Runs a stream to the end of what is there, each micro-batch written under its number. A batch run
    again after a failure overwrites its own files, so the output holds every batch once."""

    def write(batch: DataFrame, number: int) -> None:
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(write)
    return writer.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()


def latest(folder: str, spark, keys: list[str]) -> DataFrame:
    """The newest update per key of a folder ``updates_to`` wrote."""
    df = spark.read.parquet(f"{folder}/out")
    rest = [c for c in df.columns if c not in (*keys, "batch")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_l")).select(*keys, "_l.*")


def lww_stream(marks: DataFrame, value: str, rank=None) -> DataFrame:
    """The last-writer-wins state of a stream of marks: the batch aggregate itself, in update mode. Tasks
    combine a key's writes before the shuffle, so a hot key arrives as one partial row per task."""
    return lww_state(marks, value, rank=rank)


class LastWrite(StatefulProcessor):
    """Keeps a key's newest write (wall, logical, device, rank) and tells when the value read from it changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "wall bigint, logical int, device string, rank int, value string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers) -> Iterator[Row]:
        old = tuple(self.newest.get()) if self.newest.exists() else None
        place = lambda w: [(x is not None, x) for x in w[:4]]
        best = old
        for r in rows:
            write = (r["wall"], r["logical"], r["device"], r["rank"], r["value"])
            if best is None or place(write) > place(best):
                best = write
        if best is not None and best != old:
            self.newest.update(best)
        if best is not None and (old is None or old[4] != best[4]):
            yield Row(key=key[0], value=best[4], wall=best[0], logical=best[1], device=best[2])

    def close(self) -> None:
        pass


def lww_changes(marks: DataFrame, value: str) -> DataFrame:
    """Emits a key only when the value read from its state changed; a cleared value is null. Late and repeated writes
    change nothing."""
    rows = marks.select("key", F.col(value).cast("string").alias("value"), F.col("wall").cast("bigint").alias("wall"), F.col("logical").cast("int").alias("logical"),
                        "device", F.coalesce(F.col(value).try_cast("int"), F.lit(0)).alias("rank"))
    return keyed(rows, "key", LastWrite(), "key string, value string, wall bigint, logical int, device string", "Update")


class HybridClock(StatefulProcessor):
    """A device's clock: the last reading, and the place of the last write in the device's own order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "wall bigint, logical bigint, at bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers) -> Iterator[Row]:
        wall, logical, at = self.last.get() if self.last.exists() else (None, -1, None)
        for r in sorted(rows, key=lambda r: r["at"]):  # a device's writes of one micro-batch
            if at is not None and r["at"] <= at:
                continue
            at = r["at"]
            if r["received"]:
                if wall is None or (r["wall"], r["remote"]) > (wall, logical):
                    wall, logical = r["wall"], r["remote"]
            elif wall is None or r["wall"] > wall:
                wall, logical = r["wall"], 0
            else:
                logical += 1
            yield Row(by=key[0], at=at, hlc_wall=wall, hlc_logical=logical)
        if at is not None:
            self.last.update((wall, logical, at))

    def close(self) -> None:
        pass


def hlc_stream(writes: DataFrame, by: str = "device", order: str = "seq", wall: str = "wall", received: str | None = None, logical: str = "logical") -> DataFrame:
    """A hybrid clock reading per row, per device across micro-batches: later than every one made or received before.
    Rows with ``received`` are stamps (``wall``, ``logical``) of other devices, which move the clock past themselves. A
    device's rows arrive in its own order; one that is not past the last is a redelivery and gives nothing."""
    kind = dict(writes.dtypes)
    remote = (F.col(received), F.coalesce(F.col(logical).cast("bigint"), F.lit(0))) if received else (F.lit(False), F.lit(0).cast("bigint"))
    rows = writes.select(F.col(by).alias("by"), F.col(order).cast("bigint").alias("at"), F.col(wall).cast("bigint").alias("wall"), remote[0].alias("received"), remote[1].alias("remote"))
    out = keyed(rows, "by", HybridClock(), f"by {kind[by]}, at bigint, hlc_wall bigint, hlc_logical bigint", "Append")
    return out.select(F.col("by").alias(by), F.col("at").cast(kind[order]).alias(order), "hlc_wall", F.col("hlc_logical").cast("int").alias("hlc_logical"))


def review_lifecycle(events: DataFrame) -> DataFrame:
    """When each note was published. ``events``: ``review_id, seq, kind`` (note, single, submit), ``note_id``.
    A single comment is final at once; a note waits for its review's next submit. Batch form: the next
    submit of a note is the least later one, a running minimum from the end that a review of any size may
    take; a note never submitted has a null ``published``."""
    rows = running(events, ["review_id"], [F.desc("seq")], {"_next": ("min", F.when(F.col("kind") == "submit", F.col("seq")))})
    published = F.when(F.col("kind") == "single", F.col("seq")).otherwise(F.col("_next"))
    return rows.filter("kind <> 'submit'").select("review_id", "note_id", published.alias("published"))


class Lifecycle(StatefulProcessor):
    """A review's notes that wait, or whose submit a late one may still precede, and its recent submits."""

    def __init__(self, lateness: int | None) -> None:
        self.lateness = lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.notes = handle.getMapState("notes", "seq bigint, note_id bigint", "published bigint")
        self.submits = handle.getMapState("submits", "seq bigint", "n int")
        self.newest = handle.getValueState("newest", "seq bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers) -> Iterator[Row]:
        top = self.newest.get()[0] if self.newest.exists() else None
        floor = top - self.lateness if top is not None and self.lateness is not None else None
        known = {k[0] for k in self.submits.keys()}
        fresh, came, newest = set(), {}, top
        for r in rows:
            if floor is not None and r["seq"] < floor:
                continue
            newest = r["seq"] if newest is None else max(newest, r["seq"])
            if r["kind"] == "submit":
                fresh.add(r["seq"])
            elif r["kind"] == "single":
                yield Row(review_id=key[0], note_id=r["note_id"], published=r["seq"])
            else:
                came[(r["seq"], r["note_id"])] = None
        fresh -= known
        for seq in fresh:
            self.submits.updateValue((seq,), (1,))
        order = sorted(known | fresh)
        after = lambda seq: order[i] if (i := bisect_left(order, seq)) < len(order) else None
        changed = [k for k in came if not self.notes.containsKey(k)]
        if fresh:  # a submit may publish what waits, or precede the one that did
            waits = ((tuple(k), v[0]) for k, v in self.notes.iterator())
            changed += [k for k, old in waits if (s := after(k[0])) is not None and (old is None or s < old)]
        for k in changed:
            published = after(k[0])
            self.notes.updateValue(k, (published,))
            if published is not None:
                yield Row(review_id=key[0], note_id=k[1], published=published)
        if newest is not None and newest != top:
            self.newest.update((newest,))
            if self.lateness is not None:
                floor = newest - self.lateness
                for k in [tuple(k) for k, v in self.notes.iterator() if v[0] is not None and v[0] < floor]:
                    self.notes.removeKey(k)
                for seq in [s for s in order if s < floor]:
                    self.submits.removeKey((seq,))

    def close(self) -> None:
        pass


def lifecycle_stream(events: DataFrame, lateness: int | None = None) -> DataFrame:
    """The same over a stream, in any order of arrival: a note is told with its submit once that is known, and again if
    an earlier one comes late, so the newest row of a note holds. With ``lateness`` rows of a review more than so many
    places behind its newest are dropped, and its state holds the notes that wait and what is within that reach;
    without it every row is kept for good."""
    rows = events.select("review_id", F.col("seq").cast("bigint").alias("seq"), "kind", F.col("note_id").cast("bigint").alias("note_id"))
    return keyed(rows, "review_id", Lifecycle(lateness), "review_id bigint, note_id bigint, published bigint", "Update")


def approval_stream(marks: DataFrame, outline: DataFrame, folder: str, index: ApprovalIndex | None = None) -> StreamingQuery:
    """Approvals recomputed whenever a mark changes, for the change sets it touches only. The marks' state is the
    aggregate of ``lww_stream``; its updates go to a table of the newest mark per key in levelled runs, and the sets
    they touch read back the buckets of their own keys. No batch reads the outline: batches judge by its ``index``, which
    a caller that starts the stream several times makes once."""
    spark = outline.sparkSession
    state = marks.groupBy("key").agg(
        F.max_by("viewed", F.struct("wall", "logical", "device", F.col("viewed").cast("int"))).alias("viewed"),
        F.max_by(F.struct("score"), F.struct("wall", "logical", "device", F.coalesce("score", F.lit(0)))).alias("_s"),
    ).select("key", "viewed", F.col("_s.score").alias("score"))
    held = LevelledRuns(spark, f"{folder}/marks", state.schema, ["key"])
    index = index or ApprovalIndex(outline)
    keys = cut(index.asked())

    def write(batch: DataFrame, number: int) -> None:
        batch = cut(batch)
        held.add(batch, number)
        touched = cut(keys.join(batch, "key", "left_semi").select("diffset_id").distinct())
        wanted = keys.join(touched, "diffset_id", "left_semi").select("key").distinct()
        now = cut(held.read(number + 1, like=wanted).join(wanted, "key", "left_semi"))
        out = index.approval(touched, now.select("key", "score"), now.select(F.col("key").alias("atom"), "viewed"))
        out.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    return state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()


_FILE = "source string, path string, mode int, blob_id string, gone boolean"
_ARRIVED = "source string, token bigint, path string, mode int, blob_id string, ended boolean"


def watch_snapshots(rows: DataFrame, folder: str) -> StreamingQuery:
    """Change sets of a moving source, named ``source@token``. ``rows`` are a snapshot's files (source, token, path,
    mode, blob_id) and, with ``ended`` true, the mark that all of them have been sent; the token of a source grows.

    A snapshot counts once its mark is there; until then its rows wait, over as many micro-batches as it takes, and
    emit nothing. It is compared with the newest complete one before it, whose files are kept as levelled runs of what
    changed; a source's first snapshot is only remembered. Rows sent twice count once. A snapshot that ends after a
    later one is passed over. A change set whose content was already given for its source is not repeated."""
    from diffloom.operators.snapshots import diff_snapshots
    from diffloom.sources.tables import diffset_digests

    spark = rows.sparkSession
    files = LevelledRuns(spark, f"{folder}/files", StructType.fromDDL(_FILE), ["source", "path"], ["source"])
    heads = LevelledRuns(spark, f"{folder}/heads", StructType.fromDDL("source string, token bigint"), ["source"])
    given = LevelledRuns(spark, f"{folder}/given", StructType.fromDDL("source string, digest string"), ["source", "digest"], ["source"])
    columns = [f.name for f in StructType.fromDDL(_ARRIVED)]

    def write(batch: DataFrame, number: int) -> None:
        arrived = batch.select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(_ARRIVED)])
        if number:
            arrived = arrived.unionByName(spark.read.schema(_ARRIVED).parquet(f"{folder}/waiting/batch={number - 1}"))
        arrived = cut(arrived.distinct())
        sources = arrived.select("source").distinct()
        head = cut(heads.read(number, like=sources).join(sources, "source", "left_semi"))
        done = arrived.filter("ended").select("source", "token").distinct().join(head.withColumnRenamed("token", "head"), "source", "left").filter("head is null or token > head")
        before_it = F.lag("token").over(Window.partitionBy("source").orderBy("token"))  # a source's snapshots of one batch
        steps = cut(done.withColumn("previous", F.coalesce(before_it, "head")).withColumn("diffset_id", F.concat_ws("@", "source", F.col("token").cast("string"))))
        last = steps.groupBy("source").agg(F.max("token").alias("token"))
        rest = arrived.join(head.union(last).groupBy("source").agg(F.max("token").alias("head")), "source", "left").filter("head is null or token > head")
        rest.select(*columns).write.mode("overwrite").parquet(f"{folder}/waiting/batch={number}")
        whole = arrived.filter("not ended").join(steps.select("source", "token"), ["source", "token"], "left_semi")
        kept = cut(files.read(number, like=last).filter("not gone").join(last.select("source"), "source", "left_semi"))
        old = kept.join(head, "source").select("source", "token", "path", "mode", "blob_id").unionByName(whole.select("source", "token", "path", "mode", "blob_id"))
        after = whole.join(steps.filter("previous is not null"), ["source", "token"]).select("diffset_id", "path", "mode", "blob_id")
        before = old.withColumnRenamed("token", "previous").join(steps, ["source", "previous"]).select("diffset_id", "path", "mode", "blob_id")
        changes = cut(diff_snapshots(before, after))
        sets = diffset_digests(changes).join(steps.select("diffset_id", "source", "token"), "diffset_id")
        sets = sets.groupBy("source", "digest").agg(F.min_by("diffset_id", "token").alias("diffset_id"))
        sets = cut(sets.join(given.read(number, like=sets), ["source", "digest"], "left_anti"))
        changes.join(sets, "diffset_id").write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        now = whole.join(last, ["source", "token"], "left_semi").select("source", "path", F.col("mode").alias("m"), F.col("blob_id").alias("b"), F.lit(True).alias("there"))
        both = kept.join(now, ["source", "path"], "full_outer").filter(~(F.col("mode").eqNullSafe(F.col("m")) & F.col("blob_id").eqNullSafe(F.col("b")) & F.col("there").eqNullSafe(F.lit(True))))
        files.add(both.select("source", "path", F.col("m").alias("mode"), F.col("b").alias("blob_id"), F.col("there").isNull().alias("gone")), number)
        heads.add(last, number)
        given.add(sets.select("source", "digest"), number)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
