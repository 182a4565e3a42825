"""Continuous harvesting: never the same file twice, only what is new after a baseline, lawful queue moves, and
package completeness with a time limit."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import dedupe, handoff, history, windows
from ..plans.cuts import new_path
from .store import BUCKETS, Buckets, Steps

# From each state of a queue entry the states that it may move to.
MOVES = {
    "new": ("queued", "skipped_owned", "cancelled"),
    "queued": ("claimed", "cancelled", "failed"),
    "claimed": ("downloading", "queued", "failed", "cancelled"),
    "downloading": ("verified", "failed", "quarantined"),
    "verified": ("filed", "failed"),
    "filed": (),
    "skipped_owned": ("queued",),
    "failed": ("queued",),
    "quarantined": ("queued",),
    "cancelled": ("queued",),
}


HISTORY = "file_key string, url string, state string, package string, first_sent long, last_seen long"


def sent_files(spark: SparkSession, table: str, buckets: int = BUCKETS) -> Buckets:
    return Buckets(spark, table, HISTORY, ["file_key"], buckets)


def never_twice(spark: SparkSession, table: str, out: str, on_batch: Callable[[DataFrame, int], None] | None = None, checks: Callable[[DataFrame], DataFrame] | None = None, order: str = "sent", buckets: int = BUCKETS):
    """A foreachBatch function for links (item_id, pos, url, package, sent): only files that the history lacks go out,
    as packages; the history then has all of the batch.

    Steps of a batch are kept in out/batch=<number>: links, fresh, checked (checks: links -> those to keep), packages,
    told (on_batch has had the packages) and done. A batch that runs again goes on behind its last whole step, so that it
    makes nothing twice; on_batch alone may be called again, with the same packages and number, if it or the driver failed
    before `told` was written. A batch that is done does nothing.
    """
    memory = sent_files(spark, table, buckets)

    def run(batch: DataFrame, version: int) -> None:
        steps = Steps(spark, f"{out}/batch={version}")
        if steps.has("done"):
            return
        links = steps.step("links", lambda: dedupe.identified(batch).where("file_key is not null"))
        new = steps.step("fresh", lambda: dedupe.first_of(history.fresh(links, memory.read(links)), ["file_key"], [order, "item_id", "pos"]))
        kept = steps.step("checked", lambda: new if checks is None else checks(new))
        jobs = steps.step("packages", lambda: handoff.packages(kept, order))
        if not steps.has("told"):
            if on_batch is not None:
                on_batch(jobs, version)
            steps.mark("told")
        memory.merge(links.select("file_key", "url", "package", F.col(order).alias("sent")), history.record_sent)
        steps.mark("done")

    return run


def sent_links(spark: SparkSession, out: str, step: str = "fresh") -> DataFrame:
    """All rows of a step over all batches, with their batch."""
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*/{step}")


def after_baseline(spark: SparkSession, table: str, out: str, buckets: int = BUCKETS):
    """A foreachBatch function for releases (store, release_id): the first batch is the silent baseline, later ones tell
    what is new, in out/batch=<number>/new."""
    memory = Buckets(spark, table, "store long, release_id long", ["store", "release_id"], buckets)

    def run(batch: DataFrame, version: int) -> None:
        steps = Steps(spark, f"{out}/batch={version}")
        if steps.has("done"):
            return
        seen = lambda: history.not_in_baseline(batch.select("store", "release_id").distinct(), memory.read(batch), ["store", "release_id"])
        new = steps.step("new" if version else "baseline", seen)
        memory.merge(new, lambda past, rows: past.union(rows).distinct())
        steps.mark("done")

    return run


def thread_marks(spark: SparkSession, table: str, buckets: int = BUCKETS) -> Buckets:
    return Buckets(spark, table, "topic_id long, mark long", ["topic_id"], buckets)


def resumed_walks(spark: SparkSession, table: str, out: str, pager: str | None = None, most: int = 500, buckets: int = BUCKETS):
    """A foreachBatch function for the pages of topics (topic_id, offs, has_old, a pager) as they are stored: the pages to
    read go to out/batch=<number>/read, beginning where the last walk stopped. A walk that comes to its end moves its
    topic's mark; one that is cut short leaves it, so that the next one reads on."""
    marks = thread_marks(spark, table, buckets)

    def run(batch: DataFrame, version: int) -> None:
        steps = Steps(spark, f"{out}/batch={version}")
        if steps.has("done"):
            return
        read = steps.step("read", lambda: windows.thread_walks(batch, marks.read(batch), pager, most))
        ended = read.where("complete").groupBy("topic_id").agg(F.max("newest").alias("mark"))
        marks.merge(ended, lambda past, new: past.join(new, "topic_id", "left_anti").unionByName(new))
        steps.mark("done")

    return run


def bounded_once(links: DataFrame, at: str = "ts", delay: str = "1 day") -> DataFrame:
    """Within the watermark each file once: state is bounded, unlike with a history."""
    return dedupe.identified(links).where("file_key is not null").withWatermark(at, delay).dropDuplicatesWithinWatermark(["file_key"])


def run_once(stream: DataFrame, name: str) -> DataFrame:
    """All that a stream gives of what is there now, as a table in the shared folder (out of append mode)."""
    return resumed(stream, new_path(stream.sparkSession, name))


def resumed(stream: DataFrame, path: str) -> DataFrame:
    """The same with a folder of one's own: called again, it goes on behind what it has had, and gives all so far."""
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def stage_counts(events: DataFrame, length: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events by stage and window of time."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", delay).groupBy(F.window("ts", length), "stage").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "stage", "n")


def _fold(state: str, attempts: int, moves: Iterator[tuple[int, str]]):
    for seq, to in moves:
        legal = to in MOVES[state]
        attempts += legal and to == "failed"
        yield seq, state, to, legal, attempts
        state = to if legal else state


_AUDIT = "queue_id long, seq long, from_state string, to_state string, legal boolean, attempts int"
#: Numbers of moves (seq) that a task replays at a time.
RANGE = 100_000


def _runs(batches) -> Iterator[tuple[tuple, Iterator[pa.RecordBatch]]]:
    """Sorted Arrow batches (queue_id, part, ...) -> each run of one entry and range, as the slices that hold it."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, parts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        ends = [*(np.flatnonzero((ids[1:] != ids[:-1]) | (parts[1:] != parts[:-1])) + 1), batch.num_rows]
        start = 0
        for end in ends:
            now = (int(ids[start]), int(parts[start]))
            if now != key and held:
                yield key, held
                held = []
            key = now
            held.append(batch.slice(start, end - start))
            start = end
    if held:
        yield key, held


def _moves(held: list[pa.RecordBatch], column: int) -> Iterator:
    return (v for b in held for v in b.column(column).to_pylist())


def _effects(batches) -> Iterator[pa.RecordBatch]:
    """What a range of moves makes of each state that an entry could be in before it."""
    rows: list[tuple] = []
    for key, held in _runs(batches):
        now = {start: (start, 0) for start in MOVES}
        for to in _moves(held, 3):
            ways = {state: to in MOVES[state] for state in {s for s, _ in now.values()}}
            if any(ways.values()):
                now = {start: (to, fails + (to == "failed")) if ways[state] else (state, fails) for start, (state, fails) in now.items()}
        rows += ((*key, start, state, fails) for start, (state, fails) in now.items())
        if len(rows) >= 10_000:
            yield _table(rows, _EFFECTS)
            rows = []
    if rows:
        yield _table(rows, _EFFECTS)


_EFFECTS = pa.schema([("queue_id", pa.int64()), ("part", pa.int64()), ("start", pa.string()), ("state", pa.string()), ("fails", pa.int32())])
_AUDITED = pa.schema([("queue_id", pa.int64()), ("seq", pa.int64()), ("from_state", pa.string()), ("to_state", pa.string()), ("legal", pa.bool_()), ("attempts", pa.int32())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _replayed(batches) -> Iterator[pa.RecordBatch]:
    """Each range from its own start."""
    rows: list[tuple] = []
    for key, held in _runs(batches):
        state, attempts = held[0].column(4)[0].as_py(), held[0].column(5)[0].as_py()
        for row in _fold(state, attempts, zip(_moves(held, 2), _moves(held, 3))):
            rows.append((key[0], *row))
            if len(rows) >= 10_000:
                yield _table(rows, _AUDITED)
                rows = []
    if rows:
        yield _table(rows, _AUDITED)


def replay_queue(moves: DataFrame, span: int = RANGE) -> DataFrame:
    """moves (queue_id, seq, to_state) judged in order of seq: a move counts from the state that the lawful ones before
    it left, beginning with new.

    An entry with many moves is cut into ranges of about span moves, by how far its seqs lie apart. What a range makes of
    each possible state is found for all ranges side by side, then folded over the ranges of an entry, then all ranges are
    replayed from their own start. A task works through its sorted moves, however few an entry has.
    """
    moves = moves.select("queue_id", "seq", "to_state")
    size = moves.groupBy("queue_id").agg(F.count("*").alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high"))
    each = F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low") + 1) * F.lit(span) / F.col("n"))).cast("long")
    long = size.where(F.col("n") > span).select("queue_id", "low", each.alias("each"))  # entries of one range need no cut
    part = F.coalesce(F.floor((F.col("seq") - F.col("low")) / F.col("each")), F.lit(0)).cast("long")
    rows = moves.join(long, "queue_id", "left").select(F.col("queue_id").cast("long"), part.alias("part"), F.col("seq").cast("long"), "to_state")
    n = int(moves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["queue_id", "part"]
    dealt = rows.repartition(n, *by)
    in_order = lambda df: df.sortWithinPartitions(*by, "seq")
    effects = in_order(dealt).mapInArrow(_effects, "queue_id long, part long, start string, state string, fails int")
    # of each range one map from start to what becomes of it, folded over an entry's ranges
    maps = effects.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("start", F.struct("state", "fails")))).alias("m"))
    first = F.struct(F.lit("new").alias("state"), F.lit(0).alias("fails"), F.array().cast("array<struct<part:long,state:string,attempts:int>>").alias("starts"))
    step = lambda acc, x: F.struct(x["m"][acc["state"]]["state"].alias("state"), (acc["fails"] + x["m"][acc["state"]]["fails"]).alias("fails"), F.array_append(acc["starts"], F.struct(x["part"].alias("part"), acc["state"].alias("state"), acc["fails"].alias("attempts"))).alias("starts"))
    folded = maps.groupBy("queue_id").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("part", F.col("m"))), lambda a, b: F.signum(a["part"] - b["part"]).cast("int")), first, step)["starts"].alias("s"))
    starts = folded.select("queue_id", F.inline("s"))
    return in_order(dealt.join(starts.hint("merge"), by)).select(*by, "seq", "to_state", "state", "attempts").mapInArrow(_replayed, _AUDIT)


class QueueMoves(StatefulProcessor):
    """The same over a stream: the state of an entry is kept between batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state string, attempts int")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """The entry as a snapshot has it: state and attempts."""
        self.state.update((initialState["state"], initialState["attempts"]))

    def handleInputRows(self, key, rows, timerValues):
        state, attempts = self.state.get() or ("new", 0)
        last = None
        for last in _fold(state, attempts, sorted((r["seq"], r["to_state"]) for r in rows)):
            yield Row(queue_id=key[0], seq=last[0], from_state=last[1], to_state=last[2], legal=last[3], attempts=last[4])
        if last is not None:
            self.state.update((last[2] if last[3] else last[1], last[4]))

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams that are started inside keep their state by key in RocksDB, as the operators with state of their own need
    it; the session's own choice comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stream_queue(moves: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """snapshot: queue_id, state, attempts of entries that are known when the stream begins; others begin as new."""
    known = snapshot.groupBy("queue_id") if snapshot is not None else None
    return moves.groupBy("queue_id").transformWithState(QueueMoves(), _AUDIT, "Append", "None", known)


def queue_snapshot(audit: DataFrame) -> DataFrame:
    """queue_id, state, attempts that the moves of an audit leave behind."""
    after = F.when(F.col("legal"), F.col("to_state")).otherwise(F.col("from_state"))
    return audit.groupBy("queue_id").agg(F.max_by(after, "seq").alias("state"), F.max_by("attempts", "seq").alias("attempts"))


_PACKAGE = "package string, found int, wanted int, complete boolean"


class PackageWatch(StatefulProcessor):
    """Emits a package once: when all its names have come in, or its time is over."""

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.wanted = handle.getMapState("wanted", "name string", "came boolean")
        self.done = handle.getValueState("done", "done boolean")

    def _counts(self) -> tuple[int, int]:
        values = [v[0] for v in self.wanted.values()]
        return sum(values), len(values)

    def handleInputRows(self, key, rows, timerValues):
        if self.done.exists():
            return
        if not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
        for part in rows:
            for name, came in zip(part["name"], part["came"]):
                before = self.wanted.containsKey((name,)) and self.wanted.getValue((name,))[0]
                self.wanted.updateValue((name,), (bool(came or before),))
        found, wanted = self._counts()
        if found == wanted:
            self.done.update((True,))
            yield pd.DataFrame([(key[0], found, wanted, True)], columns=["package", "found", "wanted", "complete"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.done.exists():
            found, wanted = self._counts()
            self.done.update((True,))
            yield pd.DataFrame([(key[0], found, wanted, False)], columns=["package", "found", "wanted", "complete"])

    def close(self) -> None:
        pass


def watch_packages(names: DataFrame, patience_s: int = 900) -> DataFrame:
    """names (package, name, came): wanted names with came false, collected ones with came true, in any order."""
    return names.groupBy("package").transformWithStateInPandas(PackageWatch(1000 * patience_s), _PACKAGE, "Append", "ProcessingTime")
