"""Streams over event tables. Event time and watermarks are ours: ten minutes of delay by default.

Keyed state (`transformWithStateInPandas`) needs the RocksDB state store: `spark.sql.streaming.stateStore.providerClass`, set by `run_to_table` where
nothing else is.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import thresholds as T
from ..operators.limits import LIMITS, decide
from ..operators.ordering import top_per_key

DELAY = "10 minutes"


class LateRows(StreamingQueryListener):
    """Counts, for every query, the rows that came behind the watermark and so took no part: `spark.streams.addListener(LateRows())`."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(str(event.runId), 0)

    def onQueryProgress(self, event) -> None:
        late = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        self.rows[str(event.progress.runId)] = self.rows.get(str(event.progress.runId), 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def _phase(event) -> str:
    status, node = event.result_status or "", event.node or ""
    if event.interrupted:
        return "waiting"
    if event.has_error or status == "failed" or node == "failed":
        return "error"
    if status.startswith("stopped") or node.startswith("stopped_"):
        return "warning"
    return "completed"


def _tenths(micros: int) -> float:
    """Seconds to one place, halves up as in the batch form; round() would take the binary value and halves to even."""
    return max(0, (micros + 50_000) // 100_000) / 10


def _blocks(rows: pa.Table, size: int = 10_000) -> list[tuple[bytes]]:
    """Rows as values of a state, some thousands in each."""
    out = []
    for at in range(0, rows.num_rows, size):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as writer:
            writer.write_table(rows.slice(at, size))
        out.append((sink.getvalue().to_pybytes(),))
    return out


def _rows(state, schema: pa.Schema) -> pa.Table:
    """What `_blocks` has written."""
    blocks = [bytes(b[0]) for b in state.get()] if state.exists() else []
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blocks]) if blocks else schema.empty_table()


class _Stages(StatefulProcessor):
    """Starts and finishes of the tasks of one bucket. Three variables: the events that the watermark has not passed, the open starts, and the time of the timer.

    An event waits until the watermark has passed it, so that events are paired in their order in time, whatever the order they came in. A state costs about as
    much for one row as for a block of thousands, so the tasks of a bucket share theirs and rows are kept in blocks.
    """

    TASK = (("job_id", pa.string()), ("task_id", pa.string()), ("at", pa.int64()), ("id", pa.int64()), ("node", pa.string()))
    STARTS = pa.schema(TASK)
    EVENTS = pa.schema((*TASK, ("is_start", pa.bool_()), ("interrupted", pa.bool_()), ("has_error", pa.bool_()), ("result_status", pa.string())))
    Event = namedtuple("Event", EVENTS.names)

    def __init__(self, idle_seconds: int | None):
        self.idle = idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "block binary")
        self.open = handle.getListState("open", "block binary")
        self.due = handle.getValueState("due", "at bigint")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        if len(initialState):
            self.open.appendList(_blocks(pa.Table.from_pandas(initialState[self.STARTS.names], self.STARTS, preserve_index=False)))
            self._wake(self._idle_end(int(initialState["at"].min())))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            batch = batch[batch["id"].notna()]  # others only move the clock
            if len(batch):
                at = batch["ts"].astype("datetime64[us]").astype("int64")
                self.waiting.appendList(_blocks(pa.Table.from_pandas(batch.assign(at=at)[self.EVENTS.names], self.EVENTS, preserve_index=False)))
                self._wake(int(at.min()) // 1000)
        yield self._frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, rows = timerValues.getCurrentWatermarkInMs() * 1000 + 999, []
        self.due.clear()
        events = _rows(self.waiting, self.EVENTS).sort_by([("at", "ascending"), ("id", "ascending")])
        now = pc.sum(pc.less_equal(events["at"], passed)).as_py() or 0
        starts = {s[:2]: s[2:] for s in zip(*(c.to_pylist() for c in _rows(self.open, self.STARTS).columns), strict=True)}
        for e in map(self.Event._make, zip(*(c.to_pylist() for c in events.slice(0, now).columns), strict=True)):
            task = e[:2]
            start = self._unmatched(task, starts.pop(task, None), e.at, rows)
            if e.is_start:
                starts[task] = (e.at, e.id, e.node)
            else:
                rows.append((*task, e.id, e.node, _phase(e), _tenths(e.at - start[0]) if start else 0.0))
        starts = {task: start for task, start in starts.items() if self._unmatched(task, start, passed, rows)}
        left = [(*task, *start) for task, start in starts.items()]
        self.open.put(_blocks(pa.table(list(map(list, zip(*left, strict=True))), schema=self.STARTS))) if left else self.open.clear()
        later = events.slice(now)
        self.waiting.put(_blocks(later)) if later.num_rows else self.waiting.clear()
        ends = [later["at"][0].as_py() // 1000] if later.num_rows else []
        if left and self.idle:
            ends.append(self._idle_end(min(start[0] for start in starts.values())))
        if ends:
            self._wake(min(ends))
        yield self._frame(rows)

    def close(self) -> None:
        pass

    def _idle_end(self, at: int) -> int:
        return at // 1000 + self.idle * 1000 if self.idle else 0

    def _unmatched(self, task, start, until: int, rows: list):
        """The open start, or none if nothing finished it for the idle time: then it ends as an error."""
        if not start or not self.idle or until < start[0] + self.idle * 1_000_000:
            return start
        rows.append((*task, start[1], start[2], "error", float(self.idle)))
        return None

    def _wake(self, at: int) -> None:
        """One timer per bucket, at the earliest time asked for."""
        if not at:
            return
        due = self.due.get()[0] if self.due.exists() else None
        if due is None or at < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(at)
            self.due.update((at,))

    def _frame(self, rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["job_id", "task_id", "id", "node", "phase", "duration_seconds"])


STAGES = "job_id string, task_id string, id bigint, node string, phase string, duration_seconds double"
PROGRESS = ("job_id", "task_id", "id", "ts", "node", "is_start", "interrupted", "has_error", "result_status")


def stage_timing(progress: DataFrame, delay: str = DELAY, idle_seconds: int | None = None, started: DataFrame | None = None,
                 buckets: int = 256) -> DataFrame:
    """Pair starts and finishes per task, in their order in time, once the watermark has passed them.

    progress(job_id, task_id, id, ts, node, is_start, interrupted, has_error, result_status). With `idle_seconds`, a start that nothing finishes for that long (event
    time) ends as an error. `started` (batch: job_id, task_id, id, node, ts; see `open_stages`) are starts that an earlier run left open. Rows without id only move the
    clock, so a source can close a stream with one. Rows behind the watermark are left out; `LateRows` counts them. Tasks are dealt into `buckets`; a bucket holds the
    events of its tasks that the watermark has not passed, and keeps its number for the life of a checkpoint.
    """
    bucket = F.pmod(F.xxhash64("job_id", "task_id"), F.lit(buckets))
    timed = progress.select(*PROGRESS).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    first = None
    if started is not None:
        first = started.select("job_id", "task_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("id").cast("bigint").alias("id"), "node").withColumn("_bucket", bucket).groupBy("_bucket")
    return timed.withColumn("_bucket", bucket).groupBy("_bucket").transformWithStateInPandas(_Stages(idle_seconds), STAGES, "append", "EventTime", first)


def open_stages(progress: DataFrame) -> DataFrame:
    """The last event of each task where it is a start: what a stream that goes on from here begins with."""
    last = progress.groupBy("job_id", "task_id").agg(F.max_by(F.struct("id", "node", "ts", "is_start"), F.struct("ts", "id")).alias("_e"))
    return last.where("_e.is_start").select("job_id", "task_id", "_e.id", "_e.node", "_e.ts")


class _Limiter(StatefulProcessor):
    """Attempts of one client: the accepted times of the last window, the attempts not yet decided, and how far they are decided.

    The client's own newest attempt is its clock: what lies `delay` behind it is decided, in order; what comes from before that is late. With `quiet`, a client that
    sends nothing for that many seconds of wall-clock time is decided to the end and forgotten.
    """

    def __init__(self, limits: dict, delay_seconds: float, quiet_seconds: float | None):
        self.limits, self.delay, self.quiet = limits, delay_seconds, quiet_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "times array<double>")
        self.waiting = handle.getListState("waiting", "at double, attempt_id bigint")
        self.clock = handle.getValueState("clock", "decided double, timer bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        at = frame["ts"].astype("datetime64[us]").astype("int64") / 1e6
        frame = pd.DataFrame({"at": at, "attempt_id": frame["attempt_id"]})
        decided, timer = self.clock.get() if self.clock.exists() else (float("-inf"), 0)
        late = frame[(frame["at"] <= decided) & frame["attempt_id"].notna()]
        fresh = frame[(frame["at"] > decided) & frame["attempt_id"].notna()]
        waiting = pd.DataFrame([tuple(w) for w in self.waiting.get()] if self.waiting.exists() else [], columns=["at", "attempt_id"])
        waiting = pd.concat([waiting, fresh], ignore_index=True) if len(waiting) else fresh
        decided = max(decided, float(frame["at"].max()) - self.delay)
        if self.quiet:
            if timer:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + int(self.quiet * 1000)
            self.handle.registerTimer(timer)
        self.clock.update((decided, timer))
        yield self._decide(key, waiting, decided)
        if len(late):
            yield self._frame(key, late, None, None, "late")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = pd.DataFrame([tuple(w) for w in self.waiting.get()] if self.waiting.exists() else [], columns=["at", "attempt_id"])
        yield self._decide(key, waiting, float("inf"))
        for state in (self.held, self.waiting, self.clock):
            state.clear()

    def close(self) -> None:
        pass

    def _decide(self, key, waiting: pd.DataFrame, until: float) -> pd.DataFrame:
        now, later = waiting[waiting["at"] <= until].sort_values(["at", "attempt_id"]), waiting[waiting["at"] > until]
        held = list(self.held.get()[0]) if self.held.exists() else []
        accepted, wait, held = decide(now["at"].to_numpy(float), held, *self.limits.get(key[0], self.limits["login"]))
        self.held.update((held,))
        self.waiting.put([(float(a), int(i)) for a, i in zip(later["at"], later["attempt_id"], strict=True)]) if len(later) else self.waiting.clear()
        return self._frame(key, now, accepted, wait, None)

    def _frame(self, key, rows: pd.DataFrame, accepted, wait, reason) -> pd.DataFrame:
        return pd.DataFrame({"operation": key[0], "client": key[1], "attempt_id": rows["attempt_id"].astype("int64"), "at": rows["at"], "accepted": accepted,
                             "retry_after": wait, "reason": reason}, index=rows.index)


def limited_attempts(attempts: DataFrame, limits: dict | None = None, delay_seconds: float = 600, quiet_seconds: float | None = None) -> DataFrame:
    """Accept or refuse attempts(operation, client, attempt_id, ts), in their order in time: operation, client, attempt_id, at (seconds), accepted, retry_after, reason.

    An attempt waits until a newer one of its client is `delay_seconds` ahead, so order within that is mended. One that comes later than that is a row without
    verdict and with the reason `late`, which `limits.judge_late` judges. Rows without attempt_id only move the clock of their client. `quiet_seconds` is for streams that
    go on for ever: with its timers Spark starts batch after batch, so a run over what is available would not end.
    """
    rows = attempts.select("operation", "client", "attempt_id", F.col("ts").cast("timestamp").alias("ts"))
    return rows.groupBy("operation", "client").transformWithStateInPandas(
        _Limiter(limits or LIMITS, delay_seconds, quiet_seconds), "operation string, client string, attempt_id bigint, at double, accepted boolean, retry_after int, reason string",
        "append", "ProcessingTime" if quiet_seconds else "None")


def bounded_log(log: DataFrame, path: str, checkpoint: str, keep: int = T.LOG_ITEMS, buckets: int = 32) -> StreamingQuery:
    """Keep the latest items of every job in a table of buckets; read it with `current_log`.

    Each batch rewrites only the buckets it touches, as a new version, so a repeated batch changes nothing. Of a bucket
    it has written, the version before stays, for a repetition and for readers; older ones are removed.
    """
    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn("bucket", F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int"))
        touched = fresh.select("bucket").distinct()
        old = current_log(spark, path, before=epoch)
        rows = fresh if old is None else fresh.unionByName(old.join(touched, "bucket", "left_semi").select(fresh.columns))
        kept = top_per_key(rows.dropDuplicates(["job_id", "ordinal"]), ["job_id"], [F.desc("ordinal")], keep).drop("_rank")
        (kept.withColumn("version", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket", "version").parquet(path))
        _forget(spark, path, epoch)
    return (log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _forget(spark: SparkSession, path: str, epoch: int) -> None:
    """Remove, of the buckets with version `epoch`, all but that version and the one before. Folder names only; a handful of each bucket."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    for bucket in files.listStatus(hadoop):
        if bucket.getPath().getName().startswith("bucket="):
            versions = {int(v.getPath().getName().split("=")[1]): v.getPath() for v in files.listStatus(bucket.getPath()) if v.getPath().getName().startswith("version=")}
            if epoch in versions:
                for old in sorted(v for v in versions if v < epoch)[:-1]:
                    files.delete(versions[old], True)


def current_log(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """Newest version of every bucket; None before the first batch."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(hadoop) or not any(s.getPath().getName().startswith("bucket=") for s in files.listStatus(hadoop)):
        return None
    rows = spark.read.parquet(path)
    if before is not None:
        rows = rows.where(F.col("version") < before)
    # One row per bucket and version: a handful, whatever the size of the logs.
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))
    return rows.join(newest, ["bucket", "version"]).drop("version")


def with_state_store(spark: SparkSession) -> None:
    """Streams of this session keep their state in RocksDB unless another provider than Spark's default was chosen."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(name, "").endswith("HDFSBackedStateStoreProvider") or not spark.conf.get(name, ""):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def feed(df: DataFrame, path: str, arrival: Column, parts: int, last: DataFrame | None = None) -> DataFrame:
    """Write a table as files that arrive one after the other, by an integer column from 0 to parts - 1, and stream them a file at a time.

    `last` are the rows of the closing file. Each file is one append, so their times are in order. All tasks read the table, one writes the file.
    """
    marked = df.withColumn("_part", arrival)
    for k in range(parts):
        marked.where(F.col("_part") == k).drop("_part").repartition(1).write.mode("append").parquet(path)
    if last is not None:
        last.select(df.columns).coalesce(1).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet table of a folder as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over everything available into a parquet table and read it."""
    with_state_store(stream.sparkSession)
    query = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
