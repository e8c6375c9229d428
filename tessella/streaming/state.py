"""Keyed state of tasks in a stream: latest patch, end states, idle timers, growing lists of cells (T3, T6, T7); over Spark's state stores, so it survives a restart."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import TERMINAL
from ..sources.shared import shared_folder

#: A task without an event for so long is idle once; the watermark trails the newest event by so much.
IDLE_MS, LATE = 6 * 3_600_000, "10 minutes"
STATE = "state string, progress double, us long, event_id long, n_events long, ignored long, idle long, timer long"
TASK_ROW = "task_id string, state string, progress double, us long, event_id long, n_events long, ignored long, idle long"
CELL_ROW = "task_id string, cell_no long, event_id long, tile_no int, value double, total double"


def _in_order(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: (r.us, r.event_id))


class TaskState(StatefulProcessor):
    """A task's row, patched by its events in order of time and id.

    A null progress keeps the old one. After an end state further events are only counted, as `ignored`. Each event of a
    task that goes on sets a timer; if it expires before the next event, the task was idle once more.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.task = handle, handle.getValueState("task", STATE)

    def _kept(self, held: dict) -> None:
        self.task.update(tuple(held[k] for k in ("state", "progress", "us", "event_id", "n_events", "ignored", "idle", "timer")))

    @staticmethod
    def _row(key, held: dict) -> Row:
        return Row(task_id=key[0], **{k: held[k] for k in ("state", "progress", "us", "event_id", "n_events", "ignored", "idle")})

    def _held(self) -> dict:
        if self.task.exists():
            return dict(zip(("state", "progress", "us", "event_id", "n_events", "ignored", "idle", "timer"), self.task.get()))
        return {"state": None, "progress": None, "us": None, "event_id": None, "n_events": 0, "ignored": 0, "idle": 0, "timer": None}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self._held()
        before = held["timer"]
        for r in _in_order(rows):
            if held["state"] in TERMINAL:
                held["ignored"] += 1
                continue
            held["idle"] += held["timer"] is not None and r.us // 1000 > held["timer"]
            held.update(state=r.state, progress=held["progress"] if r.progress is None else r.progress, us=r.us, event_id=r.event_id, n_events=held["n_events"] + 1)
            held["timer"] = None if r.state in TERMINAL else r.us // 1000 + IDLE_MS
        if held["timer"] != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if held["timer"] is not None:
                self.handle.registerTimer(held["timer"])
        self._kept(held)
        yield self._row(key, held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self._held()
        if held["timer"] == expiredTimerInfo.getExpiryTimeInMs():
            held["timer"], held["idle"] = None, held["idle"] + 1
            self._kept(held)
            yield self._row(key, held)

    def close(self) -> None:
        pass


class CellList(StatefulProcessor):
    """Cells of a task in the order they came, numbered from 1, with the running total of their values."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cells = handle.getListState("cells", "event_id long, tile_no int, value double")
        self.sums = handle.getValueState("sums", "n long, total double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, total = self.sums.get() if self.sums.exists() else (0, 0.0)
        new = []
        for r in _in_order(rows):
            n, total = n + 1, total + (r.value or 0.0)
            new.append((r.event_id, r.tile_no, r.value))
            yield Row(task_id=key[0], cell_no=n, event_id=r.event_id, tile_no=r.tile_no, value=r.value, total=total)
        self.cells.appendList(new)
        self.sums.update((n, total))

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession):
    """Within it, streams that start keep their state in RocksDB, as timers and lists need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def _timed(events: DataFrame) -> DataFrame:
    """events with `at`, a timestamp under a watermark, and `us`, its microseconds."""
    at = F.col("ts").cast("timestamp")
    return events.withColumns({"at": at, "us": F.unix_micros(at)}).withWatermark("at", LATE)


def task_states(events: DataFrame) -> DataFrame:
    """A stream of TASK_ROW from (task_id, ts, event_id, state, progress): a task's row each time it changes. Late events behind the watermark may come in any batch order."""
    keyed = _timed(events).select("task_id", "at", "us", "event_id", "state", "progress").groupBy("task_id")
    return keyed.transformWithState(TaskState(), TASK_ROW, "Update", "EventTime")


def cell_lists(events: DataFrame) -> DataFrame:
    """A stream of CELL_ROW from (task_id, ts, event_id, tile_no, value), each cell once."""
    keyed = _timed(events).select("task_id", "at", "us", "event_id", "tile_no", "value").groupBy("task_id")
    return keyed.transformWithState(CellList(), CELL_ROW, "Append", "EventTime")


def written(stream: DataFrame, base: str, mode: str, store=rocksdb) -> DataFrame:
    """Run a stream over all that is there now; what it gave so far, with the number of its batch. base holds output and state, so a later call goes on from there.

    store: the context that chooses the state store; nullcontext for the session's own.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")  # a batch that runs again replaces its own

    spark = stream.sparkSession
    with store(spark):
        query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(f"{stream._jdf.schema().toDDL()}, batch long").parquet(f"{base}/out")


def newest(rows: DataFrame, key: str = "task_id") -> DataFrame:
    """Of written() rows in update mode, the last of each key; within a batch a timer's row follows the one by events."""
    fields = [c for c in rows.columns if c not in (key, "batch")]
    last = F.max_by(F.struct(*fields), F.struct("batch", "n_events", "ignored", "idle")).alias("l")
    return rows.groupBy(key).agg(last).select(key, "l.*")


def in_slices(events: DataFrame, slices: int, folder: str) -> list[DataFrame]:
    """events cut by time into so many slices of about equal size, each in many files."""
    events.repartitionByRange(slices * int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ts").withColumn("_at", F.spark_partition_id()).write.parquet(folder)
    whole = events.sparkSession.read.parquet(folder)
    tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return [whole.filter(F.col("_at").between(i * tasks, (i + 1) * tasks - 1)).drop("_at") for i in range(slices)]


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
