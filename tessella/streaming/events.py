"""Event streams: rooms, running totals, latest state, latency windows (T1-T6, T9); the same functions serve batch and stream."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def room(events: DataFrame, task_id: str) -> DataFrame:
    return events.filter(F.col("task_id") == task_id)


def subscribed(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """The events of tasks that someone is subscribed to, each once for all viewers of it (J11); subscriptions may be a stream's static side."""
    return events.join(subscriptions.select("task_id").distinct(), "task_id", "left_semi")


def delivered(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """A row for each event and viewer (viewer, task_id) of its task, nothing twice."""
    return events.join(subscriptions.select("viewer", "task_id").distinct(), "task_id")


def running_totals(events: DataFrame) -> DataFrame:
    return events.groupBy("task_id").agg(F.count("*").alias("n_events"), F.sum("tile_no").alias("tiles"), F.max("progress").alias("progress"))


def latest_state(events: DataFrame) -> DataFrame:
    return events.groupBy("task_id").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("ts"))


def latency_windows(events: DataFrame, every: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """Tumbling windows with a watermark, so that state stays bounded."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    w = timed.groupBy(F.window("ts", every).alias("w")).agg(F.count("*").alias("n"), F.round(F.avg("progress"), 6).alias("avg_progress"), F.max("progress").alias("max_progress"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "avg_progress", "max_progress")


def read_events(spark: SparkSession, path: str, name: str = "events.parquet") -> DataFrame:
    """The events file as a stream."""
    schema = spark.read.parquet(f"{path}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{path}/{name}*")


def fold_progress(tasks: DataFrame, updates: DataFrame) -> DataFrame:
    """tasks (task_id, progress, message) with each one's last update (task_id, ts, event_id, progress, message) folded in.

    An empty message keeps the old one, a null progress the old one; updates of unknown tasks are ignored.
    """
    last = updates.groupBy("task_id").agg(F.max_by(F.struct("progress", "message"), F.struct("ts", "event_id")).alias("new"))
    message = F.when(F.coalesce(F.col("new.message"), F.lit("")) != "", F.col("new.message")).otherwise(F.col("message"))
    return tasks.join(last, "task_id", "left").select("task_id", F.coalesce("new.progress", "progress").alias("progress"), message.alias("message"))


def folded_stream(tasks: DataFrame, updates: DataFrame) -> DataFrame:
    """fold_progress() for a stream of updates: known tasks that were updated so far, for complete mode (T4).

    tasks is the stream's static side, so updates of unknown tasks fall out before any state is kept; progress and message are
    the newest that are not null or empty.
    """
    known = updates.join(tasks.select("task_id", F.col("progress").alias("_progress"), F.col("message").alias("_message")), "task_id")
    at = F.struct("ts", "event_id")
    said = F.coalesce(F.col("message"), F.lit("")) != ""
    out = known.groupBy("task_id").agg(
        F.coalesce(F.max_by("progress", F.when(F.col("progress").isNotNull(), at)), F.first("_progress")).alias("progress"), F.coalesce(F.max_by("message", F.when(said, at)), F.first("_message")).alias("message")
    )
    return out


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there and give its result table, as Parquet in the shared folder, like its checkpoint.

    A batch that is run again overwrites its own folder. In complete mode the last batch is the result, else all are.
    """
    spark = stream.sparkSession
    given = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if given is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base, done = f"{given or tempfile.mkdtemp(prefix='spark-')}/stream-{uuid.uuid4().hex}", set()

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/{number}")
        done.add(number)

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    numbers = [max(done)] if done and mode == "complete" else sorted(done)
    return spark.read.schema(stream.schema).parquet(*[f"{base}/out/{n}" for n in numbers]) if numbers else spark.createDataFrame([], stream.schema)
