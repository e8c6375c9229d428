"""Registered streaming queries over keyed state; each runs the events in several micro-batches, with a restart between."""

from __future__ import annotations

from contextlib import nullcontext

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import events as folding
from ..streaming import frames, pending, state
from . import fixtures as fx
from .fixtures import sql
from .queries import query

SLICES = 3


def by_slices(spark, sf_dir, process, mode: str) -> DataFrame:
    """Run process(task events as a stream) over the events slice by slice: after each the query ends and the next run goes on from its checkpoint."""
    base, events = state.fresh_folder(spark, "events"), spark.read.parquet(f"{sf_dir}/events.parquet")
    for i, part in enumerate(state.in_slices(events, SLICES, f"{base}/whole")):
        part.write.parquet(f"{base}/in/{i}")
        stream = spark.readStream.schema(events.schema).parquet(f"{base}/in/*")
        rows = state.written(process(fx.as_task_events(stream)), f"{base}/run", mode)
    return rows


_ENDS = "('completed', 'failed', 'cancelled')"


@query(sql("task_events", f""", o AS (SELECT *, row_number() OVER w AS i, lead(ts) OVER w AS next_ts, max(ts) OVER () - INTERVAL 10 MINUTE AS mark FROM task_events WINDOW w AS (PARTITION BY task_id ORDER BY ts, event_id)),
e AS (SELECT task_id, min(i) AS ended FROM o WHERE state IN {_ENDS} GROUP BY task_id),
k AS (SELECT o.*, i > coalesce(ended, i) AS late FROM o LEFT JOIN e USING (task_id))
SELECT task_id, arg_max(state, i) FILTER (WHERE NOT late) AS state, round(arg_max(progress, i) FILTER (WHERE NOT late), 6) AS progress, max(ts) FILTER (WHERE NOT late) AS ts, count(*) FILTER (WHERE NOT late) AS n_events,
  count(*) FILTER (WHERE late) AS ignored, count(*) FILTER (WHERE NOT late AND state NOT IN {_ENDS} AND coalesce(next_ts, mark) > ts + INTERVAL 6 HOUR) AS idle FROM k GROUP BY task_id"""))
def stream_task_state(spark, sf_dir) -> DataFrame:
    """State of every task after all events, by keyed state with end states and idle timers."""
    last = state.newest(by_slices(spark, sf_dir, state.task_states, "update"))
    return last.select("task_id", "state", F.round("progress", 6).alias("progress"), F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "n_events", "ignored", "idle")


@query(sql("task_events", """SELECT task_id, row_number() OVER w AS cell_no, event_id, tile_no, round(progress, 6) AS value, round(sum(progress) OVER (w ROWS UNBOUNDED PRECEDING), 4) AS total
FROM task_events WHERE event_type = 'click' WINDOW w AS (PARTITION BY task_id ORDER BY ts, event_id)"""))
def stream_cells(spark, sf_dir) -> DataFrame:
    """Cells of every task as they come in, numbered, with their running total."""
    clicks = lambda events: events.filter("event_type = 'click'").withColumnRenamed("progress", "value")
    rows = by_slices(spark, sf_dir, lambda events: state.cell_lists(clicks(events)), "append")
    return rows.select("task_id", "cell_no", "event_id", "tile_no", F.round("value", 6).alias("value"), F.round("total", 4).alias("total"))


def _far(spark, sf_dir, ids: dict) -> DataFrame:
    """Events (type by id) long after all others, so that watermarks pass these."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    last = events.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"))
    kind = F.element_at(F.create_map(*[F.lit(x) for p in ids.items() for x in p]), F.col("event_id"))
    rows = F.broadcast(last).crossJoin(spark.createDataFrame([(i,) for i in ids], "event_id long"))
    return rows.select("event_id", "ts", F.lit(-1).cast("long").alias("user_id"), kind.alias("event_type"), F.lit(0.0).alias("value"), F.lit('{"k": 0}').alias("props"))


@query("""WITH q AS (SELECT event_id AS request_id, ts AS asked FROM events WHERE event_type = 'signup'),
r AS (SELECT event_id AS result_id, event_id - CAST(json_extract_string(props, '$.k') AS BIGINT) AS answer_to, ts AS answered_at, value FROM events WHERE event_type = 'purchase'),
j AS (SELECT * FROM q FULL JOIN r ON answer_to = request_id AND answered_at >= asked AND answered_at <= asked + INTERVAL 2 HOUR)
SELECT coalesce(request_id, answer_to) AS request_id, coalesce(result_id, -1) AS result_id, round(coalesce(value, -1), 4) AS value,
  CASE WHEN asked IS NULL THEN 'unknown' WHEN answered_at IS NULL THEN 'timeout' WHEN row_number() OVER (PARTITION BY request_id ORDER BY answered_at, result_id) = 1 THEN 'done' ELSE 'repeated' END AS status FROM j""")
def stream_pending_results(spark, sf_dir) -> DataFrame:
    """Requests and the results that name them, as two streams: done, repeated, timed out or of an unknown id."""
    base, events = state.fresh_folder(spark, "pending"), spark.read.parquet(f"{sf_dir}/events.parquet")
    parts = [*state.in_slices(events, SLICES - 1, f"{base}/whole"), _far(spark, sf_dir, {-1: "signup", -2: "purchase"})]
    for i, part in enumerate(parts):
        part.select(events.columns).write.parquet(f"{base}/in/{i}")
        stream = lambda: spark.readStream.schema(events.schema).parquet(f"{base}/in/*")
        requests = stream().filter("event_type = 'signup'").select(F.col("event_id").alias("request_id"), F.col("ts").alias("at"))
        k = F.get_json_object("props", "$.k").cast("long")
        results = stream().filter("event_type = 'purchase'").select(F.col("event_id").alias("result_id"), (F.col("event_id") - k).alias("answer_to"), F.col("ts").alias("answered_at"), "value")
        pairs = state.written(pending.answered(requests, results), f"{base}/run", "append", nullcontext)
    rows = pending.settled(pairs.drop("batch"))
    return rows.select("request_id", F.coalesce("result_id", F.lit(-1)).alias("result_id"), F.round(F.coalesce("value", F.lit(-1.0)), 4).alias("value"), "status")


_FRAME = """CASE event_type WHEN 'signup' THEN CAST(json_object('magic', 'OME-TIFF', 'task', task_id, 'at', event_id) AS VARCHAR) WHEN 'view' THEN CAST(json_object('type', 'tile', 'row', tile_no % 6, 'col', tile_no % 5) AS VARCHAR)
  WHEN 'click' THEN CAST(json_object('type', 'progress', 'message', '读取 ' || tile_no) AS VARCHAR) WHEN 'purchase' THEN CAST(json_object('type', 'final', 'outputPath', '/out/' || event_id) AS VARCHAR) END"""


@query(sql("task_events", f"SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY ts, event_id) AS seq, {_FRAME} AS body FROM task_events WHERE event_type <> 'error'"))
def stream_frame_files(spark, sf_dir) -> DataFrame:
    """Frames of every task, written in order by a stream with restarts and read back from its files."""
    base, events = state.fresh_folder(spark, "frames"), spark.read.parquet(f"{sf_dir}/events.parquet")
    number, of = F.col("tile_no"), lambda **fields: F.to_json(F.struct(*[(v if not isinstance(v, str) else F.lit(v)).alias(k) for k, v in fields.items()]))
    body = (
        F.when(F.col("event_type") == "signup", of(magic="OME-TIFF", task=F.col("task_id"), at=F.col("event_id"))).when(F.col("event_type") == "view", of(type="tile", row=number % 6, col=number % 5))
        .when(F.col("event_type") == "click", of(type="progress", message=F.concat(F.lit("读取 "), number.cast("string")))).otherwise(of(type="final", outputPath=F.concat(F.lit("/out/"), F.col("event_id").cast("string"))))
    )
    for i, part in enumerate(state.in_slices(events, SLICES, f"{base}/whole")):
        part.write.parquet(f"{base}/in/{i}")
        tasks = fx.as_task_events(spark.readStream.schema(events.schema).parquet(f"{base}/in/*")).filter("event_type <> 'error'")
        frames.framed_stream(tasks.select("task_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", body.alias("body")), f"{base}/out", f"{base}/state")
    return frames.read_frames(spark, f"{base}/out")


@query(sql("slides task_events", """, t AS (SELECT 'task-' || slide_id AS task_id, 0.5::DOUBLE AS progress, 'created' AS message FROM slides WHERE slide_id % 2 = 0),
u AS (SELECT task_id, arg_max(CASE WHEN tile_no % 3 > 0 THEN progress END, (ts, event_id)) FILTER (WHERE tile_no % 3 > 0) AS progress, arg_max(state, (ts, event_id)) FILTER (WHERE event_id % 2 = 0) AS message FROM task_events GROUP BY 1)
SELECT task_id, round(coalesce(u.progress, t.progress), 6) AS progress, coalesce(u.message, t.message) AS message FROM t JOIN u USING (task_id)"""))
def stream_fold_progress(spark, sf_dir) -> DataFrame:
    """Updates of known tasks, folded into them as they stream in; some leave out progress or message (T4)."""
    slides = fx.slides(spark, sf_dir).filter("slide_id % 2 = 0")
    known = slides.select(F.concat(F.lit("task-"), F.col("slide_id").cast("string")).alias("task_id"), F.lit(0.5).alias("progress"), F.lit("created").alias("message"))
    updates = fx.as_task_events(folding.read_events(spark, sf_dir))
    updates = updates.withColumns({"progress": F.when(F.col("tile_no") % 3 > 0, F.col("progress")), "message": F.when(F.col("event_id") % 2 == 0, F.col("state")).otherwise("")})
    rows = folding.drained(folding.folded_stream(known, updates))
    return rows.select("task_id", F.round("progress", 6).alias("progress"), "message")
