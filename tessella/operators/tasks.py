"""Tasks from their events: latest state, pages, search, counts, progress, the state machine."""

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import TERMINAL


def latest(events: DataFrame) -> DataFrame:
    """One row for each task: its newest state, progress and event."""
    last = F.max_by(F.struct("state", "progress", "event_id", "ts"), F.struct("ts", "event_id"))
    return events.groupBy("task_id").agg(last.alias("l"), F.min("ts").alias("created_at"), F.count("*").alias("n_events")).select("task_id", "l.*", "created_at", "n_events")


def settled(events: DataFrame) -> DataFrame:
    """The state machine: the first terminal event decides, later ones are ignored; without one the newest counts."""
    first = F.min_by("state", F.when(F.col("state").isin(*TERMINAL), F.struct("ts", "event_id")))
    return events.groupBy("task_id").agg(F.coalesce(first, F.max_by("state", F.struct("ts", "event_id"))).alias("state"))


def page(tasks: DataFrame, offset: int = 0, limit: int = 20) -> DataFrame:
    return tasks.orderBy(F.desc("created_at"), "task_id").offset(offset).limit(min(limit, 100))


def numbered_page(tasks: DataFrame, number: int, size: int = 10, most: int = 100) -> DataFrame:
    """Page `number`, from 1, of a viewer: it starts at (number - 1) * size and asks for up to `most` tasks."""
    return page(tasks, (max(number, 1) - 1) * size, most)


def in_state(tasks: DataFrame, state: str | None = None) -> DataFrame:
    """The tasks in a state; all of them if none is asked for."""
    return tasks if state is None else tasks.filter(F.col("state") == state)


def by_id(tasks: DataFrame, task_id: str, missing: str = "null") -> DataFrame:
    """The task of an id: one row, with a message and no task where there is none, or an error if `missing` is "error"."""
    asked = tasks.sparkSession.range(1).select(F.lit(task_id).alias("asked"))
    found = F.broadcast(asked).join(tasks.filter(F.col("task_id") == task_id).limit(1), F.col("asked") == F.col("task_id"), "left")
    told = F.concat(F.lit("no task "), "asked")
    message = F.when(F.col("task_id").isNull(), F.raise_error(told) if missing == "error" else told).cast("string")
    return found.withColumn("message", message)


def search(tasks: DataFrame, text: str, columns: tuple = ("task_id", "state")) -> DataFrame:
    """Tasks one of whose columns holds a text, in any case; blanks around the text do not count, an empty text finds all."""
    text = text.strip().lower()
    return tasks.filter(reduce(or_, [F.coalesce(F.lower(c).contains(text), F.lit(False)) for c in columns])) if text else tasks


def lag_ms(last, now):
    """Whole milliseconds since the last activity."""
    return F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(last.cast("timestamp"))) / 1000)


def progress(events: DataFrame) -> DataFrame:
    """Running share of a task's events, to 60 percent, as tiles are read."""
    by = Window.partitionBy("task_id")
    done = F.row_number().over(by.orderBy("ts", "event_id"))
    return events.select("task_id", "event_id", (done / F.count("*").over(by) * 60).alias("percent"))


def upserted(tasks: DataFrame, patches: DataFrame, key: str = "task_id", order: tuple = ("ts", "event_id")) -> DataFrame:
    """tasks with patches laid over them: each field has its newest value that is not null, new keys come in.

    Each side has the key; patches also the columns of `order`. Fields that only one side has are kept. As fields are
    folded apart, a patch of one nested field leaves the others: give such fields columns of their own.
    """
    fields = [c for c in patches.columns if c != key and c not in order]
    newest = F.struct(*order)
    last = patches.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), newest)).alias(c) for c in fields])
    old, new = tasks.alias("o"), last.alias("n")
    have = [c for c in tasks.columns if c != key]
    pick = [F.coalesce(F.col(f"n.`{c}`"), F.col(f"o.`{c}`")).alias(c) if c in have and c in fields else F.col(f"{'o' if c in have else 'n'}.`{c}`").alias(c) for c in [*have, *[c for c in fields if c not in have]]]
    return old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key), *pick)


def with_total(tasks: DataFrame, offset: int = 0, limit: int = 20) -> DataFrame:
    """A page beside the number of all tasks (A19); the count is one row."""
    total = tasks.agg(F.count("*").alias("total"))
    return page(tasks, offset, limit).crossJoin(F.broadcast(total))


def schedule(state, read, tiles):
    """Percent by state: tiles read make 0 to 60, then 75, 90 and 100."""
    return F.when(state == "reading", F.least(F.lit(1.0), read / F.greatest(tiles, F.lit(1))) * 60).when(state == "super_resolving", 60.0).when(state == "stitching", 75.0).when(state == "saving", 90.0).when(state == "completed", 100.0).otherwise(0.0)
