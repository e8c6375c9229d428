"""Results to pending requests: an outer join of two streams with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A request waits so long for its result; events of either stream may be late by LATE.
WITHIN, LATE = "2 hours", "10 minutes"


def answered(requests: DataFrame, results: DataFrame, within: str = WITHIN, late: str = LATE) -> DataFrame:
    """requests (request_id, at) with results (result_id, answer_to, answered_at, value): a row for each pair, request alone and result alone.

    A result belongs to the request that it names if it comes within the time. A request alone timed out; a result
    alone is of an unknown id, or too late. Streams or tables: as streams, both sides' state ends with their watermarks, and a
    side's rows alone come out once the watermark has passed all that could meet them. A null id meets nothing.
    """
    requests = requests.select("request_id", F.col("at").cast("timestamp").alias("at"))
    results = results.select("result_id", "answer_to", F.col("answered_at").cast("timestamp").alias("answered_at"), "value")
    if requests.isStreaming:
        requests, results = requests.withWatermark("at", late), results.withWatermark("answered_at", late)
    # streams would let null ids meet, so each side marks its own
    requests = requests.withColumn("_asked", F.when(F.col("request_id").isNull(), 1).otherwise(0))
    results = results.withColumn("_told", F.when(F.col("answer_to").isNull(), 2).otherwise(0))
    meets = F.expr(f"answer_to = request_id AND _told = _asked AND answered_at >= at AND answered_at <= at + INTERVAL {within}")
    return requests.join(results, meets, "full_outer").drop("_asked", "_told")


def settled(pairs: DataFrame) -> DataFrame:
    """Rows of answered() as (request_id, at, result_id, answered_at, value, status).

    status is `done` for a request's first result, `repeated` for later ones, `timeout` for a request alone and `unknown`
    for a result alone. Over a table: ranks the results of each request that has several.
    """
    by = Window.partitionBy("request_id").orderBy("answered_at", "result_id")
    met = F.col("at").isNotNull() & F.col("answered_at").isNotNull()
    ranked = pairs.filter(met).withColumn("n", F.row_number().over(by))
    done = ranked.withColumn("status", F.when(F.col("n") == 1, "done").otherwise("repeated")).drop("n")
    alone = pairs.filter(~met).withColumn("status", F.when(F.col("at").isNull(), "unknown").otherwise("timeout"))
    rows = done.unionByName(alone)
    return rows.select(F.coalesce("request_id", "answer_to").alias("request_id"), "at", "result_id", "answered_at", "value", "status")
