"""Registered queries over event payloads and requests, written as JSON from the given events, with malformed ones among them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import payloads
from .queries import query

_KINDS = [*payloads.EVENTS, "mystery"]


def _json(fields: dict[str, str], quote: str) -> str:
    """SQL for a JSON object whose values are given as SQL texts."""
    parts = f" || ',' || ".join(f"{quote}\"{k}\":{quote} || {v}" for k, v in fields.items())
    return f"({quote}{{{quote} || {parts} || {quote}}}{quote})"


def _bodies() -> dict[str, str]:
    """The payload of each kind of event as a SQL text that both engines read; id is the event's, value its value."""
    text = lambda s: f"'\"' || {s} || '\"'"
    task, number, whole = text("'task-' || CAST(user_id AS STRING)"), "CAST(id % 1000 AS STRING)", "CAST(id % 7 AS STRING)"
    cell = "'{\"centroid_x\":' || CAST(id % 50 AS STRING) || '.5,\"reasons\":[\"r' || CAST(id % 3 AS STRING) || '\"],\"bbox_w\":4}'"
    return {
        "connected": _json({"clientId": text("'c' || CAST(id AS STRING)"), "timestamp": number}, "'"),
        "pong": _json({"timestamp": number, "extra": "'[1,2]'"}, "'"),
        "subscribed": _json({"taskId": task}, "'"),
        "task_status": _json({"taskId": task, "state": text("event_type"), "progress": f"CASE WHEN id % 4 = 0 THEN '\"soon\"' WHEN id % 4 = 1 THEN '\"12.5\"' ELSE {number} END", "timestamp": number}, "'"),
        "task_tile": _json({"taskId": task, "row": whole, "col": "CASE WHEN id % 5 = 0 THEN 'null' ELSE " + whole + " END", "imageData": text("'x' || CAST(id AS STRING)")}, "'"),
        "task_progress": _json({"taskId": task, "progress": f"{whole} || '.25'", "message": text("'step ' || event_type"), "timestamp": number}, "'"),
        "task_complete": _json({"taskId": task, "outputPath": text("'/out/' || CAST(id AS STRING)")}, "'"),
        "task_error": _json({"taskId": task, "error": text("'é <' || event_type || '>'"), "timestamp": text("'late'")}, "'"),
        "cell_analysis": _json({"taskId": task, "tile_index": f"'[' || {whole} || ',3]'", "abnormal_count": whole, "total_count": number, "anomaly_score": "'0.125'",
                                "cells": f"CASE WHEN id % 3 = 0 THEN '[]' ELSE '[' || {cell} || ',' || {cell} || ']' END"}, "'"),
        "ome_header": _json({"taskId": task, "width": number, "height": whole, "tileSize": "'2048'", "gridRows": "'2'", "gridCols": "'3'"}, "'"),
        "nucleus_analysis_complete": _json({"taskId": task, "totalNuclei": number, "abnormalCount": whole, "maxAnomaly": "'0.75'", "avgAnomaly": "'0.5'", "durationMs": f"{number} || '000000000'"}, "'"),
        "mystery": _json({"taskId": task}, "'"),
    }


def _case(made: dict[str, str], of: str) -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in made.items()) + " END"


_KIND = f"CASE CAST(event_id % {len(_KINDS)} AS INT) " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END"
#: Some are cut short, some are no object, some null.
_BROKEN = "CASE WHEN id % 29 = 3 THEN substr(whole, 1, length(whole) - 2) WHEN id % 31 = 4 THEN '[1]' WHEN id % 37 = 5 THEN NULL WHEN id % 41 = 6 THEN 'no json' ELSE whole END"


def _payloads(text: str) -> str:
    """SQL of the rows (id, event, payload), for one engine's name of the text type."""
    return f"""SELECT id, event, {_BROKEN} AS payload FROM (SELECT id, event, {_case(_bodies(), 'event')} AS whole FROM (SELECT event_id AS id, user_id, event_type, {_KIND} AS event FROM events))""".replace("STRING", text)


_GET = "json_extract_string(payload, '$.{0}')"


def _only(kinds: str, expression: str) -> str:
    return f"CASE WHEN status = 'typed' AND event IN ({kinds}) THEN {expression} END"


_ALL = ", ".join(f"'{k}'" for k, f in payloads.EVENTS.items() if "taskId" in f)


@query(f"""WITH e AS ({_payloads('VARCHAR')}),
s AS (SELECT id, event, payload AS raw, CASE WHEN json_valid(payload) THEN payload END AS payload FROM e),
t AS (SELECT *, CASE WHEN payload IS NULL OR json_type(payload) <> 'OBJECT' THEN 'malformed' WHEN event = 'mystery' THEN 'unknown' ELSE 'typed' END AS status FROM s)
SELECT id, event, status, {_only(_ALL, _GET.format('taskId'))} AS task, {_only("'connected'", _GET.format('clientId'))} AS client,
  {_only("'task_status', 'task_progress'", f"TRY_CAST({_GET.format('progress')} AS DOUBLE)")} AS progress, {_only("'task_status'", _GET.format('state'))} AS state,
  coalesce({_only("'task_tile'", f"TRY_CAST({_GET.format('col')} AS INTEGER)")}, -1) AS col, {_only("'task_complete'", f"coalesce({_GET.format('thumbnail')}, 'none') || {_GET.format('outputPath')}")} AS output,
  {_only("'task_error'", _GET.format('error'))} AS error, coalesce({_only("'task_error', 'pong', 'connected'", f"TRY_CAST({_GET.format('timestamp')} AS BIGINT)")}, -1) AS at,
  coalesce({_only("'cell_analysis'", "CAST(json_array_length(payload, '$.cells') AS INTEGER)")}, -1) AS cells, {_only("'cell_analysis'", _GET.format('cells[1].reasons[0]'))} AS reason,
  {_only("'cell_analysis'", f"TRY_CAST({_GET.format('cells[0].centroid_x')} AS DOUBLE)")} AS cell_x, coalesce({_only("'cell_analysis'", f"TRY_CAST({_GET.format('tile_index[0]')} AS INTEGER)")}, -1) AS tile_row,
  coalesce({_only("'ome_header'", f"TRY_CAST({_GET.format('width')} AS INTEGER)")}, -1) AS width, coalesce({_only("'nucleus_analysis_complete'", f"TRY_CAST({_GET.format('durationMs')} AS BIGINT)")}, -1) AS took,
  CASE WHEN status <> 'typed' THEN raw END AS kept FROM t""")
def ev_typed(spark, sf_dir) -> DataFrame:
    """Every event's typed fields, eleven kinds side by side (whole numbers that are not there as -1), and the payload of those that are malformed or unknown."""
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    rows = payloads.typed(spark.sql(_payloads("STRING")))
    tasks = F.coalesce(*[F.col(f"{k}.taskId") for k, f in payloads.EVENTS.items() if "taskId" in f])
    cells, none = F.col("cell_analysis.cells"), lambda c: F.coalesce(c, F.lit(-1))
    return rows.select(
        "id", "event", "status", tasks.alias("task"), F.col("connected.clientId").alias("client"), F.coalesce("task_status.progress", "task_progress.progress").alias("progress"), F.col("task_status.state").alias("state"),
        none(F.col("task_tile.col")).alias("col"), F.concat(F.coalesce("task_complete.thumbnail", F.lit("none")), "task_complete.outputPath").alias("output"), F.col("task_error.error").alias("error"),
        none(F.coalesce("task_error.timestamp", "pong.timestamp", "connected.timestamp")).alias("at"), none(F.size(cells)).alias("cells"), F.get(F.get(cells, F.lit(1))["reasons"], F.lit(0)).alias("reason"),
        F.get(cells, F.lit(0))["centroid_x"].alias("cell_x"), none(F.get("cell_analysis.tile_index", F.lit(0))).alias("tile_row"), none(F.col("ome_header.width")).alias("width"),
        none(F.col("nucleus_analysis_complete.durationMs")).alias("took"), F.when(F.col("status") != "typed", F.col("payload")).alias("kept"),
    )


#: Requests of four kinds (and one without rules) with every sort of fault, by the event's number.
_REQUESTS = {
    "create_task": "'{\"filePath\":' || CASE WHEN id % 11 = 1 THEN '5' ELSE '\"/data/s.svs\"' END || ',\"tileSize\":' || CASE CAST(id % 6 AS INT) WHEN 0 THEN '63' WHEN 1 THEN '512.5' WHEN 2 THEN '256.0' WHEN 3 THEN 'null' ELSE '512' END"
    " || CASE WHEN id % 7 = 2 THEN ',\"overlap\":-1' WHEN id % 7 = 3 THEN ',\"colour\":1,\"size\":2' ELSE '' END || CASE WHEN id % 9 = 4 THEN ',\"enableNucleusAnalysis\":\"yes\"' ELSE ',\"enableNucleusAnalysis\":true' END || '}'",
    "task_query": "'{' || CASE WHEN id % 4 = 0 THEN '\"state\":\"done\",' WHEN id % 4 = 1 THEN '\"state\":\"failed\",' ELSE '' END || '\"limit\":' || CAST(id % 120 AS STRING) || '}'",
    "read_tile": "'{\"filePath\":\"a.tif\",\"x\":' || CAST(id % 5 - 1 AS STRING) || CASE WHEN id % 3 = 0 THEN ',\"width\":0' ELSE ',\"width\":9' END || CASE WHEN id % 7 = 0 THEN '' ELSE ',\"height\":1' END || ',\"y\":0,\"level\":' || CAST(id % 14 AS STRING) || '}'",
    "search": "'{\"featureVector\":' || CASE CAST(id % 4 AS INT) WHEN 0 THEN '[]' WHEN 1 THEN '\"x\"' ELSE '[0.5,1]' END || ',\"topK\":20}'",
    "other": "'{}'",
}
_NAMES = [*_REQUESTS]


def _requests(text: str) -> str:
    kind = f"CASE CAST(event_id % {len(_NAMES)} AS INT) " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_NAMES)) + " END"
    return f"SELECT id, kind, {_BROKEN} AS payload FROM (SELECT id, kind, {_case(_REQUESTS, 'kind')} AS whole FROM (SELECT event_id AS id, {kind} AS kind FROM events))".replace("STRING", text)


def _wrong_sql() -> str:
    """One row (kind, text, condition) for each thing that can be wrong, spelt out by field."""
    at = lambda f: f"json_extract(payload, '$.{f}')"
    there = lambda f: f"coalesce(json_type({at(f)}) <> 'NULL', false)"
    number = lambda f: f"TRY_CAST(json_extract_string(payload, '$.{f}') AS DOUBLE)"
    whole = lambda f: f"(json_type({at(f)}) IN ('BIGINT', 'UBIGINT', 'DOUBLE') AND {number(f)} = floor({number(f)}))"
    rows = []

    def add(kind, text, condition):
        rows.append(f"CASE WHEN kind = '{kind}' AND {condition} THEN '{text}' END")

    def int_field(kind, f, least=None, most=None, required=False):
        if required:
            add(kind, f"{f}: required", f"NOT {there(f)}")
        add(kind, f"{f}: int", f"{there(f)} AND NOT {whole(f)}")
        if least is not None:
            add(kind, f"{f}: least {least}", f"{there(f)} AND {whole(f)} AND {number(f)} < {least}")
        if most is not None:
            add(kind, f"{f}: most {most}", f"{there(f)} AND {whole(f)} AND {number(f)} > {most}")

    for kind in ("create_task", "read_tile"):
        add(kind, "filePath: required", f"NOT {there('filePath')}")
        add(kind, "filePath: string", f"{there('filePath')} AND json_type({at('filePath')}) <> 'VARCHAR'")
    int_field("create_task", "tileSize", 64)
    int_field("create_task", "overlap", 0)
    add("create_task", "enableNucleusAnalysis: boolean", f"{there('enableNucleusAnalysis')} AND json_type({at('enableNucleusAnalysis')}) <> 'BOOLEAN'")
    for f in ("colour", "size"):
        add("create_task", f"{f}: not allowed", f"{at(f)} IS NOT NULL")
    add("task_query", "state: one of its values", f"{there('state')} AND json_extract_string(payload, '$.state') NOT IN ({', '.join(repr(s) for s in payloads.STATES)})")
    int_field("task_query", "limit", 1, 100)
    int_field("read_tile", "level", 0, 10)
    for f in ("x", "y"):
        int_field("read_tile", f, 0, required=True)
    for f in ("width", "height"):
        int_field("read_tile", f, 1, required=True)
    add("search", "featureVector: required", f"NOT {there('featureVector')}")
    add("search", "featureVector: array", f"{there('featureVector')} AND (json_type({at('featureVector')}) <> 'ARRAY' OR json_array_length({at('featureVector')}) = 0)")
    add("other", "kind: unknown", "true")
    return f"list_filter([{', '.join(rows)}], lambda v: v IS NOT NULL)"


@query(f"""WITH e AS (SELECT id, kind, CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN payload END AS payload FROM ({_requests('VARCHAR')})),
v AS (SELECT id, kind, CASE WHEN payload IS NULL THEN ['payload: object'] ELSE list_sort({_wrong_sql()}) END AS violations FROM e)
SELECT id, kind, CAST(len(violations) AS INTEGER) AS n, array_to_string(violations, '; ') AS violations, len(violations) = 0 AS valid FROM v""")
def req_violations(spark, sf_dir) -> DataFrame:
    """What is wrong with every request."""
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    rows = payloads.checked(spark.sql(_requests("STRING")))
    return rows.select("id", "kind", F.size("violations").alias("n"), F.array_join("violations", "; ").alias("violations"), (F.size("violations") == 0).alias("valid"))
