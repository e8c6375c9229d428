"""Event payloads as VARIANT: typed fields of each kind of event, bad JSON apart, and validation by rules that are data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The events and the fields of their payloads, as sent.
EVENTS = {
    "connected": {"clientId": "string"},
    "pong": {},
    "subscribed": {"taskId": "string"},
    "task_status": {"taskId": "string", "state": "string", "progress": "double", "message": "string"},
    "task_tile": {"taskId": "string", "row": "int", "col": "int", "imageData": "string"},
    "task_progress": {"taskId": "string", "progress": "double", "message": "string"},
    "task_complete": {"taskId": "string", "outputPath": "string", "thumbnail": "string"},
    "task_error": {"taskId": "string", "error": "string"},
    "cell_analysis": {
        "taskId": "string", "tile_index": "array<int>", "abnormal_count": "int", "total_count": "int", "anomaly_score": "double",
        "cells": "array<struct<centroid_x:double,centroid_y:double,bbox_x:int,bbox_y:int,bbox_w:int,bbox_h:int,circularity:double,aspect_ratio:double,roughness:double,reasons:array<string>>>",
    },
    "ome_header": {"taskId": "string", "width": "int", "height": "int", "tileSize": "int", "gridRows": "int", "gridCols": "int"},
    "nucleus_analysis_complete": {"taskId": "string", "totalNuclei": "int", "abnormalCount": "int", "milvusSaved": "int", "maxAnomaly": "double", "avgAnomaly": "double", "durationMs": "long"},
}


def typed(events: DataFrame, event: str = "event", payload: str = "payload") -> DataFrame:
    """events with `body` (VARIANT), `status` and a struct column for each kind of event, null on rows of other kinds.

    status is `malformed` where the payload is null, no JSON or no object, `unknown` for other kinds of events, else
    `typed`. Fields that are absent, null or cannot be cast are null; fields that no kind has stay in `body`. Every
    struct has `timestamp`. For a stream too.
    """
    body = F.try_parse_json(payload)
    is_object = F.schema_of_variant("body").startswith("OBJECT")
    status = F.when(F.col("body").isNull() | ~F.coalesce(is_object, F.lit(False)), "malformed").when(F.col(event).isin(*EVENTS), "typed").otherwise("unknown")
    rows = events.withColumn("body", body).withColumn("status", status)
    get = lambda name, kind: F.try_variant_get("body", f"$.{name}", kind).alias(name)
    bodies = {kind: F.when((F.col("status") == "typed") & (F.col(event) == kind), F.struct(*[get(n, t) for n, t in fields.items()], get("timestamp", "long"))) for kind, fields in EVENTS.items()}
    return rows.withColumns(bodies)


def apart(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(typed rows, the others with their payload) of typed()."""
    return rows.filter("status = 'typed'").drop("status"), rows.filter("status <> 'typed'").drop("body", *EVENTS)


def ignored_on_error(text, kind: str):
    """JSON text as a value, null where it is not one."""
    return F.try_variant_get(F.try_parse_json(text), "$", kind)


# What requests must be. A rule is (kind, required, least, most, values).
STATES = ("pending", "reading", "super_resolving", "stitching", "saving", "completed", "failed", "cancelled")
REQUESTS = {
    "create_task": {
        "filePath": ("string", True, None, None, None), "pyramidLevel": ("int", False, 0, None, None), "tileSize": ("int", False, 64, None, None),
        "overlap": ("int", False, 0, None, None), "modelName": ("string", False, None, None, None), "enableNucleusAnalysis": ("boolean", False, None, None, None),
    },
    "task_query": {"state": ("string", False, None, None, STATES), "offset": ("int", False, 0, None, None), "limit": ("int", False, 1, 100, None)},
    "read_tile": {
        "filePath": ("string", True, None, None, None), "level": ("int", False, 0, 10, None), "x": ("int", True, 0, None, None), "y": ("int", True, 0, None, None),
        "width": ("int", True, 1, None, None), "height": ("int", True, 1, None, None),
    },
    "search": {"featureVector": ("array", True, None, None, None), "taskId": ("string", False, None, None, None), "topK": ("int", False, None, None, None)},
}


def _is(kind: str, name: str) -> Column:
    """Whether a field of `body` is of a kind; integers may be written as 3.0."""
    found, path = F.schema_of_variant(F.try_variant_get("body", f"$.{name}", "variant")), f"$.{name}"
    number = found.isin("BIGINT", "DOUBLE", "FLOAT") | found.startswith("DECIMAL")
    if kind == "int":
        value = F.try_variant_get("body", path, "double")
        return number & (value == F.floor(value))
    return {"string": found == "STRING", "boolean": found == "BOOLEAN", "number": number, "array": found.startswith("ARRAY") & (F.size(F.try_variant_get("body", path, "array<variant>")) > 0)}[kind]


def _field(name: str, kind: str, required: bool, least, most, values) -> list[Column]:
    """What is wrong with a field: one text or null for each thing that can be."""
    value = F.try_variant_get("body", f"$.{name}", "variant")
    there, number, right = value.isNotNull() & ~F.is_variant_null(value), F.try_variant_get("body", f"$.{name}", "double"), F.coalesce(_is(kind, name), F.lit(False))
    out = [F.when(~there, f"{name}: required")] if required else []
    out.append(F.when(there & ~right, f"{name}: {kind}"))
    if least is not None:
        out.append(F.when(there & right & (number < least), f"{name}: least {least}"))
    if most is not None:
        out.append(F.when(there & right & (number > most), f"{name}: most {most}"))
    if values is not None:
        out.append(F.when(there & right & ~F.try_variant_get("body", f"$.{name}", "string").isin(*values), f"{name}: one of its values"))
    return out


def checked(requests: DataFrame, rules: dict = REQUESTS, kind: str = "kind", payload: str = "payload") -> DataFrame:
    """requests with `violations`, a sorted array of texts, empty for a request that holds all rules of its kind; one pass, no shuffle.

    Fields without a rule are forbidden; a null field counts as absent. A payload that is no JSON object, and a kind
    without rules, have one violation.
    """
    rows = requests.withColumn("body", F.try_parse_json(payload))
    is_object = F.coalesce(F.schema_of_variant("body").startswith("OBJECT"), F.lit(False))
    found = F.array(F.lit("kind: unknown"))
    for name, fields in rules.items():
        own = [c for field, rule in fields.items() for c in _field(field, *rule)]
        known = F.array(*[F.lit(f) for f in fields])
        more = F.transform(F.array_except(F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>")), known), lambda f: F.concat(f, F.lit(": not allowed")))
        found = F.when(F.col(kind) == name, F.concat(F.array_compact(F.array(*own)), more)).otherwise(found)
    found = F.when(is_object, F.array_sort(found)).otherwise(F.array(F.lit("payload: object")))
    return rows.withColumn("violations", found).drop("body")


def valid_and_rejected(requests: DataFrame, observation, rules: dict = REQUESTS) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with violations); the observation counts `valid` and `rejected` of the first action on either, before they are parted."""
    good = F.size("violations") == 0
    rows = checked(requests, rules).observe(observation, F.count_if(good).alias("valid"), F.count_if(~good).alias("rejected"))
    return rows.filter(good).drop("violations"), rows.filter(~good)
