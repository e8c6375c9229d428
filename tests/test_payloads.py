"""Typed payloads and validation on hand-made rows: nulls, broken JSON, wrong types, unknown kinds and fields."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from tessella.operators import payloads


def test_each_kind_has_its_fields(spark):
    rows = [("task_progress", '{"taskId":"t","progress":"7.5","timestamp":3}'), ("task_tile", '{"row":2147483648,"col":3}'), ("cell_analysis", '{"cells":[{"centroid_x":1.5,"reasons":["a","b"]},null],"tile_index":[4,"x"]}'),
            ("task_error", "{broken"), ("task_error", None), ("task_error", "7"), ("nothing", '{"a":1}'), (None, "{}"), ("pong", '{"timestamp":null,"more":{"deep":[1]}}')]
    out = payloads.typed(spark.createDataFrame([(i, e, p) for i, (e, p) in enumerate(rows)], "id int, event string, payload string"))
    got = {r["id"]: r for r in out.select("id", "status", "task_progress", "task_tile", "cell_analysis", "pong", F.try_variant_get("body", "$.more.deep[0]", "int").alias("deep")).collect()}
    assert [got[i]["status"] for i in range(9)] == ["typed"] * 3 + ["malformed"] * 3 + ["unknown"] * 2 + ["typed"]
    assert tuple(got[0]["task_progress"]) == ("t", 7.5, None, 3) and got[0]["task_tile"] is None
    assert (got[1]["task_tile"]["row"], got[1]["task_tile"]["col"]) == (None, 3)
    assert got[2]["cell_analysis"]["cells"][0]["reasons"] == ["a", "b"] and got[2]["cell_analysis"]["tile_index"] in (None, [4, None])
    assert got[8]["deep"] == 1 and got[8]["pong"]["timestamp"] is None
    good, other = payloads.apart(out)
    assert good.count() == 4 and {r["payload"] for r in other.collect()} == {"{broken", None, "7", '{"a":1}', "{}"}
    texts = spark.createDataFrame([('["a","b"]',), ("no",), (None,), ('{"x":1}',)], "t string").select(payloads.ignored_on_error("t", "array<string>").alias("v")).collect()
    assert [r["v"] for r in texts] == [["a", "b"], None, None, None]


def test_violations_and_counts(spark):
    rows = [("create_task", '{"filePath":"a"}', []), ("create_task", '{"filePath":null,"tileSize":63}', ["filePath: required", "tileSize: least 64"]), ("create_task", '{"filePath":"a","tileSize":64.5,"b":1,"a":2}', ["a: not allowed", "b: not allowed", "tileSize: int"]),
            ("task_query", "{}", []), ("task_query", '{"state":"lost","limit":101,"offset":"0"}', ["limit: most 100", "offset: int", "state: one of its values"]), ("task_query", '{"limit":1e2}', []),
            ("search", '{"featureVector":[1]}', []), ("search", '{"featureVector":{"a":1},"topK":true}', ["featureVector: array", "topK: int"]), ("read_tile", "[]", ["payload: object"]), ("read_tile", None, ["payload: object"]),
            ("else", "{}", ["kind: unknown"]), (None, "{}", ["kind: unknown"])]
    frame = spark.createDataFrame([(i, k, p, "x") for i, (k, p, _) in enumerate(rows)], "id int, kind string, payload string, more string")
    assert {r["id"]: r["violations"] for r in payloads.checked(frame).collect()} == {i: v for i, (_, _, v) in enumerate(rows)}
    seen = Observation("requests")
    valid, rejected = payloads.valid_and_rejected(frame, seen)
    assert valid.count() == 4 and seen.get == {"valid": 4, "rejected": 8}
    assert rejected.columns == [*frame.columns, "violations"] and valid.columns == frame.columns
    assert "Exchange" not in payloads.checked(frame)._jdf.queryExecution().executedPlan().toString()
