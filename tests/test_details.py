"""Smaller operators on hand-made rows: nulls, empty values and rounding; resampling against plain loops."""

import base64

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.functions import formats
from tessella.functions import vectors as V
from tessella.operators import raster, records, search, tasks
from tessella.sources import codec


def test_formats(spark):
    rows = spark.createDataFrame([(1.005, "a,,b,", ["x", "y"]), (None, None, None), (-0.5, "", []), (2.5, ",", ["", "z"])], "v double, t string, l array<string>")
    out = rows.select(formats.fixed(F.col("v"), 2), formats.percent(F.col("v"), 1), formats.zoom(F.col("v")), formats.items(F.col("t")), formats.listed(F.col("l"))).collect()
    assert [tuple(r) for r in out] == [("1.00", "100.5%", "1.0x", ["a", "b"], "x,y"), ("0.00", "0.0%", "0.0x", [], ""), ("-0.50", "-50.0%", "-0.5x", [], ""), ("2.50", "250.0%", "2.5x", [], ",z")]


def test_merged_keeps_what_a_patch_leaves_out(spark):
    kind = "a:int,s:struct<x:int,d:struct<y:int,z:int>>"
    rows = [((1, (2, (3, 4))), (None, (None, (5, None)))), (None, (1, None)), ((1, None), None), ((1, (2, None)), (7, (None, (8, 9)))), (None, None)]
    out = spark.createDataFrame(rows, f"old struct<{kind}>, new struct<{kind}>").select(records.merged("old", "new", StructType.fromDDL(kind)).alias("m")).collect()
    assert [r["m"] if r["m"] is None else r["m"].asDict(True) for r in out] == [
        {"a": 1, "s": {"x": 2, "d": {"y": 5, "z": 4}}}, {"a": 1, "s": None}, {"a": 1, "s": None}, {"a": 7, "s": {"x": 2, "d": {"y": 8, "z": 9}}}, None]


def test_levels(spark):
    rows = spark.createDataFrame([([10, 5], 1), ([10, 5], 7), ([10, 5], None), ([], 0)], "v array<int>, k int")
    assert [r[0] for r in rows.select(records.level_or_base(F.col("v"), F.col("k"))).collect()] == [5, 10, 10, None]
    with pytest.raises(Exception, match="no level 7"):
        rows.filter("k = 7").select(records.level_or_error(F.col("v"), F.col("k"))).collect()


def test_search_and_labels(spark):
    rows = spark.createDataFrame([("T-1", "/a/Bc.svs"), (None, "/x"), ("t-2", None)], "task_id string, file_path string")
    find = lambda text: sorted(str(r["task_id"]) for r in tasks.search(rows, text, ("task_id", "file_path")).collect())
    assert find(" bC. ") == ["T-1"] and find("t-") == ["T-1", "t-2"] and find("  ") == ["None", "T-1", "t-2"] and find("/X") == ["None"]
    marks = spark.createDataFrame([(1, 3), (1, 1), (1, 3), (2, None)], "img int, label int")
    assert {r["img"]: r["labels"] for r in raster.labels(marks).collect()} == {1: [1, 3], 2: []}


def test_scan_ends_early(spark, tmp_path):
    search.insert_jsonl(spark.range(100).select("id", (F.col("id") % 3).cast("int").alias("task_id")), str(tmp_path / "r"))
    assert search.scan_jsonl(spark, str(tmp_path / "r"), "id long, task_id int", 1, k=4).count() == 4
    assert search.scan_jsonl(spark, str(tmp_path / "r"), "id long, task_id int", 1, k=400).count() == 33


def test_unit_rgb_of_anything(spark):
    image = np.random.default_rng(0).integers(0, 256, (3, 4, 4)).astype(np.uint8)
    good = base64.b64encode(codec.encode_png(image)).decode()
    out = [r["v"] for r in spark.createDataFrame([(good,), (None,), ("",), ("!!!",), (good[:40],)], "t string").select(codec.unit_rgb_of(F.col("t")).alias("v")).collect()]
    assert np.allclose(out[0], image[:, :, :3].ravel() / 255) and out[1:] == [None] * 4


def test_normalised_takes_the_norm_once(spark):
    v = np.random.default_rng(1).normal(size=(5, 40))
    rows = spark.createDataFrame([(x.tolist(),) for x in v], "v array<double>").select(V.normalised(F.col("v")).alias("n")).collect()
    assert np.allclose([r["n"] for r in rows], v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-8))


@pytest.mark.parametrize("size, to", [((5, 7), (20, 28)), ((9, 8), (4, 3)), ((6, 6), (6, 6))])
def test_resampling_equals_plain_loops(size, to):
    """Bicubic by the formula, pixel by pixel: every weight of the kernel, renormalised at the edges, rows after columns unrounded."""
    image = np.random.default_rng(2).integers(0, 256, (*size, 3)).astype(np.uint8)

    def kernel(d):
        d = abs(d)
        return 1.5 * d**3 - 2.5 * d**2 + 1 if d <= 1 else -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2 if d < 2 else 0.0

    def weights(n, m, i):
        wide = max(1.0, n / m)
        w = [kernel(((i + 0.5) * n / m - 0.5 - j) / wide) for j in range(n)]
        return [x / sum(w) for x in w]

    found = codec.resized(image, *to)
    for y in range(to[0]):
        for x in range(to[1]):
            down, across = weights(size[0], to[0], y), weights(size[1], to[1], x)
            for c in range(3):
                value = sum(a * b * int(image[j, i, c]) for j, a in enumerate(down) for i, b in enumerate(across))
                assert abs(int(found[y, x, c]) - min(255, max(0, value))) <= 0.5 + 1e-6


def test_settings_of_the_session(spark):
    from tessella.config import Grid, Soft, configured

    given = {"spark.tessella.grid.tile": "256", "spark.tessella.grid.at_least_one": "false", "spark.tessella.soft.circularity": "0.7,0.5,0.4", "spark.tessella.soft.threshold": "0.25"}
    for k, v in given.items():
        spark.conf.set(k, v)
    try:
        assert configured(spark, Grid(), "grid") == Grid(256, 32, False)
        assert configured(spark, Soft(), "soft") == Soft(circularity=(0.7, 0.5, 0.4), threshold=0.25)
    finally:
        for k in given:
            spark.conf.unset(k)
    assert configured(spark, Grid(), "grid") == Grid()


def test_lookups(spark):
    rows = spark.createDataFrame([("a", "failed", 1), ("a", "failed", 1), ("b", "pending", 2), (None, None, 3)], "task_id string, state string, created_at int")
    assert [(r["task_id"], r["message"]) for r in tasks.by_id(rows, "a").collect()] == [("a", None)]
    assert [(r["task_id"], r["message"]) for r in tasks.by_id(rows, "z").collect()] == [(None, "no task z")]
    with pytest.raises(Exception, match="no task z"):
        tasks.by_id(rows, "z", "error").collect()
    assert tasks.in_state(rows).count() == 4 and tasks.in_state(rows, "failed").count() == 2
    assert [r["task_id"] for r in tasks.numbered_page(rows, 0).collect()] == [None, "b", "a", "a"] and tasks.numbered_page(rows, 2).count() == 0


def test_zip_and_priority(spark):
    rows = spark.createDataFrame([([1, 2], ["x"]), ([], []), (None, ["y"])], "a array<int>, b array<string>").select(records.zipped("a", "b").alias("z")).collect()
    assert [r["z"] and [tuple(v) for v in r["z"]] for r in rows] == [[(0, 1, "x"), (1, 2, None)], [], None]
    shown = spark.createDataFrame([(["high_roughness", "low_circularity"],), (["abnormal_size"],), (None,)], "r array<string>").select(records.priority(F.col("r")).alias("p")).collect()
    assert [r["p"] and tuple(r["p"]) for r in shown] == [("非规则", "danger"), None, None]


def test_png_files_and_clamps(spark, tmp_path):
    image = codec.encode_png(np.zeros((2, 2, 3), np.uint8))
    rows = spark.createDataFrame([("a/b c/é.png", bytearray(image)), ("x.png", None)], "name string, png binary")
    assert [(r["name"], r["length"]) for r in codec.png_files(rows, str(tmp_path / "out")).collect()] == [("a/b c/é.png", len(image))]
    assert (tmp_path / "out" / "a" / "b c" / "é.png").read_bytes() == image and not (tmp_path / "out" / "x.png").exists()
    v = spark.createDataFrame([(-1.0,), (2.0,), (0.5,), (1.5 / 255,), (2.5 / 255,)], "v double").select(raster.clamped(F.col("v")), raster.clamped(F.col("v"), "js")).collect()
    assert [tuple(r) for r in v] == [(0, 0), (255, 255), (127, 128), (1, 2), (2, 2)]
