"""Tile analysis on a drawn image, super-resolution with its fallback, frames and upserts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import analysis, models, tasks
from tessella.sources import codec
from tessella.streaming import events


def drawn(noise: int = 10) -> np.ndarray:
    """Three dark ellipses on a bright ground, one thin and one with a wavy edge, with noise in the colours."""
    y, x = np.mgrid[:512, :512]
    rng = np.random.default_rng(3)
    image = np.tile(np.array([230, 200, 210]), (512, 512, 1)) + rng.integers(-noise, noise + 1, (512, 512, 3))
    for cx, cy, rx, ry, wave in ((100, 100, 20, 20, 0.0), (300, 120, 40, 12, 0.0), (180, 320, 25, 22, 0.3)):
        angle = np.arctan2(y - cy, x - cx)
        inside = ((x - cx) / rx) ** 2 + ((y - cy) / ry) ** 2 <= 1 + wave * np.sin(7 * angle) * np.cos(5 * angle)
        image[inside] = np.array([90, 50, 120]) + rng.integers(-noise, noise + 1, (int(inside.sum()), 3))
    return np.clip(image, 0, 255).astype(np.uint8)


def test_tile_analysis(spark):
    blank = codec.encode_png(np.full((32, 32, 3), 200, np.uint8))
    tiles = spark.createDataFrame([(1, 0, 0, codec.encode_png(drawn())), (2, 1, 2, codec.encode_png(drawn())), (3, 0, 1, blank), (4, 0, 2, None)], "img long, tile_row int, tile_col int, png binary")
    found = analysis.tile_nuclei(tiles, scale=1).cache()
    n = found.toPandas()
    assert set(n.img) == {1, 2} and (n[n.img == 1].cell_id.sort_values() == range(len(n) // 2)).all()
    v = np.array(n.feature_vector.tolist())
    assert v.shape[1] == 128 and np.allclose((v**2).sum(1), 1, atol=1e-3)
    a, b = (n[n.img == i].sort_values("cell_id").reset_index() for i in (1, 2))
    assert np.allclose(b.centroid_x - a.centroid_x, 960) and np.allclose(b.bbox_y - a.bbox_y, 480)
    round_one = a.iloc[((a.centroid_x - 100).abs() + (a.centroid_y - 100).abs()).argmin()]
    assert abs(round_one.centroid_x - 100) < 1.5 and round_one.aspect_ratio < 1.2
    t = {r["img"]: r for r in analysis.tile_results(tiles, found).collect()}
    assert t[1]["total"] >= 2 and t[1]["abnormal"] >= 1 and 0 < t[1]["score"] <= 1
    assert t[3]["total"] == t[4]["total"] == 0 and t[3]["score"] == 0
    batch = analysis.batch_result(analysis.tile_results(tiles, found)).collect()[0]
    assert batch["total_cells"] == 2 * t[1]["total"] and batch["avg_anomaly"] == pytest.approx(t[1]["score"] / 2)
    assert analysis.batch_result(analysis.tile_results(tiles.limit(0), found.limit(0))).collect()[0]["max_anomaly"] == 0


def test_resampling():
    image = np.random.default_rng(1).integers(0, 256, (12, 9, 3)).astype(np.uint8)
    assert (codec.resized(image, 12, 9) == image).all()
    assert codec.resized(np.full((31, 8, 3), 77, np.uint8), 12, 20).shape == (12, 20, 3)
    assert (codec.resized(np.full((31, 8, 3), 77, np.uint8), 12, 20) == 77).all()
    unit = image.astype(np.float32) / 255
    assert codec.preprocessed(unit, (12, 9)).shape == (1, 3, 12, 9) and codec.preprocessed(unit).shape == (1, 3, 512, 512)
    assert codec.postprocessed(codec.preprocessed(unit, (12, 9)), (12, 9), 4).shape == (48, 36, 3)
    assert codec.to_bytes(np.array([-1, 0.5, 0.999, 2])).tolist() == [0, 127, 254, 255]
    assert codec.to_bytes(np.array([0.5, 0.999]), truncated=False).tolist() == [128, 255]


def test_super_resolution_falls_back(spark):
    image = np.full((8, 6, 3), 100, np.uint8)
    d = spark.createDataFrame([(1, codec.encode_png(image)), (2, None), (3, b"no image")], "id int, png binary").filter("id < 3")

    def works():
        return lambda x: np.ones((1, 3, 16, 16), np.float32)

    def broken():
        raise RuntimeError("no model")

    for load, by_model, value in ((works, True, 255), (broken, False, 100)):
        out = {r["id"]: r["s"] for r in d.select("id", models.super_resolved(F.col("png"), load, 4, (16, 16)).alias("s")).collect()}
        big = codec.decode_png(bytes(out[1]["png"]))
        assert out[1]["by_model"] is by_model and big.shape == (32, 24, 3) and (big == value).all()
        assert out[2]["png"] is None and out[2]["by_model"] is False


def test_frames_count_bytes(spark):
    body = codec.progress_body(F.lit(5), F.lit("读取"), F.lit(9))
    data = spark.range(1).select(codec.framed(body).alias("f")).collect()[0]["f"]
    assert codec.unframe(bytes(data)) == [{"type": "progress", "progress": 5, "message": "读取", "timestamp": 9}]


def test_upserts(spark):
    old = spark.createDataFrame([("a", "reading", "x"), ("b", "pending", None)], "task_id string, state string, message string")
    rows = [("a", 1, 1, "failed", None), ("a", 2, 2, None, 50.0), ("a", 0, 0, "saving", 10.0), ("c", 1, 1, "pending", None)]
    patches = spark.createDataFrame(rows, "task_id string, ts int, event_id int, state string, progress double")
    out = sorted(map(tuple, tasks.upserted(old, patches).collect()))
    assert out == [("a", "failed", "x", 50.0), ("b", "pending", None, None), ("c", "pending", None, None)]
    assert sorted(r[0] for r in tasks.upserted(old, patches.limit(0)).collect()) == ["a", "b"]


def test_pages_schedules_and_rooms(spark):
    t = spark.createDataFrame([("a", 1, "reading", 3, 4), ("b", 2, "saving", 4, 4), ("c", 3, "reading", 9, 0)], "task_id string, created_at int, state string, read int, tiles int")
    assert [(r["task_id"], r["total"]) for r in tasks.with_total(t, 1, 1).collect()] == [("b", 3)]
    percent = {r["task_id"]: r["p"] for r in t.select("task_id", tasks.schedule(F.col("state"), F.col("read"), F.col("tiles")).alias("p")).collect()}
    assert percent == {"a": 45.0, "b": 90.0, "c": 60.0}
    s = spark.createDataFrame([("v", "a"), ("v", "a"), ("w", "a")], "viewer string, task_id string")
    assert events.subscribed(t, s).count() == 1
    assert sorted(r["viewer"] for r in events.delivered(t, s).collect()) == ["v", "w"]
    d = spark.range(1).select(analysis.density_um(F.lit(8), F.lit(400), F.lit(400)).alias("d"), analysis.degrees(F.lit(np.pi / 2)).alias("g")).collect()[0]
    assert d["d"] == pytest.approx(800) and d["g"] == pytest.approx(90)
