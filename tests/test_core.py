import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.config import Grid
from tessella.operators import grid, raster, search
from tessella.sources import codec


@pytest.mark.parametrize("size, overlap", [(128, 16), (64, 8), (32, 4)])
def test_weights_lie_between_0_and_1_and_peak_at_the_centre(spark, size, overlap):
    w = spark.range(size * size).select((F.col("id") / size).cast("int").alias("y"), (F.col("id") % size).cast("int").alias("x"))
    w = w.select("y", "x", raster.weight(F.col("y"), F.col("x"), size, size, overlap).alias("w")).toPandas()
    assert w.w.between(0, 1).all()
    assert w[(w.y == size // 2) & (w.x == size // 2)].w.iloc[0] == pytest.approx(1, abs=0.01)


def test_constant_tiles_blend_to_the_constant_off_the_zero_lines(spark):
    t = spark.range(4).selectExpr("int(id div 2) tile_row", "int(id % 2) tile_col", "0.5D v").crossJoin(spark.range(32 * 32).selectExpr("int(id div 32) y", "int(id % 32) x"))
    out = raster.blend(t, 32, 4).toPandas()
    assert len(out) == 60 * 60
    zero = out.gy.isin([0, 28, 56]) | out.gx.isin([0, 28, 56])
    assert np.allclose(out.v[~zero], 0.5) and np.allclose(out.v[zero], 0)
    assert np.allclose(raster.blend(t, 32, 4, compat=False).toPandas().v, 0.5)


@pytest.mark.parametrize("channels", [3, 4])
def test_png_round_trip(channels):
    image = np.random.default_rng(1).integers(0, 256, (32, 17, channels)).astype(np.uint8)
    assert (codec.decode_png(codec.encode_png(image)) == image).all()


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
def test_png_filters(kind):
    import struct
    import zlib

    image = np.random.default_rng(kind).integers(0, 256, (5, 6, 3)).astype(np.int32)
    pad = np.zeros((6, 7, 3), np.int32)
    pad[1:, 1:] = image
    a, b, d = pad[1:, :-1], pad[:-1, 1:], pad[:-1, :-1]
    p = a + b - d
    pa, pb, pc = abs(p - a), abs(p - b), abs(p - d)
    guess = {1: a, 2: b, 3: (a + b) // 2, 4: np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, d))}[kind]
    rows = b"".join(bytes([kind]) + r.astype(np.uint8).tobytes() for r in (image - guess) % 256)
    whole = codec.encode_png(image.astype(np.uint8))
    body = zlib.compress(rows)
    made = whole[:33] + struct.pack(">I", len(body)) + b"IDAT" + body + struct.pack(">I", zlib.crc32(b"IDAT" + body)) + whole[-12:]
    assert (codec.decode_png(made) == image).all()


def test_frames_count_bytes():
    records = [{"a": "é中"}, {"b": 1}]
    assert codec.unframe(b"".join(map(codec.frame, records))) == records


def test_upscaling_keeps_constants():
    assert (codec.upscale(np.full((6, 5, 3), 77, np.uint8), 4) == 77).all()


def test_grid_covers_small_slides(spark):
    slides = spark.createDataFrame([(1, 20, 20), (2, 513, 1000)], "slide_id long, width int, height int")
    assert grid.tile_grid(slides).filter("slide_id = 1").count() == 1
    assert grid.tile_grid(slides, Grid(at_least_one=False)).filter("slide_id = 1").count() == 0
    edge = grid.tile_grid(slides).filter("slide_id = 2").agg(F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))).first()
    assert tuple(edge) == (513, 1000)


def test_jsonl_insert_scan_delete(spark, tmp_path):
    path = str(tmp_path / "rows")
    rows = spark.createDataFrame([(1, 7, "a"), (2, 8, "b"), (3, 8, "c")], "id long, task_id int, tag string")
    search.insert_jsonl(rows, path)
    back = search.scan_jsonl(spark, path, "id long, tag string, task_id int", 8)
    assert sorted(r["id"] for r in back.collect()) == [2, 3]
    left, gone = search.delete_task(rows, 8)
    assert gone == 2 and left.count() == 1


def test_sampled_places_equal_the_ranked_sample_without_a_shuffle(spark):
    slides = spark.range(1, 60).selectExpr("id slide_id", "int(100 + id * 97 % 5000) width", "int(80 + id * 211 % 7000) height")
    places = grid.sampled_places(slides)
    ranked = grid.systematic_sample(grid.tile_grid(slides))
    assert sorted(map(tuple, places.collect())) == sorted(map(tuple, ranked.collect()))
    assert "Exchange" not in places._jdf.queryExecution().executedPlan().toString()
