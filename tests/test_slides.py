"""Slide files: the reader against numpy, planning and pushdown of the data source, errors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.config import Grid
from tessella.sources import slides
from tessella.sources.codec import decode_png


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    folder, rng, images = tmp_path_factory.mktemp("slides"), np.random.default_rng(4), {}
    for name, (w, h) in {"a.tif": (300, 170), "b.TIFF": (40, 30), "c.svs": (130, 500)}.items():
        top = rng.integers(0, 256, (h, w, 3)).astype(np.uint8)
        images[name] = [top, top[::2, ::2][: h // 2, : w // 2]]
        (folder / name).write_bytes(slides.tiff_bytes(images[name], f"name={name}\nnote=é = x", 48))
    (folder / "notes.txt").write_text("no slide")
    return str(folder), images


def test_regions_equal_slices(made):
    folder, images = made
    rng = np.random.default_rng(1)
    for name, levels in images.items():
        slide = slides.Slide(f"{folder}/{name}")
        assert slide.properties() == {"name": name, "note": "é = x"}
        for k, image in enumerate(levels):
            assert (slide.levels[k].height, slide.levels[k].width) == image.shape[:2]
            for _ in range(20):
                x, y, w, h = (int(v) for v in rng.integers(-20, 200, 4))
                w, h = abs(w) + 1, abs(h) + 1
                padded = np.zeros((900, 900, 3), np.uint8)
                padded[100 : 100 + image.shape[0], 100 : 100 + image.shape[1]] = image
                assert (slide.region(k, x, y, w, h) == padded[100 + y : 100 + y + h, 100 + x : 100 + x + w]).all()
    with pytest.raises(ValueError, match="no level 2"):
        slide.region(2, 0, 0, 5, 5)


def test_info(spark, made):
    folder, images = made
    rows = {r["path"].rsplit("/", 1)[1]: r for r in slides.slide_info(spark, folder).collect()}
    assert set(rows) == set(images)
    for name, levels in images.items():
        assert [(v["level"], v["width"], v["height"]) for v in rows[name]["levels"]] == [(i, *image.shape[1::-1]) for i, image in enumerate(levels)]
        assert rows[name]["metadata"]["name"] == name and rows[name]["level_count"] == 2


def test_tiles_equal_slices(spark, made):
    folder, images = made
    rows = slides.slide_tiles(spark, folder, Grid(100, 10)).collect()
    for r in rows:
        image = images[r["path"].rsplit("/", 1)[1]][r["level"]]
        assert (decode_png(r["image"]) == image[r["y"] : r["y"] + r["height"], r["x"] : r["x"] + r["width"]]).all()
    grids = [(n, k) for n, levels in images.items() for k in range(len(levels))]
    assert len(rows) == sum(max(1, -(-(images[n][k].shape[0] - 10) // 90)) * max(1, -(-(images[n][k].shape[1] - 10) // 90)) for n, k in grids)


def test_filters_reach_the_reader(spark, made):
    folder, _ = made
    whole = slides.slide_tiles(spark, folder, Grid(100, 10)).select("path", "level", "tile_row", "tile_col")
    expected = {tuple(r) for r in whole.collect()}
    path = f"{folder}/a.tif"
    cut = slides.registered(spark).read.format("slide_tiles").option("tileSize", 100).option("overlap", 10).option("splitBytes", 2000).load(folder)
    assert cut.rdd.getNumPartitions() > 30
    one = cut.filter((F.col("path") == path) & (F.col("level") == 0) & (F.col("tile_row") == 1) & (F.col("tile_col") == 2)).select("path", "level", "tile_row", "tile_col")
    assert one.rdd.getNumPartitions() == 1 and [tuple(r) for r in one.collect()] == [(path, 0, 1, 2)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "")
    for condition in ("tile_row >= 1", "tile_row > 1 and level in (0, 1)", "tile_col < 2 and tile_row <= 2", "path like '%c.svs' and level = 1", "tile_row = 1 or tile_col = 0", "level = 7"):
        assert {tuple(r) for r in cut.select("path", "level", "tile_row", "tile_col").filter(condition).collect()} == {tuple(r) for r in whole.filter(condition).collect()} <= expected


def test_errors_and_nulls(spark, made, tmp_path):
    folder, images = made
    asked = [(f"{folder}/a.tif", 0, 10, 20, 30, 40), (f"{folder}/a.tif", 5, 0, 0, 8, 8), (f"{folder}/gone.tif", 0, 0, 0, 8, 8), (f"{folder}/notes.txt", 0, 0, 0, 8, 8), (None, 0, 0, 0, 8, 8), (f"{folder}/a.tif", 1, 290, 160, 8, 8)]
    rows = spark.createDataFrame(asked, "path string, level int, x int, y int, w int, h int").select(slides.region("path", "level", "x", "y", "w", "h").alias("r")).collect()
    assert (decode_png(rows[0]["r"]["image"]) == images["a.tif"][0][20:60, 10:40]).all()
    assert [bool(r["r"]["error"]) for r in rows] == [False, True, True, True, False, False]
    assert "no level 5" in rows[1]["r"]["error"] and "FileNotFoundError" in rows[2]["r"]["error"] and "not a TIFF" in rows[3]["r"]["error"]
    edge = decode_png(rows[5]["r"]["image"])
    assert (edge[:5, :5] == images["a.tif"][1][80:85, 145:150]).all() and not edge[5:].any() and not edge[:, 5:].any()
    with pytest.raises(Exception, match="FileNotFoundError"):
        slides.slide_info(spark, f"{folder}/none").collect()
    assert slides.slide_tiles(spark, str(tmp_path)).count() == 0
