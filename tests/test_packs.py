"""Slides in packs: read as they were written, planned without a list of slides, small on disk."""

import os

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from tessella.config import Grid
from tessella.plans import profiles as _profiles, slides as plans  # noqa: F401  register their queries
from tessella.plans.queries import QUERIES
from tessella.sources import slides
from tessella.sources.codec import decode_png, encode_png

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def packs(tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("packs"), np.random.default_rng(6)
    images = {f"{p}.zip/d{i % 2}/s{i}.tif": rng.integers(0, 256, (50 + i, 90 - i, 3)).astype(np.uint8) for p in "ab" for i in range(9)}
    for p in "ab":
        members = [(k[6:], slides.tiff_bytes([v, v[::2, ::2]], f"key={k}", 32)) for k, v in images.items() if k[0] == p]
        (folder / f"{p}.zip").write_bytes(slides.packed([*members, ("notes.txt", b"no slide")]))
    one = images["c.tif"] = rng.integers(0, 256, (40, 40, 3)).astype(np.uint8)
    (folder / "c.tif").write_bytes(slides.tiff_bytes([one, one[::2, ::2]], "key=c.tif", 32))
    return str(folder), images


def test_tiles_of_packs_equal_slices(spark, packs):
    folder, images = packs
    whole = slides.slide_tiles(spark, folder, Grid(30, 4))
    rows = whole.collect()
    assert len({(r["path"], r["level"], r["tile_row"], r["tile_col"]) for r in rows}) == len(rows) == sum(-(-(h - 4) // 26) * -(-(w - 4) // 26) for v in images.values() for h, w in (v.shape[:2], v[::2, ::2].shape[:2]))
    for r in rows:
        image = images[r["path"].removeprefix(f"{folder}/")]
        image = image[::2, ::2] if r["level"] else image
        assert (decode_png(r["image"]) == image[r["y"] : r["y"] + r["height"], r["x"] : r["x"] + r["width"]]).all()
    for condition in (f"path = '{folder}/a.zip/d1/s3.tif' and tile_row = 1", f"path in ('{folder}/b.zip/d0/s0.tif', '{folder}/c.tif') and level = 1", f"path = '{folder}/a.zip'", f"path = '{folder}/z.zip/s1.tif'"):
        key = lambda r: (r["path"], r["level"], r["tile_row"], r["tile_col"])
        some = whole.filter(condition).collect()
        slow = spark.createDataFrame([key(r) for r in rows], "path string, level int, tile_row int, tile_col int").filter(condition).collect()
        assert sorted(map(key, some)) == sorted(map(key, slow))


def test_blocks_hold_few_rows(packs, monkeypatch):
    monkeypatch.setattr(slides, "BLOCK", 1)
    level = slides.Level(90, 50, 32, 32, 3, 1, (), ())
    blocks = list(slides._TileReader._blocks(list(slides.grid_of(level, 30, 4))))
    assert [len(b) for b in blocks] == [4, 4] and all(len({t[0] for t in b}) == 1 for b in blocks)


def test_smooth_pngs_are_read_back():
    rng = np.random.default_rng(2)
    for image in (rng.integers(0, 256, (5, 7, 3)), rng.integers(0, 256, (1, 1, 4)), np.zeros((9, 3, 3), int)):
        image = image.astype(np.uint8)
        assert (decode_png(encode_png(image, up=True)) == image).all() and (decode_png(encode_png(image)) == image).all()
    image = plans.slide_pixels(7, 72, 72, 0)
    assert len(encode_png(image, up=True)) < len(encode_png(image)) / 2


def test_slides_are_written_in_packs(spark):
    folder = plans.slide_folder(spark, DIR)
    files = pafs.LocalFileSystem().get_file_info(pafs.FileSelector(slides.located(folder)[1]))
    assert spark.read.parquet(f"{folder}-manifest").count() == 200 and len(files) <= 4


def test_directories_of_packs(spark, packs):
    folder, images = packs
    info = slides.slide_info(spark, folder)
    assert {r["path"].removeprefix(f"{folder}/"): (r["level_count"], r["metadata"]["key"], r["levels"][1]["width"]) for r in info.collect()} == {k: (2, k, -(-v.shape[1] // 2)) for k, v in images.items()}
    schema = info.schema
    for least, n in ((1, 1), (10, 10)):
        parts = slides._InfoReader({"path": folder, "minPartitions": least}, schema, cut=False).partitions()
        assert len(parts) >= n and {p for part in parts for p in part.paths} == {f"{folder}/{k}" for k in ("a.zip", "b.zip", "c.tif")}  # no slide of a pack is named to plan
        read = [p for part in parts for b in slides._InfoReader({"path": folder}, schema, cut=False).read(part) for p in b.column(0).to_pylist()]
        assert sorted(read) == sorted(f"{folder}/{k}" for k in images)


def test_regions_come_from_packs(spark, packs, capsys):
    folder, images = packs
    asked = [(f"{folder}/{k}", 0, 3, 5) for k in images] + [(f"{folder}/a.zip/gone.tif", 0, 0, 0), (f"{folder}/z.zip/s1.tif", 0, 0, 0)]
    rows = spark.createDataFrame(asked, "path string, level int, x int, y int").select("path", slides.region("path", "level", "x", "y", F.lit(40), F.lit(35)).alias("r")).collect()
    assert len(rows) == len(asked)
    for r in rows:
        image = images.get(r["path"].removeprefix(f"{folder}/"))
        assert (image is None) == ("FileNotFoundError" in (r["r"]["error"] or ""))
        assert image is None or (decode_png(r["r"]["image"]) == np.pad(image, ((0, 9), (0, 9), (0, 0)))[5:40, 3:43]).all()


def test_slides_take_little_room(spark):
    """No file of its own, whose last block is half empty, and equal tiles stored once."""
    folder = plans.slide_folder(spark, DIR)
    files = pafs.LocalFileSystem().get_file_info(pafs.FileSelector(slides.located(folder)[1]))
    assert sum(os.stat(f.path).st_blocks * 512 for f in files) < 200 * 5500
    blank = np.full((640, 640, 3), 243, np.uint8)
    assert len(slides.tiff_bytes([blank], "", 64)) < 3 * len(slides.tiff_bytes([blank[:64, :64]], "", 64)) + 800
    assert sorted(QUERIES["slide_regions"](spark, DIR).toPandas().slide_id) == sorted(spark.read.parquet(f"{DIR}/part.parquet").toPandas().p_partkey)


def test_callbacks_on_packs(spark, packs):
    folder, images = packs
    tiles = slides.slide_tiles(spark, folder, Grid(20, 2)).filter("level = 1 and tile_row >= 1")
    seen = slides.each_tile(tiles, lambda t: (t.path, t.tile_row, t.tile_col, int(decode_png(t.image).sum(dtype="int64"))), "path string, tile_row int, tile_col int, total long").collect()
    expected = {}
    for k, v in images.items():
        level = v[::2, ::2]
        for r, c in ((r, c) for r in range(1, -(-(level.shape[0] - 2) // 18)) for c in range(-(-(level.shape[1] - 2) // 18))):
            expected[f"{folder}/{k}", r, c] = int(level[r * 18 : r * 18 + 20, c * 18 : c * 18 + 20].sum(dtype="int64"))
    assert {tuple(r)[:3]: r["total"] for r in seen} == expected


def test_png_files_are_listed_by_tasks(spark, capsys):
    found = QUERIES["png_files"](spark, DIR)
    found.explain()
    plan = capsys.readouterr().out
    assert "FileScan" not in plan and "aggregate(" not in plan  # neither a listing in the driver nor pixels one by one in the JVM
    rows = found.toPandas()
    assert len(rows) == 200 and (rows.name == [f"r{i % 6}/i{i}.png" for i in rows.img]).all()
