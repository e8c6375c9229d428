"""Cases of the third round's findings."""

import struct

import pytest
from pyspark.sql import functions as F

from tessella.functions import formats
from tessella.plans import mosaics, slides
from tessella.plans.queries import QUERIES
from tessella.sources import slides as source

DIR = "/root/testdata/sf0.001"


def test_file_sizes_round_halves_to_even(spark):
    sizes = {1280: "1.2 KB", 1408: "1.4 KB", 1792: "1.8 KB", (1 << 20) + (1 << 17): "1.12 MB", 3 * (1 << 30) + (3 << 27): "3.38 GB", 1023: "1023 B"}
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", formats.file_size(F.col("n")).alias("t")).collect()
    assert {r.n: r.t for r in rows} == sizes


def test_header_frames_hold_the_whole_document(spark):
    frame = bytes.fromhex(QUERIES["stream_frames"](spark, DIR).filter("kind = 'header'").first()["frame"])
    assert struct.unpack(">I", frame[:4])[0] == len(frame) - 4
    assert b"Channel:0:2" in frame and b"TiffData" in frame and b"SizeX" in frame


def test_slide_files_are_small_and_whole(tmp_path):
    image = slides.slide_pixels(7, 213, 157, 0)
    data = source.tiff_bytes([image, image[::2, ::2]], "slide.id=7")
    (tmp_path / "a.tif").write_bytes(data)
    slide = source.Slide(str(tmp_path / "a.tif"))
    assert (slide.region(0, 0, 0, 213, 157) == image).all() and slide.levels[0].predictor == 2
    assert len(data) < image.size / 10


def test_canvases_of_a_task_do_not_grow(spark, tmp_path):
    spark.range(20000).selectExpr("id AS p_partkey", "1 AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    assert mosaics._parts(spark, str(tmp_path)).rdd.getNumPartitions() == 10


@pytest.mark.parametrize("name", ["rec_tile_layout", "ome_xml"])
def test_one_pass(spark, capsys, name):
    QUERIES[name](spark, DIR).explain()
    plan = capsys.readouterr().out
    assert "Join" not in plan and "Aggregate" not in plan and "xpath" not in plan and plan.count("from_xml") <= 1
