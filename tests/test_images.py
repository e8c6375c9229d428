"""Rows of whole images give what long-form rasters give, and their pixels meet no shuffle, join or sort."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessella.operators import images, raster
from tessella.plans.queries import QUERIES
from tessella.sources import codec

W, H = 24, 18


def drawn(spark):
    rng = np.random.default_rng(5)
    grays = [rng.integers(0, 256, (H, W)), np.where(rng.random((H, W)) < 0.4, 30, 200), np.full((H, W), 9), np.where(np.add.outer(np.arange(H), np.arange(W)) % 9 < 4, 50, 180)]
    rows = spark.createDataFrame([(i, g.ravel().tolist()) for i, g in enumerate(grays)], "img long, gray array<int>")
    return rows, rows.select("img", F.posexplode("gray").alias("p", "gray")).select("img", (F.col("p") % W).alias("x"), F.floor(F.col("p") / W).cast("int").alias("y"), "gray")


def same(a, b):
    a, b = (d.toPandas() for d in (a, b.select(a.columns)))
    a, b = (d.sort_values([c for c in d.columns if d[c].dtype != float]).reset_index(drop=True) for d in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_images_as_long_rasters(spark):
    rows, pixels = drawn(spark)
    same(images.histogram(rows), raster.histogram(pixels))
    same(rows.select("img", images.threshold("gray").alias("threshold")).dropna(), raster.otsu(pixels))
    ours, long = images.components(rows, W), raster.components(raster.otsu_mask(pixels))
    same(ours.select("img", "x", "y", "gray", "label"), long)
    same(images.perimeter(ours), raster.perimeter(long))
    same(images.box_dimension(images.box_counts(rows, W)), raster.box_dimension(long))
    same(images.components(rows, W, images.mean_std_level).select("img", "x", "y", "gray"), raster.mean_std_mask(pixels))
    same(raster.region_props(ours, 5).drop("perimeter"), raster.region_props(long, 5))


def test_no_pixels_are_moved(spark, capsys):
    for name in ("px_meanstd_mask", "px_components", "px_region_props", "px_perimeter", "px_boxcount_dim", "tile_nuclei"):
        QUERIES[name](spark, "/root/testdata/sf0.001").explain()
        plan = capsys.readouterr().out
        assert "Join" not in plan and "Generate" not in plan and plan.count("Exchange") <= 3, name


def test_masks_of_long_rasters_broadcast_nothing(spark, capsys):
    _, pixels = drawn(spark)
    for mask in (raster.mean_std_mask, raster.otsu_mask):
        mask(pixels).explain()
        assert "Broadcast" not in capsys.readouterr().out


def test_results_go_on_by_a_few_rows(spark):
    one = codec.by_rows("array<int>", len)
    assert [len(part) for part in one.func(iter([pd.Series(["ab"] * 150)]))] == [64, 64, 22]


def test_tasks_do_not_grow(spark, tmp_path):
    from tessella.plans import fixtures as fx

    spark.range(20000).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    assert fx.keys(spark, str(tmp_path)).rdd.getNumPartitions() == 5


def test_numbers_of_images_stay_in_their_tasks(spark, capsys):
    from tessella.plans.details import png_unit_rgb

    image = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    rows = spark.createDataFrame([(0, codec.to_base64(image)), (1, None), (2, "no image")], "id long, text string")
    found = {r.id: r.s for r in rows.select("id", codec.span_of_unit_rgb(F.col("text")).alias("s")).collect()}
    assert found[0].n == 48 and abs(found[0].mean - 23.5 / 255) < 1e-7 and found[0].least == 0 and abs(found[0].most - 47 / 255) < 1e-7
    assert found[1].n is None and found[2].n is None and found[1].mean is None
    for query in (png_unit_rgb, QUERIES["sr_bicubic"]):
        query(spark, "/root/testdata/sf0.001").explain()
        plan = capsys.readouterr().out
        assert "aggregate(" not in plan and "array_min" not in plan and "array_max" not in plan


def test_regions_are_measured_where_images_are_labelled(spark, capsys):
    rows, pixels = drawn(spark)
    long = raster.components(raster.otsu_mask(pixels))
    for least in (1, 5, 40):
        found, asked = images.region_props(rows, W, least).drop("perimeter"), raster.region_props(long, least)
        same(found.withColumns({c: F.round(c, 9) for c, t in found.dtypes if t == "double"}), asked.withColumns({c: F.round(c, 9) for c, t in found.dtypes if t == "double"}))
        same(images.region_props(rows, W, least).select("img", "label", "perimeter"), raster.perimeter(long).join(asked.select("img", "label"), ["img", "label"]))
    for name in ("px_region_props", "tile_nuclei"):
        QUERIES[name](spark, "/root/testdata/sf0.001").explain()
        plan = capsys.readouterr().out
        assert "Aggregate" not in plan and "Window" not in plan and plan.count("Exchange") == 1, name


def test_sums_of_masks(spark, capsys):
    rows, pixels = drawn(spark)
    rows = rows.union(spark.createDataFrame([(8, [7, 9, 9]), (9, [])], "img long, gray array<int>"))
    for level, mask, more in ((images.mean_std_level, raster.mean_std_mask, [(8, 1, 7)]), (images.otsu_level, raster.otsu_mask, [])):
        asked = mask(pixels).groupBy("img").agg(F.count("*").alias("n"), F.sum("gray").alias("total"))
        same(images.mask_sums(rows, level), asked.union(spark.createDataFrame(more, asked.schema)))
    QUERIES["px_meanstd_mask"](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "Aggregate" not in plan and plan.count("Exchange") == 1
