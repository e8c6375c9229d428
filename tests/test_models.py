import numpy as np
from pyspark.sql import functions as F

from tessella.operators import models
from tessella.sources import codec


def test_models_and_their_failures(spark):
    image = np.full((12, 10, 3), 200, np.uint8)
    image[2:5, 3:7] = 20
    image[8:12, 0:2] = 40
    rows = spark.createDataFrame([(1, codec.encode_png(image)), (2, None), (3, b"no image")], "id int, png binary")

    def doubling():
        return lambda x: x.repeat(2, 2).repeat(2, 3)

    def labels():
        return lambda x: (x[..., 0] < 0.1) * 1 + ((x[..., 0] >= 0.1) & (x[..., 0] < 0.2)) * 5

    def missing():
        raise OSError("no model")

    out = rows.select("id", models.enhanced(F.col("png"), doubling).alias("up"), models.segmented(F.col("png"), labels).alias("r"), models.enhanced(F.col("png"), missing).alias("none"))
    out = {r["id"]: r for r in out.collect()}
    assert (codec.decode_png(bytes(out[1]["up"])) == image.repeat(2, 0).repeat(2, 1)).all()
    assert [tuple(r) for r in out[1]["r"]] == [(1, 3, 2, 4, 3, 4, 3, 12), (5, 0, 8, 2, 4, 0, 9, 8)]
    assert out[1]["none"] is None and all(out[i][c] is None for i in (2, 3) for c in ("up", "r", "none"))


def test_regions_of_an_empty_mask():
    assert models.regions(np.zeros((3, 3), int)) == []
