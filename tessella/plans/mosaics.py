"""Registered queries over weight maps and blended tiles, of which every part has its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import raster
from ..sources.shared import dealt
from .queries import query

TILE, OVERLAP, IMAGES = 16, 4, 2048


def _parts(spark, sf_dir) -> DataFrame:
    """(img, size, over) of every part, a bounded number in a task, whose canvases then take bounded memory."""
    k = F.col("p_partkey")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("img"), (16 + 8 * (F.col("p_size") % 3)).alias("size"), (1 + k % 9).cast("int").alias("over"))
    return dealt(parts, "img", IMAGES)


def _side(n):
    return F.explode(F.sequence(F.lit(0), n - 1))


@query("""WITH p AS (SELECT p_partkey AS img, 16 + 8 * (p_size % 3) AS s, 1 + p_partkey % 9 AS o FROM part),
w AS (SELECT img, s, o, y, x, exp(-(pow(y - s / 2, 2) / (2 * pow(0.3::DOUBLE * s, 2)) + pow(x - s / 2, 2) / (2 * pow(0.3::DOUBLE * s, 2)))) * CASE WHEN o < s / 2 THEN
  CASE WHEN y < o THEN y / o WHEN y >= s - o THEN (y - (s - o)) / o ELSE 1 END * CASE WHEN x < o THEN x / o WHEN x >= s - o THEN (x - (s - o)) / o ELSE 1 END ELSE 1 END AS w
  FROM (SELECT *, unnest(range(s)) AS x FROM (SELECT *, unnest(range(s)) AS y FROM p)))
SELECT img, CAST(s AS INTEGER) AS size, CAST(o AS INTEGER) AS over, count(*) AS n, round(sum(w), 6) AS total, round(sum(w * (y * s + x)) / sum(w), 6) AS centre, round(max(w), 9) AS most,
  count(*) FILTER (WHERE w = 0) AS zeros, CAST(sum(floor(255 * w)) AS BIGINT) AS cut_sum, CAST(sum(floor(255 * w + 0.5::DOUBLE)) AS BIGINT) AS round_sum FROM w GROUP BY ALL""")
def px_weight_map(spark, sf_dir) -> DataFrame:
    """The weight map of each part's tile size and overlap, and as an image of 8 bits, cut off and rounded."""
    y, x, s = F.col("y"), F.col("x"), F.col("size")
    w = _parts(spark, sf_dir).select("*", _side(s).alias("y")).select("*", _side(s).alias("x")).withColumn("w", raster.weight(y, x, s, s, F.col("over")))
    grouped = w.groupBy("img", "size", "over")
    return grouped.agg(
        F.count("*").alias("n"), F.round(F.sum("w"), 6).alias("total"), F.round(F.sum(F.col("w") * (y * s + x)) / F.sum("w"), 6).alias("centre"), F.round(F.max("w"), 9).alias("most"),
        F.count_if(F.col("w") == 0).alias("zeros"), F.sum(F.floor(255 * F.col("w"))).alias("cut_sum"), F.sum(F.floor(255 * F.col("w") + 0.5)).alias("round_sum"),
    )


@query(f"""WITH t AS (SELECT p_partkey AS img, r, c, y, x, (p_partkey * 7 + (2 * r + c) * 50 + 3 * x + 5 * y) % 256 AS v FROM part, range(2) a(r), range(2) b(c), range({TILE}) d(y), range({TILE}) e(x)),
w AS (SELECT *, exp(-(pow(y - 8, 2) / (2 * pow(0.3::DOUBLE * 16, 2)) + pow(x - 8, 2) / (2 * pow(0.3::DOUBLE * 16, 2)))) * CASE WHEN y < 4 THEN y / 4 WHEN y >= 12 THEN (y - 12) / 4 ELSE 1 END
  * CASE WHEN x < 4 THEN x / 4 WHEN x >= 12 THEN (x - 12) / 4 ELSE 1 END AS w FROM t),
m AS (SELECT img, r * 12 + y AS gy, c * 12 + x AS gx, sum(w * v) / CASE WHEN sum(w) > 1e-6 THEN sum(w) ELSE 1 END AS v FROM w GROUP BY ALL)
SELECT img, count(*) AS n, round(avg(v), 4) AS mean, round(max(v), 4) AS most, count(*) FILTER (WHERE v = 0) AS zeros, round(sum(v * gx) / sum(gx), 4) AS by_x, round(sum(v * gy) / sum(gy), 4) AS by_y FROM m GROUP BY img""")
def px_blend(spark, sf_dir) -> DataFrame:
    """Four tiles of each part blended to one canvas."""
    v = (F.col("img") * 7 + (2 * F.col("tile_row") + F.col("tile_col")) * 50 + 3 * F.col("x") + 5 * F.col("y")) % 256
    tiles = _parts(spark, sf_dir).select("img")
    for name, n in (("tile_row", 2), ("tile_col", 2), ("y", TILE), ("x", TILE)):
        tiles = tiles.select("*", _side(F.lit(n)).alias(name))
    canvas = raster.blend(tiles.withColumn("v", v.cast("double")), TILE, OVERLAP, by=("img",))
    by = lambda place: F.round(F.sum(F.col("v") * F.col(place)) / F.sum(place), 4)
    return canvas.groupBy("img").agg(F.count("*").alias("n"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.max("v"), 4).alias("most"), F.count_if(F.col("v") == 0).alias("zeros"), by("gx").alias("by_x"), by("gy").alias("by_y"))
