"""Registered queries that call kinds of work from SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kinds
from . import fixtures as fx
from .fixtures import sql
from .queries import query


@query(sql("pixels", "SELECT img, CAST(64 AS INTEGER) AS height, CAST(64 AS INTEGER) AS width, CAST(3 AS INTEGER) AS channels, CAST(3 * sum(gray) AS BIGINT) AS total FROM pixels GROUP BY img"))
def kind_decode(spark, sf_dir) -> DataFrame:
    """Every image, encoded and decoded again by kinds that SQL calls."""
    fx.images(spark, sf_dir).select("img", "gray", F.lit(64).alias("height"), F.lit(64).alias("width")).createOrReplaceTempView("kind_images")
    kinds.registered(spark)
    return spark.sql("SELECT * FROM run_kind('decode_image_batch', TABLE(SELECT img, image FROM run_kind('encode_image', TABLE(kind_images))))")


@query("""WITH p AS (SELECT p_partkey AS img, 16 + 8 * (p_size % 3) AS s, 1 + p_partkey % 9 AS o FROM part),
w AS (SELECT img, s, o, y, x, exp(-(pow(y - s / 2, 2) / (2 * pow(0.3::DOUBLE * s, 2)) + pow(x - s / 2, 2) / (2 * pow(0.3::DOUBLE * s, 2)))) * CASE WHEN o < s / 2 THEN
  CASE WHEN y < o THEN y / o WHEN y >= s - o THEN (y - (s - o)) / o ELSE 1 END * CASE WHEN x < o THEN x / o WHEN x >= s - o THEN (x - (s - o)) / o ELSE 1 END ELSE 1 END AS w
  FROM (SELECT *, unnest(range(s)) AS x FROM (SELECT *, unnest(range(s)) AS y FROM p)))
SELECT img, count(*) AS n, round(sum(w), 6) AS total, round(sum(w * (y * 100 + x)) / sum(w), 6) AS centre FROM w GROUP BY img""")
def kind_weight_map(spark, sf_dir) -> DataFrame:
    """The weight map of every part's tile, by a kind that SQL calls."""
    k = F.col("p_partkey")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("img"), (16 + 8 * (F.col("p_size") % 3)).alias("tile_size"), (1 + k % 9).cast("int").alias("overlap"))
    parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "img").createOrReplaceTempView("kind_parts")
    kinds.registered(spark)
    return spark.sql("SELECT img, count(*) AS n, round(sum(weight), 6) AS total, round(sum(weight * (y * 100 + x)) / sum(weight), 6) AS centre FROM run_kind('generate_weight_map', TABLE(kind_parts)) GROUP BY img")


