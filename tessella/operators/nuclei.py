"""Nucleus rows: classification, rollups, lists."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import JS128, Rules, Soft
from ..functions import shape


def with_rules(nuclei: DataFrame, rules: Rules = JS128) -> DataFrame:
    """nuclei (area, perimeter, ar, rough, sol) with circ, reasons, is_abnormal."""
    out = nuclei.withColumn("circ", shape.circularity(F.col("area"), F.col("perimeter")))
    out = out.withColumn("reasons", shape.reasons(F.col("circ"), F.col("ar"), F.col("rough"), F.col("sol"), F.col("area"), rules))
    return out.withColumn("is_abnormal", F.size("reasons") >= rules.hits)


def with_score(nuclei: DataFrame, soft: Soft = Soft()) -> DataFrame:
    """nuclei with circ, score (4 places), tags, is_abnormal."""
    out = nuclei.withColumn("circ", F.least(F.lit(1.0), shape.circularity(F.col("area"), F.col("perimeter"))))
    args = [F.col(c) for c in ("circ", "rough", "ar", "istd")]
    return out.withColumns({"score": F.round(shape.soft_score(*args, soft), 4), "tags": shape.tags(*args, soft), "is_abnormal": shape.soft_score(*args, soft) >= soft.threshold})


def tile_rollup(classified: DataFrame, tile: int = 512, scale: int = 4, micron: float = 0.25) -> DataFrame:
    """Counts, density (cells for each mm2) and anomaly score of each tile."""
    mm2 = (tile * scale * micron / 1000) ** 2
    t = classified.groupBy("task_n", "tile_row", "tile_col").agg(
        F.count("*").alias("total"), F.count_if("is_abnormal").alias("abnormal"), F.avg(F.when(F.col("is_abnormal"), 1 - F.least(F.lit(1.0), F.col("circ")))).alias("off_circle")
    )
    t = t.withColumn("density", F.col("total") / F.lit(max(mm2, 1e-9)))
    score = 0.5 * F.col("abnormal") / F.col("total") + 0.25 * F.least(F.lit(1.0), F.col("density") / 8000) + 0.25 * F.coalesce("off_circle", F.lit(0.0))
    return t.withColumn("score", F.least(F.lit(1.0), score)).drop("off_circle")


def task_rollup(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("task_n").agg(F.count("*").alias("tiles"), F.sum("total").alias("total"), F.sum("abnormal").alias("abnormal"), F.max("score").alias("max_score"), F.avg("score").alias("avg_score"))


def first_by_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order; other rows of the key go."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def top_abnormal(scored: DataFrame, k: int = 50) -> DataFrame:
    kept = first_by_key(scored.filter("is_abnormal"), ["tile_row", "tile_col", "inst_id"], ["nucleus_id"])
    return kept.orderBy(F.desc("score"), "nucleus_id").limit(k)


def keyword(cells: DataFrame, text: str) -> DataFrame:
    """Cells whose id, centre or a reason holds the text."""
    has = F.col("nucleus_id").cast("string").contains(text) | F.exists("reasons", lambda r: r.contains(text))
    return cells.filter(has | F.col("centroid_x").cast("string").contains(text) | F.col("centroid_y").cast("string").contains(text))
