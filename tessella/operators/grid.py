"""Tile grids, pyramids, systematic samples, format filter."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EXTENSIONS, Grid
from ..functions.formats import extension


def tile_grid(slides: DataFrame, grid: Grid = Grid(), counts: bool = False) -> DataFrame:
    """slides (slide_id, width, height) to one row for each tile, edges clipped; exploded in two steps, with no join. counts adds the slide's rows and cols."""

    def count(size):
        n = F.ceil((size - grid.overlap) / grid.step).cast("int")
        return F.greatest(n, F.lit(1)) if grid.at_least_one else F.greatest(n, F.lit(0))

    every = lambda n: F.filter(F.sequence(F.lit(-1), n - 1), lambda i: i >= 0)
    both = ["rows", "cols"] if counts else []
    slides = slides.withColumns({"rows": count(F.col("height")), "cols": count(F.col("width"))}) if counts else slides
    rows = slides.select("slide_id", "width", "height", *both, F.explode(every(count(F.col("height")))).alias("tile_row"))
    tiles = rows.select("*", F.explode(every(count(F.col("width")))).alias("tile_col"))
    x, y = F.col("tile_col") * grid.step, F.col("tile_row") * grid.step
    return tiles.select("slide_id", "tile_row", "tile_col", x.alias("x"), y.alias("y"), F.least(F.lit(grid.tile), F.col("width") - x).alias("w"), F.least(F.lit(grid.tile), F.col("height") - y).alias("h"), *both)


def pyramid(slides: DataFrame, tile: int = 512) -> DataFrame:
    """Levels that halve, rounded down, while either side holds a tile; one level at least."""
    halved = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.struct(k.alias("level"), F.shiftright("width", 0).alias("w0"), F.floor(F.col("width") / F.pow(F.lit(2), k)).cast("int").alias("w"), F.floor(F.col("height") / F.pow(F.lit(2), k)).cast("int").alias("h")))
    levels = slides.select("slide_id", F.explode(halved).alias("l")).select("slide_id", "l.level", F.col("l.w").alias("width"), F.col("l.h").alias("height"))
    return levels.filter((F.col("level") == 0) | (F.col("width") >= tile) | (F.col("height") >= tile))


def systematic_sample(tiles: DataFrame, rate: float = 0.25, most: int = 32) -> DataFrame:
    """Evenly spaced tiles of each slide: places floor(j * n / k) for j below k = max(1, min(most, ceil(n * rate)))."""
    by = Window.partitionBy("slide_id")
    ranked = tiles.withColumn("i", F.row_number().over(by.orderBy("tile_row", "tile_col")) - 1).withColumn("n", F.count("*").over(by))
    ranked = ranked.withColumn("k", F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(F.col("n") * rate))).cast("int"))
    places = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.least(F.col("n") - 1, F.floor(j * (F.col("n") / F.col("k")))))
    return ranked.filter(F.array_contains(places, F.col("i").cast("long"))).select("slide_id", "tile_row", "tile_col", "i", "n", "k")


def sampled_places(slides: DataFrame, grid: Grid = Grid(), rate: float = 0.25, most: int = 32) -> DataFrame:
    """systematic_sample() of each slide's grid, from its counts alone: the places are made, not chosen, so nothing is ranked or shuffled."""
    count = lambda size: F.greatest(F.ceil((size - grid.overlap) / grid.step).cast("long"), F.lit(int(grid.at_least_one)).cast("long"))
    rows = slides.select("slide_id", count(F.col("height")).alias("rows"), count(F.col("width")).alias("cols")).withColumn("n", F.col("rows") * F.col("cols")).filter("n > 0")
    rows = rows.withColumn("k", F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(F.col("n") * rate))).cast("int"))
    places = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.least(F.col("n") - 1, F.floor(j * (F.col("n") / F.col("k")))))))
    return rows.select("*", places.alias("i")).select("slide_id", F.floor(F.col("i") / F.col("cols")).cast("int").alias("tile_row"), (F.col("i") % F.col("cols")).cast("int").alias("tile_col"), "i", "n", "k")


def readable(slides: DataFrame, formats=EXTENSIONS) -> DataFrame:
    return slides.withColumn("ext", extension(F.col("file_path"))).filter(F.col("ext").isin(*formats))


def offsets(tiles: DataFrame, grid: Grid = Grid(), scale: int = 4) -> DataFrame:
    return tiles.withColumns({"offset_x": F.col("tile_col") * grid.step * scale, "offset_y": F.col("tile_row") * grid.step * scale})
