"""Whole analysis of image tiles: pixels, nuclei, tile results and the rollup of a batch."""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import JS128, Rules
from ..functions import shape
from ..functions import vectors as V
from ..sources.codec import decode_png
from ..sources.shared import small_batches
from . import images, nuclei, raster

#: Weights of red, green and blue in the luma; fixed values.
LUMA = (0.299, 0.587, 0.114)


def _lights(images: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in images:
        out = []
        for png in batch:
            rgb = decode_png(png)[:, :, :3].astype(np.float64) if png else np.zeros((0, 0, 3))
            out.append((rgb.shape[1], rgb.shape[0], (rgb @ np.array(LUMA)).ravel()))
        yield pd.DataFrame(out, columns=["w", "h", "light"])


def tile_pixels(tiles: DataFrame, image: str = "png") -> DataFrame:
    """tiles (img, PNG) to pixels (img, x, y, gray, light): the luma, rounded halves up and as it is. Null images have none."""
    light = F.pandas_udf(_lights, "w int, h int, light array<double>")
    p = tiles.select("img", light(F.col(image)).alias("t")).select("img", "t.w", F.posexplode("t.light").alias("at", "light"))
    return p.select("img", (F.col("at") % F.col("w")).alias("x"), F.floor(F.col("at") / F.col("w")).cast("int").alias("y"), F.floor(F.col("light") + 0.5).cast("int").alias("gray"), "light")


def tile_components(tiles: DataFrame, image: str = "png") -> DataFrame:
    """tiles (img, tile_row, tile_col, PNG) to the labelled pixels of their dark components, as images.components() has them, with the tile's place.

    A tile is decoded and labelled in one pass, so only the pixels of its regions leave it and none meets a shuffle.
    """

    def batch(found, places):
        row = pa.array(found.pop("row"))
        return pa.RecordBatch.from_arrays([*[p.take(row) for p in places], *map(pa.array, found.values())], names=[*PLACE, *found])

    return _of_tiles(tiles, image, batch, images.PIXELS.split(", ", 1)[1])


def tile_regions(tiles: DataFrame, image: str = "png", least_pixels: int = 40) -> DataFrame:
    """raster.region_props() of tile_components(), with the tile's place; a region is measured where its tile is decoded, so no pixel leaves its task."""
    return raster.described(_of_tiles(tiles, image, lambda found, places: images.region_batch(found, places, PLACE, least_pixels), images.REGION))


PLACE = ["img", "tile_row", "tile_col"]


def _of_tiles(tiles: DataFrame, image: str, batch_of, columns: str) -> DataFrame:
    """PLACE and the columns that batch_of(dark pixels, columns of PLACE) makes of each few tiles."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, images.TOGETHER):
                part = batch.slice(at, images.TOGETHER)
                lights = [decode_png(p)[:, :, :3].astype(np.float64) @ np.array(LUMA) if p else np.zeros((0, 0)) for p in part.column(3).to_pylist()]
                found = images.dark_pixels([(np.floor(light + 0.5).astype(np.int64), light) for light in lights])
                if found:
                    yield batch_of(found, part.columns[:3])

    small_batches(tiles.sparkSession)
    places = ", ".join(f"{c} {tiles.schema[c].dataType.simpleString()}" for c in PLACE)
    return tiles.select(*PLACE, image).mapInArrow(run, f"{places}, {columns}")


def tile_nuclei(tiles: DataFrame, rules: Rules = JS128, size: int = 512, overlap: int = 32, scale: int = 4, image: str = "png") -> DataFrame:
    """tiles (img, tile_row, tile_col, PNG) to their nuclei: place in the slide, shape, reasons and the 128-part vector.

    img is an id of the tile. Nuclei are the dark 4-connected regions of Otsu's threshold with 40 pixels or more; box_x and
    box_y are places in the slide, as is the centre. Tiles without nuclei give no rows.
    """
    r = tile_regions(tiles, image)
    aspect = F.when(F.col("thin") > 0, F.col("major") / F.col("thin")).otherwise(1.0)
    r = r.withColumns({"ar": aspect, "rough": shape.roughness(F.col("perimeter"), F.col("major"), F.col("thin")), "sol": F.col("solidity")})
    r = nuclei.with_rules(r, rules)
    step = (size - overlap) * scale
    right, down = F.col("tile_col") * step, F.col("tile_row") * step
    base = V.base_js({**{c: F.col(c) for c in ("area", "perimeter", "circ", "ar", "sol", "rough", "major", "orientation")}, "minor": F.col("thin"), "mi": F.col("mean_light")})
    r = r.withColumn("_v", F.array(*V.expanded_js(base)))
    return r.select(
        "img", "tile_row", "tile_col", "cell_id", (F.col("cx") + right).alias("centroid_x"), (F.col("cy") + down).alias("centroid_y"), (F.col("x0") + right).alias("bbox_x"), (F.col("y0") + down).alias("bbox_y"),
        F.col("box_w").alias("bbox_w"), F.col("box_h").alias("bbox_h"), "area", "perimeter", shape.ellipse_perimeter(F.col("major"), F.col("thin")).alias("convex_perimeter"),
        F.col("major").alias("major_axis"), F.col("minor").alias("minor_axis"), "orientation", F.least(F.lit(1.0), F.col("circ")).alias("circularity"), F.col("ar").alias("aspect_ratio"),
        "solidity", F.col("rough").alias("roughness"), F.col("mean_light").alias("mean_intensity"), "is_abnormal", F.col("reasons").alias("abnormal_reasons"),
        V.normalised(F.col("_v")).alias("feature_vector"),
    )


def tile_results(tiles: DataFrame, found: DataFrame, width: int = 512, height: int = 512, micron: float = 0.25) -> DataFrame:
    """One row for each tile, those without nuclei too: counts, density (for each mm2) and anomaly score."""
    mm2 = max(width * height * micron * micron / 1e6, 1e-9)
    t = found.groupBy("img").agg(F.count("*").alias("total"), F.count_if("is_abnormal").alias("abnormal"), F.avg(F.when(F.col("is_abnormal"), 1 - F.col("circularity"))).alias("off"))
    t = tiles.select("img", "tile_row", "tile_col").join(t.hint("merge"), "img", "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("total", "abnormal")})
    density = F.col("total") / F.lit(mm2)
    score = 0.5 * F.col("abnormal") / F.col("total") + 0.25 * F.least(F.lit(1.0), density / 8000) + 0.25 * F.coalesce("off", F.lit(0.0))
    return t.select("img", "tile_row", "tile_col", "total", "abnormal", density.alias("density"), F.when(F.col("total") > 0, F.least(F.lit(1.0), score)).otherwise(0.0).alias("score"))


def batch_result(results: DataFrame, group: list[str] = ()) -> DataFrame:
    """Rollup of tile results: sums, greatest (0 at least) and mean score. The list for each tile is `results` itself, which may be of any length."""
    return results.groupBy(*group).agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total_cells"), F.coalesce(F.sum("abnormal"), F.lit(0)).alias("abnormal_cells"),
        F.greatest(F.lit(0.0), F.coalesce(F.max("score"), F.lit(0.0))).alias("max_anomaly"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_anomaly"),
    )


def density_um(n, width, height, micron: float = 0.25):
    """Cells for each mm2 by the other profile: the area counts one square micrometre at least."""
    return n / F.greatest(width * height * micron * micron, F.lit(1.0)) * 1e6


def degrees(orientation):
    return orientation * 180 / math.pi
