"""Registered queries over slide files, which a fixture writes in packs from the given tables."""

from __future__ import annotations

import uuid
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Grid
from ..sources import slides as source
from ..sources.codec import decode_png
from ..sources.shared import dealt, shared_folder
from .queries import query

#: The fixture's tiles in the files, and the grid that the queries read.
STORED, GRID = 64, Grid(72, 8)
_written: dict = {}


def slide_pixels(key: int, width: int, height: int, level: int) -> np.ndarray:
    """Level `level` of a fixture's slide: every 2 ** level-th pixel of its top image."""
    x, y = (np.arange(n >> level) << level for n in (width, height))
    across, out = ((3 * x + key) % 128).astype(np.uint8), np.empty((len(y), len(x), 3), np.uint8)
    for c in range(3):
        np.add(across[None, :], ((5 * y + 11 * c) % 128).astype(np.uint8)[:, None], out=out[:, :, c])
    return out


#: Slides of one task, and of one pack: neither grows with the table, and files are a thousandth of the slides.
SLIDES, PACK = 4096, 1024


def _slide(key: int, width: int, height: int) -> tuple[str, bytes]:
    levels = [slide_pixels(key, width, height, k) for k in range(8) if k == 0 or max(width, height) >> k >= STORED]
    return f"s{key}.tif", source.tiff_bytes(levels, f"slide.id={key}\nscan.power={20 << int(key % 2)}", STORED)


def _write(folder: str):
    def run(frames):
        filesystem, inner = source.located(folder)
        rows, part, written = (row for frame in frames for row in zip(frame.slide_id, frame.width, frame.height)), TaskContext.get().partitionId(), 0
        while some := list(islice(rows, PACK)):
            pack = f"{part}-{written}.zip"
            with filesystem.open_output_stream(f"{inner}/{pack}") as file:  # whole again if a task is run again
                file.write(source.packed(_slide(*row) for row in some))
            written += 1
            yield pd.DataFrame({"slide_id": [key for key, _, _ in some], "pack": f"{folder}/{pack}"})

    return run


def slide_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder of slides, one for each part, in packs, written once for each session and input; <folder>-manifest tells (slide_id, pack)."""
    known = (spark.sparkContext.applicationId, sf_dir)
    if known not in _written:
        folder = f"{shared_folder(spark)}/slides-{uuid.uuid4().hex}"
        filesystem, inner = source.located(folder)
        filesystem.create_dir(inner, recursive=True)
        k = F.col("p_partkey")
        parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("slide_id"), (96 + F.col("p_size") * 3 + k % 13 * 7).cast("int").alias("width"), (80 + F.col("p_size") * 2 + k % 7 * 9).cast("int").alias("height"))
        rows = dealt(parts, "slide_id", SLIDES).sortWithinPartitions("slide_id")
        rows.mapInPandas(_write(folder), "slide_id long, pack string").write.parquet(f"{folder}-manifest")
        _written[known] = folder
    return _written[known]


def _slide_id(path):
    return F.regexp_extract(path, r"s(\d+)\.tif$", 1).cast("long")


_SLIDES = f"""f AS (SELECT p_partkey AS slide_id, 96 + p_size * 3 + p_partkey % 13 * 7 AS width, 80 + p_size * 2 + p_partkey % 7 * 9 AS height FROM part),
v AS (SELECT slide_id, k, width >> k AS w, height >> k AS h, width, height FROM f, range(8) r(k) WHERE k = 0 OR greatest(width, height) >> k >= {STORED})"""


@query(f"""WITH {_SLIDES}
SELECT slide_id, CAST(count(*) OVER (PARTITION BY slide_id) AS INTEGER) AS level_count, CAST(k AS INTEGER) AS level, CAST(w AS INTEGER) AS width, CAST(h AS INTEGER) AS height,
  round((width / w + height / h) / 2, 9) AS downsample, CAST(slide_id AS VARCHAR) AS id_text, CAST(20 * (1 + slide_id % 2) AS VARCHAR) AS power FROM v""")
def slide_info(spark, sf_dir) -> DataFrame:
    """Levels and properties of every slide, from the files' directories alone."""
    info = source.slide_info(spark, slide_folder(spark, sf_dir))
    levels = info.select(_slide_id(F.col("path")).alias("slide_id"), "level_count", "metadata", F.explode("levels").alias("l"))
    return levels.select("slide_id", "level_count", "l.level", "l.width", "l.height", F.round("l.downsample", 9).alias("downsample"), F.col("metadata")["slide.id"].alias("id_text"), F.col("metadata")["scan.power"].alias("power"))


def _sums(image):
    """Column struct of a PNG's sums by colour and its first and last red; nulls of a null."""

    def one(data):
        if data is None:
            return (None,) * 5
        image = decode_png(data)
        sums = image.reshape(len(image), -1).sum(0, dtype=np.int64).reshape(-1, 3).sum(0)  # by columns first, as those lie side by side
        return (*sums.tolist(), int(image[0, 0, 0]), int(image[-1, -1, 0]))

    @F.pandas_udf("red long, green long, blue long, first int, last int")
    def of(images: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(d) for d in images], columns=["red", "green", "blue", "first", "last"], dtype="Int64")

    return of(image)


def _channel(c: int) -> str:
    return f"CAST(th * list_sum(list_transform(range(x, x + tw), lambda i: (3 * (i << k) + slide_id) % 128)) + tw * list_sum(list_transform(range(y, y + th), lambda i: (5 * (i << k) + {11 * c}) % 128)) AS BIGINT)"


_TILES = f"""g AS (SELECT *, CAST(greatest(1, (w - {GRID.overlap} + {GRID.step - 1}) // {GRID.step}) AS INTEGER) AS cols, CAST(greatest(1, (h - {GRID.overlap} + {GRID.step - 1}) // {GRID.step}) AS INTEGER) AS rows FROM v),
t AS (SELECT *, c * {GRID.step} AS x, r * {GRID.step} AS y, least({GRID.tile}, w - c * {GRID.step}) AS tw, least({GRID.tile}, h - r * {GRID.step}) AS th FROM (SELECT *, unnest(range(cols)) AS c FROM (SELECT *, unnest(range(rows)) AS r FROM g)))"""


@query(f"""WITH {_SLIDES},\n{_TILES}
SELECT slide_id, CAST(k AS INTEGER) AS level, CAST(r AS INTEGER) AS tile_row, CAST(c AS INTEGER) AS tile_col, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(tw AS INTEGER) AS width, CAST(th AS INTEGER) AS height,
  {_channel(0)} AS red, {_channel(1)} AS green, {_channel(2)} AS blue, CAST((3 * (x << k) + slide_id) % 128 + (5 * (y << k)) % 128 AS INTEGER) AS first,
  CAST((3 * ((x + tw - 1) << k) + slide_id) % 128 + (5 * ((y + th - 1) << k)) % 128 AS INTEGER) AS last FROM t""")
def slide_tiles(spark, sf_dir) -> DataFrame:
    """Every tile of every level of every slide: place, sums of its colours, first and last pixel."""
    tiles = source.slide_tiles(spark, slide_folder(spark, sf_dir), GRID)
    return tiles.select(_slide_id(F.col("path")).alias("slide_id"), "level", "tile_row", "tile_col", "x", "y", "width", "height", _sums(F.col("image")).alias("s")).select("*", "s.*").drop("s")


@query(f"""WITH {_SLIDES},
q AS (SELECT slide_id, slide_id % 3 AS k, 8 * (slide_id % 5) AS x, 4 * (slide_id % 7) AS y FROM f),
o AS (SELECT q.*, v.w, v.h, v.slide_id IS NULL AS missing, CAST(floor(x / ((width / w + height / h) / 2)) AS INTEGER) AS lx, CAST(floor(y / ((width / w + height / h) / 2)) AS INTEGER) AS ly FROM q LEFT JOIN v ON v.slide_id = q.slide_id AND v.k = q.k)
SELECT slide_id, CAST(k AS INTEGER) AS level, missing AS failed, CASE WHEN missing THEN -1 ELSE CAST(least(40, h - ly) * list_sum(list_transform(range(lx, least(lx + 48, w)), lambda i: (3 * (i << k) + slide_id) % 128))
  + least(48, w - lx) * list_sum(list_transform(range(ly, least(ly + 40, h)), lambda i: (5 * (i << k)) % 128)) AS BIGINT) END AS red FROM o""")
def slide_regions(spark, sf_dir) -> DataFrame:
    """The red of one region of 48 x 40 of every slide, -1 at a level that the slide does not have."""
    k = F.col("slide_id")
    asked = spark.read.parquet(f"{slide_folder(spark, sf_dir)}-manifest").select("slide_id", F.concat("pack", F.lit("/s"), k.cast("string"), F.lit(".tif")).alias("path"), (k % 3).cast("int").alias("level"), (8 * (k % 5)).alias("x"), (4 * (k % 7)).alias("y"))
    read = asked.select("slide_id", "level", source.region("path", "level", "x", "y", F.lit(48), F.lit(40)).alias("r"))
    return read.select("slide_id", "level", F.col("r.error").isNotNull().alias("failed"), F.coalesce(_sums(F.col("r.image"))["red"], F.lit(-1)).alias("red"))
