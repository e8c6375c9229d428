"""Views that stand for slides, tiles, pixels, nuclei, vectors and task events, derived by arithmetic from the given tables.

CTE holds the same derivations for the independent engine.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid
from ..sources.shared import dealt, small_batches

SUFFIXES = (".svs", ".TIF", ".tiff", ".ndpi", ".mrxs", ".png")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    suffix = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), (k % 6 + 1).cast("int"))
    return _read(spark, sf_dir, "part").select(
        k.alias("slide_id"), F.concat(F.lit("/data/input/s"), k.cast("string"), suffix).alias("file_path"),
        (300 + F.col("p_size") * 97 + k % 13 * 41).cast("int").alias("width"), (280 + F.col("p_size") * 61 + k % 7 * 53).cast("int").alias("height"),
    )


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.tile_grid(dealt(slides(spark, sf_dir), "slide_id", 50_000))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img and the squared radii of its ellipses) for each part, in many tasks; by image, so that the code by pixel stays small enough to be compiled."""
    squares = {f"{axis}{k}": F.pow(4 + (F.col("img") * 3 + k * 5) % 9 if axis == "rx" else 3 + (F.col("img") * 7 + k * 2) % 8, F.lit(2)).cast("long") for k in range(3) for axis in ("rx", "ry")}
    return keys(spark, sf_dir).withColumns(squares)


def _pixel(x, y):
    """(gray, ellipse) at a place of an image."""
    gray, ellipse = 210 + (31 * x + 17 * y + 7 * F.col("img")) % 11, F.lit(None).cast("int")
    for k, (cx, cy) in enumerate(((16, 16), (48, 18), (30, 46))):
        rx, ry = F.col(f"rx{k}"), F.col(f"ry{k}")
        q = (x - cx) * (x - cx) * ry + (y - cy) * (y - cy) * rx
        gray = F.when(q <= rx * ry, 60 + F.floor(9 * q / (rx * ry))).otherwise(gray)
        ellipse = F.when(q <= rx * ry, k).otherwise(ellipse)
    return gray.cast("int"), ellipse


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image of 64 x 64 for each part, with three disjoint dark ellipses each; gray rises towards their edges. `ellipse` is the number of the ellipse or null."""
    side = F.sequence(F.lit(0), F.lit(63))
    gray, ellipse = _pixel(F.col("x"), F.col("y"))
    p = _parts(spark, sf_dir).withColumn("y", F.explode(side)).withColumn("x", F.explode(side))
    return p.select("img", "x", "y", gray.alias("gray"), ellipse.alias("ellipse"))


def _images(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gray, ellipse) of images, a row of 64 x 64 numbers for each key; -1 is no ellipse."""
    key, y, x = keys.astype(np.int64)[:, None, None], np.arange(64)[None, :, None], np.arange(64)[None, None, :]
    gray = (210 + (31 * x + 17 * y + 7 * (key % 11)) % 11).astype(np.int32)
    ellipse = np.full(gray.shape, -1, np.int32)
    for k, (cx, cy) in enumerate(((16, 16), (48, 18), (30, 46))):
        rx, ry = (4 + (key * 3 + k * 5) % 9) ** 2, (3 + (key * 7 + k * 2) % 8) ** 2
        box = np.s_[:, max(0, cy - 10) : cy + 11, max(0, cx - 12) : cx + 13]  # no radius is longer
        q = (x[:, :, box[2]] - cx) ** 2 * ry + (y[:, box[1]] - cy) ** 2 * rx
        inside = q <= rx * ry
        np.copyto(gray[box], 60 + 9 * q // (rx * ry), where=inside, casting="unsafe")
        ellipse[box][inside] = k
    return gray.reshape(len(keys), -1), ellipse.reshape(len(keys), -1)


def _lists(values: np.ndarray, missing: bool = False) -> pa.Array:
    flat = pa.array(values.ravel(), mask=values.ravel() < 0 if missing else None)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), flat)


#: Images of one batch of the fixture, and of one task: neither grows with the table.
BATCH, IMAGES = 128, 4096


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img) of every part, a bounded number of images in a task."""
    return dealt(_read(spark, sf_dir, "part").select(F.col("p_partkey").alias("img")), "img", IMAGES)


def images(spark: SparkSession, sf_dir: str, ellipses: bool = False) -> DataFrame:
    """The same images, each with its grey values, and its ellipses if asked, row by row as one array; nothing is grouped."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.column(0).slice(at, BATCH)
                gray, ellipse = _images(part.to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([part, _lists(gray)] + [_lists(ellipse, True)] * ellipses, names=["img", "gray", "ellipse"][: 2 + ellipses])

    small_batches(spark)
    return keys(spark, sf_dir).mapInArrow(run, "img long, gray array<int>" + ", ellipse array<int>" * ellipses)


def ellipse_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels of pixels() that lie in an ellipse; no others are made."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.column(0).to_numpy(zero_copy_only=False)[at : at + BATCH]
                gray, ellipse = _images(part)
                row, place = np.nonzero(ellipse >= 0)
                columns = part[row], (place % 64).astype(np.int32), (place // 64).astype(np.int32), gray[row, place], ellipse[row, place]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["img", "x", "y", "gray", "ellipse"])

    return keys(spark, sf_dir).mapInArrow(run, "img long, x int, y int, gray int, ellipse int")


def nuclei(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    area, ar = F.col("o_totalprice") / 30, 1 + k % 29 / 15
    n = _read(spark, sf_dir, "orders").select(
        k.alias("nucleus_id"), (F.col("o_custkey") % 40).cast("int").alias("task_n"), (k % 6).cast("int").alias("tile_row"), (F.floor(k / 6) % 5).cast("int").alias("tile_col"), (k % 50).cast("int").alias("inst_id"),
        area.alias("area"), (2 * F.sqrt(math.pi * area) * (1 + k % 23 / 20)).alias("perimeter"), ar.alias("ar"), (0.45 + k % 31 / 60).alias("sol"), (1 + k % 19 / 20).alias("rough"),
        (k % 83).cast("double").alias("istd"), (20 + k % 200).cast("double").alias("mi"), (0.5 + k % 37 / 80).alias("rect"), (1 + k % 41 / 40).alias("fd"), (k % 180 * math.pi / 180 - math.pi / 2).alias("orientation"),
    )
    minor = 2 * F.sqrt(F.col("area") / (math.pi * F.col("ar")))
    n = n.withColumns({"minor": minor, "centroid_x": (F.col("tile_col") * 1920 + F.col("nucleus_id") % 2048).cast("int"), "centroid_y": (F.col("tile_row") * 1920 + F.col("nucleus_id") * 7 % 2048).cast("int")})
    return n.withColumn("major", F.col("minor") * F.col("ar"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("task_id"), F.col("embedding").cast("array<double>").alias("vec"))


STATES = {"signup": "pending", "view": "reading", "click": "super_resolving", "purchase": "completed", "error": "failed"}


def as_task_events(events: DataFrame) -> DataFrame:
    """events to task events; for a stream too."""
    state = F.create_map(*[F.lit(x) for p in STATES.items() for x in p])[F.col("event_type")]
    tile_no = F.get_json_object("props", "$.k").cast("int")
    return events.select("event_id", F.concat(F.lit("task-"), F.col("user_id").cast("string")).alias("task_id"), "ts", state.alias("state"), F.least(F.lit(100.0), F.col("value")).alias("progress"), "event_type", tile_no.alias("tile_no"))


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_task_events(_read(spark, sf_dir, "events"))


def blend_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four constant 64 x 64 tiles."""
    side = lambda c: F.explode(F.sequence(F.lit(0), F.lit(63))).alias(c)
    t = spark.range(4).select((F.col("id") / 2).cast("int").alias("tile_row"), (F.col("id") % 2).cast("int").alias("tile_col"), F.element_at(F.array(*[F.lit(float(v)) for v in (220, 50, 60, 240)]), (F.col("id") + 1).cast("int")).alias("v"))
    return t.select("*", side("y")).select("*", side("x"))


_K = "o_orderkey"
CTE = {
    "slides": """slides AS (SELECT p_partkey AS slide_id, '/data/input/s' || p_partkey || ['.svs', '.TIF', '.tiff', '.ndpi', '.mrxs', '.png'][p_partkey % 6 + 1] AS file_path,
  CAST(300 + p_size * 97 + p_partkey % 13 * 41 AS INTEGER) AS width, CAST(280 + p_size * 61 + p_partkey % 7 * 53 AS INTEGER) AS height FROM part)""",
    "tiles": """tiles AS (SELECT slide_id, CAST(r AS INTEGER) AS tile_row, CAST(c AS INTEGER) AS tile_col, CAST(c * 480 AS INTEGER) AS x, CAST(r * 480 AS INTEGER) AS y,
  CAST(least(512, width - c * 480) AS INTEGER) AS w, CAST(least(512, height - r * 480) AS INTEGER) AS h
  FROM (SELECT *, unnest(range(greatest(1, (width - 32 + 479) // 480))) AS c FROM (SELECT *, unnest(range(greatest(1, (height - 32 + 479) // 480))) AS r FROM slides)))""",
    "pixels": """e0 AS (SELECT p_partkey AS img, x, y, k, 4 + (p_partkey * 3 + k * 5) % 9 AS rx, 3 + (p_partkey * 7 + k * 2) % 8 AS ry, x - [16, 48, 30][k + 1] AS dx, y - [16, 18, 46][k + 1] AS dy
  FROM part, range(64) a(x), range(64) b(y), range(3) c(k)),
pixels AS (SELECT img, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y,
  CAST(coalesce(max(CASE WHEN dx*dx*ry*ry + dy*dy*rx*rx <= rx*rx*ry*ry THEN 60 + (9 * (dx*dx*ry*ry + dy*dy*rx*rx)) // (rx*rx*ry*ry) END), 210 + (31 * x + 17 * y + 7 * img) % 11) AS INTEGER) AS gray,
  CAST(max(CASE WHEN dx*dx*ry*ry + dy*dy*rx*rx <= rx*rx*ry*ry THEN k END) AS INTEGER) AS ellipse FROM e0 GROUP BY img, x, y)""",
    "nuclei": f"""n0 AS (SELECT {_K} AS nucleus_id, CAST(o_custkey % 40 AS INTEGER) AS task_n, CAST({_K} % 6 AS INTEGER) AS tile_row, CAST({_K} // 6 % 5 AS INTEGER) AS tile_col, CAST({_K} % 50 AS INTEGER) AS inst_id,
  o_totalprice / 30 AS area, 2 * sqrt(pi() * (o_totalprice / 30)) * (1 + ({_K} % 23) / 20) AS perimeter, 1 + ({_K} % 29) / 15 AS ar, 0.45::DOUBLE + ({_K} % 31) / 60 AS sol, 1 + ({_K} % 19) / 20 AS rough,
  CAST({_K} % 83 AS DOUBLE) AS istd, CAST(20 + {_K} % 200 AS DOUBLE) AS mi, 0.5::DOUBLE + ({_K} % 37) / 80 AS rect, 1 + ({_K} % 41) / 40 AS fd, ({_K} % 180) * pi() / 180 - pi() / 2 AS orientation FROM orders),
nuclei AS (SELECT *, 2 * sqrt(area / (pi() * ar)) AS minor, 2 * sqrt(area / (pi() * ar)) * ar AS major, CAST(tile_col * 1920 + nucleus_id % 2048 AS INTEGER) AS centroid_x,
  CAST(tile_row * 1920 + nucleus_id * 7 % 2048 AS INTEGER) AS centroid_y, 4 * pi() * area / (perimeter * perimeter) AS circ FROM n0)""",
    "vectors": "vectors AS (SELECT vec_id AS id, label AS task_id, embedding::DOUBLE[] AS vec FROM embeddings)",
    "task_events": """task_events AS (SELECT event_id, 'task-' || user_id AS task_id, ts, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'reading' WHEN 'click' THEN 'super_resolving' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS state,
  least(100.0::DOUBLE, value) AS progress, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS tile_no FROM events)""",
}


def sql(names: str, body: str) -> str:
    """A query over the named derivations."""
    return "WITH " + ",\n".join(CTE[n] for n in names.split()) + "\n" + body.strip()  # a body may start with a comma and more derivations
