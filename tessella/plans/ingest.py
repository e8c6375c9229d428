"""Registered query over uploads: a small file for each part, written by a fixture."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import ingest
from ..sources.shared import dealt, in_folder, shared_folder
from ..sources.slides import located
from . import fixtures as fx
from .fixtures import sql
from .queries import query

#: The fixture's greatest size of an upload.
MOST = 150
#: Keys whose uploads share four folders, and uploads of one task: neither grows with the table.
KEYS = 1 << 14


def _uploaded(spark, sf_dir) -> str:
    folder = f"{shared_folder(spark)}/uploads-{uuid.uuid4().hex}"

    def write(frames):
        (to, base), made = located(folder), set()
        for frame in frames:
            for key, path in zip(frame.slide_id, frame.file_path):
                target = f"{base}/d{key % 4}/{key // KEYS}/{path.rsplit('/', 1)[1]}"
                with to.open_output_stream(in_folder(made, to, target), buffer_size=0) as out:
                    out.write(bytes([key % 256]) * (1 + key % 200))
            yield pd.DataFrame({"slide_id": frame.slide_id})

    slides = fx.slides(spark, sf_dir).select("slide_id", "file_path")
    dealt(slides, "slide_id", KEYS).mapInPandas(write, "slide_id long").write.parquet(f"{folder}-manifest")
    return folder


_FILES = f"""f AS (SELECT slide_id, regexp_extract(file_path, '[^/]*$') AS name, lower(regexp_extract(file_path, '\\.[^./]*$')) AS ext, 1 + slide_id % 200 AS length FROM slides),
u AS (SELECT *, CASE WHEN ext NOT IN ('.svs', '.tif', '.tiff', '.ndpi', '.mrxs') THEN 'format' WHEN length > {MOST} THEN 'size' ELSE 'in' END AS reason FROM f)"""


@query(sql("slides", f""", {_FILES}
SELECT slide_id, ext, length, '1700000000000-' || name AS stamped, reason, CASE WHEN reason = 'in' THEN length ELSE -1 END AS copied FROM u"""))
def ingest_files(spark, sf_dir) -> DataFrame:
    """Every upload with its reason, and the bytes that were copied of those that are taken in."""
    folder = _uploaded(spark, sf_dir)
    rows = ingest.uploads(spark, folder, most=MOST, at_ms=F.lit(1_700_000_000_000), by_tasks=True)
    slide_id = F.regexp_extract("name", r"s(\d+)\.", 1).cast("long").alias("slide_id")
    return ingest.ingested(rows, f"{folder}-in").select(slide_id, "ext", "length", "stamped", F.coalesce("reason", F.lit("in")).alias("reason"), F.coalesce("copied", F.lit(-1)).alias("copied"))
