"""Uploads: files below a path that are taken in under a stamped name, or turned away with a reason."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EXTENSIONS
from .shared import gathered, in_folder, listed
from .slides import located

#: The greatest size of an upload, and the setting that lists other formats, parted by commas.
MOST = 100 << 30
SETTING = "spark.tessella.formats"


def formats(spark: SparkSession) -> list[str]:
    """The formats that are taken in: the setting's, in lower case and with a dot, else EXTENSIONS."""
    named = [f.strip().lower() for f in (spark.conf.get(SETTING, None) or ",".join(EXTENSIONS)).split(",")]
    return [f if f.startswith(".") else f".{f}" for f in named if f]


def uploads(spark: SparkSession, path: str, pattern: str = "*", most: int = MOST, at_ms=None, by_tasks: bool = False) -> DataFrame:
    """(path, name, ext, length, stamped, reason) of every file below a path whose name fits the pattern.

    reason is `format` or `size`, null for a file that is taken in; stamped is `<milliseconds>-<name>`, by default of the query's
    time. Names and sizes come from the listing: no file is read. Spark lists no empty file and none whose name begins
    with a dot or an underscore. A scan by Spark holds the whole listing in the driver; with by_tasks, for millions of files, tasks
    list the folders.
    """
    if by_tasks:
        files = listed(spark, path, pattern)
    else:
        files = gathered(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length"))
    name, at = F.regexp_extract("path", "[^/]*$", 0), F.unix_millis(F.current_timestamp()) if at_ms is None else at_ms
    rows = files.select("path", name.alias("name"), "length").withColumn("ext", F.lower(F.regexp_extract("name", r"\.[^.]*$", 0)))
    reason = F.when(~F.col("ext").isin(formats(spark)), "format").when(F.col("length") > most, "size")
    return rows.select("path", "name", "ext", "length", F.concat(at.cast("string"), F.lit("-"), "name").alias("stamped"), reason.alias("reason"))


def accepted_and_rejected(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """uploads() apart: what goes in, and what does not with its reason."""
    return rows.filter(F.col("reason").isNull()).drop("reason"), rows.filter(F.col("reason").isNotNull()).drop("stamped")


def _copied(frame: pd.DataFrame, folder: str, made: set) -> pd.DataFrame:
    """The rows (path, stamped, under) of a batch as (stored, length), after their files are copied below a folder; nulls where stamped is null. made: in_folder()."""
    to, base = located(folder)
    stored, lengths = [], []
    for path, stamped, under in zip(frame.path, frame.stamped, frame.under):
        if stamped is None:
            stored.append(None)
            lengths.append(None)
            continue
        from_, inner = located(path)
        target, length = in_folder(made, to, f"{base}/{under}/{stamped}"), 0
        with from_.open_input_stream(inner) as source, to.open_output_stream(target) as out:
            while piece := source.read(8 << 20):
                out.write(piece)
                length += len(piece)
        stored.append(f"{folder}/{under}/{stamped}")
        lengths.append(length)
    return pd.DataFrame({"stored": stored, "copied": pd.array(lengths, "Int64")})


def _under():
    return F.lower(F.hex(F.xxhash64(F.regexp_extract("path", "^(.*)/", 1)))).alias("under")


def taken_in(accepted: DataFrame, folder: str) -> DataFrame:
    """Copy accepted files below a folder under their stamped names and give (path, stored, length) of what was copied.

    Files are streamed through the tasks, never held whole. A task that runs again writes the same files again; two
    uploads of one name and time would be one file, so each is put below the hash of the folder that it comes from.
    """

    def run(frames):
        made: set = set()
        for frame in frames:
            out = _copied(frame, folder, made)
            yield pd.DataFrame({"path": list(frame.path), "stored": out.stored, "length": out.copied})

    return accepted.select("path", "stamped", _under()).mapInPandas(run, "path string, stored string, length long")


def ingested(rows: DataFrame, folder: str) -> DataFrame:
    """uploads() with stored and copied: taken_in() of those that go in, nulls of the others; one pass over the listing, nothing is joined."""

    def run(frames):
        made: set = set()
        for frame in frames:
            out = _copied(frame.assign(stamped=frame.stamped.where(frame.reason.isna(), None)), folder, made)
            yield pd.concat([frame.drop(columns="under"), out], axis=1)

    columns = rows.select("path", "name", "ext", "length", "stamped", "reason")
    return columns.withColumn("under", _under()).mapInPandas(run, "path string, name string, ext string, length long, stamped string, reason string, stored string, copied long")
