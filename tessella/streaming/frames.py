"""Frames of each task as files, in order and exactly once: a stream sink whose batches commit."""

from __future__ import annotations

import posixpath
import struct
import uuid
from dataclasses import dataclass
from itertools import groupby
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

from ..sources.shared import dealt
from ..sources.slides import located


@dataclass
class Staged(WriterCommitMessage):
    """(task, file) of what one task of Spark wrote."""

    files: tuple


class FrameWriter(DataSourceStreamWriter):
    """Rows (task_id, at, event_id, body) of a micro-batch to one file for each task, in order of time and id.

    Files are staged apart, where no reader looks, and moved at the commit under the batch's number, so a batch that runs again
    replaces its own files; its mark tells that it is whole, and names its files, so that no reader lists folders. All rows of a
    task must be in one partition: framed_stream() sees to that. A partition's rows of one micro-batch are held at a time.
    """

    def __init__(self, root: str):
        self.root = root

    def write(self, iterator):
        filesystem, root = located(self.root)
        rows, files = sorted(iterator, key=lambda r: (r.task_id or "", r.at, r.event_id)), []
        filesystem.create_dir(f"{root}/_staging", recursive=True)
        for task, group in groupby(rows, key=lambda r: r.task_id):
            name = f"_staging/{uuid.uuid4().hex}.bin"
            with filesystem.open_output_stream(f"{root}/{name}") as out:
                for r in group:
                    body = r.body.encode()
                    out.write(struct.pack(">I", len(body)) + body)
            files.append((task, name))
        return Staged(tuple(files))

    def commit(self, messages, batchId):
        filesystem, root = located(self.root)
        mark = f"{root}/_batches/{batchId:012d}"
        if filesystem.get_file_info(mark).type == pafs.FileType.File:
            return self.abort(messages, batchId)
        for folder in ("_staging", "_batches"):
            filesystem.create_dir(f"{root}/{folder}", recursive=True)
        staged = f"{root}/_staging/{uuid.uuid4().hex}.txt"
        with filesystem.open_output_stream(staged) as out:
            for task, name in (f for m in messages if m is not None for f in m.files):
                target = f"task={quote(task or '', safe='')}/{batchId:012d}.bin"
                filesystem.create_dir(posixpath.dirname(f"{root}/{target}"), recursive=True)
                filesystem.move(f"{root}/{name}", f"{root}/{target}")
                out.write(f"{target}\n".encode())
        filesystem.move(staged, mark)

    def abort(self, messages, batchId):
        filesystem, root = located(self.root)
        for _, name in (f for m in messages if m is not None for f in m.files):
            if filesystem.get_file_info(f"{root}/{name}").type == pafs.FileType.File:
                filesystem.delete_file(f"{root}/{name}")


class FrameFiles(DataSource):
    """stream.writeStream.format("frame_files").option("path", root)."""

    @classmethod
    def name(cls):
        return "frame_files"

    def schema(self):
        return "task_id string, at long, event_id long, body string"

    def streamWriter(self, schema, overwrite):
        return FrameWriter(self.options["path"])


def framed_stream(frames: DataFrame, root: str, state: str) -> None:
    """Write a stream (task_id, at, event_id, body) of all that is there now; state is its checkpoint, from which a later call goes on."""
    frames.sparkSession.dataSource.register(FrameFiles)
    rows = frames.select("task_id", F.col("at").cast("long").alias("at"), F.col("event_id").cast("long").alias("event_id"), "body")
    rows = rows.repartition(int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")), "task_id")
    query = rows.writeStream.format("frame_files").option("path", root).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


#: Files that one task reads, and frames of one batch of it: neither grows with the number of files.
FILES, FRAMES = 4096, 4096


def read_frames(spark: SparkSession, root: str) -> DataFrame:
    """(task_id, seq, body) of the committed frames, numbered from 1 in each task. A null task reads as an empty one.

    The marks of the batches name the files, which are dealt by task and read in order, so no folder is listed and no body shuffled.
    """

    def read(names):
        filesystem, at = located(root)
        task, seq, out = None, 0, []
        for batch in names:
            for name in batch.name:
                folder = name.split("/")[0]
                task, seq = folder, seq if folder == task else 0
                with filesystem.open_input_stream(f"{at}/{name}", buffer_size=1 << 16) as file:
                    while head := file.read(4):
                        seq += 1
                        out.append((unquote(folder.removeprefix("task=")), seq, file.read(*struct.unpack(">I", head)).decode()))
                        if len(out) == FRAMES:
                            yield pd.DataFrame(out, columns=["task_id", "seq", "body"])
                            out = []
        yield pd.DataFrame(out, columns=["task_id", "seq", "body"])

    names = spark.read.text(f"{root}/_batches").select(F.col("value").alias("name"), F.substring_index("value", "/", 1).alias("folder"))
    return dealt(names, "folder", FILES).sortWithinPartitions("folder", "name").mapInPandas(read, "task_id string, seq long, body string")
