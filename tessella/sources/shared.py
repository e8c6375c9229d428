"""The folder all executors share, and how rows are dealt to tasks and batches that do not grow with a table."""

import posixpath
import tempfile
from fnmatch import fnmatchcase

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local master may leave it unset, as tests do, and then gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def dealt(rows: DataFrame, by: str, most: int) -> DataFrame:
    """rows by the hash of a column in as many partitions as shuffles have, or more, so that one has about `most` rows; a small file would be one task."""
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(usual, -(-rows.count() // most)), by)


def small_batches(spark: SparkSession, size: int = 4 << 20) -> SparkSession:
    """The session with batches to Python of a few megabytes, as rows may hold whole images."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return spark


#: Spark counts each small file as 4 MB, so that a task has some 32 of them; so many of such tasks become one.
FILES = 16


def gathered(files: DataFrame) -> DataFrame:
    """A scan of many small files in fewer tasks, and as many as the session has slots at least."""
    return files.coalesce(max(files.sparkSession.sparkContext.defaultParallelism, files.rdd.getNumPartitions() // FILES))


def _entries(folder: str) -> tuple[list, str]:
    """What lies in a folder, by name, and what its paths lack in front; without what Spark hides: names that begin with a dot, or with an underscore and are no partition's."""
    from .slides import located

    filesystem, inner = located(folder)
    found = [i for i in filesystem.get_file_info(pafs.FileSelector(inner)) if i.base_name[0] != "." and (i.base_name[0] != "_" or "=" in i.base_name)]
    return sorted(found, key=lambda i: i.base_name), folder[: len(folder) - len(inner)] if folder.endswith(inner) else ""


def _folders(spark: SparkSession, names: list[str]) -> DataFrame:
    """(folder) in some tasks for each slot, more if there are many."""
    slots = 4 * spark.sparkContext.defaultParallelism
    return spark.createDataFrame([(n,) for n in names], "folder string").repartition(min(len(names), max(slots, len(names) // 4)))


#: Files of one batch of listed().
LISTED = 1024


def listed(spark: SparkSession, path: str, pattern: str = "*", content: bool = False) -> DataFrame:
    """(path, length) of every file below a path whose name fits the pattern (of *, ? and [...]), and its content if asked.

    Tasks list the folders, each as a whole, so the driver holds the names of folders but not those of files, as a scan by Spark does.
    Files of a folder are read a few megabytes at a time. Like Spark's, the list has no empty file and no hidden one.
    """

    def within(frames):
        for frame in frames:
            for folder in frame.folder:
                found, prefix = _entries(folder)
                yield pd.DataFrame({"folder": [prefix + i.path for i in found if i.type == pafs.FileType.Directory]}, dtype=object)

    def files(frames):
        from .slides import located

        rows, size = [], 0
        for folder in (f for frame in frames for f in frame.folder):
            filesystem, _ = located(folder)
            found, prefix = _entries(folder)
            for i in found:
                if i.type == pafs.FileType.File and i.size and fnmatchcase(i.base_name, pattern):
                    if content:
                        with filesystem.open_input_stream(i.path) as file:
                            rows.append((prefix + i.path, i.size, file.read()))
                        size += i.size
                    else:
                        rows.append((prefix + i.path, i.size))
                    if len(rows) == LISTED or size > 4 << 20:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
        yield pd.DataFrame(rows, columns=columns)

    columns, level, whole = ["path", "length"] + ["content"] * content, [path.rstrip("/") or "/"], []
    while level:
        whole += level
        level = [r.folder for r in _folders(spark, level).mapInPandas(within, "folder string").collect()]
    return _folders(spark, whole).mapInPandas(files, "path string, length long" + ", content binary" * content)


def in_folder(made: set, filesystem, target: str) -> str:
    """target, after the folder that it lies in is made, unless `made` has it, as most files of a task share theirs."""
    if (folder := posixpath.dirname(target)) not in made:
        filesystem.create_dir(folder, recursive=True)
        made.add(folder)
    return target
