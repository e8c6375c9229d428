"""The stored vector table: inserts that commit whole or not at all, deletes of a task, and inverted lists for search.

Rows lie as Parquet in folders by task, so that one task is read, replaced or dropped without the others.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions import vectors as V
from .slides import located


@dataclass
class Written(WriterCommitMessage):
    """What one task staged: its files, rows that went in and rows that did not."""

    files: tuple
    inserted: int
    failed: int


class VectorWriter(DataSourceArrowWriter):
    """Tasks write below `_staging/<batch>`, which no reader lists; the commit moves their files into the table and records the counts.

    What a failed batch's last tasks still stage is cleared by the next try. A batch whose record exists is not inserted again. A commit that ended halfway is undone by the next one of that batch:
    its files bear the batch's name.
    """

    def __init__(self, root: str, batch: str, dimension: int):
        self.root, self.batch, self.dimension = root, batch, dimension

    def write(self, iterator):
        filesystem, root = located(self.root)
        base, files, inserted, failed, attempt = f"{root}/_staging/{self.batch}", [], 0, 0, uuid.uuid4().hex
        for n, batch in enumerate(iterator):
            vectors = batch.column("vec")
            sound = pc.and_(pc.is_valid(batch.column("id")), pc.and_(pc.is_valid(batch.column("task_id")), pc.equal(pc.list_value_length(vectors), self.dimension)))
            sound = np.array(pc.fill_null(sound, False))
            kept = batch.filter(pa.array(sound))
            flat = np.asarray(kept.column("vec").flatten().to_numpy(zero_copy_only=False), float).reshape(len(kept), self.dimension)
            fine = np.isfinite(flat).all(axis=1)  # a null component is not finite either
            kept = kept.filter(pa.array(fine))
            inserted, failed = inserted + len(kept), failed + len(batch) - len(kept)
            for task in pc.unique(kept.column("task_id")).to_pylist():
                rows = pa.Table.from_batches([kept.filter(pc.equal(kept.column("task_id"), task)).drop_columns(["task_id"])])
                name = f"task_id={task}/{self.batch}-{attempt}-{n}.parquet"
                filesystem.create_dir(posixpath.dirname(f"{base}/{name}"), recursive=True)
                pq.write_table(rows, f"{base}/{name}", filesystem=filesystem, compression="zstd")
                files.append(name)
        return Written(tuple(files), inserted, failed)

    def _record(self, root: str) -> str:
        return f"{root}/_commits/{self.batch}.json"

    def commit(self, messages):
        filesystem, root = located(self.root)
        staging = f"{root}/_staging/{self.batch}"
        if filesystem.get_file_info(self._record(root)).type == pafs.FileType.NotFound:
            for info in filesystem.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
                if info.base_name.startswith(f"{self.batch}-") and "/_staging/" not in info.path:
                    filesystem.delete_file(info.path)  # left by a commit that ended halfway
            done = [m for m in messages if m is not None]
            for name in (f for m in done for f in m.files):
                filesystem.create_dir(posixpath.dirname(f"{root}/{name}"), recursive=True)
                filesystem.move(f"{staging}/{name}", f"{root}/{name}")
            filesystem.create_dir(f"{root}/_commits", recursive=True)
            record = {"inserted": sum(m.inserted for m in done), "failed": sum(m.failed for m in done)}
            with filesystem.open_output_stream(self._record(root)) as out:
                out.write(json.dumps(record).encode())
        self._clear(filesystem, staging)

    def abort(self, messages):
        filesystem, root = located(self.root)
        self._clear(filesystem, f"{root}/_staging/{self.batch}")

    @staticmethod
    def _clear(filesystem, staging: str) -> None:
        if filesystem.get_file_info(staging).type != pafs.FileType.NotFound:
            filesystem.delete_dir(staging)


class VectorTable(DataSource):
    """rows.write.format("vector_table").option("batch", ...).mode("append").save(root); option `dimension`."""

    @classmethod
    def name(cls):
        return "vector_table"

    def schema(self):
        return "id long, task_id int, vec array<double>"

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("the vector table is only appended to; delete() takes rows away")
        options = {k.lower(): v for k, v in self.options.items()}
        return VectorWriter(options["path"], options["batch"], int(options["dimension"]))


def insert(rows: DataFrame, root: str, batch: str, dimension: int) -> dict:
    """Append rows (id, task_id, vec) as one batch and give {"inserted": n, "failed": n}.

    A row fails whose id, task or vector is null, or whose vector has another dimension or a component that is null or not
    finite; the others go in. If a task fails for good, nothing goes in. A batch that is inserted again changes nothing and gives its
    first counts. Repeated ids are kept, as in the collection; an empty batch gives zeros.
    """
    spark = rows.sparkSession
    spark.dataSource.register(VectorTable)
    named = rows.select(F.col("id").cast("long").alias("id"), F.col("task_id").cast("int").alias("task_id"), F.col("vec").cast("array<double>").alias("vec"))
    named.write.format("vector_table").option("batch", batch).option("dimension", dimension).mode("append").save(root)
    filesystem, inner = located(root)
    with filesystem.open_input_stream(f"{inner}/_commits/{batch}.json") as record:
        return json.loads(record.read())


SCHEMA = "id long, vec array<double>, task_id int"


def stored(spark: SparkSession, root: str) -> DataFrame:
    """The table's rows; a filter on task_id reads that folder only."""
    return spark.read.schema(SCHEMA).parquet(root)


def delete(spark: SparkSession, root: str, task_id: int, where=None) -> int:
    """Take away a task's rows, or those of them that meet a condition, and give their true number.

    The task's folder is dropped, or replaced by the rows that stay through a dynamic partition overwrite; other folders
    are not touched. A condition that is null keeps its row.
    """
    rows = stored(spark, root).filter(F.col("task_id") == task_id)
    gone = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    n, left = rows.agg(F.count_if(gone), F.count_if(~gone)).first()
    if n and left:
        rows.filter(~gone).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("task_id").parquet(root)
    elif n:
        filesystem, inner = located(root)
        filesystem.delete_dir(f"{inner}/task_id={task_id}")
    return n


#: Lists of the coarse quantiser and lists that a search reads first, as in the collection; at most so many vectors are used to train it.
NLIST, NPROBE, TRAINING = 128, 16, 100_000


def build_lists(rows: DataFrame, folder: str, nlist: int = NLIST, training: int = TRAINING, seed: int = 7) -> None:
    """Write rows (id, task_id, vec) into inverted lists below folder: `lists/list=<n>` as Parquet and `centres` (list, centre, radius, n).

    k-means is trained on at most `training` vectors, chosen by a hash of their ids; every vector goes into the list of
    its nearest centre. radius is the largest distance of a member, so a search can tell which lists cannot matter. A list of
    any size is written by as many tasks as it needs.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark, total = rows.sparkSession, rows.count()
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, training / max(total, 1)) * (1 << 30))
    sample = rows.filter(share).select(array_to_vector("vec").alias("features"))
    model = KMeans(k=max(2, min(nlist, total)), seed=seed, maxIter=10).fit(sample)
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "list int, centre array<double>")
    listed = model.transform(rows.select("id", "task_id", "vec", array_to_vector("vec").alias("features"))).withColumnRenamed("prediction", "list").drop("features")
    listed = listed.join(F.broadcast(centres), "list").withColumn("away", V.l2(F.col("vec"), F.col("centre"))).drop("centre")
    listed.hint("rebalance", "list").write.partitionBy("list").parquet(f"{folder}/lists")
    sizes = spark.read.parquet(f"{folder}/lists").groupBy("list").agg(F.max("away").alias("radius"), F.count("*").alias("n"))
    centres.join(F.broadcast(sizes), "list").coalesce(1).write.parquet(f"{folder}/centres")


def _best(lists: DataFrame, numbers: list[int], query: list[float], k: int) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = lists.filter(F.col("list").isin(numbers)).select("id", "task_id", V.l2(F.col("vec"), q).alias("distance"))
    return rows.orderBy("distance", "id").limit(k)


def search_lists(spark: SparkSession, folder: str, query: list[float], k: int = 20, nprobe: int = NPROBE, exact: bool = False) -> DataFrame:
    """(id, task_id, distance) of the k nearest, from the nprobe lists whose centres are nearest; only their folders are read.

    exact: then also the lists that may hold a nearer vector, those whose centre is no further than the k-th distance and
    the list's radius. Few are left where vectors form clusters, all where they do not.
    """
    at = np.asarray(query, float)
    centres = sorted((float(np.linalg.norm(np.asarray(r["centre"]) - at)), r["list"], r["radius"], r["n"]) for r in spark.read.parquet(f"{folder}/centres").collect())  # NLIST rows
    lists, first, held = spark.read.parquet(f"{folder}/lists"), [], 0
    for _, number, _, n in centres:  # as many as asked, and more if these hold fewer than k
        if len(first) >= nprobe and held >= k:
            break
        first.append(number)
        held += n
    found = _best(lists, first, query, k)
    if not exact:
        return found
    rows = found.collect()
    reach = rows[-1]["distance"] if len(rows) == k else float("inf")
    near = [number for away, number, radius, _ in centres if away - radius <= reach * (1 + 1e-9) + 1e-9]
    return _best(lists, sorted({*first, *near}), query, k)
