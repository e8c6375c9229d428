"""Helpers shared by the training-data operators: reading, staging in the shared folder, distributed running sums."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One run of the white space that parts words: blank and the controls tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
#: One word.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master may leave it unset, as tests do; it gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def stage(df: DataFrame, name: str, made: list | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts lineage, survives lost executors, fixes ids that depend on partitions.

    made: a list that gets the table's path, for dropped().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, made: list) -> None:
    """Delete staged tables that nothing reads any more."""
    jvm = spark._jvm
    for path in made:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    made.clear()


def numbered(df: DataFrame) -> DataFrame:
    """df staged as (`_row`, `doc`): an id of the row that no other row has, null keys and repeated rows included, and the row.

    As the row is one struct, no column of df can clash with those that an operator adds; select("doc.*") gives it back.
    """
    return stage(df.select(F.monotonically_increasing_id().alias("_row"), F.struct("*").alias("doc")), "numbered")


#: Rows of the Arrow batches of texts that Python functions get, so that a worker's memory stays bounded.
TEXTS = 500


@contextmanager
def text_batches(spark: SparkSession):
    """Within it, Python functions get TEXTS rows at a time; afterwards as many as before. Plans must run within it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(TEXTS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ascii_lower(column):
    return F.translate(column, UPPER, LOWER)


def words(text):
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def running_before(df: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """df with `name`: the sum of `value` over the rows of the same group that stand before in `order`.

    Rows are range-partitioned by `order`, so a hot group is spread over all tasks; only one row for each group and
    range goes into the second, small sum. `group` must not be null and `order` must be total.
    """
    ranged = stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(group, "_part").agg(F.sum(value).alias("_sum"))
    offsets = offsets.select(group, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn("_own", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return own.join(offsets, [group, "_part"]).withColumn(name, F.col("_offset") + F.col("_own")).drop("_part", "_own", "_offset")
