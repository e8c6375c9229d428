"""Registered queries over the stored vector table: commits, deletes, inverted lists."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources import vector_table as table
from ..sources.shared import shared_folder
from . import fixtures as fx
from .fixtures import sql
from .queries import query


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(sql("vectors", """, r AS (SELECT id, task_id, CASE WHEN id % 97 = 5 THEN 63 WHEN id % 101 = 7 THEN NULL ELSE len(vec) END AS n, list_sum(vec) AS total FROM vectors),
i AS (SELECT count(*) FILTER (WHERE n = 64) AS inserted, count(*) FILTER (WHERE n IS DISTINCT FROM 64) AS failed FROM r),
d AS (SELECT count(*) AS deleted FROM r WHERE n = 64 AND (task_id = 3 OR task_id = 4 AND id % 2 = 0))
SELECT task_id, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids, round(sum(total), 6) AS total, any_value(inserted) AS inserted, any_value(failed) AS failed, any_value(deleted) AS deleted
FROM r, i, d WHERE n = 64 AND task_id <> 3 AND NOT (task_id = 4 AND id % 2 = 0) GROUP BY task_id"""))
def vec_commits(spark, sf_dir) -> DataFrame:
    """The collection after two batches (some of their rows unsound, one batch sent twice), the deletion of a task and of part of another."""
    root, i = _folder(spark, "vectors"), F.col("id")
    vec = F.when(i % 97 == 5, F.slice("vec", 1, 63)).when(i % 101 == 7, F.lit(None)).otherwise(F.col("vec"))
    rows = fx.vectors(spark, sf_dir).withColumn("vec", vec)
    halves = [rows.filter(i % 2 == k) for k in (0, 1)]
    counts = [table.insert(halves[k], root, f"half-{k}", 64) for k in (0, 1)]
    counts[0] = table.insert(halves[0], root, "half-0", 64)
    deleted = table.delete(spark, root, 3) + table.delete(spark, root, 4, i % 2 == 0)
    told = [F.lit(sum(c[k] for c in counts)).cast("long").alias(k) for k in ("inserted", "failed")]
    sums = table.stored(spark, root).groupBy("task_id").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.round(F.sum(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)), 6).alias("total"))
    return sums.select("*", *told, F.lit(deleted).cast("long").alias("deleted"))


@query(sql("vectors", "SELECT id, task_id, round(list_distance(vec, (SELECT vec FROM vectors WHERE id = 0)), 6) AS distance FROM vectors ORDER BY list_distance(vec, (SELECT vec FROM vectors WHERE id = 0)), id LIMIT 20"))
def vec_ivf_topk(spark, sf_dir) -> DataFrame:
    """The 20 nearest by inverted lists: the nearest lists first, then those that the distances found do not rule out."""
    folder, rows = _folder(spark, "lists"), fx.vectors(spark, sf_dir)
    table.build_lists(rows, folder)
    asked = rows.filter("id = 0").select("vec").first()["vec"]
    return table.search_lists(spark, folder, asked, exact=True).select("id", "task_id", F.round("distance", 6).alias("distance"))


@query(sql("vectors", """SELECT count(*) AS n, CAST(sum(id) AS BIGINT) AS ids, true AS within FROM vectors"""))
def vec_ivf_lists(spark, sf_dir) -> DataFrame:
    """The index as a whole: every vector in one list, none further from its centre than the list's radius, no other centre nearer."""
    folder, rows = _folder(spark, "lists"), fx.vectors(spark, sf_dir)
    table.build_lists(rows, folder)
    centres, lists = spark.read.parquet(f"{folder}/centres"), spark.read.parquet(f"{folder}/lists")
    every = F.broadcast(centres.agg(F.collect_list(F.struct("list", "centre")).alias("every")))  # NLIST centres
    met = lists.join(F.broadcast(centres), "list").crossJoin(every)
    nearest = F.array_min(F.transform("every", lambda c: V.l2(F.col("vec"), c["centre"])))
    within = (F.col("away") <= F.col("radius")) & (F.col("away") <= nearest + 1e-9)
    return met.agg(F.count("*").alias("n"), F.sum("id").alias("ids"), (F.every(within) & (F.count_distinct("list") <= table.NLIST)).alias("within"))
