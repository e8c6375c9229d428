"""Queries of records, each beside its SQL; registered with the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nuclei, records, tasks
from ..streaming import events as stream
from . import fixtures as fx
from .fixtures import sql
from .queries import query, rounded


def _named(spark, sf_dir):
    """The nuclei under the records' names, with tags and a box."""
    n = nuclei.with_score(fx.nuclei(spark, sf_dir))
    box = {"bbox_x": F.floor(F.col("centroid_x") - F.col("major") / 2), "bbox_y": F.floor(F.col("centroid_y") - F.col("minor") / 2), "bbox_w": F.ceil("major"), "bbox_h": F.ceil("minor")}
    return n.withColumns(box).withColumnsRenamed({"circ": "circularity", "ar": "aspect_ratio", "rough": "boundary_roughness", "istd": "intensity_std", "score": "abnormality_score"})


_TAGS = """n1 AS (SELECT *, least(1.0::DOUBLE, circ) AS c, array_to_string(list_filter([CASE WHEN least(1.0::DOUBLE, circ) < 0.75::DOUBLE OR rough > 1.4::DOUBLE THEN 'polygonal' END, CASE WHEN rough > 1.4::DOUBLE THEN 'rough_boundary' END,
  CASE WHEN ar > 2 THEN 'spindle' END, CASE WHEN istd > 45 THEN 'chromatin_aggregation' END], lambda t: t IS NOT NULL), ',') AS tags FROM nuclei)"""


@query(sql("nuclei", f""", {_TAGS} SELECT 'task-' || task_n || '_' || tile_row || '_' || tile_col || '_' || inst_id AS id, 'task-' || task_n AS task_id, CAST(tile_col * 480 + centroid_x AS INTEGER) AS wsi_x, CAST(tile_row * 480 + centroid_y AS INTEGER) AS wsi_y,
  100000 AS wsi_width, 80000 AS wsi_height, CAST(tile_row AS SMALLINT) AS tile_row, CAST(tile_col AS SMALLINT) AS tile_col, inst_id, round(c, 6) AS circularity, round(ar, 6) AS aspect_ratio, round(rough, 6) AS boundary_roughness, istd AS intensity_std, tags,
  12 AS dims FROM n1"""))  # fmt: skip
def rec_collection_a(spark, sf_dir):
    n = _named(spark, sf_dir).withColumns({"task_id": F.concat(F.lit("task-"), "task_n"), "feature_vector": F.array_repeat(F.lit(0.0), 12)})
    rows = records.to_collection_a(n, F.col("tile_col") * 480, F.col("tile_row") * 480, 100000, 80000)
    rows = rows.withColumn("dims", F.size("feature_vector")).drop("created_at", "feature_vector", "abnormality_score")
    return rounded(rows, "circularity", "aspect_ratio", "boundary_roughness")


@query(sql("nuclei", "SELECT nucleus_id, round(area, 6) AS area, 'task-1' AS task_id, '/data/input/s1.svs' AS slide_path, 36 AS id_length, true AS dated FROM nuclei"))
def rec_collection_b(spark, sf_dir):
    rows = records.to_collection_b(fx.nuclei(spark, sf_dir).select("nucleus_id", "area"), "task-1", "/data/input/s1.svs")
    return rounded(rows.select("nucleus_id", "area", "task_id", "slide_path", F.length("id").alias("id_length"), (F.col("created_at") > 0).alias("dated")), "area")


@query(sql("nuclei", f""", {_TAGS} SELECT nucleus_id, inst_id, round(area, 6) AS area, round(c, 6) AS circularity, tags, 0 AS vector_length FROM n1 WHERE area BETWEEN 80 AND 8000"""))
def rec_compact(spark, sf_dir):
    n = records.in_area(_named(spark, sf_dir)).withColumnRenamed("tags", "abnormality_tags")
    kept = records.compact(n.withColumn("centroid", F.array("centroid_x", "nucleus_id")))
    return rounded(kept.select(F.col("centroid")[1].alias("nucleus_id"), "inst_id", "area", "circularity", F.array_join("abnormality_tags", ",").alias("tags"), F.size("feature_vector").alias("vector_length")), "area", "circularity")


@query(sql("nuclei", """, r AS (SELECT *, (circ < 0.55::DOUBLE)::INT + (ar > 2.2::DOUBLE)::INT + (rough > 1.35::DOUBLE)::INT + (sol < 0.55::DOUBLE)::INT + (area < 150 OR area > 15000)::INT AS hits FROM nuclei)
SELECT task_n, tile_row, tile_col, centroid_x, centroid_y, CAST(ceil(major) * ceil(minor) AS BIGINT) AS area, 1.0::DOUBLE AS solidity, 0.0::DOUBLE AS mean_intensity FROM r WHERE hits >= 2"""))  # fmt: skip
def rec_cell_events(spark, sf_dir):
    n = nuclei.with_rules(fx.nuclei(spark, sf_dir))
    n = n.select("task_n", "tile_row", "tile_col", "centroid_x", "centroid_y", F.lit(0).alias("bbox_x"), F.lit(0).alias("bbox_y"), F.ceil("major").alias("bbox_w"), F.ceil("minor").alias("bbox_h"),
                 F.col("circ").alias("circularity"), F.col("ar").alias("aspect_ratio"), F.col("rough").alias("roughness"), "reasons", "is_abnormal")
    return records.rehydrated(records.cell_events(n)).select("task_n", "tile_row", "tile_col", "centroid_x", "centroid_y", "area", "solidity", "mean_intensity")


@query(sql("nuclei", """SELECT nucleus_id, CAST(row_number() OVER t AS INTEGER) AS inst_id, CAST(row_number() OVER t + 1 AS INTEGER) AS second_id FROM nuclei WHERE area BETWEEN 80 AND 40000
  WINDOW t AS (PARTITION BY task_n, tile_row, tile_col ORDER BY nucleus_id)"""))  # fmt: skip
def rec_renumbered(spark, sf_dir):
    n, tile = records.in_area(fx.nuclei(spark, sf_dir), "py128"), ["task_n", "tile_row", "tile_col"]
    n = records.renumbered(records.renumbered(n, tile, ["nucleus_id"]), tile, ["nucleus_id"], 2, "second_id")
    return n.select("nucleus_id", "inst_id", "second_id")


@query(sql("task_events", """, l AS (SELECT task_id, arg_max(state, (ts, event_id)) AS state FROM task_events GROUP BY 1)
SELECT task_id, state, state IN ('completed', 'super_resolving', 'stitching') AS viewable, state IN ('pending', 'reading', 'super_resolving', 'stitching', 'saving') AS cancelable, right(task_id, 6) AS last_six, left(task_id, 8) AS first_eight FROM l"""))  # fmt: skip
def rec_task_flags(spark, sf_dir):
    c = F.col
    t = tasks.latest(fx.task_events(spark, sf_dir))
    return t.select("task_id", "state", records.viewable(c("state")).alias("viewable"), records.cancelable(c("state")).alias("cancelable"), F.right("task_id", F.lit(6)).alias("last_six"), F.left("task_id", F.lit(8)).alias("first_eight"))


@query(sql("task_events", """SELECT event_id, CASE WHEN tile_no % 4 = 0 THEN '未启用' WHEN tile_no % 3 = 0 THEN '等待中' WHEN event_id % 7 < tile_no % 3 * 3 THEN '分析中' ELSE '已完成' END AS text,
  CASE WHEN tile_no % 4 = 0 THEN 'info' WHEN tile_no % 3 <> 0 AND event_id % 7 < tile_no % 3 * 3 THEN 'warning' WHEN event_id % 2 > 0 THEN 'danger' ELSE 'success' END AS kind FROM task_events"""))  # fmt: skip
def rec_analysis_status(spark, sf_dir):
    n, e = F.col("tile_no"), F.col("event_id")
    return fx.task_events(spark, sf_dir).select("event_id", records.analysis_status(n % 4 != 0, n % 3 * 3, e % 7, e % 2).alias("s")).select("event_id", "s.*")


@query(sql("slides tiles", """SELECT slide_id, tile_row, tile_col, round(x * 0.01::DOUBLE - 14, 6) AS marker_x, CAST(tile_col * 512 AS INTEGER) AS left, CAST(tile_row * 512 AS INTEGER) AS top, CAST(floor(w / 512 * 100 + 0.5::DOUBLE) AS INTEGER) AS percent FROM tiles"""))
def rec_layout(spark, sf_dir):
    c = F.col
    t = fx.tiles(spark, sf_dir).select("slide_id", "tile_row", "tile_col", records.marker_at(c("x"), F.lit(1000), F.lit(100000)).alias("marker_x"), (c("tile_col") * 512).alias("left"), (c("tile_row") * 512).alias("top"), records.percent(c("w"), F.lit(512)).alias("percent"))
    return rounded(t, "marker_x")


@query(sql("slides tiles", """SELECT slide_id, tile_row, tile_col, 80 AS min_area, CASE WHEN tile_col % 2 = 0 THEN 9000 ELSE 8000 END AS max_area, 0.5::DOUBLE AS score_threshold, false AS skip_milvus, 0 AS offset_x FROM tiles"""))
def rec_requests(spark, sf_dir):
    t = fx.tiles(spark, sf_dir)
    payload = F.to_json(F.struct(F.lit("t").alias("task_id"), "tile_row", "tile_col", F.when(F.col("tile_col") % 2 == 0, 9000).alias("max_area")))
    r = records.requests(t.select("slide_id", payload.alias("value")))
    return r.select("slide_id", "tile_row", "tile_col", "min_area", "max_area", "score_threshold", "skip_milvus", F.col("tile_global_offset")[0].alias("offset_x"))


@query(sql("slides", """SELECT slide_id, CAST(n AS INTEGER) AS place, CAST(n AS INTEGER) AS row, CAST(slide_id % 5 AS INTEGER) AS col, 'i' || n AS image_data FROM slides, range(3) t(n)"""))
def rec_tile_lists(spark, sf_dir):
    s = fx.slides(spark, sf_dir)
    one = lambda n: F.struct(F.lit(n).alias("row"), (F.col("slide_id") % 5).alias("col"), F.lit(f"i{n}").alias("image_data"))
    return records.tile_lists(s.select("slide_id", F.to_json(F.array(*map(one, range(3)))).alias("value")))


@query(sql("task_events", """, u AS (SELECT task_id, arg_max(progress, (ts, event_id)) AS progress, arg_max(CASE WHEN event_id % 2 = 0 THEN state ELSE '' END, (ts, event_id)) AS message FROM task_events GROUP BY 1)
SELECT task_id, coalesce(u.progress, 0) AS progress, CASE WHEN coalesce(u.message, '') <> '' THEN u.message ELSE 'created' END AS message FROM (SELECT 'task-' || n AS task_id FROM range(200) t(n)) LEFT JOIN u USING (task_id)"""))  # fmt: skip
def rec_fold_progress(spark, sf_dir):
    known = spark.range(200).select(F.concat(F.lit("task-"), F.col("id").cast("string")).alias("task_id"), F.lit(0.0).alias("progress"), F.lit("created").alias("message"))
    updates = fx.task_events(spark, sf_dir).withColumn("message", F.when(F.col("event_id") % 2 == 0, F.col("state")).otherwise(""))
    return stream.fold_progress(known, updates)


@query(sql("nuclei", """SELECT nucleus_id, 'a' AS list FROM nuclei WHERE area > 8000 AND NOT tile_row = 0 UNION ALL SELECT nucleus_id, 'b' FROM (SELECT nucleus_id FROM nuclei ORDER BY area DESC, nucleus_id LIMIT 200)"""))
def rec_lists(spark, sf_dir):
    n = fx.nuclei(spark, sf_dir)
    large = records.without(n.filter("area > 8000"), n.filter("tile_row = 0"), ["nucleus_id"]).select("nucleus_id", F.lit("a").alias("list"))
    return records.both_lists(large, records.first_rows(n, 200, F.desc("area"), "nucleus_id").select("nucleus_id", F.lit("b").alias("list")))
