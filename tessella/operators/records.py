"""Records of nuclei, cells, requests and tasks: projections, predicates, numbering."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CANCELABLE, VIEWABLE

#: Fields of an analysis request with the defaults of those that may be left out; fixed values.
REQUEST = "task_id string, image_b64 string, tile_row int, tile_col int, tile_global_offset array<int>, wsi_width int, wsi_height int, min_area int, max_area int, score_threshold double, skip_milvus boolean"
DEFAULTS = {"tile_row": 0, "tile_col": 0, "wsi_width": 0, "wsi_height": 0, "min_area": 80, "max_area": 8000, "score_threshold": 0.5, "skip_milvus": False}
#: Least and greatest area of a nucleus in each profile; fixed values.
AREAS = {"py12": (80, 8000), "py128": (80, 40000)}
#: Fields that a compact nucleus keeps, and those of a cell event; fixed values.
COMPACT = "inst_id centroid bbox area circularity aspect_ratio solidity boundary_roughness ecd rectangularity fractal_dim intensity_std abnormality_score abnormality_tags sub_scores feature_vector".split()
CELL = "centroid_x centroid_y bbox_x bbox_y bbox_w bbox_h circularity aspect_ratio roughness reasons".split()


def requests(rows: DataFrame, column: str = "value") -> DataFrame:
    """JSON payloads as typed requests, defaults in place of what is missing; a payload that is no JSON gives nulls and defaults."""
    r = rows.select("*", F.from_json(F.col(column), REQUEST).alias("_r")).select(*[c for c in rows.columns if c != column], "_r.*")
    r = r.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in DEFAULTS.items()})
    return r.withColumn("tile_global_offset", F.coalesce("tile_global_offset", F.array(F.lit(0), F.lit(0))))


def tile_lists(rows: DataFrame, column: str = "value") -> DataFrame:
    """JSON arrays of tiles as rows (row, col, image_data), in order (place)."""
    listed = F.from_json(F.col(column), "array<struct<row:int,col:int,image_data:string>>")
    others = [c for c in rows.columns if c != column]
    return rows.select(*others, F.posexplode(listed).alias("place", "t")).select(*others, "place", "t.*")


def compact(nuclei: DataFrame) -> DataFrame:
    """The fields of COMPACT that nuclei has; missing sub scores and vectors are empty."""
    empty = {"sub_scores": F.create_map().cast("map<string,double>"), "feature_vector": F.array().cast("array<double>")}
    have = {c for c in nuclei.columns}
    return nuclei.select(*[F.coalesce(F.col(c), empty[c]).alias(c) if c in have and c in empty else F.col(c) if c in have else empty[c].alias(c) for c in COMPACT if c in have or c in empty])


def vector_key(task, row, col, inst):
    return F.concat_ws("_", task, row, col, inst)


def to_collection_a(nuclei: DataFrame, offset_x, offset_y, wsi_width: int, wsi_height: int) -> DataFrame:
    """Rows of the 12-number collection from (task_id, tile_row, tile_col, inst_id, centroid_x, centroid_y, measures, tags, feature_vector).

    The centre is cut to whole numbers towards zero; null measures are 0; created_at is the time of the query, in milliseconds.
    """
    measures = ["circularity", "aspect_ratio", "boundary_roughness", "intensity_std", "abnormality_score"]
    return nuclei.select(
        vector_key("task_id", "tile_row", "tile_col", "inst_id").alias("id"), "task_id",
        (offset_x + F.col("centroid_x")).cast("int").alias("wsi_x"), (offset_y + F.col("centroid_y")).cast("int").alias("wsi_y"), F.lit(wsi_width).alias("wsi_width"), F.lit(wsi_height).alias("wsi_height"),
        F.col("tile_row").cast("short").alias("tile_row"), F.col("tile_col").cast("short").alias("tile_col"), F.col("inst_id").cast("int").alias("inst_id"),
        *[F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) for m in measures],
        F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ",").alias("tags"), F.unix_millis(F.current_timestamp()).alias("created_at"), F.col("feature_vector").cast("array<double>").alias("feature_vector"),
    )


def to_collection_b(nuclei: DataFrame, task_id: str, slide_path: str) -> DataFrame:
    """Rows of the 128-number collection: a random id, the task and slide, the time of the query, and the nucleus as it is."""
    return nuclei.select(F.expr("uuid()").alias("id"), F.lit(task_id).alias("task_id"), F.lit(slide_path).alias("slide_path"), F.unix_millis(F.current_timestamp()).alias("created_at"), *nuclei.columns)


def cell_events(nuclei: DataFrame) -> DataFrame:
    """The abnormal nuclei as (task_n, tile_row, tile_col, CELL), as they are sent to viewers."""
    return nuclei.filter("is_abnormal").select("task_n", "tile_row", "tile_col", *CELL)


def rehydrated(cells: DataFrame) -> DataFrame:
    """Received cells with what an event leaves out: the box's area, solidity 1, mean intensity 0, no vector."""
    empty = F.array().cast("array<double>")
    return cells.withColumns({"area": F.col("bbox_w") * F.col("bbox_h"), "solidity": F.lit(1.0), "mean_intensity": F.lit(0.0), "feature_vector": empty})


def in_area(nuclei: DataFrame, profile: str = "py12") -> DataFrame:
    return nuclei.filter(F.col("area").between(*AREAS[profile]))


def renumbered(rows: DataFrame, group: list[str], order: list, first: int = 1, name: str = "inst_id") -> DataFrame:
    """rows numbered without gaps within each group, from `first` (2 in the profile that counts the background as one)."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) + (first - 1))


def viewable(state):
    return state.isin(*VIEWABLE)


def cancelable(state):
    return state.isin(*CANCELABLE)


def level_or_base(levels, level):
    """An array's element by number from 0; its first one where there is no such level or none is asked for."""
    return F.coalesce(F.get(levels, level), F.get(levels, F.lit(0)))


def level_or_error(levels, level):
    """The same for reading: a level that is not there is an error."""
    return F.when((level >= 0) & (level < F.size(levels)), F.get(levels, level)).otherwise(F.raise_error(F.concat(F.lit("no level "), level.cast("string"))))


def analysis_status(enabled, total, analysed, abnormal):
    """(text, kind) of an analysis: labels are fixed values."""
    on = F.coalesce(enabled, F.lit(False))
    text = F.when(~on, "未启用").when(total == 0, "等待中").when(analysed < total, "分析中").otherwise("已完成")
    kind = F.when(~on, "info").when((total != 0) & (analysed < total), "warning").when(abnormal > 0, "danger").otherwise("success")
    return F.struct(text.alias("text"), kind.alias("kind"))


def marker_at(wsi, viewer, image, size=28):
    """Viewport position of a marker's corner."""
    return wsi * (viewer / image) - size / 2


def percent(part, whole):
    """Whole percent, halves up."""
    return F.floor(part / whole * 100 + 0.5).cast("int")


def without(mask: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """The pixels of a mask that another does not have."""
    return mask.join(other.select(*on), on, "left_anti")


def both_lists(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def first_rows(rows: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows of a total order, a report's list."""
    return rows.orderBy(*order).limit(n)


def tile_layout(row, col, size):
    """Where a received tile is drawn: (left, top); overlap does not count here."""
    return F.struct((col * size).alias("left"), (row * size).alias("top"))


def canvas_size(rows, cols, size):
    return F.struct((cols * size).alias("width"), (rows * size).alias("height"))


def merged(old: str, new: str, kind):
    """A patch laid over a struct column of the same type (F45): fields that the patch leaves null stay, those of inner structs one by one."""

    def pick(a, b, fields):
        out = []
        for f in fields:
            x, y = a.getField(f.name), b.getField(f.name)
            inner = getattr(f.dataType, "fields", None)
            value = F.when(x.isNull(), y).when(y.isNull(), x).otherwise(F.struct(*pick(x, y, inner))) if inner else F.coalesce(y, x)
            out.append(value.alias(f.name))
        return out

    a, b = F.col(old), F.col(new)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.struct(*pick(a, b, kind.fields)))


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as one line of JSON, null fields left out (K1): what a command prints, or a text file's lines."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def zipped(*lists: str):
    """Columns of arrays as rows by their ordinal (J4): an array of structs (ordinal from 0, one field for each column); a shorter array ends in nulls."""
    names = ", ".join(f"'{c}', z.{c}" for c in lists)
    return F.expr(f"transform(arrays_zip({', '.join(lists)}), (z, i) -> named_struct('ordinal', i, {names}))")


#: Places of the 12-number profile; fixed values.
PLACES = {6: ("circularity", "solidity", "rectangularity"), 4: ("aspect_ratio", "boundary_roughness", "fractal_dim", "abnormality_score"), 3: ("major_axis", "minor_axis", "ecd", "intensity_std")}


def rounded_profile(rows: DataFrame) -> DataFrame:
    """Columns of the 12-number profile that rows has, rounded to its places; area and perimeter stay."""
    return rows.withColumns({c: F.round(c, places) for places, columns in PLACES.items() for c in columns if c in rows.columns})


def priority(reasons):
    """(text, kind) of the first reason that a list of cells shows; fixed values, null without one."""
    shown = {"low_circularity": ("非规则", "danger"), "high_aspect_ratio": ("拉长", "warning"), "high_roughness": ("毛糙", "warning")}
    out = F.lit(None)
    for reason, (text, kind) in reversed(shown.items()):
        out = F.when(F.array_contains(reasons, reason), F.struct(F.lit(text).alias("text"), F.lit(kind).alias("kind"))).otherwise(out)
    return out
