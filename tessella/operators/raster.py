"""Long-form rasters (img, x, y, gray): thresholds, components, region measures."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("img", "gray").agg(F.count("*").alias("n"))


def otsu(pixels: DataFrame) -> DataFrame:
    """(img, threshold): the grey level of the greatest variance between classes, the first of several."""
    by = Window.partitionBy("img")
    up = by.orderBy("gray").rowsBetween(Window.unboundedPreceding, 0)
    h = histogram(pixels).withColumns({"w": F.sum("n").over(up), "s": F.sum(F.col("n") * F.col("gray")).over(up), "wt": F.sum("n").over(by), "st": F.sum(F.col("n") * F.col("gray")).over(by)})
    h = h.filter(F.col("w") < F.col("wt"))
    gap = F.col("s") / F.col("w") - (F.col("st") - F.col("s")) / (F.col("wt") - F.col("w"))
    h = h.withColumn("v", F.col("w").cast("double") * (F.col("wt") - F.col("w")) * gap * gap)
    return h.groupBy("img").agg(F.min_by("gray", F.struct(-F.col("v"), "gray")).alias("threshold"))


def otsu_mask(pixels: DataFrame) -> DataFrame:
    """The pixels strictly darker than the threshold."""
    return pixels.join(otsu(pixels).hint("merge"), "img").filter(F.col("gray") < F.col("threshold")).drop("threshold")


def mean_std_mask(pixels: DataFrame, k: float = 0.3) -> DataFrame:
    cut = pixels.groupBy("img").agg((F.avg("gray") - k * F.stddev_pop("gray")).alias("cut"))
    return pixels.join(cut.hint("merge"), "img").filter(F.col("gray") < F.col("cut")).drop("cut")


def label_runs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels 0, 1, ... of the 4-connected components of the pixels (x, y), by raster order of their first pixels.

    Pixels in raster order fall into runs along rows; runs that overlap in neighbouring rows are joined. Work and memory go
    by the pixels given, wherever they lie.
    """
    at = y.astype(np.int64) * (int(x.max()) + 2) + x
    order = np.argsort(at, kind="stable")
    at = at[order]
    begins = np.concatenate([[True], np.diff(at) > 1])
    run = np.cumsum(begins) - 1
    first, last = at[begins], at[np.concatenate([begins[1:], [True]])]
    above = int(x.max()) + 2
    low, high = np.searchsorted(last, first - above), np.searchsorted(first, last - above, side="right")
    out = np.empty(len(x), np.int32)
    out[order] = np.unique(joined_runs(low, high), return_inverse=True)[1][run]
    return out


def joined_runs(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each run the least number of the runs that it hangs together with; run k touches those from low[k] up to, not with, high[k].

    Each run takes the least number of the runs that it touches and of the run which that names, until nothing changes: rounds
    grow with the logarithm of a path.
    """
    n = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(low)), n)
    b = np.repeat(low, n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
    names = np.arange(len(low))
    while True:
        least, new = np.minimum(names[a], names[b]), names.copy()
        for end in (names[a], names[b], a, b):
            np.minimum.at(new, end, least)
        while not np.array_equal(new, shorter := new[new]):
            new = shorter
        if np.array_equal(new, names):
            return names
        names = new


def _labelled(p: pd.DataFrame) -> pd.DataFrame:
    """Whole images, one after the other, with labels; a blank row between images keeps them apart."""
    img, y = p["img"].to_numpy(), p["y"].to_numpy().astype(np.int64)
    new = np.concatenate([[True], img[1:] != img[:-1]])
    number, y = np.cumsum(new) - 1, y - y.min()
    found = label_runs(p["x"].to_numpy(), y + number * (y.max() + 2))
    return p.assign(label=(found - np.minimum.reduceat(found, np.nonzero(new)[0])[number]).astype(np.int32))


def _label(batches):
    """Whole images of the batches, labelled; the last image of a batch waits for its other pixels."""
    rest = None
    for p in batches:
        if len(p):
            p = p if rest is None else pd.concat([rest, p])
            last = p["img"] == p["img"].iloc[-1]
            if not last.all():
                yield _labelled(p[~last])
            rest = p[last]
    if rest is not None:
        yield _labelled(rest)


def components(mask: DataFrame) -> DataFrame:
    """4-connected components of each image, labelled 0, 1, ... in raster order of first pixels.

    An image is the unit here, as segmentation is per tile; a tile's pixels are bounded by its size. Images stream through
    the tasks, many in one batch. A column `light`, the grey before rounding, is kept.
    """
    parts = int(mask.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    light = ["light"] if "light" in mask.columns else []
    dealt = mask.select("img", "x", "y", "gray", *light).repartition(parts, "img").sortWithinPartitions("img")
    return dealt.mapInPandas(_label, f"img long, x int, y int, gray int, {'light double, ' if light else ''}label int")


def region_props(labelled: DataFrame, least_pixels: int = 40, keep: tuple = ()) -> DataFrame:
    """One row for each region of enough pixels: box, centre, covariance axes, orientation, mean and spread of grey (population statistics).

    cell_id numbers an image's regions that are kept, from 0 in raster order; the minor axis is 1 at least, `thin` is it as
    measured. mean_light is the mean of `light`, where labelled has it, else of grey. Where labelled has `edges`, each pixel's
    exposed edges, there is a perimeter too. Columns of keep, alike for all of a region, are kept.
    """
    more = [F.first(c).alias(c) for c in keep] + ([(F.greatest(F.lit(4), F.sum("edges")) * 0.886).alias("perimeter")] if "edges" in labelled.columns else [])
    light = "light" if "light" in labelled.columns else "gray"
    r = labelled.groupBy("img", "label").agg(
        F.count("*").alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"),
        F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.var_pop("x").alias("sxx"), F.var_pop("y").alias("syy"), F.covar_pop("x", "y").alias("sxy"), F.avg("gray").alias("mean_gray"), F.stddev_pop("gray").alias("std_gray"), F.avg(light).alias("mean_light"), *more,
    ).filter(F.col("area") >= least_pixels)
    return described(r.withColumn("cell_id", F.row_number().over(Window.partitionBy("img").orderBy("label")) - 1))


def described(r: DataFrame) -> DataFrame:
    """Regions (area, x0, y0, x1, y1 and the variances sxx, syy, sxy) with what follows from these: box, axes, orientation, solidity."""
    half, det = (F.col("sxx") + F.col("syy")) / 2, F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")
    root = F.sqrt(F.greatest(F.lit(0.0), half * half - det))
    major, minor = 2 * F.sqrt(2 * F.greatest(F.lit(0.0), half + root)), 2 * F.sqrt(2 * F.greatest(F.lit(0.0), half - root))
    return r.select(
        "*", (F.col("x1") - F.col("x0") + 1).alias("box_w"), (F.col("y1") - F.col("y0") + 1).alias("box_h"),
        major.alias("major"), F.greatest(F.lit(1.0), minor).alias("minor"), minor.alias("thin"),
        (0.5 * F.atan2(2 * F.col("sxy"), F.col("sxx") - F.col("syy"))).alias("orientation"),
        F.least(F.lit(1.0), F.col("area") / ((F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)) * 1.6).alias("solidity"),
    )


#: Weights of red, green and blue in the luma of each profile; fixed values.
LUMA = {"js": (0.299, 0.587, 0.114), "py": (0.2989, 0.5870, 0.1140)}


def luma(red, green, blue, profile: str = "js"):
    """Brightness of a colour."""
    r, g, b = LUMA[profile]
    return red * r + green * g + blue * b


def bins(brightness):
    """Brightness as a histogram counts it: halves up."""
    return F.floor(brightness + 0.5).cast("int")


def clamped(unit, profile: str = "py"):
    """A value of 0 to 1 as 0 to 255 (F27): clipped and cut off, or clipped and rounded with halves to even."""
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), unit)) * 255
    return (F.floor(scaled) if profile == "py" else F.bround(scaled)).cast("int")


def boxes(labelled: DataFrame, profile: str = "js", least_pixels: int | None = None) -> DataFrame:
    """(img, label, n, x, y, w, h) of regions with enough pixels (A22, P13): 40 in the js profile, 10 in py128, where a box is one narrower each way."""
    least, more = {"js": (40, 1), "py12": (1, 1), "py128": (10, 0)}[profile]
    r = labelled.groupBy("img", "label").agg(F.count("*").alias("n"), F.min("x").alias("x"), F.min("y").alias("y"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return r.filter(F.col("n") >= (least if least_pixels is None else least_pixels)).select("img", "label", "n", "x", "y", (F.col("x1") - F.col("x") + more).alias("w"), (F.col("y1") - F.col("y") + more).alias("h"))


def labels(labelled: DataFrame) -> DataFrame:
    """(img, labels): the distinct labels of each image, in order; null labels do not count."""
    return labelled.groupBy("img").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def perimeter(labelled: DataFrame) -> DataFrame:
    """(img, label, perimeter): exposed pixel edges, four at least, times 0.886; neighbours by windows along rows and columns."""
    row, col = Window.partitionBy("img", "label", "y").orderBy("x"), Window.partitionBy("img", "label", "x").orderBy("y")
    apart = lambda c, w, f, d: F.when(f(c).over(w) == F.col(c) + d, 0).otherwise(1)
    edges = apart("x", row, F.lag, -1) + apart("x", row, F.lead, 1) + apart("y", col, F.lag, -1) + apart("y", col, F.lead, 1)
    return labelled.select("img", "label", edges.alias("edges")).groupBy("img", "label").agg((F.greatest(F.lit(4), F.sum("edges")) * 0.886).alias("perimeter"))


def box_dimension(labelled: DataFrame, sizes=(2, 4, 8, 16, 32)) -> DataFrame:
    """Box-counting dimension by the slope of ln N(s) on ln(1/s), in [1, 2], boxes from the region's corner; 1 with fewer than two sizes."""
    by = Window.partitionBy("img", "label")
    p = labelled.withColumns({"bx": F.col("x") - F.min("x").over(by), "by": F.col("y") - F.min("y").over(by)})
    p = p.withColumn("side", F.least(F.max("bx").over(by), F.max("by").over(by)) + 1)
    boxes = p.select("img", "label", "side", "bx", "by", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("s")).filter("s < side")
    n = boxes.groupBy("img", "label", "s").agg(F.count_distinct(F.floor(F.col("bx") / F.col("s")), F.floor(F.col("by") / F.col("s"))).alias("n"))
    slope = n.groupBy("img", "label").agg(F.when(F.count("*") > 1, F.regr_slope(F.log(F.col("n").cast("double")), F.log(1 / F.col("s")))).alias("slope"))
    every = labelled.select("img", "label").distinct()
    return every.join(slope, ["img", "label"], "left").select("img", "label", F.greatest(F.lit(1.0), F.least(F.lit(2.0), F.coalesce("slope", F.lit(1.0)))).alias("dimension"))


def weight(i, j, h, w, overlap, compat: bool = True):
    """Gaussian weight of row i, column j of an h x w tile, 1 at most, with edge ramps (F25, F26, A25); compat keeps the zero lines that the ramps make.

    h, w and overlap are numbers or columns; ramps are left out where they would meet.
    """
    sigma = 0.3
    h, w, overlap = (F.lit(v) if isinstance(v, int) else v for v in (h, w, overlap))
    at = lambda y, x: F.exp(-(F.pow(y - h / 2, F.lit(2.0)) / (2 * F.pow(sigma * h, F.lit(2.0))) + F.pow(x - w / 2, F.lit(2.0)) / (2 * F.pow(sigma * w, F.lit(2.0)))))
    middle = at(F.floor(h / 2).cast("double"), F.floor(w / 2).cast("double"))  # the greatest of all; ramps leave it as it is
    value = at(i.cast("double"), j.cast("double")) / middle
    if not compat:
        return value
    ramps = F.lit(1.0)
    for k, n in ((i, h), (j, w)):
        ramps = ramps * F.when(k < overlap, k / overlap).otherwise(1.0) * F.when(k >= n - overlap, (k - (n - overlap)) / overlap).otherwise(1.0)
    return value * F.when((overlap < h / 2) & (overlap < w / 2), ramps).otherwise(1.0)


def blend(tiles: DataFrame, size: int, overlap: int, compat: bool = True, by: tuple = ()) -> DataFrame:
    """Tiles in long form (tile_row, tile_col, y, x, v) to canvas pixels (gy, gx, v): weighted mean, divisor 1 where weights vanish; a canvas for each value of `by`.

    Grouped by canvas pixel with partial sums, so no canvas is held anywhere; tiles of any number blend at once (R8, A10, J1, J2).
    """
    step = size - overlap
    w = weight(F.col("y"), F.col("x"), size, size, overlap, compat)
    placed = tiles.select(*by, (F.col("tile_row") * step + F.col("y")).alias("gy"), (F.col("tile_col") * step + F.col("x")).alias("gx"), w.alias("w"), (w * F.col("v")).alias("wv"))
    total = placed.groupBy(*by, "gy", "gx").agg(F.sum("w").alias("w"), F.sum("wv").alias("wv"))
    return total.select(*by, "gy", "gx", (F.col("wv") / F.when(F.col("w") > 1e-6, F.col("w")).otherwise(1.0)).alias("v"))
