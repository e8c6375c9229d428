"""Hooks for models of the user's own: super-resolution and segmentation of tiles."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..sources.codec import decode_png, encode_png, postprocessed, preprocessed, to_bytes, upscale

#: A function that loads a model, once for each batch stream of a task, and returns its call: float32 array in, array out.
Loader = Callable[[], Callable[[np.ndarray], np.ndarray]]
REGIONS = "array<struct<inst_id:int,x:int,y:int,w:int,h:int,cx:int,cy:int,area:int>>"


def _each(load: Loader, apply, images: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """apply(model, RGB image in [0, 1]) for each PNG; null for a null image and wherever loading or the call fails."""
    try:
        model = load()
    except Exception:
        model = None

    def one(png):
        if model is None or png is None:
            return None
        try:
            return apply(model, decode_png(png)[:, :, :3].astype(np.float32) / 255)
        except Exception:
            return None

    for batch in images:
        yield pd.Series([one(png) for png in batch], dtype=object)


def enhanced(png, load: Loader):
    """Column of PNGs from a column of PNGs by a model on (1, 3, h, w); null on failure, so that coalesce can name another way."""

    def apply(model, image):
        out = np.asarray(model(image.transpose(2, 0, 1)[None]))[0].transpose(1, 2, 0)
        return encode_png(np.rint(np.clip(out, 0, 1) * 255).astype(np.uint8))

    @F.pandas_udf("binary")
    def of(images: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _each(load, apply, images)

    return of(png)


def regions(mask: np.ndarray) -> list[dict]:
    """Box, centroid (rounded down) and area of each positive label of a mask, by label."""
    y, x = np.nonzero(mask > 0)
    ids, at, area = np.unique(mask[y, x], return_inverse=True, return_counts=True)

    def extreme(of, values):
        out = np.full(len(ids), values[0] if len(values) else 0)
        out[at] = values
        of.at(out, at, values)
        return out

    x0, x1, y0, y1 = extreme(np.minimum, x), extreme(np.maximum, x), extreme(np.minimum, y), extreme(np.maximum, y)
    cx, cy = np.bincount(at, x, len(ids)) // area, np.bincount(at, y, len(ids)) // area
    columns = (ids, x0, y0, x1 - x0 + 1, y1 - y0 + 1, cx, cy, area)
    names = ("inst_id", "x", "y", "w", "h", "cx", "cy", "area")
    return [dict(zip(names, map(int, row))) for row in zip(*columns)]


def segmented(png, load: Loader):
    """Column of regions from a column of PNGs by a model from (1, h, w, 3) to a mask of labels (1, h, w); null on failure."""

    @F.pandas_udf(REGIONS)
    def of(images: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _each(load, lambda model, image: regions(np.asarray(model(image[None]))[0]), images)

    return of(png)


def super_resolved(png, load: Loader, scale: int = 4, size: tuple[int, int] = (512, 512)):
    """Column of structs (png, by_model): the model's image on a resampled input, brought to scale times the tile; bicubic where the model fails.

    Null images stay null. by_model says which way was taken.
    """

    def apply(model, image):
        return encode_png(to_bytes(postprocessed(np.asarray(model(preprocessed(image, size))), image.shape[:2], scale)))

    @F.pandas_udf("binary")
    def by_model(images: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _each(load, apply, images)

    @F.pandas_udf("binary")
    def bicubic(images: pd.Series) -> pd.Series:
        return images.map(lambda data: None if data is None else encode_png(upscale(decode_png(data)[:, :, :3], scale)))

    first = by_model(png)
    return F.struct(F.coalesce(first, bicubic(F.when(first.isNull(), png))).alias("png"), first.isNotNull().alias("by_model"))
