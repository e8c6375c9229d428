"""Segmentation by threshold, distance and seeds, and outline measures, of whole tiles in one narrow pass."""

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StructType

from ..config import PY128, Rules, Soft
from ..functions import shape
from ..functions import vectors as V
from ..sources.codec import ROWS, decode_png
from ..sources.shared import small_batches
from . import nuclei, raster
from .analysis import LUMA


@dataclass(frozen=True)
class Profile:
    """How nuclei are cut out: by the a axis of Lab, inverted and blurred, or by dark grey; closings; seeds' share of the greatest distance; areas."""

    lab: bool
    closings: int
    seed: float
    least: int
    most: int
    watershed: bool = True


#: Fixed values of the two profiles.
PY12, PY128_SEGMENTS = Profile(True, 2, 0.25, 80, 8000), Profile(False, 1, 0.4, 80, 40000)
#: sRGB to XYZ (D65), fixed values of the standard; each row sums to 1 for white.
XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169]])
NUCLEI = "array<struct<w:int,h:int,x:array<int>,y:array<int>,gray:array<int>,light:double>>"
OUTLINE = "area double, perimeter double, hull_area double, hull_perimeter double, points int, cx double, cy double, major double, minor double, angle double"
#: The linear light of each byte of sRGB.
LINEAR = np.where(np.arange(256) / 255 > 0.04045, ((np.arange(256) / 255 + 0.055) / 1.055) ** 2.4, np.arange(256) / 255 / 12.92)
ROUND = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def lab_a(rgb: np.ndarray) -> np.ndarray:
    """The a axis of Lab, moved by 128 to whole numbers of a byte."""
    xy = LINEAR[rgb.astype(np.uint8)] @ (XYZ / XYZ.sum(1, keepdims=True)).T
    f = np.where(xy > 216 / 24389, np.cbrt(xy), (24389 / 27 * xy + 16) / 116)
    return np.clip(np.rint(500 * (f[..., 0] - f[..., 1]) + 128), 0, 255).astype(np.int64)


@lru_cache(maxsize=1)
def _met() -> np.ndarray:
    """lab_a() + 1 of each colour that this process met, else 0; 32 MB at most, of which only the parts in use are taken."""
    return np.zeros(1 << 24, np.uint16)


def lab_a_of(rgb: np.ndarray) -> np.ndarray:
    """lab_a(), each colour made once in a process."""
    c = rgb.astype(np.uint8).astype(np.int32)
    known, colour = _met(), (c[..., 0] << 16) + (c[..., 1] << 8) + c[..., 2]
    out = known[colour]
    if not out.all():
        new = np.unique(colour[out == 0])
        known[new] = lab_a(np.stack([new >> 16, new >> 8 & 255, new & 255], 1)) + 1
        out = known[colour]
    return out - 1


def blurred(gray: np.ndarray) -> np.ndarray:
    """Binomial smoothing over 5 x 5 pixels, mirrored at the edges."""
    for axis in (-2, -1):
        wide = np.pad(gray, [(2, 2) if a == axis else (0, 0) for a in range(-gray.ndim, 0)], mode="reflect" if gray.shape[axis] > 2 else "edge")
        gray = sum(k * np.take(wide, range(i, i + gray.shape[axis]), axis) for i, k in enumerate((1, 4, 6, 4, 1)))
    return (gray + 128) // 256


def otsu_levels(gray: np.ndarray) -> np.ndarray:
    """The grey level of each image of a stack, lower class included, of the greatest variance between classes."""
    flat = gray.reshape(len(gray), -1).astype(np.int64)
    n = np.bincount((flat + 256 * np.arange(len(flat))[:, None]).ravel(), minlength=256 * len(flat)).reshape(-1, 256).astype(np.float64)
    w, s = np.cumsum(n, 1), np.cumsum(n * np.arange(256), 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (s * w[:, -1:] - s[:, -1:] * w) ** 2 / (w * (w[:, -1:] - w))
    return np.argmax(np.where(np.isfinite(between), between, -1), 1)


def otsu_level(gray: np.ndarray) -> int:
    """otsu_levels() of one image."""
    return int(otsu_levels(gray[None])[0])


def _padded(image: np.ndarray, value) -> np.ndarray:
    """An image or stack with one more pixel of a value on each side."""
    out = np.full((*image.shape[:-2], image.shape[-2] + 2, image.shape[-1] + 2), value, image.dtype)
    out[..., 1:-1, 1:-1] = image
    return out


def _cross(mask: np.ndarray, grow: bool) -> np.ndarray:
    """One dilation or erosion by the cross of 3 x 3; what lies outside the image changes nothing."""
    p, join = _padded(mask, not grow), np.logical_or if grow else np.logical_and
    out = join(p[..., :-2, 1:-1], p[..., 2:, 1:-1])
    for part in (p[..., 1:-1, :-2], p[..., 1:-1, 2:], mask):
        join(out, part, out=out)
    return out


def distances(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of each pixel of the mask to the nearest one outside it, exact: along columns, then the least over each row."""
    h, w = mask.shape[-2:]
    up = np.where(mask, h + w, 0).astype(np.int32 if h + w < 1 << 15 else np.int64)  # no sum of squares below is greater
    for i in range(1, h):
        up[..., i, :] = np.minimum(up[..., i, :], up[..., i - 1, :] + 1)
    for i in range(h - 2, -1, -1):
        up[..., i, :] = np.minimum(up[..., i, :], up[..., i + 1, :] + 1)
    square, out = up * up, up * up
    for k in range(1, w):
        if k * k >= out.max():
            break
        np.minimum(out[..., k:], square[..., :-k] + k * k, out=out[..., k:])
        np.minimum(out[..., :-k], square[..., k:] + k * k, out=out[..., :-k])
    return np.sqrt(out.astype(np.float64))


def labels8(mask: np.ndarray) -> np.ndarray:
    """8-connected components, numbered from 1 in raster order of first pixels, image by image in a stack; 0 outside the mask.

    Pixels fall into runs along rows, and runs that touch are joined.
    """
    wide = mask.shape[-1] + 2  # a blank pixel parts rows, a blank row parts images
    p = _padded(mask, False).ravel()
    at = np.nonzero(p)[0]
    out = np.zeros(p.size, np.int64)
    if len(at):
        begins = np.concatenate([[True], np.diff(at) > 1])
        first, last = at[begins], at[np.concatenate([begins[1:], [True]])]
        low, high = np.searchsorted(last, first - wide - 1), np.searchsorted(first, last - wide + 1, side="right")
        out[at] = (np.unique(raster.joined_runs(low, high), return_inverse=True)[1] + 1)[np.cumsum(begins) - 1]
    return out.reshape(*mask.shape[:-2], mask.shape[-2] + 2, wide)[..., 1:-1, 1:-1].copy()


def flooded(seeds: np.ndarray, away: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Seeds grown over the mask by falling distance, level by level; where two meet, the lower number stays. Only open pixels are looked at."""
    none = seeds.max() + 1
    p = _padded(np.where(seeds > 0, seeds, none), none)
    flat, wide, level_of = p.reshape(-1), p.shape[-1], _padded(np.where(mask & (seeds == 0), np.floor(away), -1.0), -1.0).ravel()
    left, around = np.nonzero(level_of >= 0)[0], np.array([i * wide + j for i, j in ROUND])
    for level in range(int(away.max()), -1, -1):
        reached = level_of[left] >= level
        open_, left = left[reached], left[~reached]
        while len(open_):
            near = flat[open_[:, None] + around].min(1)
            new = near < none
            if not new.any():
                break
            flat[open_[new]] = near[new]
            open_ = open_[~new]
        left = np.concatenate([left, open_])
    return np.where(p == none, 0, p)[..., 1:-1, 1:-1]


def stacked(rgb: np.ndarray, profile: Profile) -> np.ndarray:
    """instances() of a stack of RGB images of one size; steps for all of them at once, as those of small images cost more to call than to do."""
    if profile.lab:
        gray = blurred(255 - lab_a_of(rgb))  # 16 bits hold all sums
        mask = gray > otsu_levels(gray).astype(gray.dtype)[:, None, None]
    else:
        gray = np.rint(rgb @ np.array(LUMA)).astype(np.int64)
        mask = gray <= otsu_levels(gray)[:, None, None]
    mask &= (gray.min((1, 2)) < gray.max((1, 2)))[:, None, None]
    for grow in [False, True] + [True] * profile.closings + [False] * profile.closings:
        mask = _cross(mask, grow)
    if profile.watershed:
        away = distances(mask)
        label = flooded(labels8(away > profile.seed * away.max((1, 2), keepdims=True)), away, mask)
    else:
        label = labels8(mask)
    area = np.bincount(label.ravel())
    keep = (area >= profile.least) & (area <= profile.most)
    keep[0] = False
    place = np.where(keep, np.cumsum(keep) - 1, -1)[label]  # gapless in the stack; an image's begin where those of the images before it end
    begin = np.concatenate([[0], np.maximum.accumulate(place.max((1, 2)) + 1)[:-1]])
    return np.where(place >= 0, place - begin[:, None, None], -1)


def instances(rgb: np.ndarray, profile: Profile) -> np.ndarray:
    """Numbers of the nuclei of an RGB image, from 0 without gaps by raster order of their seeds; -1 elsewhere. An image of one grey has none."""
    return stacked(rgb[None], profile)[0]


#: Pixels of the images that are cut together, one at least.
STACK = 1 << 18


def _nuclei(rgb: np.ndarray, label: np.ndarray) -> list[dict]:
    """The nuclei of an image, each as its pixels in raster order with their grey and the mean of their colours."""
    y, x = np.nonzero(label >= 0)
    order = np.argsort(label[y, x], kind="stable")
    y, x = y[order].astype(np.int32), x[order].astype(np.int32)
    gray = np.rint(rgb @ np.array(LUMA)).astype(np.int32)
    ends = np.cumsum(np.bincount(label[y, x]))[:-1]
    parts = zip(np.split(x, ends), np.split(y, ends)) if len(x) else ()
    return [{"w": rgb.shape[1], "h": rgb.shape[0], "x": i, "y": j, "gray": gray[j, i], "light": rgb[j, i].mean()} for i, j in parts]


def _stacks(pngs: list):
    """(places, RGB images) of neighbouring PNGs of one size, as many as are cut together; nulls and images without pixels are left out."""
    places, group = [], []
    for place, png in enumerate(pngs):
        rgb = decode_png(png)[:, :, :3] if png else None
        if rgb is None or not rgb.size:
            continue
        if group and (rgb.shape != group[0].shape or len(group) * rgb.size >= STACK * 3):
            yield places, np.stack(group).astype(np.float64)
            places, group = [], []
        places.append(place)
        group.append(rgb)
    if group:
        yield places, np.stack(group).astype(np.float64)


def _cut(profile: Profile):
    """PNGs to the nuclei in them; neighbouring images of one size are cut together."""

    def cut(pngs) -> list:
        out: list = [[] for _ in pngs]
        for places, rgb in _stacks(pngs):
            for place, image, label in zip(places, rgb, stacked(rgb, profile)):
                out[place] = _nuclei(image, label)
        return out

    def of(images: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in images:
            for at in range(0, len(batch), ROWS):
                yield pd.Series(cut(batch.iloc[at : at + ROWS].tolist()), dtype=object)

    return F.pandas_udf(of, NUCLEI)


def _next_steps() -> bytes:
    """For the neighbours of a pixel that are inside (bits by ROUND) and the way it was reached, the way on along the boundary; 8 if there is none."""
    ways = lambda turn: ((turn + (6 if turn % 2 else 7) + k) % 8 for k in range(8))
    return bytes(next((d for d in ways(turn) if code >> d & 1), 8) for code in range(256) for turn in range(8))


NEXT = _next_steps()


def _walk(code: bytes, start: int, steps: list[int]) -> list[int]:
    """The boundary from a first pixel, as places in an image whose pixels' inside neighbours are told by code."""
    at, turn, path = start, 7, [start]
    while True:
        d = NEXT[code[at] * 8 + turn]
        if d == 8:
            return path
        to = at + steps[d]
        if at == start and len(path) > 2 and to == path[1]:
            path.pop()
            return path
        path.append(to)
        at, turn = to, d


def _boundaries(label: np.ndarray, starts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, lengths) of the outer boundaries of labels (-1 outside) of a stack, from their first pixels, which are places in the padded stack."""
    p = _padded(label, -1)
    h, w = p.shape[-2:]
    flat, steps = p.ravel(), [i * w + j for i, j in ROUND]
    at = np.nonzero(flat >= 0)[0]
    code = np.zeros(flat.size, np.uint8)
    code[at] = sum((flat[at + step] == flat[at]).astype(np.uint8) << d for d, step in enumerate(steps))
    text = code.tobytes()
    paths = [_walk(text, start, steps) for start in starts]
    place = np.fromiter(chain.from_iterable(paths), np.int64)
    return place % w - 1, place // w % h - 1, np.array([len(path) for path in paths], np.int64)


def boundary(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The outer boundary (n, 2) of 8-connected pixels in raster order, walked clockwise from the first by neighbouring pixels."""
    left, top = int(min(x)), int(min(y))
    label = np.full((1, int(max(y)) - top + 1, int(max(x)) - left + 1), -1)
    label[0, y - top, x - left] = 0
    i, j, _ = _boundaries(label, [(int(y[0]) - top + 1) * (label.shape[2] + 2) + int(x[0]) - left + 1])
    return np.stack([i + left, j + top], 1)


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, by monotone chains: one of the lowest and one of the highest point of each column, as no other is a corner."""
    low: dict = {}
    high: dict = {}
    for x, y in points.tolist():
        if y < low.get(x, y + 1):
            low[x] = y
        if y > high.get(x, y - 1):
            high[x] = y
    columns = sorted(low)
    first, last = columns[0], columns[-1]
    ways = [(x, low[x]) for x in columns], [(x, high[x]) for x in reversed(columns)]
    for way, end in zip(ways, ((last, high[last]), (first, low[first]))):
        if way[-1] != end:
            way.append(end)
    corners = []
    for way in ways:
        kept: list = []
        for x, y in way:
            while len(kept) > 1:
                (a, b), (c, d) = kept[-2], kept[-1]
                if (c - a) * (y - b) > (d - b) * (x - a):
                    break
                kept.pop()
            kept.append((x, y))
        corners += kept[:-1]
    return np.array(corners or [(first, low[first])])


def _polygons(x: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(areas, lengths) of closed lines, one after the other."""
    ends = np.cumsum(lengths)
    begins, following = ends - lengths, np.arange(1, len(x) + 1)
    following[ends - 1] = begins
    x, y = x.astype(np.float64), y.astype(np.float64)
    cross, step = x * y[following] - x[following] * y, np.hypot(x[following] - x, y[following] - y)
    return np.abs(np.add.reduceat(cross, begins)) / 2, np.array([step[a:b].sum() for a, b in zip(begins.tolist(), ends.tolist())])


def polygon(points: np.ndarray) -> tuple[float, float]:
    """(area, length) of a closed line."""
    area, length = _polygons(points[:, 0], points[:, 1], np.array([len(points)]))
    return float(area[0]), float(length[0])


#: Points, filled up to those of the longest line, of the lines whose ellipses are fitted together.
FITTED = 1 << 16


def ellipses(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, angles: bool = True) -> np.ndarray:
    """(cx, cy, major, minor, angle) for each line, one after the other: the conic of least squares as an ellipse, full axes, the major axis in degrees; nan if it is no ellipse.

    Without angles, those of circles and of level ellipses, which rounding alone tells from 180, are of no account.
    """
    out, begins = np.full((len(lengths), 5), np.nan), np.cumsum(lengths) - lengths
    order, at = np.argsort(lengths, kind="stable"), int((lengths < 5).sum())
    while at < len(order):
        some = order[at : at + 1]
        while at + len(some) < len(order) and lengths[order[at + len(some)]] * (len(some) + 1) <= FITTED:
            some = order[at : at + len(some) + 1]
        out[some] = _fitted(x, y, begins[some], lengths[some], angles)
        at += len(some)
    return out


def _fitted(px: np.ndarray, py: np.ndarray, begins: np.ndarray, lengths: np.ndarray, angles: bool) -> np.ndarray:
    """ellipses() of lines of about one length; rows of zeros fill up the shorter ones, which changes no fit."""
    real = np.arange(max(6, lengths.max())) < lengths[:, None]
    place = np.where(real, begins[:, None] + np.arange(real.shape[1]), begins[:, None])
    x, y = (np.where(real, p[place], 0).astype(np.float64) for p in (px, py))
    mx, my = x.sum(1) / lengths, y.sum(1) / lengths
    x, y = np.where(real, x - mx[:, None], 0), np.where(real, y - my[:, None], 0)
    scale = np.maximum(1e-9, np.maximum(np.abs(x).max(1), np.abs(y).max(1)))
    x, y = x / scale[:, None], y / scale[:, None]
    r = np.linalg.qr(np.stack([x * x, x * y, y * y, x, y, real.astype(np.float64)], 2), mode="r")
    size = np.abs(np.diagonal(r[:, :5, :5], axis1=1, axis2=2))
    plain = size.min(1) > 1e-7 * size.max(1)
    r[~plain] = np.eye(6)
    a, b, c, d, e = np.linalg.solve(r[:, :5, :5], r[:, :5, 5:])[..., 0].T
    form = np.stack([a, b / 2, b / 2, c], 1).reshape(-1, 2, 2)
    real = plain & (a * c - b * b / 4 > 1e-9)
    form[~real] = np.eye(2)
    centre = -np.linalg.solve(form, np.stack([d, e], 1)[..., None])[..., 0] / 2
    whole = 1 + np.einsum("ni,nij,nj->n", centre, form, centre)
    real &= whole > 1e-9
    values, axes = np.linalg.eigh(form / np.where(real, whole, 1)[:, None, None])
    plain &= real & (values[:, 0] > 1e-9)
    major, minor = 2 * scale / np.sqrt(np.maximum(values, 1e-9)).T
    angle = np.degrees(np.arctan2(axes[:, 1, 0], axes[:, 0, 0])) % 180
    if angles:
        plain &= (values[:, 1] - values[:, 0] > 1e-7 * values[:, 1]) & (np.abs(angle - 90) < 90 - 1e-6)
    out = np.stack([centre[:, 0] * scale + mx, centre[:, 1] * scale + my, major, minor, angle], 1)
    for i in np.nonzero(~plain)[0]:  # what is near to no ellipse or to a lower rank, or has an angle by rounding alone
        line = slice(begins[i], begins[i] + lengths[i])
        out[i] = ellipse(np.stack([px[line], py[line]], 1)) or np.nan
    return out


def ellipse(points: np.ndarray) -> tuple[float, float, float, float, float] | None:
    """(cx, cy, major, minor, angle): the conic of least squares as an ellipse, full axes, the major axis in degrees; None if it is no ellipse."""
    middle, scale = points.mean(0), max(1e-9, float(np.abs(points - points.mean(0)).max()))
    x, y = ((points - middle) / scale).T
    (a, b, c, d, e), _, rank, _ = np.linalg.lstsq(np.stack([x * x, x * y, y * y, x, y], 1), np.ones(len(x)), rcond=None)
    form = np.array([[a, b / 2], [b / 2, c]])
    if rank < 5 or np.linalg.det(form) <= 0:
        return None
    centre = -np.linalg.solve(form, [d, e]) / 2
    values, axes = np.linalg.eigh(form / (1 + centre @ form @ centre))
    if values[0] <= 0:
        return None
    major, minor = 2 * scale / np.sqrt(values)
    angle = math.degrees(math.atan2(axes[1, 0], axes[0, 0])) % 180
    return (*(centre * scale + middle).tolist(), float(major), float(minor), angle)


SIZES = (2, 4, 8, 16, 32)
#: Of each nucleus: pixels, box, means of places, grey and its spread, mean of colours, boxes of each of SIZES that its pixels meet; OUTLINE.
MEASURES = "n int, w int, h int, x0 int, x1 int, y0 int, y1 int, mx double, my double, mg double, istd double, light double, boxes array<int>, " + OUTLINE


def measures(rgb: np.ndarray, label: np.ndarray, angles: bool = True) -> tuple[np.ndarray, list]:
    """(number of nuclei by image, MEASURES as columns) of a stack and its instances; without an ellipse, the box's sides are the axes."""
    counts = label.max((1, 2)) + 1
    first = np.cumsum(counts) - counts
    number, y, x = np.nonzero(label >= 0)
    which = label[number, y, x] + first[number]
    order = np.argsort(which, kind="stable")
    number, y, x, which = number[order], y[order], x[order], which[order]
    n = np.bincount(which, minlength=counts.sum())
    if not len(n):
        return counts, []
    begins, mean = np.cumsum(n) - n, lambda v: np.bincount(which, v) / n  # sums go pixel by pixel
    x0, x1, y0, y1 = np.minimum.reduceat(x, begins), np.maximum.reduceat(x, begins), np.minimum.reduceat(y, begins), np.maximum.reduceat(y, begins)
    gray = np.rint(rgb @ np.array(LUMA))[number, y, x]
    mg = mean(gray)
    spread = np.sqrt(mean((gray - mg[which]) ** 2))
    left, top, boxes = np.maximum(0, x0 - 2)[which], np.maximum(0, y0 - 2)[which], []
    for s in SIZES:
        i, j = (x - left) // s, (y - top) // s
        met = np.unique((which * (j.max() + 1) + j) * (i.max() + 1) + i)
        boxes.append(np.bincount(met // ((j.max() + 1) * (i.max() + 1)), minlength=len(n)))
    boxes = pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * len(SIZES), np.stack(boxes, 1).ravel().astype(np.int32))
    wide, high = label.shape[2] + 2, label.shape[1] + 2
    px, py, length = _boundaries(label, ((number[begins] * high + y[begins] + 1) * wide + x[begins] + 1).tolist())
    area, perimeter = _polygons(px, py, length)
    corners = [hull(line) for line in np.split(np.stack([px, py], 1), np.cumsum(length)[:-1])]
    both = np.concatenate(corners)
    hull_area, hull_perimeter = _polygons(both[:, 0], both[:, 1], np.array([len(c) for c in corners]))
    sides, mx, my = np.sort(np.stack([x1 - x0, y1 - y0]) + 1, 0).astype(np.float64), mean(x), mean(y)
    fit = ellipses(px, py, length, angles)
    fit = np.where(np.isnan(fit[:, :1]), np.stack([mx, my, sides[1], sides[0], np.zeros(len(n))], 1), fit)
    size = [np.full(len(n), k) for k in (label.shape[2], label.shape[1])]
    return counts, [n, *size, x0, x1, y0, y1, mx, my, mg, spread, np.bincount(which, rgb[number, y, x].sum(1)) / (3 * n), boxes, area, perimeter, hull_area, hull_perimeter, length, *fit.T]


def box_counts(boxes, w, h):
    """The box-counting dimension of a patch (width, height) whose pixels meet so many boxes of each of SIZES, by least squares over those less than its sides; 1 with fewer than two."""
    sizes = F.filter(F.array(*[F.lit(s) for s in SIZES]), lambda s: s < F.least(w, h))
    a, b = F.transform(sizes, lambda s: -F.log(s.cast("double"))), F.transform(F.slice(boxes, 1, F.size(sizes)), lambda n: F.log(n.cast("double")))
    n, total = F.size(sizes), lambda v: F.aggregate(v, F.lit(0.0), lambda p, q: p + q)
    slope = (n * V.dot(a, b) - total(a) * total(b)) / (n * V.dot(a, a) - total(a) * total(a))
    return F.when(n < 2, 1.0).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(2.0), slope)))


def segmented(tiles: DataFrame, profile: Profile = PY12, image: str = "png") -> DataFrame:
    """tiles with PNGs to one row for each nucleus: the tile's other columns, at (its number from 0) and n (its pixels).

    Null images and images without nuclei give no rows. No shuffle: a tile is the unit, and its nuclei stay in its task.
    """
    others = [c for c in tiles.columns if c != image]
    small_batches(tiles.sparkSession)
    return tiles.select(*others, F.posexplode(_cut(profile)(F.col(image))).alias("at", "n"))


def _measured(tiles: DataFrame, profile: Profile, image: str, angles: bool) -> DataFrame:
    """tiles with PNGs to one row for each nucleus: the tile's other columns, at (its number from 0) and o (its MEASURES), which are made where it is cut, so that no pixels leave the task."""
    small_batches(tiles.sparkSession)
    others = [c for c in tiles.columns if c != image]
    plain = tiles.select(*others, image)
    schema = StructType([plain.schema[c] for c in others]).add("at", IntegerType()).add("o", StructType.fromDDL(MEASURES))
    fields = list(to_arrow_type(schema["o"].dataType))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                for places, rgb in _stacks(batch.column(len(others)).to_pylist()):
                    counts, columns = measures(rgb, stacked(rgb, profile), angles)
                    if columns:
                        rows = pa.array(np.repeat(places, counts))
                        number = np.concatenate([np.arange(k) for k in counts]).astype(np.int32)
                        found = pa.StructArray.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, fields)], fields=fields)
                        yield pa.RecordBatch.from_arrays([*[batch.column(i).take(rows) for i in range(len(others))], pa.array(number), found], names=[*others, "at", "o"])

    return plain.mapInArrow(run, schema)


def nuclei12(tiles: DataFrame, profile: Profile = PY12, image: str = "png", soft: Soft = Soft()) -> DataFrame:
    """tiles (img, PNG and others) to nuclei by the 12-number profile: measures, score, tags, vector.

    inst_id counts from 1 in a tile; the box is that in the patch of two more pixels on each side, as the profile has it.
    An outline of an area under 4 gives zeros throughout. centroid is cut to whole numbers.
    """
    m = _measured(tiles, profile, image, angles=False)
    x0, x1, y0, y1 = (F.col(f"o.{c}") for c in ("x0", "x1", "y0", "y1"))
    left, top = F.greatest(F.lit(0), x0 - 2), F.greatest(F.lit(0), y0 - 2)
    right, low = F.least(F.col("o.w"), x1 + 3), F.least(F.col("o.h"), y1 + 3)
    w, h, area = x1 - x0 + 1, y1 - y0 + 1, F.col("o.area")
    m = m.withColumns({"minor": F.greatest(F.lit(1.0), F.col("o.minor")), "perimeter": F.greatest(F.col("o.perimeter"), F.lit(1e-6))})
    m = m.withColumns({
        "ar": F.col("o.major") / F.col("minor"), "rough": F.col("perimeter") / F.greatest(F.lit(1.0), F.col("o.hull_perimeter")),
        "istd": F.col("o.istd"), "rect": shape.rectangularity(area, w, h),
        "sol": F.least(F.lit(1.0), area / F.greatest(F.lit(1.0), F.col("o.hull_area"))), "fd": box_counts(F.col("o.boxes"), right - left, low - top),
        "circ": F.least(F.lit(1.0), shape.circularity(area, F.col("perimeter"))), "area": area, "major": F.col("o.major"),
    })
    real = F.col("area") >= 4
    zeros = {c: F.when(real, F.col(c)).otherwise(0.0) for c in ("area", "perimeter", "circ", "major", "minor", "ar", "sol", "rough", "rect", "fd", "istd")}
    rounded = {"circ": 6, "major": 3, "minor": 3, "ar": 4, "sol": 6, "rough": 4, "rect": 6, "fd": 4, "istd": 3}
    vector = F.transform(F.array(*V.vector12({c: F.col(c) for c in zeros})), lambda v: F.when(real, v.cast("float")).otherwise(F.lit(0.0).cast("float")))
    box = F.when(real, F.array(x0 - left, y0 - top, w, h)).otherwise(F.array(*[F.lit(0)] * 4))
    m = m.withColumns({"feature_vector": vector, "bbox": box, "centroid": F.array(F.col("o.mx").cast("int"), F.col("o.my").cast("int"))})
    m = m.withColumns(zeros)
    m = m.withColumns({c: F.round(c, n) for c, n in rounded.items()})
    args = [F.col(c) for c in ("circ", "rough", "ar", "istd")]
    others = [c for c in tiles.columns if c != image]
    return m.select(
        *others, (F.col("at") + 1).alias("inst_id"), "centroid", "bbox", "area", "perimeter", F.col("circ").alias("circularity"), F.col("major").alias("major_axis"), F.col("minor").alias("minor_axis"),
        F.col("ar").alias("aspect_ratio"), F.col("sol").alias("solidity"), F.col("rough").alias("boundary_roughness"), F.round(shape.equivalent_diameter(F.col("area")), 3).alias("ecd"),
        F.col("rect").alias("rectangularity"), F.col("fd").alias("fractal_dim"), F.col("istd").alias("intensity_std"), "feature_vector",
        F.round(shape.soft_score(*args, soft), 4).alias("abnormality_score"), shape.tags(*args, soft).alias("abnormality_tags"),
        F.create_map(*[v for k, p in shape.sub_scores(*args, soft).items() for v in (F.lit(k), F.round(p, 4))]).alias("sub_scores"),
    )


def results12(tiles: DataFrame, found: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row for each tile, those without nuclei too: total, and abnormal by a score of the threshold or more."""
    n = found.groupBy("img").agg(F.count("*").alias("total"), F.count_if(F.col("abnormality_score") >= threshold).alias("abnormal"))
    return tiles.select("img").join(n.hint("merge"), "img", "left").select("img", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "abnormal")])


def nuclei128(tiles: DataFrame, profile: Profile = PY128_SEGMENTS, rules: Rules = PY128, image: str = "png") -> DataFrame:
    """tiles (img, PNG and others) to nuclei by the 128-number profile: measures, rules, vector.

    The box is one less wide and high than its pixels; the orientation is in degrees. Nuclei of fewer than ten pixels or an
    outline area under 4 go; cell_id numbers a tile's nuclei from 0, and one that goes, which takes a `least` far below the
    profile's, leaves a gap.
    """
    m = _measured(tiles, profile, image, angles=True).filter((F.col("o.n") >= 10) & (F.col("o.area") >= 4))
    tiny = lambda c: F.when(F.col(c) == 0, 1e-6).otherwise(F.col(c))
    m = m.withColumns({
        "area": F.col("o.area"), "perimeter": F.col("o.perimeter"), "major": F.col("o.major"), "minor": tiny("o.minor"), "mi": F.col("o.light"), "orientation": F.col("o.angle"),
        "ar": F.col("o.major") / tiny("o.minor"), "rough": F.col("o.perimeter") / tiny("o.hull_perimeter"), "sol": F.col("o.area") / tiny("o.hull_area"),
    })
    m = nuclei.with_rules(m, rules)
    base = V.base_py({c: F.col(c) for c in ("area", "perimeter", "circ", "ar", "sol", "rough", "major", "minor", "mi", "orientation")})
    m = m.withColumn("_v", F.array(*V.expanded_py(base)))
    others = [c for c in tiles.columns if c != image]
    return m.select(
        *others, F.col("at").alias("cell_id"), F.col("o.cx").alias("centroid_x"), F.col("o.cy").alias("centroid_y"), F.col("o.x0").alias("bbox_x"), F.col("o.y0").alias("bbox_y"),
        (F.col("o.x1") - F.col("o.x0")).alias("bbox_w"), (F.col("o.y1") - F.col("o.y0")).alias("bbox_h"), "area", "perimeter", F.col("o.hull_perimeter").alias("convex_perimeter"),
        F.col("major").alias("major_axis"), F.col("minor").alias("minor_axis"), "orientation", F.col("circ").alias("circularity"), F.col("ar").alias("aspect_ratio"), F.col("sol").alias("solidity"),
        F.col("rough").alias("roughness"), F.col("mi").alias("mean_intensity"), "is_abnormal", F.col("reasons").alias("abnormal_reasons"), V.normalised(F.col("_v")).alias("feature_vector"),
    )
