"""Slide files as tables: data sources over tiled, pyramidal TIFF whose partitions are planned from paths and sizes and whose filters reach the reader.

Small slides may lie in packs: ZIP files of stored, not deflated members, which are listed, planned and kept on disk as one file. A
slide's path is then the pack's and its name, as in folder/0.zip/s1.tif.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..config import EXTENSIONS, Grid
from .codec import encode_png, running

# Tags and codes of the TIFF specification.
WIDTH, HEIGHT, BITS, COMPRESSION, DESCRIPTION, SAMPLES, TILE_WIDTH, TILE_HEIGHT, OFFSETS, COUNTS, PHOTOMETRIC, PREDICTOR = 256, 257, 258, 259, 270, 277, 322, 323, 324, 325, 262, 317
PLAIN, DEFLATE, OLD_DEFLATE, ZSTD = 1, 8, 32946, 50000
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 16: "Q"}


@dataclass
class Level:
    """One image of a pyramid and where its tiles lie in the file."""

    width: int
    height: int
    tile_width: int
    tile_height: int
    samples: int
    compression: int
    offsets: tuple
    counts: tuple
    predictor: int = 1


def _directories(read) -> list[dict]:
    """The tag directories of a TIFF or BigTIFF; only these are read, not the pixels."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(f"{order or '<'}H", head[2:4])[0]
    if order is None or version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    size, count_size, word = (20, 8, "Q") if big else (12, 2, "I")
    out = []
    while at:
        n = struct.unpack(order + ("Q" if big else "H"), read(at, count_size))[0]
        body = read(at + count_size, n * size + struct.calcsize(word))
        tags = {}
        for i in range(n):
            entry = body[i * size : (i + 1) * size]
            tag, kind, count = struct.unpack(f"{order}HH{word}", entry[: 4 + struct.calcsize(word)])
            if kind not in TYPES:
                continue
            code = f"{order}{count}{TYPES[kind]}"
            raw, need = entry[4 + struct.calcsize(word) :], struct.calcsize(code)
            if need > len(raw):
                raw = read(struct.unpack(order + word, raw)[0], need)
            tags[tag] = struct.unpack(code, raw[:need])
        out.append(tags)
        at = struct.unpack(order + word, body[n * size :])[0]
    return out


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path within it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class Pack:
    """An open ZIP of slides: where each lies, from its directory alone."""

    def __init__(self, path: str):
        filesystem, inner = located(path)
        self.path, self.file = path, filesystem.open_input_file(inner)
        with zipfile.ZipFile(self.file) as opened:
            self.members = {m.filename: m for m in opened.infolist() if not m.is_dir()}

    def place(self, name: str) -> tuple[int, int]:
        """(begin, size) of a member's bytes."""
        member = self.members.get(name)
        if member is None:
            raise FileNotFoundError(f"{self.path}/{name}")
        if member.compress_type != zipfile.ZIP_STORED:
            raise ValueError(f"{name} is not stored as it is")
        self.file.seek(member.header_offset)
        head = self.file.read(30)  # its name and extra field, whose lengths end it, lie before the bytes
        return member.header_offset + 30 + sum(struct.unpack("<HH", head[26:])), member.file_size


def packed(slides) -> bytes:
    """(name, bytes) of slides as one pack, the same for the same slides."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as pack:
        for name, data in slides:
            pack.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def in_pack(path: str) -> tuple[str, str] | None:
    """(pack, name) of the path of a slide within a pack, by its form."""
    found = re.match(r"(?is)(.+?\.zip)/(.+)$", path)
    return found and found.groups()


def _is_file(path: str) -> bool:
    filesystem, inner = located(path)
    return filesystem.get_file_info(inner).type == pafs.FileType.File


#: Bytes that are read of a file at once when it is opened; those of a small one are all that is needed.
HEAD = 1 << 16


class Slide:
    """An open slide file, of its own or within a pack: its levels, its properties and regions of pixels.

    `packs` opens packs, so that many slides share one; `pack` is one that is open and known to hold the slide.
    """

    def __init__(self, path: str, packs=Pack, pack: Pack | None = None):
        member = in_pack(path)
        if pack is None and member and _is_file(member[0]):
            pack = packs(member[0])
        if pack:
            self.file, (self.begin, size) = pack.file, pack.place(path[len(pack.path) + 1 :])
        else:
            filesystem, inner = located(path)
            info = filesystem.get_file_info(inner)
            if info.type != pafs.FileType.File:
                raise FileNotFoundError(path)
            self.file, self.begin, size = filesystem.open_input_file(inner), 0, info.size
        self.path, self.head, self.size = path, b"", size
        self.head = self._read(0, min(HEAD, size))
        tags = [t for t in _directories(self._read) if OFFSETS in t]
        one = lambda t, tag, default: t.get(tag, (default,))[0]
        self.levels = [Level(one(t, WIDTH, 0), one(t, HEIGHT, 0), one(t, TILE_WIDTH, 0), one(t, TILE_HEIGHT, 0), one(t, SAMPLES, 1), one(t, COMPRESSION, PLAIN), t[OFFSETS], t[COUNTS], one(t, PREDICTOR, 1)) for t in tags]
        self.text = b"".join(tags[0].get(DESCRIPTION, (b"",))).rstrip(b"\0").decode() if tags else ""

    def _read(self, at: int, size: int) -> bytes:
        if at + size <= len(self.head):
            return self.head[at : at + size]
        self.file.seek(self.begin + at)
        return self.file.read(max(0, min(size, self.size - at)))

    def _decoded(self, of: Level, numbers: np.ndarray) -> np.ndarray:
        """(n, tile height, tile width, 3) of tiles of a level; those that share their bytes in the file are decoded once."""
        if of.predictor not in (1, 2):
            raise ValueError(f"predictor {of.predictor} is not supported")
        size, places = of.tile_height * of.tile_width * of.samples, {}
        which = [places.setdefault((of.offsets[i], of.counts[i]), len(places)) for i in numbers]
        images = np.empty((len(places), size), np.uint8)
        for (at, count), k in places.items():
            data = self._read(at, count)
            if of.compression == ZSTD:
                data = pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True)
            elif of.compression in (DEFLATE, OLD_DEFLATE):
                data = zlib.decompress(data)
            elif of.compression != PLAIN:
                raise ValueError(f"compression {of.compression} is not supported")
            images[k] = np.frombuffer(data, np.uint8)
        if of.predictor == 2:  # each pixel as its difference to the one on its left
            images = running(images.reshape(-1, of.tile_width * of.samples), 1, of.samples)
        images = images.reshape(-1, of.tile_height, of.tile_width, of.samples)
        images = images[..., :3] if of.samples >= 3 else np.repeat(images[..., :1], 3, axis=3)
        return images if len(places) == len(which) else images[which]

    def properties(self) -> dict:
        """`key=value` lines of the description, every value as text."""
        return dict(line.split("=", 1) for line in self.text.splitlines() if "=" in line)

    def downsample(self, level: int) -> float:
        top, of = self.levels[0], self.levels[level]
        return (top.width / of.width + top.height / of.height) / 2

    def region(self, level: int, x: int, y: int, width: int, height: int) -> np.ndarray:
        """RGB of a rectangle in the level's own pixels; outside the image it is black. Only the file's tiles that it touches are read."""
        if not 0 <= level < len(self.levels):
            raise ValueError(f"no level {level}; the highest is {len(self.levels) - 1}")
        of, out = self.levels[level], np.zeros((height, width, 3), np.uint8)
        x0, x1, y0, y1 = max(x, 0), min(x + width, of.width), max(y, 0), min(y + height, of.height)
        if x0 >= x1 or y0 >= y1:
            return out
        rows, columns = (np.arange(a // n, -(-b // n)) for a, b, n in ((y0, y1, of.tile_height), (x0, x1, of.tile_width)))
        tiles = self._decoded(of, (rows[:, None] * -(-of.width // of.tile_width) + columns).ravel().tolist())
        whole = tiles.reshape(len(rows), len(columns), *tiles.shape[1:]).swapaxes(1, 2).reshape(len(rows) * of.tile_height, -1, 3)
        top, left = rows[0] * of.tile_height, columns[0] * of.tile_width
        out[y0 - y : y1 - y, x0 - x : x1 - x] = whole[y0 - top : y1 - top, x0 - left : x1 - left]
        return out


def _parted(image: np.ndarray, tile: int) -> np.ndarray:
    """(tiles, bytes) of an RGB image, each pixel as its difference to the one on its left within its tile; zeros beyond the edges."""
    h, w = image.shape[:2]
    down, across = -(-h // tile), -(-w // tile)
    padded = np.zeros((down * tile, across * tile * 3), np.uint8)
    padded[:h, : w * 3] = image.reshape(h, w * 3)
    out = np.empty_like(padded)
    np.subtract(padded[:, 3:], padded[:, :-3], out=out[:, 3:])
    first = lambda v: v.reshape(down * tile, across, tile, 3)[:, :, 0]
    first(out)[:] = first(padded)
    return out.reshape(down, tile, across, tile * 3).swapaxes(1, 2).reshape(down * across, -1)


def tiff_bytes(levels: list[np.ndarray], description: str = "", tile: int = 64) -> bytes:
    """A pyramid of RGB images as a tiled TIFF, little end first, packed by Zstandard after horizontal differences; equal tiles are stored once."""
    out, heads, codec, places = bytearray(b"II*\0\0\0\0\0"), [], pa.Codec("zstd", compression_level=3), {}
    for image in levels:
        offsets, counts = [], []
        for part in map(bytes, _parted(image, tile)):
            if part not in places:
                data = codec.compress(part, asbytes=True)
                places[part] = len(out), len(data)
                out += data
            offset, count = places[part]
            offsets.append(offset)
            counts.append(count)
        heads.append((image.shape[1], image.shape[0], offsets, counts))
    link = 4
    for i, (w, h, offsets, counts) in enumerate(heads):
        note = description.encode() + b"\0"
        tags = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [8, 8, 8]), (COMPRESSION, 3, [ZSTD]), (PHOTOMETRIC, 3, [2])]
        tags += [(DESCRIPTION, 2, note)] * (i == 0) + [(SAMPLES, 3, [3]), (TILE_WIDTH, 3, [tile]), (TILE_HEIGHT, 3, [tile]), (OFFSETS, 4, offsets), (COUNTS, 4, counts), (PREDICTOR, 3, [2])]
        entries = b""
        for tag, kind, values in tags:
            raw = values if kind == 2 else struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
            if len(raw) > 4:
                at, raw = len(out), raw + b"\0" * (len(raw) % 2)
                out += raw
                raw = struct.pack("<I", at)
            entries += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@dataclass
class Files(InputPartition):
    """Files of one task; of a large file a band: the rows, or slides of a pack, whose remainder by `bands` is `band`."""

    paths: tuple = ()
    band: int = 0
    bands: int = 1


@dataclass
class _Bounds:
    """What pushed filters leave of a number."""

    least: float = float("-inf")
    most: float = float("inf")
    among: set | None = None

    def allows(self, value: int) -> bool:
        return self.least <= value <= self.most and (self.among is None or value in self.among)


@dataclass
class _Wanted:
    paths: set | None = None
    numbers: dict = field(default_factory=dict)

    def push(self, f) -> bool:
        """Whether the reader takes over this filter whole."""
        name = ".".join(f.attribute).lower() if hasattr(f, "attribute") else ""
        if name == "path" and isinstance(f, (EqualTo, In)):
            asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.paths = asked if self.paths is None else self.paths & asked
            return True
        if name not in ("level", "tile_row", "tile_col"):
            return name == "path" and isinstance(f, IsNotNull)
        if isinstance(f, IsNotNull):
            return True
        b = self.numbers.setdefault(name, _Bounds())
        if isinstance(f, (EqualTo, In)):
            asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
            b.among = asked if b.among is None else b.among & asked
        elif isinstance(f, GreaterThan):
            b.least = max(b.least, f.value + 1)
        elif isinstance(f, GreaterThanOrEqual):
            b.least = max(b.least, f.value)
        elif isinstance(f, LessThan):
            b.most = min(b.most, f.value - 1)
        elif isinstance(f, LessThanOrEqual):
            b.most = min(b.most, f.value)
        else:
            return False
        return True

    def allows(self, name: str, value: int) -> bool:
        return name not in self.numbers or self.numbers[name].allows(value)


class _Reader(DataSourceReader):
    """Files below a path, packed or cut into partitions of about `splitBytes`, from their sizes alone: no file is opened to plan."""

    def __init__(self, options: dict, schema: StructType, cut: bool):
        self.options, self.cut, self.wanted = {k.lower(): v for k, v in options.items()}, cut, _Wanted()
        self.fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in schema.fields]
        self.least = int(self.options.get("minpartitions", 1))
        self.tile, self.overlap = int(self.options.get("tilesize", Grid().tile)), int(self.options.get("overlap", Grid().overlap))
        if not 0 <= self.overlap < self.tile:
            raise ValueError("overlap must be at least 0 and less than tileSize")

    def pushFilters(self, filters):
        for f in filters:
            if not self.wanted.push(f):
                yield f

    def _files(self) -> list[tuple[str, int]]:
        path = self.options["path"]
        filesystem, inner = located(path)
        prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
        info = filesystem.get_file_info(inner)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.type == pafs.FileType.File else filesystem.get_file_info(pafs.FileSelector(inner, recursive=True))
        listed = [(prefix + i.path, i.size) for i in found if i.type == pafs.FileType.File and (is_slide(i.path) or is_pack(i.path))]
        asked = self.wanted.paths
        if asked is not None:
            asked = asked | {p[: -len(m[1]) - 1] for p in asked if (m := in_pack(p))}
        return sorted(p for p in listed if asked is None or p[0] in asked)

    def partitions(self):
        files = self._files()
        split = min(int(self.options.get("splitbytes", 32 << 20)), max(1, sum(size for _, size in files) // self.least))
        out, pack, size = [], [], 0
        for path, length in files:
            if length > split and (self.cut or is_pack(path)):
                bands = -(-length // split)
                rows = None if is_pack(path) else self.wanted.numbers.get("tile_row", _Bounds()).among
                out += [Files((path,), b, bands) for b in range(bands) if rows is None or any(r % bands == b for r in rows)]
                continue
            if pack and size + length > split:
                out.append(Files(tuple(pack)))
                pack, size = [], 0
            pack.append(path)
            size += length
        return [*out, Files(tuple(pack))] if pack or not out else out

    def slides(self, partition):
        """(slide, band, bands) of a task's files; a pack's slides by name."""
        for path in partition.paths:
            if not is_pack(path):
                yield Slide(path), partition.band, partition.bands
                continue
            pack = Pack(path)
            for name in sorted(n for n in pack.members if is_slide(n))[partition.band :: partition.bands]:
                if self.wanted.paths is None or f"{path}/{name}" in self.wanted.paths:
                    yield Slide(f"{path}/{name}", pack=pack), 0, 1

    def batches(self, rows):
        """Rows as Arrow batches of some thousand rows or a few megabytes of images, which are their last value."""
        held, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held), self.fields)], schema=pa.schema(self.fields))

        for row in rows:
            held.append(row)
            size += len(row[-1])
            if len(held) == 2048 or size > 4 << 20:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()


def is_slide(path: str) -> bool:
    return f".{path.rsplit('.', 1)[-1].lower()}" in EXTENSIONS


def is_pack(path: str) -> bool:
    return path.lower().endswith(".zip")


def grid_of(level: Level, tile: int, overlap: int):
    """(row, col, x, y, width, height) of the overlapping tiles of a level, one at least, edges clipped."""
    step = tile - overlap
    for row in range(max(1, -(-(level.height - overlap) // step))):
        for col in range(max(1, -(-(level.width - overlap) // step))):
            yield row, col, col * step, row * step, min(tile, level.width - col * step), min(tile, level.height - row * step)


#: Pixels of a level that are decoded at once, a row of tiles at least.
BLOCK = 1 << 22


class _InfoReader(_Reader):
    def read(self, partition):
        def rows():
            for slide, _, _ in self.slides(partition):
                levels = [(i, of.width, of.height, slide.downsample(i)) for i, of in enumerate(slide.levels)]
                yield slide.path, len(levels), levels, list(slide.properties().items())

        yield from self.batches(rows())


class _TileReader(_Reader):
    def read(self, partition):
        yield from self.batches((row for slide, band, bands in self.slides(partition) for row in self._tiles(slide, band, bands)))

    def _tiles(self, slide: Slide, band: int, bands: int):
        allows = self.wanted.allows
        for number, level in enumerate(slide.levels):
            if not allows("level", number):
                continue
            asked = [t for t in grid_of(level, self.tile, self.overlap) if t[0] % bands == band and allows("tile_row", t[0]) and allows("tile_col", t[1])]
            for some in self._blocks(asked):
                left, top = min(t[2] for t in some), min(t[3] for t in some)
                block = slide.region(number, left, top, max(t[2] + t[4] for t in some) - left, max(t[3] + t[5] for t in some) - top)
                for row, col, x, y, w, h in some:
                    yield slide.path, number, row, col, x, y, w, h, encode_png(block[y - top : y - top + h, x - left : x - left + w], up=True)

    @staticmethod
    def _blocks(asked: list):
        """Tiles of neighbouring rows, as many as BLOCK allows and one row at least, whose box is read at once."""
        some: list = []
        for _, row in groupby(asked, key=lambda t: t[0]):
            row = list(row)
            if some and (row[0][0] > some[-1][0] + 1 or (row[0][3] + row[0][5] - some[0][3]) * (row[-1][2] + row[-1][4] - row[0][2]) > BLOCK):
                yield some
                some = []
            some += row
        if some:
            yield some


class SlideInfo(DataSource):
    """spark.read.format("slide_info").load(path): one row for each slide file, from its directories; options splitBytes, minPartitions."""

    @classmethod
    def name(cls):
        return "slide_info"

    def schema(self):
        return "path string, level_count int, levels array<struct<level:int,width:int,height:int,downsample:double>>, metadata map<string,string>"

    def reader(self, schema):
        return _InfoReader(dict(self.options), schema, cut=False)


class SlideTiles(DataSource):
    """spark.read.format("slide_tiles").load(path): one row for each tile of each level, as PNG; options tileSize, overlap, splitBytes, minPartitions.

    Filters on path, level, tile_row and tile_col are applied before pixels are read; paths, and rows of files that are
    cut into bands, also before tasks are made.
    """

    @classmethod
    def name(cls):
        return "slide_tiles"

    def schema(self):
        return "path string, level int, tile_row int, tile_col int, x int, y int, width int, height int, image binary"

    def reader(self, schema):
        return _TileReader(dict(self.options), schema, cut=True)


def registered(spark: SparkSession) -> SparkSession:
    """The session with both sources and filter pushdown for sources of this kind."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (SlideInfo, SlideTiles):
        spark.dataSource.register(source)
    return spark


def _source(spark: SparkSession, name: str):
    """A reader of some tasks for each slot, so that a long one delays little."""
    return registered(spark).read.format(name).option("minPartitions", 4 * spark.sparkContext.defaultParallelism)


def slide_info(spark: SparkSession, path: str) -> DataFrame:
    return _source(spark, "slide_info").load(path)


def slide_tiles(spark: SparkSession, path: str, grid: Grid = Grid()) -> DataFrame:
    return _source(spark, "slide_tiles").option("tileSize", grid.tile).option("overlap", grid.overlap).load(path)


def region(path, level, x, y, width, height):
    """Column struct (image, error) of the PNG of any region (S2, S5): x and y count pixels of level 0, width and height those of the level.

    A missing file or level gives an error text and no image; a null argument neither.
    """

    @F.pandas_udf("image binary, error string")
    def of(path: pd.Series, level: pd.Series, x: pd.Series, y: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
        packs = lru_cache(maxsize=8)(Pack)
        opened = lru_cache(maxsize=8)(lambda path: Slide(path, packs))

        def one(path, level, x, y, width, height):
            if path is None or pd.isna([level, x, y, width, height]).any():
                return None, None
            try:
                slide = opened(path)
                if not 0 <= level < len(slide.levels):
                    raise ValueError(f"no level {int(level)}; the highest is {len(slide.levels) - 1}")
                by = slide.downsample(int(level))
                return encode_png(slide.region(int(level), int(x / by), int(y / by), int(width), int(height)), up=True), None
            except (OSError, ValueError, zlib.error, zipfile.BadZipFile) as error:
                return None, f"{type(error).__name__}: {error}"

        return pd.DataFrame([one(*row) for row in zip(path, level, x, y, width, height)], columns=["image", "error"], dtype=object)

    return of(path, level, x, y, width, height)


def each_tile(tiles: DataFrame, callback, schema: str) -> DataFrame:
    """Rows that a callback gives for each tile of slide_tiles(): callback(row) returns a tuple of the schema.

    Tiles of one file reach it row by row as they are read, within Spark's tasks; an exception fails its task.
    """

    def run(frames):
        names = [part.split()[0] for part in schema.split(",")]
        for frame in frames:
            yield pd.DataFrame([callback(row) for row in frame.itertuples(index=False)], columns=names)

    return tiles.mapInPandas(run, schema)
