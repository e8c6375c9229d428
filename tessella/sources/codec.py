"""PNG, frames and resampling: array-shaped work in Arrow batches, a row for each image."""

import base64
import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def encode_png(image: np.ndarray, up: bool = False) -> bytes:
    """8-bit RGB or RGBA image (h, w, c) as PNG, fastest compression; every row unfiltered, or as its difference to the row above, which suits smooth images."""
    h, w, c = image.shape
    rows, flat = np.zeros((h, w * c + 1), np.uint8), image.reshape(h, w * c)
    rows[:, 0] = 2 * up
    rows[:, 1:] = flat
    if up:
        np.subtract(flat[1:], flat[:-1], out=rows[1:, 1:])

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 6 if c == 4 else 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def running(v: np.ndarray, axis: int, step: int) -> np.ndarray:
    """Sums of bytes (modulo 256) along an axis of (rows, columns), each with those `step`, 2 * `step` and so on before it; doubled spans add whole rows, where a cumulative sum goes byte by byte."""
    at = lambda a, b: (slice(a, b), slice(None)) if axis == 0 else (slice(None), slice(a, b))
    v, out = v.copy(), np.empty_like(v, order="C")
    while step < v.shape[axis]:
        out[at(0, step)] = v[at(0, step)]
        np.add(v[at(step, None)], v[at(0, -step)], out=out[at(step, None)])
        v, out, step = out, v, step * 2
    return v


def decode_png(data: bytes) -> np.ndarray:
    """(h, w, c) of an 8-bit PNG without interlacing, of colour type 2 or 6, with any of the five row filters."""
    at, idat, head = len(SIGNATURE), b"", b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        head, idat = body if kind == b"IHDR" else head, idat + body if kind == b"IDAT" else idat
        at += size + 12
    w, h, _, colour = struct.unpack(">IIBB", head[:10])
    c = 3 if colour == 2 else 4
    raw = np.frombuffer(zlib.decompress(idat), np.uint8).reshape(h, w * c + 1)
    if not raw[:, 0].any():  # no row is filtered
        return raw[:, 1:].reshape(h, w, c).copy()
    if (raw[:, 0] == 2).all():
        return running(raw[:, 1:], 0, 1).reshape(h, w, c)
    out = np.zeros((h + 1, w + 1, c), np.int32)  # a zero row above and a zero pixel to the left
    for y in range(h):
        line, above, kind = raw[y, 1:].reshape(w, c).astype(np.int32), out[y], raw[y, 0]
        if kind in (0, 2):
            out[y + 1, 1:] = line if kind == 0 else (line + above[1:]) % 256
        elif kind == 1:
            out[y + 1, 1:] = np.cumsum(line, axis=0) % 256
        else:
            for x in range(w):
                a, b, d = out[y + 1, x], above[x + 1], above[x]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - d
                    pa, pb, pd_ = abs(p - a), abs(p - b), abs(p - d)
                    guess = np.where((pa <= pb) & (pa <= pd_), a, np.where(pb <= pd_, b, d))
                out[y + 1, x + 1] = (line[x] + guess) % 256
    return out[1:, 1:].astype(np.uint8)


def to_base64(image: np.ndarray) -> str:
    return base64.b64encode(encode_png(image)).decode()


def unit_rgb(text: str) -> np.ndarray:
    """A base64 PNG as RGB in [0, 1]."""
    return decode_png(base64.b64decode(text))[:, :, :3].astype(np.float32) / 255


#: Rows that a task makes at once: a short PNG may hold a large image, so bytes of input do not bound those of output.
ROWS = 64


def by_rows(schema: str, one):
    """A pandas UDF of a function of one value that hands on its results a few rows at a time."""

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            for at in range(0, len(values), ROWS):
                yield pd.Series([one(v) for v in values.iloc[at : at + ROWS]], dtype=object)

    return F.pandas_udf(of, schema)


def _unit_rgb(text) -> np.ndarray | None:
    """unit_rgb() as a flat array; None of a null and of what is no such PNG."""
    try:
        return None if text is None else unit_rgb(text).ravel()
    except (ValueError, IndexError, struct.error, zlib.error):
        return None


def unit_rgb_of(text):
    """Column of flat arrays of unit_rgb() of a column of base64 PNGs; null of a null and of what is no such PNG."""
    return by_rows("array<float>", _unit_rgb)(text)


#: What spans() gives.
SPAN = "n int, mean double, least double, most double"


def spans(column, read):
    """Column of the SPAN of the numbers that read() makes of each value, nulls where it makes none.

    A task holds the numbers of one value at a time and none leaves it, so neither batches nor rows hold whole images.
    """

    def one(value):
        v = read(value)
        return (None,) * 4 if v is None else (v.size, v.mean(dtype=np.float64), v.min(), v.max())

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for values in batches:
            out = pd.DataFrame([one(v) for v in values], columns=["n", "mean", "least", "most"])
            yield out.astype({"n": "Int32", "mean": "float64", "least": "float64", "most": "float64"})

    return F.pandas_udf(of, SPAN)(column)


def span_of_unit_rgb(text):
    """spans() of what unit_rgb_of() gives."""
    return spans(text, _unit_rgb)


def span_of_gray(png, scale: int = 1):
    """spans() of what gray_of_png() gives."""
    return spans(png, lambda data: None if data is None else _gray(data, scale))


@lru_cache(maxsize=16)
def cubic_weights(n: int, to: int, a: float = -0.5) -> np.ndarray:
    """(to, n) weights of bicubic resampling (Keys), edges renormalised; in shrinking the kernel is as wide as the new pixels."""
    at, wide = (np.arange(to) + 0.5) * n / to - 0.5, max(1.0, n / to)
    d = np.abs(at[:, None] - np.arange(n)[None, :]) / wide
    w = np.where(d <= 1, (a + 2) * d**3 - (a + 3) * d**2 + 1, np.where(d < 2, a * (d**3 - 5 * d**2 + 8 * d - 4), 0))
    return w / w.sum(1, keepdims=True)


def resized(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bicubic to h x w, each channel by itself, 8 bits in and out."""
    down, across = cubic_weights(image.shape[0], h), cubic_weights(image.shape[1], w)
    tall = np.tensordot(down, image.astype(np.float64), 1)
    out = across @ np.moveaxis(tall, 1, 0).reshape(image.shape[1], -1)
    out = np.moveaxis(out.reshape(w, h, image.shape[2]), 0, 1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def upscale(image: np.ndarray, scale: int = 4) -> np.ndarray:
    return resized(image, image.shape[0] * scale, image.shape[1] * scale)


def to_bytes(unit: np.ndarray, truncated: bool = True) -> np.ndarray:
    """Values of [0, 1], clipped, as 8 bits: cut off, or rounded with halves to even."""
    scaled = np.clip(unit, 0, 1) * 255
    return (np.floor(scaled) if truncated else np.rint(scaled)).astype(np.uint8)


def preprocessed(unit: np.ndarray, size: tuple[int, int] = (512, 512)) -> np.ndarray:
    """An RGB image in [0, 1] as a model's input (1, 3, h, w), resampled if its size differs."""
    if unit.shape[:2] != size:
        unit = resized(to_bytes(unit), *size).astype(np.float32) / 255
    return np.ascontiguousarray(unit.transpose(2, 0, 1)[None], np.float32)


def postprocessed(output: np.ndarray, original: tuple[int, int] | None = None, scale: int = 4) -> np.ndarray:
    """A model's output (1, 3, h, w) as an image in [0, 1], resampled to scale times the original size, if given."""
    unit = np.clip(output[0].transpose(1, 2, 0), 0, 1)
    if original and unit.shape[:2] != (original[0] * scale, original[1] * scale):
        unit = resized(to_bytes(unit), original[0] * scale, original[1] * scale).astype(np.float32) / 255
    return unit


def frame(record: dict) -> bytes:
    """Four bytes of length, big end first, and the record as UTF-8 JSON; the length counts bytes."""
    body = json.dumps(record, ensure_ascii=False).encode()
    return struct.pack(">I", len(body)) + body


def unframe(data: bytes) -> list[dict]:
    out, at = [], 0
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        out.append(json.loads(data[at + 4 : at + 4 + size]))
        at += 4 + size
    return out


def png_files(rows, folder: str):
    """Write rows (name, png) as files below a folder, which is made as needed, and give (name, path, length) of each (K4).

    A name may hold folders. A task that runs again writes the same files again; a null image writes none.
    """

    def run(frames):
        from .shared import in_folder
        from .slides import located

        (to, base), made = located(folder), set()
        for frame in frames:
            frame = frame[frame.png.notna()]
            for name, png in zip(frame.name, frame.png):
                with to.open_output_stream(in_folder(made, to, f"{base}/{name}")) as out:
                    out.write(bytes(png))
            if len(frame):
                yield pd.DataFrame({"name": list(frame.name), "path": [f"{folder}/{n}" for n in frame.name], "length": [len(p) for p in frame.png]})

    return rows.select("name", "png").mapInPandas(run, "name string, path string, length long")


def png_of_gray(gray, h: int, w: int, bands: int = 1, tint=None):
    """Column of PNGs (binary) of a column of grey values, row by row; with three bands, of red, green and blue of each pixel, which tint may make of the grey values."""

    def one(v):
        return encode_png(np.repeat(np.asarray(v if tint is None else tint(v), np.uint8).reshape(h, w, bands), 3 // bands, axis=2))

    return by_rows("binary", one)(gray)


def _gray(data: bytes, scale: int) -> np.ndarray:
    image = decode_png(data)[:, :, :1]
    return (upscale(image, scale) if scale > 1 else image).ravel().astype(np.int32)


def gray_of_png(png, scale: int = 1):
    """Column of grey values, upscaled if asked, of a column of PNGs."""

    return by_rows("array<int>", lambda data: _gray(data, scale))(png)


#: The address that the schema fixes.
SCHEMA = "http://www.openmicroscopy.org/Schemas/OME/2016-06"


#: What is read of a document by one parse: F.from_xml(xml, OME, {"attributePrefix": "_"}).
OME = (
    "_UUID string, Image struct<_Name: string, AcquisitionDate: string, Pixels: struct<_Type: string, _SizeX: string, _SizeY: string, _PhysicalSizeX: string, "
    "Channel: array<struct<_ID: string, _Name: string>>, TiffData: struct<_PlaneCount: string>>>"
)


def ome_xml(name, width, height, colours: tuple = ("red", "green", "blue"), bits: int = 8, micron=None, uuid=None, acquired=None):
    """A slide's OME document as a text column, written from a struct by Spark: one image of interleaved planes, a channel for each colour.

    micron, the width of a pixel, and acquired, a date, are optional; uuid is random by default.
    """
    image = [F.lit("Image:0").alias("_ID"), name.alias("_Name")]
    size = {"SizeX": width, "SizeY": height, "SizeZ": F.lit(1), "SizeC": F.lit(len(colours)), "SizeT": F.lit(1)}
    pixels = [F.lit("Pixels:0").alias("_ID"), F.lit(f"uint{bits}").alias("_Type"), F.lit("XYCZT").alias("_DimensionOrder"), *[v.alias(f"_{k}") for k, v in size.items()], F.lit(True).alias("_Interleaved")]
    if micron is not None:
        pixels += [micron.alias("_PhysicalSizeX"), micron.alias("_PhysicalSizeY")]
    channels = [F.struct(F.lit(f"Channel:0:{i}").alias("_ID"), F.lit(c).alias("_Name"), F.lit(1).alias("_SamplesPerPixel")) for i, c in enumerate(colours)]
    planes = F.struct(F.lit(0).alias("_IFD"), F.lit(len(colours)).alias("_PlaneCount"))
    pixels = F.struct(*pixels, F.array(*channels).alias("Channel"), planes.alias("TiffData"))
    image += ([acquired.alias("AcquisitionDate")] if acquired is not None else []) + [pixels.alias("Pixels")]
    uuid = F.expr("uuid()") if uuid is None else uuid
    whole = F.struct(F.lit(SCHEMA).alias("_xmlns"), F.concat(F.lit("urn:uuid:"), uuid).alias("_UUID"), F.struct(*image).alias("Image"))
    return F.to_xml(whole, {"rowTag": "OME", "attributePrefix": "_"})


def framed(body):
    """A text column as a frame (binary): four bytes of length in bytes, big end first, and the text as UTF-8."""
    data = F.encode(body, "UTF-8")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(data)), 8, "0")), data)


def header_body(xml, width, height, tile, levels, at, channels: int = 3, bits: int = 8):
    """JSON of the frame that opens a streamed image; `at` is its time in milliseconds."""
    fields = {"magic": F.lit("OME-TIFF"), "version": F.lit("1.0"), "width": width, "height": height, "tileSize": tile, "channels": F.lit(channels), "bitsPerSample": F.lit(bits), "pyramidLevels": levels, "omeXml": xml, "createdAt": at}
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def tile_body(row, col, image, at, level=0):
    return F.to_json(F.struct(F.lit("tile").alias("type"), row.alias("row"), col.alias("col"), F.lit(level).alias("level"), image.alias("imageData"), at.alias("timestamp")))


def progress_body(progress, message, at):
    return F.to_json(F.struct(F.lit("progress").alias("type"), progress.alias("progress"), message.alias("message"), at.alias("timestamp")))


def final_body(path, at):
    return F.to_json(F.struct(F.lit("final").alias("type"), path.alias("outputPath"), at.alias("timestamp")))
