"""Kinds of work by name, as a table function for SQL whose columns depend on the kind."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BinaryType, DataType, DoubleType, IntegerType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..sources.codec import decode_png, encode_png


@dataclass(frozen=True)
class Kind:
    """takes: the input columns it needs; gives: names and types of the columns that it adds; run: the values of takes to rows of gives."""

    takes: tuple
    gives: dict[str, DataType]
    run: Callable[..., Iterable[tuple]]


def weights(size: int, overlap: int) -> Iterable[tuple]:
    """(y, x, weight) of a square tile: the Gaussian of the weight map with its edge ramps."""
    at = np.arange(size)
    bell = np.exp(-((at - size / 2) ** 2) / (2 * (0.3 * size) ** 2))
    line = bell / bell[size // 2]
    if overlap < size / 2:
        line = line * np.where(at < overlap, at / max(overlap, 1), 1) * np.where(at >= size - overlap, (at - (size - overlap)) / max(overlap, 1), 1)
    whole = np.outer(line, line)
    return ((y, x, float(whole[y, x])) for y in range(size) for x in range(size))


def decoded(image: bytes) -> Iterable[tuple]:
    if image is None:
        return [(None, None, None, None)]
    pixels = decode_png(bytes(image))
    return [(*pixels.shape, int(pixels[:, :, :3].sum(dtype=np.int64)))]


def encoded(gray: list, height: int, width: int) -> Iterable[tuple]:
    if gray is None or height is None or width is None:
        return [(None,)]
    return [(encode_png(np.repeat(np.asarray(gray, np.uint8).reshape(height, width, 1), 3, axis=2)),)]


KINDS = {
    "generate_weight_map": Kind(("tile_size", "overlap"), {"y": IntegerType(), "x": IntegerType(), "weight": DoubleType()}, weights),
    "decode_image_batch": Kind(("image",), {"height": IntegerType(), "width": IntegerType(), "channels": IntegerType(), "total": LongType()}, decoded),
    "encode_image": Kind(("gray", "height", "width"), {"image": BinaryType()}, encoded),
}


class _RunKind:
    """Each row of a table to the rows of a kind; columns that the kind does not take are passed through."""

    def __init__(self):
        self.kind = None

    @staticmethod
    def analyze(kind: AnalyzeArgument, rows: AnalyzeArgument) -> AnalyzeResult:
        if not kind.isConstantExpression or kind.value not in KINDS:
            raise ValueError(f"unknown kind {kind.value!r}; there are {', '.join(sorted(KINDS))}")
        if not rows.isTable:
            raise ValueError("the second argument must be a table")
        takes = KINDS[kind.value].takes
        missing = [c for c in takes if c not in rows.dataType.names]
        if missing:
            raise ValueError(f"kind {kind.value} needs the columns {', '.join(missing)}")
        schema = StructType([f for f in rows.dataType.fields if f.name not in takes])
        for name, type_ in KINDS[kind.value].gives.items():
            schema = schema.add(name, type_)
        return AnalyzeResult(schema)

    def eval(self, kind, rows):
        if self.kind is None:
            self.kind = KINDS[kind]
            self.passed = [c for c in rows.__fields__ if c not in self.kind.takes]
        own = tuple(rows[c] for c in self.passed)
        for made in self.kind.run(*(rows[c] for c in self.kind.takes)):
            yield own + tuple(made)


def registered(spark: SparkSession) -> SparkSession:
    """The session with run_kind: SELECT * FROM run_kind('<kind>', TABLE(<query>))."""
    spark.udtf.register("run_kind", udtf(_RunKind, useArrow=True))
    return spark
