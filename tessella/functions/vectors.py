"""Distances, norms and the 12- and 128-part feature vectors."""

import math

from pyspark.sql import functions as F


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v):
    return F.sqrt(dot(v, v))


def l2(a, b):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine(a, b):
    return dot(a, b) / (norm(a) * norm(b))


def similarity(distance):
    return 1 / (1 + distance)


def normalised(v):
    return F.zip_with(v, F.array_repeat(norm(v) + 1e-8, F.size(v)), lambda x, n: x / n)  # the norm once, not for each component


def _products(b: list, wrap) -> list:
    return [wrap(b[i] * b[j]) for i in range(len(b)) for j in range(i + 1, len(b))]


def expanded_js(base: list) -> list:
    """Ten numbers to 95: tanh of powers, sine, cosine, tanh of products of pairs; zeros up to 128."""
    out = [F.tanh(b) for b in base] + [F.tanh(b * b) for b in base] + [F.tanh(b * b * b) for b in base]
    out += [F.sin(math.pi * b) for b in base] + [F.cos(math.pi * b) for b in base] + _products(base, F.tanh)
    return out + [F.lit(0.0)] * (128 - len(out))


def expanded_py(base: list) -> list:
    """Ten numbers to 95: powers, sine, cosine, products of pairs; the last is repeated up to 128."""
    out = list(base) + [b * b for b in base] + [b * b * b for b in base]
    out += [F.sin(math.pi * b) for b in base] + [F.cos(math.pi * b) for b in base] + _products(base, lambda x: x)
    return out + [out[-1]] * (128 - len(out))


def base_js(n: dict) -> list:
    return [n["area"] / 5000, n["perimeter"] / 500, F.least(F.lit(1.0), n["circ"]), F.least(F.lit(1.0), n["ar"] / 3), n["sol"], F.least(F.lit(1.0), n["rough"] / 2), n["major"] / 200, n["minor"] / 100, n["mi"] / 255, n["orientation"] / math.pi]


def base_py(n: dict) -> list:
    scale = (5000, 500, 1, 3, 1, 2, 200, 100, 180, 3.14)
    values = (n["area"], n["perimeter"], n["circ"], n["ar"], n["sol"], n["rough"], n["major"], n["minor"], n["mi"], n["orientation"])
    return [F.tanh(v / s) for v, s in zip(values, scale)]


def vector12(n: dict) -> list:
    smooth = n["circ"] * (1 - F.least(n["rough"], F.lit(3.0)) / 3)
    values = [n["area"] / 1e4, n["perimeter"] / 2000, n["circ"], n["major"] / 500, n["ar"] / 10, n["sol"], F.least(n["rough"], F.lit(5.0)) / 5, 2 * F.sqrt(n["area"] / math.pi) / 500, n["rect"], n["fd"] / 2, n["istd"] / 80, smooth]
    return [F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) for v in values]
