"""Labels and formats of numbers, times and paths."""

from pyspark.sql import functions as F


def label(key, names: dict):
    """The name of a key; unknown keys pass through."""
    chain = F.lit(None).cast("string")
    for k, v in names.items():
        chain = F.when(key == k, v).otherwise(chain)
    return F.coalesce(chain, key)


def duration(seconds):
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, s)).when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))


def file_size(n):
    """Bytes as B, KB, MB or GB; halves to even, as a division by a power of two is exact."""
    scaled = lambda by, places, unit: F.format_string(f"%.{places}f {unit}", F.bround(n / by, places))
    return F.when(n < 1 << 10, F.format_string("%d B", n)).when(n < 1 << 20, scaled(1 << 10, 1, "KB")).when(n < 1 << 30, scaled(1 << 20, 2, "MB")).otherwise(scaled(1 << 30, 2, "GB"))


def timestamp(ts):
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("-"))


def short_path(path):
    return F.when(F.length(path) > 40, F.concat(F.lit("..."), F.right(path, F.lit(38)))).otherwise(path)


def base_name(path):
    return F.substring_index(path, "/", -1)


def extension(path):
    return F.lower(F.regexp_extract(path, r"\.[^./]*$", 0))


def first_part(id_, n: int = 8):
    """The first n characters of an id."""
    return F.left(id_, F.lit(n))


def last_part(id_, n: int = 6):
    return F.right(id_, F.lit(n))


def fixed(value, places: int):
    """A number with so many places, halves up; null as 0."""
    scale = 10.0**places
    return F.format_string(f"%.{places}f", F.floor(F.coalesce(value.cast("double"), F.lit(0.0)) * scale + 0.5) / scale)


def percent(share, places: int = 0):
    """A share of 1 as a percentage."""
    return F.concat(fixed(F.coalesce(share.cast("double"), F.lit(0.0)) * 100, places), F.lit("%"))


def zoom(factor):
    """A viewer's zoom, with one place."""
    return F.concat(fixed(factor, 1), F.lit("x"))


def listed(items):
    """Texts as one, parted by commas; null as empty."""
    return F.array_join(F.coalesce(items, F.array().cast("array<string>")), ",")


def items(text):
    """A text's parts between commas without the empty ones; none of a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda t: t != "")
