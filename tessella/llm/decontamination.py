"""Benchmark decontamination by spaced seeds: masks that ignore chosen places find passages with substituted words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, stage, table

#: Words of the aligned stretch that is verified and the least percentage of them that must be equal.
STRETCH, SAME = 16, 70
#: Places of a seed that are compared (1) or ignored (0). However the substitutions that SAME allows are spread over a
#: stretch of STRETCH words, or over a whole item of LEAST words or more, some mask finds only equal words at some place;
#: tests show this for every spread.
SEEDS = ("1111", "10111", "11011", "11101", "100111", "1010011", "1101001")
SPAN, LEAST = max(map(len, SEEDS)), 5
#: Broadcast at most so many benchmark seeds or hits (three numbers each), and words of benchmark items that are hit, by
#: their count; more are joined by shuffles.
BROADCAST_ROWS, BROADCAST_WORDS = 500_000, 2_000_000


def tokens(text):
    """Lower-case words between ASCII white space, punctuation and controls, hashed."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-/:-@\[-`{-\x7F]+")
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, keep: list[str], items: bool = False) -> DataFrame:
    """rows (`all`: hashed words) to one row for each place and seed: keep, at, seed (hash of the seed's number and its words).

    Fewer than LEAST words also give one seed of all of them, which is the only one of such items. Shifted copies of the
    word array are zipped, so hashing runs in generated code, not in a lambda for each word.
    """
    shifted = [F.slice("all", i + 1, F.greatest(F.size("all") - i, F.lit(0))).alias(f"w{i}") for i in range(SPAN)]
    whole = F.when(F.size("all") < LEAST, F.xxhash64(F.lit(-1), "all")).alias("whole")
    zipped = rows.select(*keep, whole, F.posexplode(F.arrays_zip(*shifted)).alias("at", "w"))
    hashed = [F.when(F.col("at") == 0, F.col("whole"))]
    for n, mask in enumerate(SEEDS):
        used = [F.col(f"w.w{i}") for i, c in enumerate(mask) if c == "1"]
        fits = F.col(f"w.w{len(mask) - 1}").isNotNull()
        hashed.append(F.when(fits & F.col("whole").isNull() if items else fits, F.xxhash64(F.lit(n), *used)))
    return zipped.select(*keep, "at", F.explode(F.array(*hashed)).alias("seed")).filter("seed is not null")


def best_stretch(doc, item, shift):
    """Most equal words of any STRETCH neighbouring places (all of a shorter item) where item place j meets doc place j + shift; (equal, places)."""
    low = F.greatest(F.lit(0), -shift)
    length = F.least(F.size(item), F.size(doc) - shift) - low
    same = F.zip_with(F.slice(item, low + 1, length), F.slice(doc, low + shift + 1, length), lambda a, b: (a == b).cast("int"))
    sums = F.transform(F.sequence(F.lit(0), F.greatest(length - STRETCH, F.lit(0))), lambda i: F.aggregate(F.slice(same, i + 1, F.lit(STRETCH)), F.lit(0), lambda a, b: a + b))
    return F.struct(F.array_max(sums).alias("equal"), F.least(F.size(item), F.lit(STRETCH)).alias("places"))


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def stretches(rows: DataFrame, benchmark: DataFrame, item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(row, id, item, b): rows (row, id, text), staged, and each alignment with a benchmark item that a seed found; b is its best stretch.

    Items of fewer than LEAST words meet only texts that have their very words and no others.
    """
    items = benchmark.select(F.col(item).alias("item"), tokens(F.col(item_text)).alias("item_all")).filter(F.size("item_all") > 0)
    items = stage(items.distinct(), "items")
    wanted = seeds(items.withColumnRenamed("item_all", "all"), ["item"], items=True).withColumnRenamed("at", "item_at")
    places = seeds(rows.select("row", tokens(F.col("text")).alias("all")), ["row"])
    hits = places.join(_sized(wanted), "seed").select("row", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    hits = stage(hits, "hits")
    hits = rows.select("row", "id", F.col("text").alias("_text")).join(_sized(hits), "row").select("row", "id", "item", "shift", tokens(F.col("_text")).alias("all"))
    if (items.agg(F.sum(F.size("item_all") + 4)).first()[0] or 0) <= BROADCAST_WORDS:
        items = F.broadcast(items)
    return hits.join(items, "item").select("row", "id", "item", best_stretch(F.col("all"), F.col("item_all"), F.col("shift")).alias("b"))


def enough(b: str):
    return F.col(f"{b}.equal") * 100 >= F.col(f"{b}.places") * SAME


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, equal, places, share): each benchmark item that a document overlaps, with the best aligned stretch.

    Verified where SAME percent of STRETCH neighbouring words, or of all words of a shorter item, are equal in place. An
    item of under LEAST words overlaps only a document that has just these words; null and empty texts and items overlap
    nothing. Texts of any length are read whole. Rows with the same key count as one document's, each row with a null key
    as a document of its own; repeated items give repeated answers once; empty tables give no rows. Extra columns are
    ignored.
    """
    rows = numbered(docs.select(F.col(key).alias("id"), F.col(text).alias("text"))).select(F.col("_row").alias("row"), "doc.*")
    own = F.when(F.col("id").isNull(), F.col("row")).alias("own")
    found = stretches(rows, benchmark, item, item_text)
    best = found.groupBy("id", own, "item").agg(F.max("b").alias("b")).filter(enough("b"))
    return best.select(F.col("id").alias(key), F.col("item").alias("item_id"), "b.equal", "b.places", (F.col("b.equal") / F.col("b.places")).alias("share"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that overlap the benchmark, whatever their doc_id; null and empty texts stay, repeated rows share their fate.

    An empty table or benchmark is fine; other columns are passed on, whatever their names.
    """
    rows = numbered(docs)
    found = stretches(rows.select(F.col("_row").alias("row"), F.col("doc.doc_id").alias("id"), F.col("doc.text").alias("text")), table(spark, sf_dir, "benchmark"))
    leaked = stage(found.filter(enough("b")).select(F.col("row").alias("_row")).distinct(), "leaked")
    return rows.join(leaked, "_row", "left_anti").select("doc.*")
