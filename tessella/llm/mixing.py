"""Mixing sources to target weights: fixed-length blocks of words, multinomial draws for each output shard, pseudorandom permutations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import small_batches
from .common import WORD, numbered, running_before, stage, table

#: Words of a block, share of all words that the mix takes, most repeats of a source, weights by rank of the source.
BLOCK, SHARE, REPEATS, WEIGHTS = 64, 1.5, 2, (5, 2, 1)
OUT_SHARDS, SEED = 8, 42
#: Broadcast the copies of at most so many documents (12 bytes each), by their count; more are joined by shuffles.
BROADCAST_IDS = 500_000
#: Slots that one row of the plan is expanded to at a time.
SLOT_CHUNK = 1 << 16


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed bijection of [0, n) applied to each index: a four-round Feistel network, walked until it falls below n."""
    half = np.ones(len(n), np.uint64)
    while (small := half * half < n.astype(np.uint64)).any():
        half[small] *= np.uint64(2)
    key, out, go = key.astype(np.uint64), index.astype(np.uint64), np.ones(len(n), bool)
    while go.any():
        h, k = half[go], key[go]
        left, right = out[go] // h, out[go] % h
        for turn in range(4):
            mixed = (right + np.uint64(0x9E3779B97F4A7C15) * (k + np.uint64(turn + 1))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0x94D049BB133111EB)
            mixed ^= mixed >> np.uint64(32)
            left, right = right, (left + mixed) % h
        out[go] = left * h + right
        go = out >= n.astype(np.uint64)
    return out.astype(np.int64)


def block_of(slot, blocks, source):
    """The block that a slot of a source takes (columns): each epoch of as many slots as blocks takes every block once."""

    @F.pandas_udf("long")
    def of(slots: pd.Series, blocks: pd.Series, sources: pd.Series) -> pd.Series:
        n = blocks.to_numpy()
        epoch = slots.to_numpy() // n
        key = (sources.to_numpy().astype(np.uint64) << np.uint64(20)) + epoch.astype(np.uint64) + np.uint64(SEED << 44)
        return pd.Series(permuted(slots.to_numpy() % n, n, key))

    return of(slot, blocks, source)


def plan(sizes: DataFrame) -> DataFrame:
    """Sizes (source, source_size) to (source, source_size, target, rank, n_blocks, slots), one row for each source.

    Sources rank by code point, null last. Targets are the weights times one level, stopped at REPEATS times the
    source's size; the level is the one at which they sum to SHARE of all words. In closed form: by falling weight over
    stop, the first place at which the level that the rest would need reaches no stop among the rest.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("rank", (F.row_number().over(by_name) - 1).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    stops = ranked.withColumn("_weight", weight).withColumn("_stop", F.lit(float(REPEATS)) * F.col("source_size"))
    stops = stops.withColumn("_ratio", F.col("_stop") / F.col("_weight"))
    all_rows, by_ratio = Window.partitionBy(), Window.orderBy("_ratio", "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(all_rows) * SHARE
    stops = stops.withColumn("_stopped", F.coalesce(F.sum("_stop").over(before), F.lit(0.0)))
    stops = stops.withColumn("_rest", F.sum("_weight").over(all_rows) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
    level = (total - F.col("_stopped")) / F.col("_rest")
    stops = stops.withColumn("_level", F.when(level <= F.col("_ratio"), level))
    stops = stops.withColumn("_level", F.min_by("_level", F.when(F.col("_level").isNotNull(), F.struct("_ratio", "rank"))).over(all_rows))
    target = F.least("_stop", F.col("_weight") * F.coalesce("_level", F.lit(float("inf"))))
    out = stops.withColumn("target", target).withColumn("n_blocks", F.ceil(F.col("source_size") / BLOCK))
    mean = F.greatest(F.col("source_size") / F.greatest("n_blocks", F.lit(1)), F.lit(1.0))
    slots = F.least(F.round(F.col("target") / mean).cast("long"), REPEATS * F.col("n_blocks"))
    return out.withColumn("slots", slots).select("source", "source_size", "target", "rank", "n_blocks", "slots")


def position_of(place, total, shard):
    """A keyed permutation of the places of an output shard (columns), which interleaves its sources."""

    @F.pandas_udf("long")
    def of(places: pd.Series, totals: pd.Series, shards: pd.Series) -> pd.Series:
        return pd.Series(permuted(places.to_numpy(), totals.to_numpy(), shards.to_numpy().astype(np.uint64) + np.uint64((SEED + 1) << 44)))

    return of(place, total, shard)


def _multinomial(batches):
    for batch in batches:
        drawn = [np.random.default_rng([SEED, r]).multinomial(n, np.full(OUT_SHARDS, 1 / OUT_SHARDS)) for r, n in zip(batch["rank"], batch["slots"])]
        each = batch.loc[batch.index.repeat(OUT_SHARDS)]
        yield pd.DataFrame({"rank": each["rank"], "n_blocks": each["n_blocks"], "out_shard": np.tile(np.arange(OUT_SHARDS), len(batch)), "n": np.concatenate([np.zeros(0, np.int64), *drawn])})


def draw(planned: DataFrame) -> DataFrame:
    """One row (rank, slot, out_shard, position, block) for each block of the mix.

    The slots of each source are dealt over the output shards by a multinomial draw, so that, given a shard, its sources
    are one too; the totals stay those of the plan. A shard's slots are neighbours, which the source's permutations map
    to blocks and the shard's permutation to positions, numbered from 0 without gaps.
    """
    counts = planned.filter("slots > 0").select("rank", "n_blocks", "slots").mapInPandas(_multinomial, "rank long, n_blocks long, out_shard int, n long")
    counts = stage(counts, "counts")
    before = (F.coalesce(F.sum("n").over(Window.partitionBy(g).orderBy(o).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for g, o in (("rank", "out_shard"), ("out_shard", "rank")))
    counts = counts.withColumns(dict(zip(("_slot", "_place"), before))).withColumn("_total", F.sum("n").over(Window.partitionBy("out_shard")))
    chunks = counts.filter("n > 0").withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SLOT_CHUNK))))
    chunks = chunks.repartition(int(planned.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rank", "out_shard", "_chunk")
    first = F.col("_chunk") * SLOT_CHUNK
    slots = chunks.select("*", F.explode(F.sequence(first, F.least(first + SLOT_CHUNK, "n") - 1)).alias("_i")).withColumn("slot", F.col("_slot") + F.col("_i"))
    return slots.select(
        "rank",
        "slot",
        "out_shard",
        position_of(F.col("_place") + F.col("_i"), F.col("_total"), F.col("out_shard")).alias("position"),
        block_of("slot", "n_blocks", "rank").alias("block"),
    )


def pack(docs: DataFrame, row=None, carried: tuple = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, planned, pieces): the documents as intervals of their source's word stream, the plan, and the part of each block in each document.

    row: the column that tells rows apart, if docs is staged with one. carried: further columns of docs that rows keep.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        (F.monotonically_increasing_id() if row is None else row).alias("row"),
        *carried,
    )
    rows = stage(rows, "mixing")
    planned = stage(plan(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "plan")
    known = rows.alias("r").join(planned.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    known = known.select("doc_id", F.col("r.source").alias("source"), "size", "row", "source_size", "target", "rank", *carried)
    placed = running_before(known, "rank", ["doc_id", "size", "row"], "size", "start")
    placed = stage(placed, "placed")
    last = F.floor((F.col("start") + F.col("size") - 1) / BLOCK)
    blocks = F.explode(F.sequence(F.floor(F.col("start") / BLOCK), last)).alias("block")
    pieces = placed.filter("size > 0").select("row", "rank", "start", "size", blocks)
    n = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK) - F.greatest("start", F.col("block") * BLOCK)
    return placed, planned, pieces.select("row", "rank", "block", n.alias("n_words"))


def taken_words(docs: DataFrame, row=None) -> DataFrame:
    """(doc_id, row, rank, start, size, source_size, target, taken) for each row of docs (doc_id, text, source): see mix."""
    placed, planned, pieces = pack(docs, row)
    # Spark takes what is exploded from the small plan for small; merge joins keep it from broadcasting that.
    times = draw(planned).groupBy("rank", "block").agg(F.count("*").alias("times"))
    taken = pieces.join(times.hint("merge"), ["rank", "block"]).groupBy("row").agg(F.sum(F.col("n_words") * F.col("times")).alias("taken"))
    out = placed.join(taken.hint("merge"), "row", "left")
    return out.select("doc_id", "row", "rank", "start", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, row, size, source_size, target, taken) for each row of docs (doc_id, text, source).

    taken counts the words of the blocks that the mix draws, repeats counted; a block is drawn REPEATS times at most, so
    no document exceeds that many times its size. A null source is a source of its own, ranked last. Null, empty and
    blank texts have size 0 and take nothing; repeated rows count each by itself; an empty table gives no rows; other
    columns are ignored. Draws depend on ranks, sizes and SEED alone, so reruns agree.
    """
    return taken_words(docs).drop("rank", "start")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix(table(spark, sf_dir, "documents")).drop("row")


#: Pieces that a task of _cut holds at a time.
PIECES = 4096


def _cut(batches):
    """Rows (rank, start, text) to (rank, block, at, words): the words of each text that stand in each block, some pieces at a time."""
    columns = ["rank", "block", "at", "words"]
    for batch in batches:
        out = []
        for rank, start, text in zip(batch["rank"], batch["start"], batch["text"]):
            found, at = (text or "").encode(errors="replace").split(), 0
            while at < len(found):
                block = (start + at) // BLOCK
                end = min(len(found), (block + 1) * BLOCK - start)
                out.append((rank, block, start + at, b" ".join(found[at:end]).decode()))
                at = end
                if len(out) == PIECES:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
        yield pd.DataFrame(out, columns=columns)


def drawn_blocks(docs: DataFrame) -> DataFrame:
    """(out_shard, position, source, block, words): the mix of docs (doc_id, text, source) itself, one row for each drawn block.

    Texts meet their rows' places by id and two hashes of 96 bits together, so that no copy of the table is staged; they are
    cut in batches of a few megabytes. words
    are the block's words parted by blanks; position numbers the blocks of an output shard from 0. The draws are
    those that mix counts.
    """
    prints = (F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.xxhash64("text").alias("_hash"), F.crc32(F.encode("text", "UTF-8")).alias("_crc"))
    known = ["_id", "_hash", "_crc"]
    marked = docs.select("doc_id", "text", "source", *prints)
    placed, planned, _ = pack(marked, carried=tuple(known))
    once = marked.filter(F.col("text").isNotNull()).select(*known, "text").dropDuplicates(known)
    small_batches(docs.sparkSession)
    texts = placed.filter("size > 0").select(*known, "rank", "start").join(once.hint("merge"), known)
    cut = texts.select("rank", "start", "text").mapInPandas(_cut, "rank long, block long, at long, words string")
    blocks = cut.groupBy("rank", "block").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("w"))
    blocks = blocks.select("rank", "block", F.concat_ws(" ", "w.words").alias("words"))
    out = draw(planned).join(blocks.hint("merge"), ["rank", "block"]).join(planned.select("rank", "source"), "rank")
    return out.select("out_shard", "position", "source", "block", "words")


def mixing_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawn_blocks(table(spark, sf_dir, "documents"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: taken words over size (rows without words, null texts too: once).

    The whole part of that always, and one more where a hash of the row's place falls below the rest, so that each
    source's words meet its target on average, whatever the sizes of its documents. A null source is one of its own; an
    empty table gives no rows; other columns are passed on, whatever their names.
    """
    rows = numbered(docs)
    chance = F.pmod(F.xxhash64("rank", "start", F.lit(SEED + 1)), F.lit(1 << 30)) / (1 << 30)
    more = (chance < F.col("taken") % F.col("size") / F.col("size")).cast("int")
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size")).cast("int") + more).otherwise(1)
    taken = taken_words(rows.select("_row", "doc.doc_id", "doc.text", "doc.source"), F.col("_row"))
    times = stage(taken.select(F.col("row").alias("_row"), copies.alias("copies")).filter("copies > 0"), "times")
    if times.count() <= BROADCAST_IDS:
        times = F.broadcast(times)
    out = rows.join(times, "_row").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return out.select("doc.*")
