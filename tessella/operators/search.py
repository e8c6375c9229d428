"""The vector table: exact top-k, filtered retrieval, delete."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

METRICS = {"l2": V.l2, "cosine": V.cosine, "ip": V.dot}


def score(metric: str, a, b):
    return V.similarity(V.l2(a, b)) if metric == "l2" else METRICS[metric](a, b)


def top_k(rows: DataFrame, query: list[float], k: int = 20, metric: str = "l2", where=None, min_score: float | None = None, before: bool = True) -> DataFrame:
    """(id, task_id, score): the k best rows for one vector; min_score cuts before or after the k are taken. Ties go to smaller ids."""
    q = F.array(*[F.lit(float(x)) for x in query])
    out = (rows.filter(where) if where is not None else rows).select("id", "task_id", score(metric, F.col("vec"), q).alias("score"))
    if min_score is not None and before:
        out = out.filter(F.col("score") >= min_score)
    out = out.orderBy(F.desc("score"), "id").limit(k)
    return out.filter(F.col("score") >= min_score) if min_score is not None and not before else out


def _by_length(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The places and values (n, length) of the vectors of each length; null vectors and those that hold a null are left out."""
    n = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat, ends = vectors.flatten(), np.cumsum(n)
    whole = ~vectors.is_null().to_numpy(zero_copy_only=False)
    whole[np.searchsorted(ends, np.nonzero(flat.is_null().to_numpy(zero_copy_only=False))[0], side="right")] = False
    values, places = flat.to_numpy(zero_copy_only=False).astype(np.float64), {k: np.nonzero(whole & (n == k))[0] for k in np.unique(n[whole]).tolist()}
    return {k: (at, values[(ends - n)[at][:, None] + np.arange(k)]) for k, at in places.items()}


def _nearest(query: np.ndarray, guess: np.ndarray, slack: float, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the k nearest vectors: those that the guessed squares of distances leave, measured exactly, number by number in order."""
    near, odd = np.arange(len(ids)), ~np.isfinite(guess)
    if len(ids) - odd.sum() > k:
        near = np.nonzero(odd | (guess <= np.partition(guess[~odd], k - 1)[k - 1] + slack))[0]  # what cannot be guessed is measured
    apart = vectors[near] - query
    distance = np.sqrt(np.cumsum(apart * apart, 1)[:, -1]) if apart.shape[1] else np.zeros(len(near))
    best = np.lexsort((ids[near], distance))[:k]
    return ids[near[best]], distance[best]


def _nearest_each(rows: pa.Table, asked: pa.Table, k: int) -> Iterator[tuple]:
    """(query_id, id, distance) of the k nearest rows to each query; distances to what has another length or no numbers are null and come last."""
    ids, parts = rows["id"].combine_chunks().to_numpy(zero_copy_only=False), _by_length(rows["vec"].combine_chunks())
    names, left = asked["query_id"].to_pylist(), set(range(len(asked)))
    for length, (places, queries) in _by_length(asked["q"].combine_chunks()).items():
        at, vectors = parts.get(length, (np.zeros(0, np.int64), np.zeros((0, length))))
        with np.errstate(all="ignore"):
            squares, others = (vectors * vectors).sum(1), np.sort(np.delete(ids, at))[:k]
        for some in range(0, len(places), 64):  # a few queries' guesses at a time
            q = queries[some : some + 64]
            with np.errstate(all="ignore"):
                guesses = squares - 2 * (q @ vectors.T) + (q * q).sum(1)[:, None]
                slack = 1e-9 * (np.max(squares, initial=0, where=np.isfinite(squares)) + (q * q).sum(1))
                for place, query, guess, more in zip(places[some : some + 64].tolist(), q, guesses, slack):
                    left.discard(place)
                    yield from ((names[place], i, d) for i, d in zip(*(v.tolist() for v in _nearest(query, guess, more, vectors, ids[at], k))))
                    yield from ((names[place], i, None) for i in others.tolist())
    least = np.sort(ids)[:k].tolist()
    yield from ((names[place], i, None) for place in left for i in least)


def top_k_each(rows: DataFrame, queries: DataFrame, k: int = 5, block: int = 1000, part: int = 10_000) -> DataFrame:
    """(query_id, rank, id, score) by L2 for a stated set of queries (query_id, q), which meet all rows in blocks; ties go to smaller ids, null distances last.

    Rows are dealt to parts and queries to blocks, by hash; each block meets each part in one place, so neither side is
    held whole anywhere. A place hands on the k nearest of its part to each of its queries, and the ranks come from these.
    """
    blocks, session = max(1, -(-queries.count() // block)), rows.sparkSession
    parts = max(4 * int(session.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // part))
    spread = lambda c, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")).alias(c)
    asked = queries.select("query_id", "q", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"), spread("part", parts))
    dealt = rows.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), spread("block", blocks))

    def run(part: pa.Table, block: pa.Table) -> pa.Table:
        found = list(_nearest_each(part, block, k)) if len(part) and len(block) else []
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*found)) or [()] * 3, (block["query_id"].type, part["id"].type, pa.float64()))], names=["query_id", "id", "distance"])

    of = {"query_id": queries.schema["query_id"].dataType.simpleString(), "id": rows.schema["id"].dataType.simpleString()}
    pairs = dealt.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(run, f"query_id {of['query_id']}, id {of['id']}, distance double")
    best = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "id")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", V.similarity(F.col("distance")).alias("score"))


def insert(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("task_id").parquet(path)


def insert_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("task_id").json(path)


def scan_jsonl(spark: SparkSession, path: str, schema: str, task_id: int | None = None, k: int | None = None) -> DataFrame:
    """All rows or, pruned to its folder, those of one task; blank lines are skipped. With k, a scan that ends once it has any k rows."""
    rows = spark.read.schema(schema).json(path)
    rows = rows if task_id is None else rows.filter(F.col("task_id") == task_id)
    return rows if k is None else rows.limit(k)


def delete_task(rows: DataFrame, task_id: int) -> tuple[DataFrame, int]:
    """(rows without those of a task, the true number that went)."""
    gone = F.col("task_id") == task_id
    return rows.filter(~gone | F.col("task_id").isNull()), rows.filter(gone).count()


def where(task_id=None, abnormal: bool | None = None):
    """A conjunction of the given conditions."""
    out = F.lit(True)
    if task_id is not None:
        out = out & (F.col("task_id") == task_id)
    if abnormal is not None:
        out = out & (F.col("is_abnormal") == abnormal)
    return out
