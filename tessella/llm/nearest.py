"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, as flat neighbour arrays; shard results merge."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table

#: Links of a node above the ground level (twice that on it), candidates kept while building and searching, vectors of a shard, queries of a block.
LINKS, BUILD, SEARCH, SHARD, BLOCK, NEAREST, SEED = 12, 64, 96, 4096, 1024, 10, 9


class Graph:
    """Flat arrays: x (n, d); for each level the member rows and neighbours (rows, LINKS or 2 * LINKS), -1 for none."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.level = np.minimum((-np.log(1 - np.random.default_rng(SEED).random(len(x))) / math.log(LINKS)).astype(np.int64), 8)
        self.level[0] = self.level.max()
        self.links = [np.full((len(x), 2 * LINKS if k == 0 else LINKS), -1, np.int32) for k in range(self.level.max() + 1)]
        self.seen = np.zeros(len(x), np.int32)
        self.stamp = 0
        for i in range(1, len(x)):
            self._insert(i)

    def search(self, q: np.ndarray, start: list[tuple[float, int]], keep: int, level: int) -> list[tuple[float, int]]:
        """The nearest `keep` nodes found on a level from the start nodes, as (squared distance, node), ascending."""
        x, links, seen = self.x, self.links[level], self.seen
        self.stamp += 1
        stamp = self.stamp
        todo, best = list(start), [(-d, i) for d, i in start]
        for _, i in start:
            seen[i] = stamp
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= keep and d > -best[0][0]:
                break
            near = links[i]
            near = near[near >= 0]
            near = near[seen[near] != stamp]
            if not len(near):
                continue
            seen[near] = stamp
            away = x[near] - q
            for e, j in zip(np.einsum("ij,ij->i", away, away).tolist(), near.tolist()):
                if len(best) < keep:
                    heapq.heappush(best, (-e, j))
                    heapq.heappush(todo, (e, j))
                elif e < -best[0][0]:
                    heapq.heapreplace(best, (-e, j))
                    heapq.heappush(todo, (e, j))
        return sorted((-d, i) for d, i in best)

    def _enter(self, q: np.ndarray, to: int) -> list[tuple[float, int]]:
        away = self.x[0] - q
        at = [(float(away @ away), 0)]
        for level in range(int(self.level[0]), to, -1):
            at = self.search(q, at, 1, level)[:1]
        return at

    def _insert(self, i: int) -> None:
        q = self.x[i]
        at = self._enter(q, int(self.level[i]))
        for level in range(int(self.level[i]), -1, -1):
            at = self.search(q, at, BUILD, level)
            rows = np.array([j for _, j in at])
            far = self.x[rows]
            chosen: list[int] = []
            closest = np.full(len(rows), np.inf)
            for k, (d, _) in enumerate(at):  # a neighbour nearer to a chosen one than to q adds little
                if d <= closest[k]:
                    chosen.append(k)
                    if len(chosen) == LINKS:
                        break
                    away = far - far[k]
                    closest = np.minimum(closest, np.einsum("ij,ij->i", away, away))
            chosen += [k for k in range(min(len(at), LINKS)) if k not in chosen][: max(0, LINKS // 2 - len(chosen))]
            links = self.links[level]
            links[i, : len(chosen)] = rows[chosen]
            for k in chosen:
                j = rows[k]
                free = np.nonzero(links[j] < 0)[0]
                if len(free):
                    links[j, free[0]] = i
                    continue
                away = self.x[links[j]] - self.x[j]
                dist = np.einsum("ij,ij->i", away, away)
                if dist[worst := int(dist.argmax())] > at[k][0]:
                    links[j, worst] = i

    def nearest(self, q: np.ndarray, k: int) -> list[int]:
        return [i for _, i in self.search(q, self._enter(q, 0), max(k, SEARCH), 0)[:k]]


def usable(vector):
    """Not null, no null or non-finite component, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


INDEX = "shard int, n int, d int, x binary, level binary, links array<binary>"


def build_index(vectors: DataFrame) -> DataFrame:
    """Distinct vectors (d, shard, node, x), d being their length, to one row (INDEX) and its nodes for each length and shard, built by one task for each."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.array(rows["x"].tolist(), np.float64)
        g = Graph(x)
        return pd.DataFrame([{"shard": rows["shard"].iloc[0], "n": x.shape[0], "d": x.shape[1], "x": x.tobytes(), "level": g.level.tobytes(), "links": [a.tobytes() for a in g.links], "nodes": rows["node"].tolist()}])

    return vectors.groupBy("d", "shard").applyInPandas(build, INDEX + ", nodes array<long>")


def _search(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "node": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    if not len(index) or not len(queries):
        return empty
    row = index.iloc[0]
    g = Graph.__new__(Graph)
    g.x = np.frombuffer(row["x"], np.float64).reshape(row["n"], row["d"])
    g.level = np.frombuffer(row["level"], np.int64)
    g.links = [np.frombuffer(a, np.int32).reshape(row["n"], -1) for a in row["links"]]
    g.seen, g.stamp, nodes, out = np.zeros(row["n"], np.int32), 0, np.asarray(row["nodes"]), []
    for query_id, q in zip(queries["query_id"], queries["q"]):
        q = np.asarray(q, np.float64)
        for i in g.nearest(q, NEAREST + 1):  # one more, for the query's own vector
            out.append((query_id, nodes[i], math.sqrt(float(((g.x[i] - q) ** 2).sum()))))
    return pd.DataFrame(out, columns=["query_id", "node", "score"]) if out else empty


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of `vectors` found for each row of `queries`, by Euclidean distance.

    Equal vectors are one node of a graph with their k + 1 smallest ids, as ties go to smaller ids and no query can need
    more. Shards hold equal shares of the nodes, so their number grows with the table; a block of queries meets each
    shard in one task. Vectors that are null, zero or hold null or non-finite components take no part, nor do rows
    without id; vectors are compared with those of their own length only,
    of which there may be any number. A row is no neighbour of its own id; rows that repeat an id and its vector count
    once. An id with several vectors is a candidate with each, and asks with each, its neighbours in one ranking. Fewer
    candidates than k: all that are found. Other columns are not read.
    """
    assert k <= NEAREST
    as_double = F.col(vector).cast("array<double>")
    rows = vectors.filter(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), as_double.alias("x"))
    rows = stage(rows.withColumn("node", F.xxhash64("x")).distinct(), "vectors")
    firsts = rows.select("node", "vec_id").withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    firsts = firsts.select("node", "vec_id")
    distinct = rows.groupBy("node").agg(F.first("x").alias("x"))
    shards = max(1, -(-rows.count() // SHARD))
    placed = distinct.withColumn("d", F.size("x")).withColumn("shard", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(shards)).cast("int"))
    # Few bytes, but long work for each shard: a given number of partitions keeps them from being merged into few tasks.
    index = stage(build_index(placed.select("d", "shard", "node", "x").repartition(2 * shards, "d", "shard")), "index")
    asked = queries.filter(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("query_id"), as_double.alias("q")).distinct()
    blocks = max(1, -(-asked.count() // BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    asked = asked.select(F.size("q").alias("d"), every.alias("shard"), "block", "query_id", "q")
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = index.groupBy("d", "shard", "block").cogroup(asked.groupBy("d", "shard", "block")).applyInPandas(_search, "query_id long, node long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.join(firsts, "node").filter("vec_id != query_id").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.filter("vec_id % 100 = 0"))
