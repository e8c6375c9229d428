"""Top-k of many queries: as a plain search has it, however the rows are dealt."""

import math

import pytest
from pyspark.sql import functions as F

from tessella.operators import search

ODD = {0: None, 7: [1.0], 14: [None, 2.0], 21: [float("nan"), 1.0], 28: [], 35: [float("inf"), 0.0], 42: [1e200, 0.0]}


def plain(rows, query, k):
    def key(row):
        i, v = row
        if v is None or query is None or len(v) != len(query) or None in (*v, *query):
            return 2, 0.0, i
        d = math.sqrt(sum((a - b) * (a - b) for a, b in zip(v, query)))
        return (1, 0.0, i) if math.isnan(d) else (0, d, i)

    return [r[0] for r in sorted(rows, key=key)[:k]]


@pytest.mark.parametrize("block, part", [(1000, 10_000), (3, 9)])
def test_top_k_each(spark, block, part):
    rows = [(i, ODD.get(i, [float(i * 7 % 10), float(i * 3 % 4)])) for i in range(120)]
    asked = [r for r in rows if r[0] % 7 == 0]
    table = spark.createDataFrame(rows, "id long, vec array<double>")
    queries = table.filter("id % 7 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("q"))
    found = {}
    for r in search.top_k_each(table, queries, 5, block, part).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["id"])
    assert found == {i: plain(rows, v, 5) for i, v in asked}


def test_only_the_nearest_of_a_part_are_ranked(spark, capsys):
    table = spark.createDataFrame([(1, [1.0])], "id long, vec array<double>")
    search.top_k_each(table, table.select(F.col("id").alias("query_id"), F.col("vec").alias("q"))).explain()
    plan = capsys.readouterr().out
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan and "aggregate(" not in plan
