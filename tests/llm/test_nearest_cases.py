"""Nearest neighbours of ids with several vectors, and of repeated rows."""

from tessella.llm import nearest


def test_an_id_with_several_vectors(spark):
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (2, [0.0, 5.0]), (3, [0.0, 3.5]), (None, [0.0, 1.0]), (4, [0.0, None]), (5, [0.0, 0.0])]
    v = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    found = {}
    for r in nearest.nearest_neighbours(v, v.filter("vec_id <= 2")).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert found[1] == [(1, 2, 1.0), (2, 3, 2.5), (3, 2, 4.0)]
    assert found[2] == [(1, 1, 1.0), (2, 3, 1.5), (3, 3, 1.5), (4, 1, 4.0)]
