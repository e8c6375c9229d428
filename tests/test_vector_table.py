"""The stored vector table: counts, commits that are whole or nothing, deletes, and inverted lists against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.sources import vector_table as table

SCHEMA = "id long, task_id int, vec array<double>"


def files(root):
    return sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file())


def test_counts_replay_and_delete(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = [(1, 1, [1.0, 2.0]), (2, 1, [1.0]), (3, 2, None), (4, 2, [1.0, None]), (5, 2, [0.0, float("nan")]), (None, 2, [1.0, 1.0]), (6, None, [1.0, 1.0]), (7, 2, [3.0, 4.0]), (7, 2, [3.0, 4.0]), (8, 3, [float("inf"), 0.0])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", other string").repartition(3)
    assert table.insert(frame, root, "a", 2) == {"inserted": 3, "failed": 7}
    before = files(tmp_path)
    assert table.insert(frame, root, "a", 2) == {"inserted": 3, "failed": 7} and files(tmp_path) == before
    assert table.insert(frame.filter("id = 1"), root, "b", 2) == {"inserted": 1, "failed": 0}
    assert table.insert(frame.limit(0), root, "c", 2) == {"inserted": 0, "failed": 0}
    assert sorted(r["id"] for r in table.stored(spark, root).collect()) == [1, 1, 7, 7]
    assert table.delete(spark, root, 9) == 0 and table.delete(spark, root, 2, F.col("vec")[0] == 5) == 0
    assert table.delete(spark, root, 1, F.col("id").isNull()) == 0
    assert table.delete(spark, root, 2) == 2 and table.stored(spark, root).count() == 2
    assert not (tmp_path / "t" / "task_id=2").exists() and not (tmp_path / "t" / "_staging" / "a").exists()


def test_partial_delete_leaves_other_folders(spark, tmp_path):
    root = str(tmp_path / "t")
    table.insert(spark.range(40).select("id", (F.col("id") % 2).cast("int").alias("task_id"), F.array(F.col("id").cast("double")).alias("vec")), root, "a", 1)
    other = files(tmp_path / "t" / "task_id=0")
    assert table.delete(spark, root, 1, F.col("id") < 20) == 10
    assert sorted(r["id"] for r in table.stored(spark, root).collect()) == sorted([*range(0, 40, 2), *range(21, 40, 2)])
    assert files(tmp_path / "t" / "task_id=0") == other
    plan = table.stored(spark, root).filter("task_id = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(task_id" in plan


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    root = tmp_path / "t"
    broken = spark.range(0, 100, 1, 4).select("id", F.lit(1).alias("task_id"), F.array(F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise(F.lit(1.0))).alias("vec"))
    with pytest.raises(Exception, match="lost"):
        table.insert(broken, str(root), "a", 1)
    assert not [f for f in files(root) if f.endswith((".parquet", ".json")) and not f.startswith("_staging")]  # tasks that still ran may have staged files
    assert table.insert(broken.filter("id < 90"), str(root), "a", 1) == {"inserted": 90, "failed": 0}
    assert table.stored(spark, str(root)).count() == 90 and not [f for f in files(root) if f.startswith("_staging")]


def test_a_halfway_commit_is_undone(spark, tmp_path):
    root = tmp_path / "t"
    rows = spark.createDataFrame([(i, 1, [float(i)]) for i in range(10)], SCHEMA)
    table.insert(rows, str(root), "a", 1)
    (root / "_commits" / "a.json").unlink()  # as if the driver had died before the record
    assert table.insert(rows, str(root), "a", 1) == {"inserted": 10, "failed": 0} and table.stored(spark, str(root)).count() == 10


@pytest.mark.parametrize("clustered", [True, False])
def test_inverted_lists(spark, tmp_path, clustered):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 16)) * (4 if clustered else 0)
    vectors = centres[rng.integers(30, size=3000)] + rng.normal(size=(3000, 16)) * (0.5 if clustered else 1)
    rows = spark.createDataFrame([(i, i % 7, v.tolist()) for i, v in enumerate(vectors)], SCHEMA).repartition(4)
    folder = str(tmp_path)
    table.build_lists(rows, folder, nlist=32)
    assert sorted(r["id"] for r in spark.read.parquet(f"{folder}/lists").select("id").collect()) == list(range(3000))
    hits = 0
    for q in range(0, 3000, 400):
        truth = np.argsort(np.linalg.norm(vectors - vectors[q], axis=1), kind="stable")[:20].tolist()
        assert [r["id"] for r in table.search_lists(spark, folder, vectors[q].tolist(), exact=True).collect()] == truth
        hits += len(set(truth) & {r["id"] for r in table.search_lists(spark, folder, vectors[q].tolist(), nprobe=8).collect()})
    assert hits / 160 >= (0.9 if clustered else 0.6)
    found = table.search_lists(spark, folder, vectors[0].tolist(), nprobe=4)
    found.collect()
    scan = [n for n in str(found._jdf.queryExecution().executedPlan()).splitlines() if "FileScan" in n]
    assert len(scan) == 1 and len(re.search(r"PartitionFilters: \[list#\d+ IN \(([\d,]+)\)\]", scan[0])[1].split(",")) == 4
    assert table.search_lists(spark, folder, vectors[0].tolist(), k=3000, nprobe=1).count() == 3000
