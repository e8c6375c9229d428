"""Line deduplication against brute force, with null ids, repeated rows, empty and long texts, and clashing columns."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import line_dedup

BLANKS = " \t\n\v\f\r"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows):
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(BLANKS).translate(UP)
            if len(key) >= 10:
                holders.setdefault(key, set()).add(doc)
    out = Counter()
    for doc, text in rows:
        lines = (text or "").split("\n")

        def stays(line):
            held = holders.get(line.strip(BLANKS).translate(UP), set())
            return not held or doc == min((d for d in held if d is not None), default=None)

        kept = [line for line in lines if stays(line)]
        out[doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


def found(rows):
    digest = F.sha2(line_dedup.kept_text(F.col("text"), F.col("keep")).cast("binary"), 256)
    return Counter(tuple(r) for r in rows.select("doc_id", "n_lines", "n_dropped", digest).collect())


@pytest.fixture
def rows():
    rng = np.random.default_rng(13)
    pool = [f"Line {i} of the pool" for i in range(40)] + ["short", "", " \t", "ÀÉÎ straße ünï", "exactly10!", "nine char", "x\ty\x0bz and more", "   Line 3 OF the pool\r"]
    made = [(int(i), "\n".join(pool[j] for j in rng.integers(0, len(pool), rng.integers(1, 30)))) for i in rng.permutation(60)]
    made += [(None, None), (None, ""), (None, "only the null id holds this\nLine 3 of the pool"), (None, "only the null id holds this"), (7, None)]
    made += [(61, "a line said twice here\nother text of it\na line said twice here"), (62, "A LINE said twice here\nAnd once"), made[3], made[3]]
    made.append((63, "\n".join(f"hot line of many {i % 7}" for i in range(20_000))))
    return made + [(100 + i, f"hot line of many 0\nown line number {i}") for i in range(300)]


@pytest.mark.parametrize("frequent", [1000, 3])
def test_equals_brute_force(spark, rows, frequent, monkeypatch):
    monkeypatch.setattr(line_dedup, "FREQUENT", frequent)
    docs = spark.createDataFrame([(d, t, 1, "x", "y") for d, t in rows], "doc_id long, text string, _pos int, keep string, _t1 string")
    assert found(line_dedup.dedup_lines(docs)) == expected(rows)


def test_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bitmap_of_runs(spark):
    cases = [[0], [3], [0, 1, 2], [0, 2, 4], [1, 2, 5, 6, 7, 9], []]
    got = spark.createDataFrame([(c,) for c in cases], "d array<int>").select("d", line_dedup.runs(F.col("d")).alias("r")).collect()
    for r in got:
        flags = [i % 2 == 1 for i, n in enumerate(r["r"]) for _ in range(n)]
        assert [i for i, gone in enumerate(flags) if gone] == r["d"]


def test_sql_and_plan(spark):
    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{at}/documents.parquet'")
    out = line_dedup.op13_line_dedup(spark, at)
    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert Counter(map(tuple, out.select(names).collect())) == Counter(con.execute(f"select {', '.join(names)} from ({line_dedup.ORACLE_SQL})").fetchall())
    plan = line_dedup.repeated_lines(line_dedup.hashed_lines(spark.read.parquet(f"{at}/documents.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(_h1" in plan and "Python" not in plan
