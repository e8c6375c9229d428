"""Frames by a stream sink, exactly once; results to pending requests over tables and streams."""

import datetime as dt
from contextlib import nullcontext
from types import SimpleNamespace

from tessella.streaming import frames, pending, state

START = dt.datetime(2024, 1, 1)


def test_a_batch_that_runs_again_replaces_its_files(spark, tmp_path):
    writer = frames.FrameWriter(str(tmp_path))
    rows = [SimpleNamespace(task_id=t, at=a, event_id=e, body=b) for t, a, e, b in [("b", 2, 1, "é2"), ("b", 1, 5, "1"), ("a/x y", 9, 1, ""), (None, 0, 0, "none"), ("b", 2, 0, "2")]]
    writer.commit([writer.write(iter(rows)), writer.write(iter([]))], 0)
    writer.commit([writer.write(iter(rows))], 0)  # the same batch, after a restart
    again = writer.write(iter(rows[:2]))
    writer.abort([again, None], 1)
    writer.commit([writer.write(iter([SimpleNamespace(task_id="b", at=0, event_id=0, body="next batch")]))], 1)
    found = {}
    for r in frames.read_frames(spark, str(tmp_path)).orderBy("seq").collect():
        found.setdefault(r["task_id"], []).append(r["body"])
    assert found == {"b": ["1", "2", "é2", "next batch"], "a/x y": [""], "": ["none"]}
    assert not list((tmp_path / "_staging").iterdir())


def test_a_commit_that_ended_halfway(spark, tmp_path):
    writer = frames.FrameWriter(str(tmp_path))
    rows = [SimpleNamespace(task_id=t, at=1, event_id=1, body=t) for t in "abc"]
    writer.commit([writer.write(iter(rows))], 3)
    (tmp_path / "_batches" / f"{3:012d}").unlink()
    (tmp_path / "task=b" / f"{3:012d}.bin").unlink()  # as if the driver had died between two moves
    writer.commit([writer.write(iter(rows))], 3)
    assert sorted(r["body"] for r in frames.read_frames(spark, str(tmp_path)).collect()) == ["a", "b", "c"]


def test_frames_are_found_by_marks_and_read_in_order(spark, tmp_path, capsys):
    writer = frames.FrameWriter(str(tmp_path))
    for batch in range(12):
        rows = [SimpleNamespace(task_id=t, at=batch, event_id=e, body=f"{t} {batch} {e}") for t in ("a", "ab/é %", "a=1") for e in range(500)]
        writer.commit([writer.write(iter(rows)), None], batch)
    writer.commit([writer.write(iter([]))], 12)
    (tmp_path / "task=z").mkdir()
    (tmp_path / "task=z" / f"{13:012d}.bin").write_bytes(b"")  # of a batch that has no mark
    read = frames.read_frames(spark, str(tmp_path))
    found = {}
    for r in sorted(read.collect(), key=lambda r: r.seq):
        found.setdefault(r.task_id, []).append((r.seq, r.body))
    assert found == {t: [(b * 500 + e + 1, f"{t} {b} {e}") for b in range(12) for e in range(500)] for t in ("a", "ab/é %", "a=1")}
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("read_frames", "")
    frames.read_frames(spark, str(tmp_path)).count()
    tasks = sum(jobs.getStageInfo(s).numTasks for j in jobs.getJobIdsForGroup("read_frames") for s in jobs.getJobInfo(j).stageIds)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    frames.read_frames(spark, str(tmp_path)).explain()
    plan = capsys.readouterr().out
    assert tasks < 40 and "binaryFile" not in plan and "Window" not in plan and plan.count("Exchange") == 1


def test_pending_over_streams_equals_tables(spark, tmp_path):
    minutes = lambda n: START + dt.timedelta(minutes=n)
    requests = [(1, minutes(0)), (2, minutes(5)), (3, minutes(10)), (None, minutes(11)), (4, minutes(300)), (99, minutes(9000))]
    results = [(10, 1, minutes(30), 1.0), (11, 1, minutes(20), 2.0), (12, 2, minutes(126), 3.0), (13, 7, minutes(40), 4.0), (14, None, minutes(41), 5.0), (15, 4, minutes(299), 6.0), (16, 4, minutes(300), 7.0), (98, 98, minutes(9000), 0.0)]
    asked = spark.createDataFrame(requests, "request_id long, at timestamp")
    came = spark.createDataFrame(results, "result_id long, answer_to long, answered_at timestamp, value double")
    status = lambda rows: sorted((str(r["request_id"]), str(r["result_id"]), r["status"]) for r in rows.collect() if r["request_id"] not in (98, 99))
    table = status(pending.settled(pending.answered(asked, came)))
    assert table == sorted([("1", "11", "done"), ("1", "10", "repeated"), ("2", "None", "timeout"), ("2", "12", "unknown"), ("3", "None", "timeout"), ("None", "None", "timeout"), ("7", "13", "unknown"), ("None", "14", "unknown"), ("4", "15", "unknown"), ("4", "16", "done")])
    for i, late in enumerate((200, 20000)):
        for rows, at, name in ((asked, "at", "q"), (came, "answered_at", "r")):
            cut = f"{at} < timestamp'{minutes(late)}' AND {at} >= timestamp'{minutes(-1 if i == 0 else 200)}'"
            rows.filter(cut).write.parquet(f"{tmp_path}/{name}/{i}")
        stream = lambda name, rows: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/{name}/*")
        pairs = state.written(pending.answered(stream("q", asked), stream("r", came)), f"{tmp_path}/run", "append", nullcontext)
    assert status(pending.settled(pairs.drop("batch"))) == table
