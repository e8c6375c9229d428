"""Keyed stream state against a plain fold, over several runs from one checkpoint."""

import datetime as dt
import random

from tessella.config import TERMINAL
from tessella.streaming import state

SCHEMA = "task_id string, ts timestamp, event_id long, state string, progress double, tile_no int, value double"
START = dt.datetime(2024, 5, 1)


def folded(rows, end):
    """{task: (state, progress, n_events, ignored, idle)} by one pass in order; end: the last watermark in milliseconds."""
    out, idle_ms = {}, state.IDLE_MS
    ms = lambda ts: int((ts - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
    for task in {r[0] for r in rows}:
        held, last = [None, None, 0, 0, 0], None
        for r in sorted((r for r in rows if r[0] == task), key=lambda r: (r[1], r[2])):
            if held[0] in TERMINAL:
                held[3] += 1
                continue
            held[4] += last is not None and ms(r[1]) > last + idle_ms
            held[:3] = r[3], held[1] if r[4] is None else r[4], held[2] + 1
            last = ms(r[1])
        held[4] += held[0] not in TERMINAL and end >= last + idle_ms
        out[task] = tuple(held)
    return out


def test_states_and_cells_over_restarts(spark, tmp_path):
    rng, rows = random.Random(3), []
    states = ["pending", "reading", "stitching", "reading", None, "completed", "failed", "cancelled"]
    for i in range(300):
        ts = START + dt.timedelta(minutes=10 * (i // 2))  # pairs of one time
        rows.append((f"task-{rng.randrange(12)}", ts, 1000 - i, rng.choices(states, [5, 5, 5, 5, 2, 1, 1, 1])[0], rng.choice([None, float(i)]), i % 9, rng.choice([None, i / 4])))
    rows.append((None, START + dt.timedelta(minutes=20), 5000, "reading", 1.0, 1, 2.0))
    for i in range(3):
        part = [r for r in rows if i <= (r[1] - START) / dt.timedelta(minutes=505) < i + 1]
        spark.createDataFrame(part, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/in/{i}")
        stream = lambda: spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*")
        tasks = state.written(state.task_states(stream()), f"{tmp_path}/tasks", "update")
        cells = state.written(state.cell_lists(stream()), f"{tmp_path}/cells", "append")
    end = max(r[1] for r in rows) - dt.timedelta(minutes=10)
    found = {r["task_id"]: (r["state"], r["progress"], r["n_events"], r["ignored"], r["idle"]) for r in state.newest(tasks).collect()}
    expected = folded(rows, (end - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
    assert found == expected and any(v[3] for v in expected.values()) and any(v[4] for v in expected.values())
    listed = {}
    for r in cells.orderBy("cell_no").collect():
        listed.setdefault(r["task_id"], []).append((r["cell_no"], r["event_id"], r["total"]))
    for task in {r[0] for r in rows}:
        total, own = 0.0, []
        for n, r in enumerate(sorted((r for r in rows if r[0] == task), key=lambda r: (r[1], r[2])), 1):
            total += r[6] or 0.0
            own.append((n, r[2], total))
        assert listed[task] == own
