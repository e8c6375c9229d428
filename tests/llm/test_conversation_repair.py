"""Conversation repair against a search of all edits, and against SQL; nulls, ties, repeats, empty tables and long conversations."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import conversation_repair as repair

COLUMNS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
SCHEMA = "conv_id long, turn long, role string, text string, at int, letters string, n string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        said = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        out.append("blank" if not BLANK.search(text) else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found, insert=5):
    """The best of all edits whose roles can still become (s?(ua)+)?, with up to two inserts in each place."""
    begun, whole = re.compile(r"s?(ua)*u?\Z"), re.compile(r"(s?(ua)+)?\Z")
    inserts = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    states = [(0, "", [])]
    for (_, role, text), fault in zip([*rows, (None, None, None)], [*found, None]):
        more = []
        for cost, audit, made in states:
            for put in inserts:
                c, a, m = cost + insert * len(put), audit + "I" * len(put), made + [(r, "") for r in put]
                if role is None:
                    more.append((c, a, m))
                    continue
                more.append((c + 2, a + "D", m))
                if fault not in ("blank", "duplicate"):
                    late = 5 * (fault == "truncated")
                    more += [(c + late, a + "K", m + [(role, text)])] + [(c + 1 + late, a + "R", m + [(r, text)]) for r in ("user", "assistant")]
        states = [s for s in more if begun.match("".join(r[:1] or "?" for r, _ in s[2]))]
        least = {}
        for s in states:  # many end alike; only the best of each output's roles can win
            key = "".join(r[:1] for r, _ in s[2])[-1:], len(s[2]) > 0
            least.setdefault(key, []).append(s)
        states = [s for group in least.values() for s in sorted(group, key=lambda s: s[:2])[:400]]
    return min((s for s in states if whole.match("".join(r[:1] or "?" for r, _ in s[2]))), key=lambda s: s[:2])


def damaged(conv, rows):
    out = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit:
            out += [(turn, "user" if hit == 4 else role, "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text)] * (2 if hit == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))


def expected(conversations, damage=True):
    out = Counter()
    for conv, rows in conversations.items():
        rows = damaged(conv, rows) if damage else rows
        found = faults(rows)
        turns = {t for t, _, _ in rows if t is not None}
        cost, audit, made = cheapest(rows, found)
        initials = [r[:1] for _, r, _ in rows]
        out[(conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[found.count(f) for f in ("blank", "duplicate", "truncated")],
             sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())] += 1
    return out


@pytest.fixture(scope="module")
def conversations():
    rng = np.random.default_rng(12)
    texts = ["Done.", "Why?", "cut off", "", " \t", "Hello!\n", "é. ", None, "Done.", "no end\x0b", "."]
    roles = ["user", "assistant", "system", "tool", None, "", "user", "assistant", "Assistant", "umpire"]
    made = {}
    for conv in [None, *range(120)]:
        n = int(rng.integers(0, 7)) if conv is not None else 6
        turns = [None if rng.random() < 0.1 else int(i + (i > 2) * 3) for i in range(n)]
        made[conv] = [(t, roles[rng.integers(len(roles))], texts[rng.integers(len(texts))]) for t in turns]
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    made[gone] = [(0, "user", "All is lost.")]
    return {c: r for c, r in made.items() if r}


def frame(spark, conversations):
    rows = [(c, t, r, x, 1, "x", "y") for c, turns in conversations.items() for t, r, x in turns]
    return spark.createDataFrame(rows, SCHEMA)


def written(spark, path, conversations):
    frame(spark, conversations).write.parquet(f"{path}/conversations.parquet")
    return str(path)


def test_equals_all_edits_and_sql(spark, conversations, tmp_path):
    at = written(spark, tmp_path, conversations)
    found = Counter(map(tuple, repair.op12_conversation_repair(spark, at).select(COLUMNS).collect()))
    assert found == expected(conversations)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{at}/conversations.parquet/*.parquet'")
    assert found == Counter(con.execute(f"select {', '.join(COLUMNS)} from ({repair.ORACLE_SQL})").fetchall())
    assert any(r[7] == "" and r[6] == 0 for r in found)


def test_blocks_merge_to_the_same(spark, conversations, tmp_path, monkeypatch):
    long = dict(conversations)
    rng = np.random.default_rng(5)
    said = [f"Turn {i}." for i in range(40)]
    long[5000] = [(i // 2, ["user", "assistant", "system"][rng.integers(3)], said[rng.integers(40)] if rng.random() < 0.4 else f"Own {i}{'.' * int(rng.integers(2))}") for i in range(900)]
    at = written(spark, tmp_path, long)
    whole = sorted(map(str, repair.op12_conversation_repair(spark, at).collect()))
    monkeypatch.setattr(repair, "BLOCK_BITS", 2)
    monkeypatch.setattr(repair, "ARITY_BITS", 1)
    assert sorted(map(str, repair.op12_conversation_repair(spark, at).collect())) == whole


def test_products_are_associative():
    rng = np.random.default_rng(1)
    kinds = [(i, f) for i in ("s", "u", "a", "") for f in ("", "blank", "truncated", "duplicate")]
    for _ in range(60):
        run = [repair.turn_matrix(*kinds[k]) for k in rng.integers(len(kinds), size=7)]
        left = run[0]
        for m in run[1:]:
            left = repair.product(left, m)
        cut = int(rng.integers(1, 6))
        halves = [run[:cut], run[cut:]]
        for i, half in enumerate(halves):
            right = half[-1]
            for m in half[-2::-1]:
                right = repair.product(m, right)
            halves[i] = right
        assert repair.product(*halves) == left


def test_inserts_where_they_are_cheap(conversations, monkeypatch):
    """At the contract's costs an insert never pays; at a lower one it does."""
    monkeypatch.setattr(repair, "INSERT", 1)
    with_inserts = 0
    for rows in list(conversations.values())[:60]:
        rows = [(t, r or "", x or "") for t, r, x in rows][:4]
        found = faults(rows)
        whole = repair.identity()
        for (_, role, _), fault in zip(rows, found):
            whole = repair.product(whole, repair.turn_matrix(role[:1], fault))
        ends = repair.product(whole, repair.closure())[repair.START]
        cost, letters = min(x for x in (ends[repair.START], ends[repair.ASSISTANT]) if x is not None)
        audit = letters.translate(str.maketrans("JS", "IR"))
        assert (cost, audit) == cheapest(rows, found, 1)[:2]
        with_inserts += "I" in audit
    assert with_inserts


def test_repaired_texts(spark):
    rows = [(1, 1, "assistant", "Hi."), (1, 2, "user", "Yes."), (1, 3, "user", "No"), (2, 0, "user", "Alone here."), (2, 1, "user", "Alone here.")]
    turns, report, edits = repair.repair_plan(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    made = {}
    for r in repair.repaired(turns, edits).orderBy("conv_id", "ordinal", "step").collect():
        made.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert made == {1: [("user", "Hi."), ("assistant", "Yes.")]}
    assert {r["conv_id"]: (r["cost"], r["letters"]) for r in report.collect()} == {1: (4, "SRD"), 2: (4, "DD")}


def test_empty_table(spark, tmp_path):
    frame(spark, {}).write.parquet(f"{tmp_path}/conversations.parquet")
    assert repair.op12_conversation_repair(spark, str(tmp_path)).count() == 0
    assert repair.repair_plan(frame(spark, {}).select(F.col("*")))[1].count() == 0
