"""Conversation repair: each turn is a 4x4 matrix over (cost, audit), a conversation their min-plus product, reduced as a tree across partitions."""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, WORD, stage, table

#: What an edit costs; a truncated turn that stays costs TRUNCATED more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing so far, after system, after user, after assistant. The first and the last may end a conversation.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Edits as letters that sort like their initials D < I < K < R and say the new role: I and J insert an assistant and a user
#: turn, R and S make a turn assistant and user. After equal edits from one state only one letter of each pair can follow.
INITIALS = ("JS", "IR")
#: Turns of a block, which one task reduces in memory, and blocks that one step of the tree merges.
BLOCK_BITS, ARITY_BITS = 10, 4


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the contract's damage by crc32 of `conv_id:turn`; null roles, texts and parts of that key are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20).alias("_hit")
    role, text = F.when(F.col("_hit") == 4, "user").otherwise(blank("role")), blank("text")
    text = F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    made = rows.select("conv_id", "turn", "role", "text", hit).filter(F.col("_hit") != 0)
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("_hit") == 3, 2).otherwise(1))).alias("_copy")
    return made.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), times).drop("_copy")


def ordered(rows: DataFrame) -> DataFrame:
    """(at, conv_id, turn, role, text, digest), staged; at numbers all rows by conversation, turn (null first), role and the text's digest.

    Ranges of this order, equal rows told apart by a row number, are as even as can be, whatever a conversation's length.
    A conversation's rows in one range have consecutive numbers.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    by = ["conv_id", "turn", "role", "digest", "_row"]
    return stage(rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("_row").withColumn("at", F.monotonically_increasing_id()), "turns")


def faulted(turns: DataFrame) -> DataFrame:
    """(at, conv_id, turn, initial, fault) of ordered(): fault is blank, duplicate, truncated or empty, the first that holds.

    The least number of each role and text of a conversation is its first occurrence; as it meets the rows by number, no
    hot text meets in one task.
    """
    firsts = turns.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    last = F.right(F.regexp_replace("text", SPACES + r"\z", ""), F.lit(1))
    narrow = turns.select("at", "conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), F.col("text").rlike(WORD).alias("said"), last.isin(".", "!", "?").alias("ended"))
    fault = F.when(~F.col("said"), "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("ended"), "truncated").otherwise("")
    return narrow.join(firsts, "at", "left").select("at", "conv_id", "turn", "initial", fault.alias("fault"))


NONE = [[None] * 4 for _ in range(4)]


def identity() -> list:
    return [[(0, "") if i == j else None for j in range(4)] for i in range(4)]


def product(a: list, b: list) -> list:
    """The least (cost, audit) of each pair of states through any state between.

    Costs add and audits join. Of equal costs the least audit is taken; no audit of equal cost for the same turns begins
    with another, as what it has more would be inserts, which cost. So joining keeps their order on both sides, and the
    product is associative.
    """
    out = []
    for row in a:
        line = []
        for j in range(4):
            best = None
            for first, rest in zip(row, b):
                if first is not None and (then := rest[j]) is not None:
                    cost = first[0] + then[0]
                    if best is None or cost < best[0] or cost == best[0] and first[1] + then[1] < best[1]:
                        best = (cost, first[1] + then[1])
            line.append(best)
        out.append(line)
    return out


def closure() -> list:
    """Any number of inserts: more than two never pay."""
    step = [list(r) for r in NONE]
    for state in (START, SYSTEM, ASSISTANT):
        step[state][USER] = (INSERT, "J")
    step[USER][ASSISTANT] = (INSERT, "I")
    either = [[min((x for x in (one, other) if x is not None), default=None) for one, other in zip(*pair)] for pair in zip(identity(), step)]
    return product(either, either)


def turn_matrix(initial: str, fault: str) -> list:
    """Inserts, then one turn: deleted, kept as it is, or under another role."""
    out = [[(DELETE, "D") if i == j else None for j in range(4)] for i in range(4)]
    if fault not in ("blank", "duplicate"):
        stays = TRUNCATED if fault == "truncated" else 0
        moves = [(state, USER, "u", "S") for state in (START, SYSTEM, ASSISTANT)] + [(USER, ASSISTANT, "a", "R"), (START, SYSTEM, "s", "")]
        for before, after, kept, rerole in moves:
            ways = [(KEEP + stays, "K")] if initial == kept else []
            ways += [(REROLE + stays, rerole)] if rerole else []
            ways += [out[before][after]] if out[before][after] else []
            out[before][after] = min(ways, default=None)
    return product(closure(), out)


#: What is known of a run of turns; two neighbouring runs give that of both.
SUMMARY = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
    ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("least", pa.int64()), ("most", pa.int64()), ("turns", pa.int64()),
    ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())),
])
SUMMARY_SQL = """conv_id long, part long, at long, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, least long, most long, turns long,
costs array<long>, audits array<string>"""
LEGAL = ("su", "ua", "au")
_MATRICES: dict = {}


def _lifted(row: dict) -> dict:
    """A turn as a summary."""
    key = (row["initial"] if row["initial"] in ("s", "u", "a") else "", row["fault"])
    if key not in _MATRICES:
        _MATRICES[key] = turn_matrix(*key)
    counts = {k: int(row["fault"] == k) for k in ("blank", "duplicate", "truncated")}
    turn = row["turn"]
    return {"at": row["at"], "n": 1, **counts, "illegal": 0, "first": row["initial"], "last": row["initial"], "least": turn, "most": turn, "turns": int(turn is not None), "matrix": _MATRICES[key]}


def _joined(a: dict, b: dict) -> dict:
    """Two neighbouring runs as one."""
    out = {k: a[k] + b[k] for k in ("n", "blank", "duplicate", "truncated", "illegal", "turns")}
    out["illegal"] += (a["last"] + b["first"]) not in LEGAL
    out["turns"] -= a["most"] is not None and a["most"] == b["least"]
    least, most = a["least"] if a["least"] is not None else b["least"], b["most"] if b["most"] is not None else a["most"]
    return {**out, "at": a["at"], "first": a["first"], "last": b["last"], "least": least, "most": most, "matrix": product(a["matrix"], b["matrix"])}


def tree(runs: list) -> dict:
    """Neighbours joined level by level."""
    while len(runs) > 1:
        runs = [_joined(*runs[i : i + 2]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0]


def _flat(conv, part, run: dict) -> dict:
    cells = [c for row in run["matrix"] for c in row]
    own = {k: v for k, v in run.items() if k != "matrix"}
    return {"conv_id": conv, "part": part, **own, "costs": [None if c is None else c[0] for c in cells], "audits": [None if c is None else c[1] for c in cells]}


def _unflat(row: dict) -> dict:
    cells = [None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"])]
    return {**row, "matrix": [cells[i : i + 4] for i in range(0, 16, 4)]}


def _reduced(lift):
    """Rows sorted by (conv_id, part) and place to one summary for each part of a conversation; only one part is held."""

    def run(batches):
        rows = (row for batch in batches for row in batch.to_pylist())
        done: list = []
        for (conv, part), group in groupby(rows, key=lambda r: (r["conv_id"], r["part"])):
            whole = tree([lift(r) for r in group])
            done.append(_flat(conv, part, {k: whole[k] for k in [*SUMMARY.names[2:-2], "matrix"]}))
            if len(done) == 500:
                yield pa.RecordBatch.from_pylist(done, SUMMARY)
                done = []
        if done:
            yield pa.RecordBatch.from_pylist(done, SUMMARY)

    return run


def _parts(rows: DataFrame, part, lift) -> DataFrame:
    dealt = rows.withColumn("part", part).repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "at")
    return dealt.mapInArrow(_reduced(lift), SUMMARY_SQL)


def reduced(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, whole): summaries of blocks of turns and of whole conversations, from faulted().

    A block has at most 2 ** BLOCK_BITS turns of one conversation; 2 ** ARITY_BITS neighbours merge in one step, so the
    steps grow with the logarithm of the longest conversation, and conversations of one block take no step. The last
    product of a conversation holds 16 audits, of a letter for each edit.
    """
    blocks = stage(_parts(rows, F.shiftright("at", BLOCK_BITS), _lifted), "blocks")
    by = Window.partitionBy("conv_id").orderBy("part")
    blocks = blocks.withColumn("ordinal", (F.row_number().over(by) - 1).cast("long")).withColumn("of", F.count("*").over(Window.partitionBy("conv_id")))
    whole = [blocks.filter("of = 1").drop("ordinal", "of", "part")]
    longest = blocks.agg(F.max("of")).first()[0] or 1
    level = blocks.filter("of > 1").withColumn("part", F.col("ordinal")).drop("ordinal", "of")
    while longest > 1:
        level = stage(_parts(level, F.shiftright("part", ARITY_BITS), _unflat), "merged")
        longest = -(-longest >> ARITY_BITS)
    return blocks, whole[0].unionByName(level.drop("part"))


def _finished(costs, audits):
    """Column struct (cost, letters) of a conversation's cheapest edits, ties to the least letters: inserts after its last turn, then an end."""

    @F.pandas_udf("cost long, letters string")
    def of(costs, audits):
        import pandas as pd

        ends = closure()
        out = []
        for c, a in zip(costs, audits):
            cells = [None if x != x or x is None else (int(x), y) for x, y in zip(c, a)]
            row = product([cells[:4]], ends)[0]
            out.append(min(x for x in (row[START], row[ASSISTANT]) if x is not None))
        return pd.DataFrame(out, columns=["cost", "letters"])

    return of(costs, audits)


def repair_plan(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(turns, report, edits) of conversations (conv_id, turn, role, text).

    turns: the rows in order, of ordered(). report, a row for each conversation: conv_id, n, gaps, blank, duplicate,
    truncated, illegal, cost, letters (INITIALS). edits: conv_id, ordinal (from 1), at (null after the last turn) and
    piece, the letters of inserts before a turn and of its own edit. Rows without conv_id form a conversation of their
    own; null turns stand first and count in no gap; rows of one turn stand by role and the text's SHA-256; null roles
    and texts are one space. Repeated rows are duplicates. An empty table gives none; other columns are not read.
    """
    turns = ordered(rows)
    blocks, whole = reduced(faulted(turns))
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0)).cast("long")
    report = whole.withColumn("best", _finished(F.col("costs"), F.col("audits")))
    report = stage(report.select("conv_id", "n", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "best.cost", "best.letters"), "report")
    before = Window.partitionBy("conv_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.select("conv_id", "at", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = placed.select("conv_id", "at", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    placed = placed.select(F.col("conv_id").alias("_conv"), (F.col("before") + F.col("i") + 1).alias("_ordinal"), (F.col("at") + F.col("i")).alias("at"))
    pieces = report.select("conv_id", F.posexplode(F.regexp_extract_all("letters", F.lit("[IJ]*[DKRS]|[IJ]+$"), F.lit(0))).alias("ordinal", "piece"))
    pieces = pieces.withColumn("ordinal", (F.col("ordinal") + 1).cast("long"))
    # Spark takes what is exploded from few rows for small; merge joins keep it from broadcasting that.
    edits = pieces.join(placed.hint("merge"), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("ordinal") == F.col("_ordinal")), "left").select("conv_id", "ordinal", "at", "piece")
    return turns, report, edits


def repaired(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, ordinal, step, edit, role, text): the turns of the repaired conversations, each with its edit's letter."""
    each = edits.join(turns.select("at", "role", "text").hint("merge"), "at", "left").select("conv_id", "ordinal", "role", "text", F.posexplode(F.split("piece", "")).alias("step", "edit"))
    inserted = F.col("edit").isin("I", "J")
    role = F.when(F.col("edit").isin(*INITIALS[0]), "user").when(F.col("edit").isin(*INITIALS[1]), "assistant").otherwise(F.col("role"))
    return each.filter(~F.col("edit").isin("D", "")).select("conv_id", "ordinal", "step", "edit", role.alias("role"), F.when(inserted, "").otherwise(F.col("text")).alias("text"))


DIGEST = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def _digests(batches):
    """Turns in order to one digest for each conversation; only a running hash is kept."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))))
    done: list = []
    for conv, group in groupby(rows, key=lambda r: r[0]):
        state = hashlib.sha256()
        for i, (_, role, text) in enumerate(group):
            state.update(f"{chr(10) * (i > 0)}{role}:{text}".encode())
        done.append({"conv_id": conv, "repaired_sha256": state.hexdigest()})
        if len(done) == 500:
            yield pa.RecordBatch.from_pylist(done, DIGEST)
            done = []
    if done:
        yield pa.RecordBatch.from_pylist(done, DIGEST)


def audit(letters):
    return F.translate(letters, "JS", "IR")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation before the damage, with its faults after it, the cheapest repair and the digest of what that gives."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns, report, edits = repair_plan(damaged(rows))
    digests = repaired(turns, edits).repartition("conv_id").sortWithinPartitions("conv_id", "ordinal", "step").mapInArrow(_digests, "conv_id long, repaired_sha256 string")
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().alias("e")
    met = every.join(report.alias("r"), F.col("e.conv_id").eqNullSafe(F.col("r.conv_id")), "left").join(digests.alias("d"), F.col("e.conv_id").eqNullSafe(F.col("d.conv_id")), "left")
    counts = [F.coalesce(f"r.{c}", F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return met.select("e.conv_id", *counts, F.coalesce(audit(F.col("r.letters")), F.lit("")).alias("audit"), F.coalesce("d.repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def _plus(state: str, cost, letters: str) -> str:
    """A state as text, ten digits of cost and then letters, with more of both; least() of such texts is the least cost, then the least letters."""
    return f"(lpad(CAST(CAST(substr({state}, 1, 10) AS BIGINT) + {cost} AS VARCHAR), 10, '0') || substr({state}, 11) || '{letters}')"


def _step_sql() -> str:
    kept = "fault NOT IN ('blank', 'duplicate')"
    new = [_plus(f"c{i}", DELETE, "D") for i in range(4)]
    system = f"CASE WHEN {kept} AND initial = 's' THEN {_plus('c0', 'late', 'K')} END"
    user = [f"CASE WHEN {kept} AND initial = 'u' THEN {_plus('cu', 'late', 'K')} END", f"CASE WHEN {kept} THEN {_plus('cu', f'{REROLE} + late', 'S')} END"]
    other = [f"CASE WHEN {kept} AND initial = 'a' THEN {_plus('c2', 'late', 'K')} END", f"CASE WHEN {kept} THEN {_plus('c2', f'{REROLE} + late', 'R')} END"]
    return f"{new[0]} AS v0, least({new[1]}, {system}) AS v1, least({', '.join([new[2], *user])}) AS v2, least({', '.join([new[3], *other])}) AS v3"


def _closed_sql(source: str) -> str:
    user = ", ".join(["v2", *[_plus(v, INSERT, "J") for v in ("v0", "v1", "v3")]])
    other = ", ".join(["v3", _plus("v2", INSERT, "I"), *[_plus(v, 2 * INSERT, "JI") for v in ("v0", "v1")]])
    return f"(SELECT *, v0 AS c0, v1 AS c1, least({user}) AS c2, least({other}) AS c3, least(v0, v1, least({other})) AS cu FROM {source})"


#: The same by a walk over the turns with the least text of each state.
ORACLE_SQL = f"""
WITH RECURSIVE bits AS (SELECT list(c ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(list_prepend(i::BIGINT, [0,0,0,0,0,0,0,0]::BIGINT[]), lambda a, x:
    CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) AS c FROM range(256) r(i))),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
    regexp_extract_all(hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1]))) % 20 AS hit FROM conversations, bits),
g AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
  CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN hit = 3 THEN [1, 2] ELSE [1] END) AS twice FROM h WHERE hit <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), twice) AS n FROM g),
f AS (SELECT *, substr(role, 1, 1) AS initial, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS said, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS k,
  lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS ahead FROM o),
t AS (SELECT *, CASE WHEN said = '' THEN 'blank' WHEN k > 1 THEN 'duplicate' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM f),
u AS (SELECT *, CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS late FROM t),
w(conv_id, n, v0, v1, v2, v3) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '0000000000', NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM o
  UNION ALL SELECT conv_id, n, v0, v1, v2, v3 FROM (SELECT u.conv_id, u.n, {_step_sql()} FROM {_closed_sql('w')} c JOIN u ON u.conv_id IS NOT DISTINCT FROM c.conv_id AND u.n = c.n + 1)),
best AS (SELECT conv_id, least(c0, c3) AS b FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) AS back FROM {_closed_sql('w')} x) WHERE back = 1),
p AS (SELECT conv_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS n FROM (SELECT conv_id, regexp_extract_all(substr(b, 11), '[IJ]*[DKRS]|[IJ]+$') AS ps FROM best)),
e AS (SELECT conv_id, n, unnest(string_split(piece, '')) AS edit, generate_subscripts(string_split(piece, ''), 1) AS i FROM p),
d AS (SELECT e.conv_id, sha256(string_agg((CASE WHEN edit IN ('J', 'S') THEN 'user' WHEN edit IN ('I', 'R') THEN 'assistant' ELSE o.role END) || ':' ||
  (CASE WHEN edit IN ('I', 'J') THEN '' ELSE o.text END), chr(10) ORDER BY e.n, e.i)) AS digest
  FROM e LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM e.conv_id AND o.n = e.n WHERE edit NOT IN ('D', '') GROUP BY e.conv_id),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE n > 1 AND ahead || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY conv_id)
SELECT CAST(a.conv_id AS BIGINT) AS conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(CAST(substr(b, 1, 10) AS BIGINT), 0) AS cost, coalesce(translate(substr(b, 11), 'JS', 'IR'), '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN d ON d.conv_id IS NOT DISTINCT FROM a.conv_id
"""
