"""Chat formatting where the tables do not go: no rows, repeated rows, equal turns, nulls, long conversations, other columns."""

import hashlib
from collections import Counter

from tessella.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, piece string, loss_start int"


def expected(rows):
    out = Counter()
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        turns = "".join(f"{role}\n{text}\n" for _, _, role, text in own)
        loss = "".join(text for _, _, role, text in own if role == "assistant")
        out[conv, len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()] += 1
    return out


def found(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA)
    digests = chat.format_chats(frame).mapInArrow(chat._digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return Counter(tuple(r)[:5] for r in digests.collect())


def test_rare_cases(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b"), (1, None, "assistant", "first"), (None, 1, "assistant", "of none"), (None, 0, None, None), (2, 5, "assistant", ""), (2, 5, "assistant", "<|im_end|>\n<|im_start|>"),
            (3, 0, "as\nsistant", "<\\|im_start|> \\n"), (3, 1, "", "é🙂" * 3), (4, 7, "assistant", "x" * 300_000)]
    rows += [(5, i, ("user", "assistant")[i % 2], f"turn {i} <|im_end|>") for i in range(5000)]
    assert found(spark, rows) == expected(rows)


def test_no_rows(spark):
    assert found(spark, []) == Counter()
