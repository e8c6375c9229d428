"""Token alignment against brute force over whole texts: sets of end offsets in place of labels, all pairs of occurrences, no chunks."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import token_alignment as alignment
from tessella.llm.common import text_batches

NAMES = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


def groups_of(text):
    """[(ids of A, ids of B, end)] or None."""
    to = alignment.aligner(alignment.FOLDER)
    if not text:
        return None
    a, b, whole = to.a.encode(" " + text, add_special_tokens=False).ids, to.b.encode(text), (" " + text).encode()
    if b"".join(to.a_bytes[i] for i in a) != whole or b"".join(to.b_bytes[i] for i in b) != whole:
        return None
    ends = [np.cumsum([len(table[i]) for i in ids]).tolist() for table, ids in ((to.a_bytes, a), (to.b_bytes, b))]
    out, x, y = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        k, m = ends[0].index(end, x) + 1, ends[1].index(end, y) + 1
        out.append((a[x:k], b[y:m], end))
        x, y = k, m
    return out


def expected(rows):
    cut = [groups_of(t) for _, t in rows]
    links = [Counter((i, j) for a, b, _ in g or [] for i in a for j in b) for g in cut]
    held = Counter(p for each in links for p in each)
    most = {}
    for (i, _), n in held.items():
        most[i] = max(n, most.get(i, 0))
    out = Counter()
    for (doc, _), g, each in zip(rows, cut, links):
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b, _ in g or [])
        digest = hashlib.sha256(said.encode()).hexdigest() if g else ""
        n = [sum(len(x[k]) for x in g or []) for k in (0, 1)]
        out[(doc, *n, len(g or []), sum(each.values()), sum(t for p, t in each.items() if held[p] == most[p[0]]), sum(t * held[p] for p, t in each.items()), digest)] += 1
    return out


@pytest.fixture(scope="module")
def rows(spark):
    texts = [None, "", " ", "\n", "a", "Hello world, this is it.", "  two  blanks and <|endoftext|> and <s> </s> <unk>", "tab\there\r\n\r\n end ", "naïve Straße ÀÉ × ÷ don't we'll I'm", "日本語のテキスト と 漢字", "🙂🙂 👩‍👩‍👧 emoji",
             "a▁b is a block", "nul\x00 byte", "x" * 3000, "0123456789" * 200, " no break space 　wide", "é combining", "'s 't a 's", "word.Next ,word", "<0x41> is text", "ends with blank ", "word " * 500, "Ω≈ç√∫ ∂ƒ"]
    real = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    rng, signs = np.random.default_rng(2), list("aB é.,'0 9 \n\t  ßñ日<>|")
    noise = ["".join(rng.choice(signs, int(rng.integers(1, 80)))) for _ in range(150)]
    made = list(enumerate([*texts, *real, *noise]))
    return [*made, (None, "Hello world, this is it."), (5, "Hello world, this is it."), (None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_a int, links string")


@pytest.mark.parametrize("most", [10**6, 0])
def test_equals_brute_force(spark, rows, tmp_path, monkeypatch, most):
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", most)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(map(tuple, alignment.op11_token_alignment(spark, str(tmp_path)).select(NAMES).collect())) == expected(rows)


def test_ends_and_memo(spark, rows):
    with text_batches(spark):
        found = alignment.align(frame(spark, rows)).select("groups", "ends", "n_groups", F.size("ends")).collect()
    for (_, text), r in zip(rows, found):
        g = groups_of(text)
        assert r["ends"] == [e for _, _, e in g or []] and r["n_groups"] == len(r["ends"])


def test_texts_apart_as_together(rows, monkeypatch):
    texts = [t for _, t in rows]
    together = alignment.Aligner(alignment.FOLDER).align(texts)
    monkeypatch.setattr(alignment, "MEMO_TOKENS", 50)  # forgets all the time
    monkeypatch.setattr(alignment, "WIDE", 3)
    one = alignment.Aligner(alignment.FOLDER)
    for i, t in enumerate(texts):
        alone = one.align([t])
        for name, column in together.items():
            assert (column[i].as_py() if hasattr(column[i], "as_py") else column[i]) == (alone[name][0].as_py() if hasattr(alone[name][0], "as_py") else alone[name][0])


def test_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert alignment.op11_token_alignment(spark, str(tmp_path)).count() == 0
