"""Toxicity: Viterbi decoding of leetspeak, spacing and repetition under a character language model, then scoring of the restored words."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table, text_batches

#: Character classes of the language model: 0 boundary, 1 to 26 a to z, 27 any other letter.
CLASSES = 28
#: What a sign can stand for, as in common leetspeak.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
#: Channel costs (natural log): a sign for a letter, a character repeated, a separator put in, one that could be a letter
#: put in, a space put in (none is needed between single characters).
SIGN_COST, REPEAT_COST, SEPARATOR_COST, LETTER_SIGN_COST, SPACE_COST = 0.5, 0.3, 0.2, 16.0, 1.0
#: Letters of a fragment that a space may have cut off; sightings, and share of all words, that make such a word known.
FRAGMENT, KNOWN_COUNT, KNOWN_SHARE = 5, 20, 1e-5
#: Labelled documents of each class that the classifier is fitted on at most, by smallest hash of doc_id.
SAMPLE_EACH = 3000
#: Hash space of features, least G-squared of a feature that is used, steps, rate and ridge of the fit.
SPACE, LEAST_G2, STEPS, RATE, RIDGE = 1 << 24, 20.0, 300, 0.5, 1e-3
#: Restored tokens that a task remembers at a time.
CACHE = 100_000


def _class_table() -> np.ndarray:
    """Class of each UTF-8 byte; 255: continuation byte, which has none."""
    out = np.zeros(256, np.uint8)
    for i in range(26):
        out[ord("a") + i] = out[ord("A") + i] = i + 1
    out[0x80:0xC0], out[0xC0:] = 255, CLASSES - 1
    return out


def _counts(batches):
    """Rows (trigram, word, n) of each task: counts of character trigrams, of short words, and of all words (word '')."""
    classes, total, short = _class_table(), np.zeros(CLASSES**3, np.int64), Counter()
    for batch in batches:
        for text in batch.column(0).cast(pa.binary()):
            c = classes[np.frombuffer(text.as_buffer() or b"", np.uint8)]
            c = np.concatenate([[0, 0], c[c != 255], [0]]).astype(np.int64)
            total += np.bincount(c[:-2] * CLASSES**2 + c[1:-1] * CLASSES + c[2:], minlength=CLASSES**3)
            words = (text.as_py() or b"").decode(errors="replace").lower().split()
            short[""] += len(words)
            short.update(w for w in words if len(w) <= FRAGMENT and w.isalpha())
    found, words = np.nonzero(total)[0], list(short)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(found.tolist() + [None] * len(words), pa.int64()),
            pa.array([None] * len(found) + words, pa.string()),
            pa.array(total[found].tolist() + [short[w] for w in words], pa.int64()),
        ],
        names=["trigram", "word", "n"],
    )


def language_model(docs: DataFrame, text: str = "text") -> tuple[list, frozenset]:
    """(log P(c | a, b) by character class, known short words), counted over the whole corpus.

    Counts of each task are summed; CLASSES ** 3 numbers and 1 / KNOWN_SHARE words at most come back.
    """
    counts = docs.filter(F.col(text).isNotNull()).select(text).mapInArrow(_counts, "trigram long, word string, n long")
    counts = stage(counts.groupBy("trigram", "word").agg(F.sum("n").alias("n")), "counts")
    n = np.zeros(CLASSES**3)
    for row in counts.filter("trigram is not null").collect():
        n[row["trigram"]] = row["n"]
    words = (counts.filter("word = ''").agg(F.sum("n")).first()[0] or 0) * KNOWN_SHARE
    known = frozenset(r["word"] for r in counts.filter((F.col("word") != "") & (F.col("n") >= max(KNOWN_COUNT, words))).collect())
    three = n.reshape(CLASSES, CLASSES, CLASSES) + 1e-9
    two = three.sum(0) + 0.5
    backed = two / two.sum(1, keepdims=True)
    return np.log((three + 5 * backed) / (three.sum(2, keepdims=True) + 5)).tolist(), known


def _class(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else CLASSES - 1 if c.isalpha() else 0


def decode(typed: str, model: list) -> str:
    """The likeliest words, parted by blanks, behind lower-case text of any length: Viterbi over all paths through its lattice.

    Each sign may stand for a letter of LEET or, put in, for none; a repeated character for none; any other sign or white
    space for the end of a word or for none. A state is the last two classes of the restored text, so there are CLASSES
    squared at most, and time is linear in the length.
    """
    states: dict = {(0, 0): (0.0, None)}
    previous = ""
    for i, c in enumerate(typed):
        after: dict = {}
        letter, space, signs = c.isalpha(), c.isspace(), LEET.get(c, "")
        spelt = space and not typed[max(i - 2, 0) : max(i - 1, 0)].strip() and not typed[i + 2 : i + 3].strip()
        none = 0.0 if spelt else SPACE_COST if space else LETTER_SIGN_COST if signs else SEPARATOR_COST
        if c == previous:
            none = min(none, REPEAT_COST) if not letter else REPEAT_COST
        emitted = ((c, _class(c), 0.0),) if letter else tuple((x, _class(x), SIGN_COST) for x in signs)
        for (a, b), (cost, path) in states.items():
            ways = [((b, k), cost + extra - model[a][b][k], x) for x, k, extra in emitted]
            if not letter or c == previous:
                ways.append(((a, b), cost + none, ""))
            if not letter and not signs:
                ways.append(((b, 0), cost - model[a][b][0], " ") if b else ((a, b), cost, ""))
            for state, total, x in ways:
                if state not in after or after[state][0] > total:
                    after[state] = total, (path, x) if x else path
        states, previous = after, c
    path = min(((cost - (model[a][b][0] if b else 0.0), i, path) for i, ((a, b), (cost, path)) in enumerate(states.items())))[2]
    out = []
    while path:
        path, x = path
        out.append(x)
    return "".join(reversed(out)).strip()


_EDGE = re.compile(r"^[^\w@$]+|(?:[^\w@$]|([@$])\1\1+)+$")
_TWICE = re.compile(r"([a-z])\1+")
_APART = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
#: Signs around words that are cut off without a regex.
_AROUND = ".,;:!?'\"()-"


def shortened(word: str, model: list) -> str:
    """decode() of a word of letters alone, faster: as a state is two letters, each run of one letter is decided by itself."""

    def run(m):
        x, k, y = (_class(c) if c else 0 for c in (word[m.start() - 1 : m.start()], m[1], word[m.end() : m.end() + 1]))
        more, after = len(m[0]) - 2, model[x][k]
        one = REPEAT_COST * (more + 1) - after[y]
        two = REPEAT_COST * more - after[k] - model[k][k][y]
        whole = two - more * (REPEAT_COST + model[k][k][k])
        return m[1] if one < min(two, whole) else m[1] * 2 if two <= whole else m[0]

    return _TWICE.sub(run, word)


def restore(token: str, model: list) -> tuple[str, ...]:
    """The plain lower-case words behind a token: what is left without its edges, decoded if it mixes letters with signs, or both if a letter stands twice."""
    plain = token.lower().strip(_AROUND)
    if plain.isalpha():  # most tokens; the rules below say the same of them
        return (plain, shortened(plain, model)) if _TWICE.search(plain) else (plain,)
    word = _EDGE.sub("", token.lower())
    if word.isalpha() or not any(map(str.isalpha, word)):
        return (word,)
    return tuple(decode(word, model).split())


def fragment(token: str, known: frozenset) -> bool:
    """Whether a token may be a part that spaces have cut off a word: short, with a letter, and no known word."""
    word = token.lower().strip(_AROUND)
    return len(word) <= FRAGMENT and word not in known and any(map(str.isalpha, word))


def spaced(tokens: list[str], odd: set) -> list[str]:
    """Stretches of neighbouring short tokens, each of which is odd, stands beside an odd one, or is one of three single characters in a row."""
    short = [len(t.strip(_AROUND)) <= FRAGMENT for t in tokens]
    single = [len(t) == 1 and t.isalnum() or t in LEET for t in tokens]
    marked = [t in odd or (single[i] and (single[max(0, i - 2) : i + 3].count(True) > 2)) for i, t in enumerate(tokens)]
    out, run = [], []
    for i, t in enumerate(tokens):
        if short[i] and (marked[i] or (i and marked[i - 1]) or (i + 1 < len(tokens) and marked[i + 1])):
            run.append(t.lower())
            continue
        if len(run) > 1:
            out.append(" ".join(run))
        run = []
    return [*out, " ".join(run)] if len(run) > 1 else out


def restored_words(text: str | None, model: tuple[list, frozenset], cache: dict) -> set:
    """The distinct words of a whole text after restoring, and those that come of joining fragments apart."""
    letters, known = model
    tokens = (text or "").split()
    if len(cache) > CACHE:
        cache.clear()
    out, odd = set(), set()
    for token in set(tokens):
        found = cache.get(token)
        if found is None:
            found = cache[token] = restore(token, letters), fragment(token, known)
        out.update(found[0])
        if found[1]:
            odd.add(token)
    if odd or (text and _APART.search(text)):
        for run in spaced(tokens, odd):
            words = cache.get((run,))
            if words is None:
                words = cache[run,] = decode(run, letters).split()
            out.update(words)
    return out


def features(word: str) -> list[int]:
    """Hashes of a word and its beginnings of four to seven letters."""
    keys = [f"{word}$"] + [word[:n] for n in (4, 5, 6, 7) if len(word) >= n] if len(word) > 2 else []
    return [zlib.crc32(k.encode(errors="replace")) % SPACE for k in keys]


def g2(a, b, n_a: float, n_b: float):
    """Log-likelihood ratio (column) of a feature in a of n_a and b of n_b documents."""
    p = (a + b) / (n_a + n_b)
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    return 2 * (term(a, p * n_a) + term(b, p * n_b) + term(n_a - a, (1 - p) * n_a) + term(n_b - b, (1 - p) * n_b))


def telling(sample: DataFrame, n_toxic: int, n_clean: int) -> list[int]:
    """The features of sample (toxic, features) that are much likelier in toxic documents: as many as the bounded sample shows."""
    seen = sample.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b"))
    value = g2(F.col("a"), F.col("b"), float(max(n_toxic, 1)), float(max(n_clean, 1)))
    seen = seen.filter(F.col("a") / max(n_toxic, 1) > 2 * F.col("b") / max(n_clean, 1)).select("f", value.alias("value")).filter(F.col("value") >= LEAST_G2)
    return [r["f"] for r in seen.orderBy(F.desc("value"), "f").collect()]


def fit(rows: list, labels: np.ndarray, chosen: list[int], share: float) -> tuple[dict[int, float], float]:
    """(weights by feature, bias) of a logistic regression on the chosen features; share: of toxic labels overall, which the sample's rows are weighted to."""
    share = min(max(share, 0.01), 0.99)
    bias = float(np.log(share / (1 - share)))
    if not chosen or not 0 < labels.sum() < len(labels):
        return {}, bias
    place = {f: i for i, f in enumerate(chosen)}
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([place[f] for r in rows for f in r], np.int64)
    weight = np.where(labels == 1, share / labels.sum(), (1 - share) / (1 - labels).sum())
    w, b = np.zeros(len(chosen)), bias
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, w[col], len(labels)), -30, 30)))
        error = weight * (p - labels)
        w -= RATE * 40 * (np.bincount(col, error[row], len(chosen)) + RIDGE * 0.1 * w)
        b -= RATE * float(error.sum())
    return dict(zip(chosen, w.tolist())), b


def train(docs: DataFrame, labels: DataFrame, model: tuple[list, frozenset]) -> tuple[dict[int, float], float]:
    """Fit on SAMPLE_EACH labelled documents of each class at most, never on held-out ones."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_EACH) for k in (0, 1)]
    picked = F.broadcast(picked[0].unionAll(picked[1]).select(F.col("doc_id").alias("_id"), "toxic"))

    def extract(batches):
        cache: dict = {}
        for batch in batches:
            found = [sorted({f for w in restored_words(t, model, cache) for f in features(w)}) for t in batch["text"]]
            yield pd.DataFrame({"toxic": batch["toxic"], "features": found})

    rows = docs.select(F.col("doc_id"), "text").join(picked, F.col("doc_id") == F.col("_id")).select("text", F.col("toxic").cast("int").alias("toxic"))
    sample = stage(rows.mapInPandas(extract, "toxic int, features array<int>"), "sample")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = telling(sample, sizes.get(1, 0), sizes.get(0, 0))

    def keep(batches):
        wanted = np.array(chosen, np.int64)
        for batch in batches:
            yield batch.assign(features=[f[np.isin(f, wanted)] for f in batch["features"]])

    kept = sample.mapInPandas(keep, "toxic int, features array<int>").collect()  # SAMPLE_EACH rows of each class, telling features only
    total = sum(counts.values())
    return fit([r["features"] for r in kept], np.array([r["toxic"] for r in kept], np.float64), chosen, counts.get(1, 0) / total if total else 0.0)


def scorer(weights: dict[int, float], bias: float, model: tuple[list, frozenset]):
    """A column function: probability that a text is toxic."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        worth, cache = {}, {}

        def one(text):
            total = bias
            for word in restored_words(text, model, cache):
                value = worth.get(word)
                if value is None:
                    if len(worth) > CACHE:
                        worth.clear()
                    value = worth[word] = sum(weights.get(f, 0.0) for f in features(word))
                total += value
            return 1 / (1 + np.exp(-min(max(total, -30.0), 30.0)))

        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype="float64")

    return score


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity_score(docs: DataFrame, labels: DataFrame):
    """A column function text -> score, trained on the documents that `labels` (doc_id, toxic) marks.

    The language model counts all documents. Null and empty texts have no words and get the bias alone; texts and tokens of
    any length are read whole, repeated rows score alike. Several labels of one document: toxic if any is; null labels are
    left out; without any labels, or on empty tables, every score is near the least.
    """
    with text_batches(docs.sparkSession):
        model = language_model(docs)
        return scorer(*train(docs, labels, model), model)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document; held_out tells those whose labels were not learned."""
    docs = table(spark, sf_dir, "documents")
    score = toxicity_score(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    with text_batches(spark):
        out = stage(out, "scores")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that are scored toxic (0.5 or more); null and empty texts stay.

    An empty table gives no rows; repeated rows share their fate; other columns are passed on, whatever their names.
    """
    score = toxicity_score(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct("*").alias("doc"))
    return rows.filter(score("doc.text") < 0.5).select("doc.*")
