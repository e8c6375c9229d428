"""Cross-tokenizer alignment: a label for each byte of a text, a regular expression that cuts the labels into groups, and corpus-wide counts of linked tokens."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table, text_batches

#: Where the vocabularies are, on every executor, and their names: A byte-level, B in pieces.
FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A worker aligns texts of about so many characters at a time (a longer text by itself), and forgets chunks after so many tokens.
TEXT_CHARS, MEMO_TOKENS = 400_000, 2_500_000
#: Pairs of ids with their counts are broadcast up to so many (about 64 bytes each); more meet their links by a shuffle.
BROADCAST_PAIRS = 1_000_000
#: Places over which the links of each pair are dealt in that shuffle: a pair may be in every document.
SALTS = 16
#: Labels of a byte: no token ends after it, one of A, one of B, one of both.
LABELS = bytes.maketrans(b"\x00\x01\x02\x03", b".ABx")
SPAN = re.compile(rb"[^x]*x")
#: A blank between letters (or after a full stop or comma) parts the text for both tokenizers: each begins a token with it, whatever stands before.
PARTED = re.compile(r"(?<=[A-Za-zÀ-ÿ.,]) (?=[A-Za-zÀ-ÿ])")
#: Links of a group with more pairs of occurrences than this are counted by distinct ids.
WIDE = 4096


def byte_level() -> dict:
    """Byte of each character of a byte-level vocabulary: printable ones stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


def piece_bytes(piece: str) -> bytes:
    hexed = re.fullmatch("<0x([0-9A-F]{2})>", piece)
    return bytes([int(hexed[1], 16)]) if hexed else piece.replace("▁", " ").encode()


def cartesian(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple:
    """(group, a, b, times) of all pairs of occurrences of each group; group g has the next na[g] of a and nb[g] of b."""
    size, sa, sb = na * nb, np.cumsum(na) - na, np.cumsum(nb) - nb
    wide = np.flatnonzero(size > WIDE)
    size = np.where(size > WIDE, 0, size)
    group = np.repeat(np.arange(len(na)), size)
    within = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)
    out = [(group, a[sa[group] + within // nb[group]], b[sb[group] + within % nb[group]], np.ones(len(group), np.int64))]
    for g in wide:
        (ua, ca), (ub, cb) = np.unique(a[sa[g] : sa[g] + na[g]], return_counts=True), np.unique(b[sb[g] : sb[g] + nb[g]], return_counts=True)
        out.append((np.full(len(ua) * len(ub), g), np.repeat(ua, len(ub)), np.tile(ub, len(ua)), np.outer(ca, cb).ravel()))
    return tuple(np.concatenate(c) for c in zip(*out))


def counted(owner: np.ndarray, a: np.ndarray, b: np.ndarray, times: np.ndarray) -> tuple:
    """(owner, a, b, times), each pair of an owner once, sorted; ids below 2 ** 20, so that a row is one number."""
    key = (owner.astype(np.int64) << 40) | (a.astype(np.int64) << 20) | b
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    first = key[new]
    return first >> 40, (first >> 20) & 0xFFFFF, first & 0xFFFFF, np.add.reduceat(times[order], new) if len(new) else times


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + length), one after the other."""
    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


class Aligner:
    """Both tokenizers and the alignments of the chunks met lately.

    A text is blank + text; where PARTED fits it falls into chunks, each a blank and what follows, whose tokens do not
    depend on the rest: A's pattern starts a token there, and no piece of B has a blank after something else. Both are
    checked when the vocabularies are read, else texts are not parted. As both tokenizers end a token there, groups never cross.
    """

    def __init__(self, folder: str):
        import sentencepiece
        from tokenizers import Tokenizer

        source = open(f"{folder}/{A_FILE}", encoding="utf-8").read()
        self.a = Tokenizer.from_str(source)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{B_FILE}")
        decode, vocabulary = byte_level(), self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.a_bytes[i] = bytes(decode[c] for c in entry) if all(c in decode for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        self.b_bytes = [piece_bytes(p) for p in pieces]
        self.a_size, self.b_size = (np.array([len(x) for x in table]) for table in (self.a_bytes, self.b_bytes))
        ids = range(max(len(self.a_bytes), len(self.b_bytes)))
        self.comma, self.bar, self.semicolon = (np.array([f"{i}{sign}" for i in ids], object) for sign in ",|;")
        self.digits = np.array([len(str(i)) for i in ids])
        self.encode = getattr(self.a, "encode_batch_fast", self.a.encode_batch)  # without offsets, where the library can
        rule = json.loads(source).get("pre_tokenizer") or {}
        plain = rule.get("type") == "ByteLevel" and rule.get("use_regex") and not rule.get("add_prefix_space")
        self.parts = plain and not any(re.search("[^▁]▁", p) for p in pieces)
        self.forget()

    def forget(self) -> None:
        self.codes: dict = {}
        self.good, self.strings = [], []
        self.n_a, self.n_b, self.n_groups, self.n_links, self.size, self.n_ends, self.n_pairs = (np.zeros(0, np.int64) for _ in range(7))
        self.ends = np.zeros(0, np.int32)
        self.pairs = [np.zeros(0, np.int32) for _ in range(3)]

    def learn(self, chunks: list[str]) -> None:
        """Align chunks that are not known yet."""
        ids_a = [e.ids for e in self.encode([" " + c for c in chunks], add_special_tokens=False)]
        ids_b = self.b.encode(chunks, num_threads=1)
        wholes = [b" " + c.encode() for c in chunks]
        good = [True] * len(chunks)
        if not (self._says(ids_a, wholes, self.a_bytes) and self._says(ids_b, wholes, self.b_bytes)):
            for i, whole in enumerate(wholes):
                good[i] = self._says(ids_a[i : i + 1], [whole], self.a_bytes) and self._says(ids_b[i : i + 1], [whole], self.b_bytes)
                if not good[i]:
                    ids_a[i], ids_b[i], wholes[i] = [], [], b""
        self.codes.update(zip(chunks, range(len(self.codes), len(self.codes) + len(chunks))))
        self.good += good
        n_a, n_b, size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (ids_a, ids_b, wholes))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int32, n.sum()) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        of_bytes = np.zeros(size.sum(), np.uint8)
        of_bytes[ends_a - 1] |= 1
        of_bytes[ends_b - 1] |= 2
        spans = SPAN.findall(of_bytes.tobytes().translate(LABELS))
        ends = np.cumsum(np.fromiter(map(len, spans), np.int64, len(spans)))
        in_a, in_b = (np.diff(np.cumsum(of_bytes & mine > 0)[ends - 1], prepend=0) for mine in (1, 2))
        chunk = np.repeat(np.arange(len(chunks)), size)[ends - 1] if len(ends) else np.zeros(0, np.int64)
        n_groups = np.bincount(chunk, minlength=len(chunks))
        self.strings += self._said(a, b, in_a, in_b, n_a + n_b)
        group, pa_, pb, times = cartesian(a, b, in_a, in_b)
        owner, pa_, pb, times = counted(chunk[group], pa_, pb, times)
        links = np.bincount(chunk, in_a * in_b, len(chunks)).astype(np.int64)
        more = {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": links, "size": size, "n_pairs": np.bincount(owner, minlength=len(chunks))}
        for name, values in more.items():
            setattr(self, name, np.concatenate([getattr(self, name), values]))
        self.ends = np.concatenate([self.ends, (ends - np.repeat(np.cumsum(size) - size, n_groups)).astype(np.int32)])
        self.pairs = [np.concatenate([old, new.astype(np.int32)]) for old, new in zip(self.pairs, (pa_, pb, times))]

    @staticmethod
    def _says(ids: list, wholes: list, table: list) -> bool:
        """Whether each row of ids stands for the bytes of its whole."""
        parts = list(map(table.__getitem__, chain.from_iterable(ids)))
        if b"".join(parts) != b"".join(wholes):
            return False
        at = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        last = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) - 1
        return bool(len(parts)) and bool((at[last] == np.cumsum(np.fromiter(map(len, wholes), np.int64, len(wholes)))).all())

    def _said(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, tokens: np.ndarray) -> list[str]:
        """The groups of each chunk as text; each id is followed by a comma, the last A id of a group by a bar and the last B id by a semicolon."""
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[np.cumsum(in_a) - 1], last_b[np.cumsum(in_b) - 1] = True, True
        groups = np.arange(len(in_a))
        order = np.argsort(np.concatenate([np.repeat(2 * groups, in_a), np.repeat(2 * groups + 1, in_b)]), kind="stable")
        said = np.concatenate([np.where(last_a, self.bar[a], self.comma[a]), np.where(last_b, self.semicolon[b], self.comma[b])])[order]
        stops = np.concatenate([[0], np.cumsum(self.digits[np.concatenate([a, b])[order]] + 1)])[np.cumsum(tokens)]
        whole, starts = "".join(said.tolist()), np.concatenate([[0], stops[:-1]])
        return [whole[s : max(s, e - 1)] for s, e in zip(starts.tolist(), stops.tolist())]

    def align(self, texts: list) -> dict:
        """Columns of the alignment, a row for each text."""
        if self.n_a.sum() > MEMO_TOKENS:
            self.forget()
        chunks = [(PARTED.split(t) if self.parts else [t]) if t else [] for t in texts]
        new = {c: None for c in chain.from_iterable(chunks) if c not in self.codes}
        if new:
            self.learn(list(new))
        at = [[self.codes[c] for c in row] for row in chunks]
        at = [row if all(self.good[c] for c in row) else [] for row in at]
        count = np.fromiter(map(len, at), np.int64, len(at))
        code = np.fromiter(chain.from_iterable(at), np.int64, count.sum())
        text = np.repeat(np.arange(len(texts)), count)

        def total(values):
            return np.bincount(text, values[code], len(texts)).astype(np.int64)

        out = {n: total(getattr(self, n)) for n in ("n_a", "n_b", "n_groups", "n_links")}
        out["groups"] = pa.array([";".join([self.strings[c] for c in row]) for row in at], pa.string())
        size = self.size[code]
        start = np.cumsum(size) - size
        start -= np.repeat(start[np.cumsum(count)[count > 0] - count[count > 0]], count[count > 0])
        n = self.n_groups[code]
        ends = self.ends[gathered((np.cumsum(self.n_groups) - self.n_groups)[code], n)] + np.repeat(start, n)
        out["ends"] = pa.ListArray.from_arrays(_offsets(out["n_groups"]), pa.array(ends.astype(np.int32)))
        n = self.n_pairs[code]
        take = gathered((np.cumsum(self.n_pairs) - self.n_pairs)[code], n)
        owner, a, b, times = counted(np.repeat(text, n), *(p[take] for p in self.pairs))
        links = pa.StructArray.from_arrays([pa.array(v.astype(np.int32)) for v in (a, b, times)], ["a", "b", "times"])
        out["links"] = pa.ListArray.from_arrays(_offsets(np.bincount(owner, minlength=len(texts))), links)
        return out


def _offsets(lengths: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))


@lru_cache(maxsize=1)
def aligner(folder: str) -> Aligner:
    """One for each worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
    return Aligner(folder)


COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, ends array<int>, links array<struct<a:int,b:int,times:int>>"


def _aligned(folder: str):
    def run(batches):
        to = aligner(folder)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            cut = 0
            while cut < len(texts):
                end, chars = cut, 0
                while end < len(texts) and (end == cut or chars + len(texts[end] or "") <= TEXT_CHARS):
                    chars, end = chars + len(texts[end] or ""), end + 1
                columns = {"doc_id": ids[cut:end], **to.align(texts[cut:end])}
                yield pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns.values()], names=list(columns))
                cut = end

    return run


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = FOLDER) -> DataFrame:
    """COLUMNS for each row of docs: counts, the groups as `a1,a2|b1;a3|b2,b3`, the byte offsets in blank + text where they end, and the linked ids.

    links has each pair of an A and a B id that share a group, with the number of pairs of occurrences. A null or empty
    text, and one whose tokens' bytes are not those of blank + text (such as one with U+2581), has no tokens: zeros, an
    empty string and empty arrays. Null and repeated ids are kept as they are; other columns are not read; an empty table
    gives no rows. Use it within text_batches().
    """
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_aligned(folder), COLUMNS)


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, n, best): in how many rows of links (array column `links`) a pair is linked, and whether none of its A id's pairs is in more.

    An A id has at most as many pairs as B has ids, so the window over it is bounded.
    """
    counts = links.select(F.explode("links").alias("l")).groupBy("l.a", "l.b").agg(F.count("*").alias("n"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))


def scored(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(_row, n_best, count_sum) of rows (_row, links) that have links."""
    links = rows.select("_row", F.explode("links").alias("l")).select("_row", "l.*")
    if counts.count() <= BROADCAST_PAIRS:
        met = links.join(F.broadcast(counts), ["a", "b"])
    else:
        salts = counts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
        met = links.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS))).hint("merge").join(salts, ["a", "b", "_salt"])
    times = F.col("times").cast("long")
    return met.groupBy("_row").agg(F.sum(F.when(F.col("best"), times).otherwise(0)).alias("n_best"), F.sum(times * F.col("n")).alias("count_sum"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest of the groups and corpus-wide scores of the links, for every document. Texts are encoded once; only counts, digests and links are staged."""
    docs = align(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("").alias("groups_sha256")
    with text_batches(spark):
        rows = stage(docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "links"), "aligned")
    counts = stage(pair_counts(rows), "pair-counts")
    met = rows.drop("links").join(scored(rows, counts), "_row", "left")
    return met.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
