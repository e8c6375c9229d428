"""Line deduplication over a corpus: hashes of lines in ranges, first occurrences streamed by document and position, keep bitmaps in place of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, dropped, stage, table

#: Keys of fewer code points are never compared.
LEAST = 10
#: White space that is stripped from a line's ends.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: So many of the most frequent keys are counted apart. A sketch over all lines finds them; any other key holds at most a
#: thousandth of all lines and the sketch's error (3.5 / TRACKED of them). It decides only where a line is compared.
FREQUENT, TRACKED = 1_000, 8_192


def _body(text):
    return F.coalesce(text, F.lit(""))


def _texts(text) -> list:
    """A text's identity beside the document's id: 128 bits."""
    return [F.xxhash64(_body(text)).alias("_t1"), F.xxhash64(F.lit(1), _body(text)).alias("_t2")]


def hashed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(_h1, _h2, _doc, _t1, _t2, _pos): the key's hash of 128 bits, document, text and position (from 0) of each line whose key is long enough."""
    rows = docs.select(F.col(doc_id).alias("_doc"), *_texts(F.col(text)), F.posexplode(F.split(_body(F.col(text)), "\n")).alias("_pos", "_line"))
    rows = rows.withColumn("_key", ascii_lower(F.btrim("_line", F.lit(BLANKS)))).filter(F.char_length("_key") >= least)
    return rows.select(F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"), "_doc", "_t1", "_t2", "_pos")


def repeated_lines(lines: DataFrame) -> DataFrame:
    """(_doc, _t1, _t2, _pos) of the lines of hashed_lines that a smaller document holds too; lines should be staged, it is read four times.

    Ranges of hashes, sorted by document and position within: a key's first row names its holder, and the rows that
    follow are compared with it as they stream by. The most frequent keys do not go into one range: their least document
    is found by partial aggregation in every task and meets their lines where these lie (at most FREQUENT rows, broadcast).
    """
    top = lines.select(F.explode(F.expr(f"approx_top_k(_h1, {FREQUENT}, {TRACKED})")).alias("top")).select(F.col("top.item").alias("_h1"))
    frequent = F.broadcast(stage(top, "frequent-lines"))
    by = Window.partitionBy("_h1", "_h2").orderBy(F.asc_nulls_last("_doc"), "_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rare = lines.join(frequent, "_h1", "left_anti").repartitionByRange("_h1", "_h2").withColumn("_holder", F.first("_doc").over(by))
    among = lines.join(frequent, "_h1", "left_semi")
    holders = among.groupBy("_h1", "_h2").agg(F.min("_doc").alias("_holder"))
    common = among.join(F.broadcast(holders), ["_h1", "_h2"])
    columns = ["_doc", "_t1", "_t2", "_pos", "_holder"]
    return rare.select(columns).unionByName(common.select(columns)).filter(~F.col("_holder").eqNullSafe(F.col("_doc"))).drop("_holder")


def runs(positions):
    """Sorted positions of dropped lines as a bitmap in run lengths: lines kept, dropped, kept, dropped and so on; all that follow are kept."""
    starts = F.filter(positions, lambda p, i: F.coalesce(F.get(positions, i - 1) != p - 1, F.lit(True)))
    ends = F.filter(positions, lambda p, i: F.coalesce(F.get(positions, i + 1) != p + 1, F.lit(True)))
    first_kept = F.concat(F.array(F.lit(0)), F.transform(ends, lambda e: e + 1))
    kept = F.zip_with(starts, F.slice(first_kept, F.lit(1), F.size(starts)), lambda s, k: s - k)
    return F.flatten(F.zip_with(kept, F.zip_with(starts, ends, lambda s, e: e - s + 1), lambda k, d: F.array(k, d)))


def kept_text(text, keep):
    """The text without the lines that the bitmap of runs() drops; a null bitmap keeps all."""
    gone = F.flatten(F.transform(keep, lambda n, i: F.array_repeat(i % 2 == 1, n)))
    left = F.array_join(F.zip_with(F.split(_body(text), "\n"), gone, lambda line, out: F.when(F.coalesce(out, F.lit(False)), F.lit(None)).otherwise(line)), "\n")
    return F.when(keep.isNull(), _body(text)).otherwise(left)


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(_doc, _t1, _t2, n_dropped, keep) of each document that loses lines; keep is the bitmap of runs().

    A line is split off at each line feed; its key is the line without white space at its ends, A-Z in lower case. Of a
    key of at least `least` code points only the lines of the smallest id that holds it stay, all of them; a null id
    counts as one greater than all. Rows of one id are one document. Null and empty texts are one empty line and lose
    nothing; an empty table gives no rows; other columns are not read. Staged in the shared folder; lines' hashes go
    again once they have served.
    """
    made: list = []
    lines = stage(hashed_lines(docs, doc_id, text, least), "lines", made)
    gone = repeated_lines(lines).groupBy("_doc", "_t1", "_t2").agg(F.array_sort(F.collect_set("_pos")).alias("_gone"))
    bitmaps = stage(gone.select("_doc", "_t1", "_t2", F.size("_gone").cast("long").alias("n_dropped"), runs(F.col("_gone")).alias("keep")), "keep-bitmaps")
    dropped(docs.sparkSession, made)
    return bitmaps


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """One row for each row of docs: doc_id, text as it was, n_lines, n_dropped and keep, null where nothing goes; kept_text() applies it.

    Cases are those of keep_bitmaps(). Repeated rows get the same bitmap.
    """
    bitmaps = keep_bitmaps(docs, doc_id, text, least)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *_texts(F.col(text))).alias("d")
    met = rows.join(bitmaps.alias("b"), F.col("d.doc_id").eqNullSafe(F.col("b._doc")) & (F.col("d._t1") == F.col("b._t1")) & (F.col("d._t2") == F.col("b._t2")), "left")
    n_lines = F.size(F.split(_body(F.col("d.text")), "\n")).cast("long")
    return met.select("d.doc_id", "d.text", n_lines.alias("n_lines"), F.coalesce("b.n_dropped", F.lit(0).cast("long")).alias("n_dropped"), "b.keep")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of what stays, for every document."""
    rows = dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", F.sha2(kept_text(F.col("text"), F.col("keep")).cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
o AS (SELECT key, min(doc_id) AS holder FROM k WHERE length(key) >= {LEAST} GROUP BY key),
m AS (SELECT r, doc_id, i, line, length(k.key) >= {LEAST} AND holder IS DISTINCT FROM doc_id AS gone FROM k LEFT JOIN o USING (key))
SELECT CAST(any_value(doc_id) AS BIGINT) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
