"""Sharding by jump consistent hashing: a stable key and the shard count decide, with no ring table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, running_before, stage, table

SHARDS = 8
#: Broadcast the shards of at most so many rows (50 bytes each), by their count; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key (Lamping and Veach, 2014); going from n to n + 1 shards moves keys only to shard n."""
    key = keys.astype(np.uint64)
    at, to = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    while (go := to < shards).any():
        at[go] = to[go]
        key[go] = key[go] * np.uint64(2862933555777941757) + np.uint64(1)
        to[go] = ((at[go] + 1) * (float(1 << 31) / ((key[go] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
    return at


def jump_shard(key, shards: int):
    """Column form of jump_hash for a bigint column; a null key counts as key 0."""

    @F.pandas_udf("int")
    def of(values: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(values.fillna(0).to_numpy().astype(np.int64), shards).astype(np.int32))

    return of(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


RESULT = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def _sharded(rows: DataFrame, shards: int) -> DataFrame:
    """rows (_row, doc_id, size, text_crc32) with law, shard, slot and grown_shard."""
    rows = rows.withColumns({"shard": jump_shard(F.col("doc_id"), shards), "grown_shard": jump_shard(F.col("doc_id"), shards + 1), "_one": F.lit(1).cast("long")})
    ranked = running_before(rows, "shard", ["doc_id", "size", "text_crc32", "_row"], "_one", "slot")
    law = F.lit("key").alias("law")  # doc_id and shard count decide
    return ranked.withColumn("slot", F.col("slot").cast("long")).select("_row", "doc_id", "size", "text_crc32", law, "shard", "slot", "grown_shard")


def _measured(doc_id, text) -> list:
    body = F.coalesce(text, F.lit(""))
    return [doc_id.cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32")]


def shard_documents(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows RESULT, one for each row of docs, by the law `key`: key and shard count decide.

    size is the UTF-8 length of the text plus 1 (null: 1); text_crc32 of a null text is that of the empty text, 0.
    slot numbers the rows of a shard from 0 without gaps, by key (null first), size and checksum; repeated rows and rows
    with a null key get slots of their own. grown_shard is the shard with one shard more. Other columns are ignored; an
    empty table gives no rows. Texts are read once and not shuffled.
    """
    rows = stage(docs.select(*_measured(F.col(key), F.col(text)), F.monotonically_increasing_id().alias("_row")), "sharding")
    return _sharded(rows, shards).select(*RESULT)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, among SHARDS and with one more."""
    return shard_documents(table(spark, sf_dir, "documents"))


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with their shards: RESULT as in shard_documents, then the other columns of docs; those named as in RESULT give way."""
    rows = numbered(docs)
    placed = stage(_sharded(rows.select("_row", *_measured(F.col("doc.doc_id"), F.col("doc.text"))), SHARDS), "placed")
    if placed.count() <= BROADCAST_IDS:
        placed = F.broadcast(placed)
    others = [c for c in docs.columns if c.lower() not in RESULT]
    return rows.join(placed, "_row").select(*RESULT, *[F.col("doc").getField(c).alias(c) for c in others])


#: CRC-32 of the UTF-8 bytes, by the usual table of 256 remainders, which the first part computes.
CRC_SQL = """
bits AS (SELECT list(c ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(list_prepend(i::BIGINT, [0,0,0,0,0,0,0,0]::BIGINT[]), lambda a, x:
    CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, CAST(coalesce(doc_id, 0) AS HUGEINT) AS k, strlen(coalesce(text, '')) + 1 AS size,
  xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
    regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1]))) AS text_crc32 FROM documents, bits)"""

#: The jump walk is unrolled by recursion over the distinct keys; the last place below the shard count is the shard.
ORACLE_SQL = f"""
WITH RECURSIVE {CRC_SQL.strip()},
walk(k, h, b) AS (
  SELECT DISTINCT k, CASE WHEN k < 0 THEN k + 18446744073709551616::HUGEINT ELSE k END, 0::BIGINT FROM d
  UNION ALL
  SELECT k, n, CAST(floor((b + 1) * (2147483648.0::DOUBLE / ((n // 8589934592::HUGEINT)::DOUBLE + 1.0::DOUBLE))) AS BIGINT)
  FROM (SELECT k, b, (h * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS n FROM walk WHERE b < {SHARDS + 1})),
s AS (SELECT k, max(b) FILTER (WHERE b < {SHARDS}) AS shard, max(b) FILTER (WHERE b < {SHARDS + 1}) AS grown FROM walk GROUP BY k)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS BIGINT) AS slot,
  CAST(grown AS INTEGER) AS grown_shard
FROM d JOIN s USING (k)
"""
