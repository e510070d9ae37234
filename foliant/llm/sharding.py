"""Shard assignment by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import table

SHARDS = 16
#: Slots are counted within this many buckets of each shard; it also bounds the broadcast
#: table of offsets to ``SHARDS * BUCKETS`` rows of 20 bytes, however many documents there are.
BUCKETS = 2048


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key; going from n to n + 1 shards moves keys only to shard n."""
    state = keys.astype(np.uint64, copy=True)
    bucket = np.zeros(len(state), np.int64)
    jump = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(live):
            bucket[live] = jump[live]
            s = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
            state[live] = s
            jump[live] = ((bucket[live] + 1) * (float(1 << 31) / ((s >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
            live = live[jump[live] < shards]
    return bucket.astype(np.int32)


def _mixed(keys: np.ndarray) -> np.ndarray:
    """Keys spread over all 64 bits (splitmix64's finaliser), as neighbouring ids would else share their first jumps."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _place(shards: int):
    """Shard, shard with one more, and the bucket that slots are counted in, of each key."""

    @F.arrow_udf("struct<shard:int,grown_shard:int,bucket:int>")
    def udf(keys: pa.Array) -> pa.Array:
        mixed = _mixed(keys.to_numpy(zero_copy_only=False).view(np.uint64))
        return pa.StructArray.from_arrays([pa.array(jump_hash(mixed, shards)), pa.array(jump_hash(mixed, shards + 1)), pa.array((mixed >> np.uint64(53)).astype(np.int32) % BUCKETS)], ["shard", "grown_shard", "bucket"])

    return udf


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """Shard, slot and the shard after one more shard is appended, for every row.

    Only the id and the number of shards decide the shard, so equal texts may part.  An integer id
    is its own key, any other's is its hash.  Slots number each shard's rows from 0
    without a gap: a row's rank within its (shard, bucket) plus the rows in the shard's
    earlier buckets.  Ranks order by id, size and checksum; rows equal in all of them are
    interchangeable.

    Null text: size 1 and checksum 0, as for the empty text.  Null ids share one key and so
    one shard.  Repeated ids stay together in one shard, each with its own slot.  No rows in,
    no rows out.
    """
    rows = df.select(df[id_col].alias("id"), F.coalesce(df[text_col].cast("string"), F.lit("")).cast("binary").alias("raw"))
    whole = isinstance(rows.schema["id"].dataType, T.IntegralType)
    key = F.coalesce(F.col("id").cast("long"), F.lit(-1)) if whole else F.xxhash64("id")
    placed = rows.select("id", (F.octet_length("raw") + 1).cast("long").alias("size"), F.crc32("raw").alias("text_crc32"), _place(shards)(key).alias("p"))
    placed = placed.select("id", "size", "text_crc32", "p.*")
    per_bucket = rows.select(_place(shards)(key).alias("p")).groupBy("p.shard", "p.bucket").count()
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("shard", "bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "size", "text_crc32"))
    return (
        placed.withColumn("rank", rank)
        .join(F.broadcast(offsets), ["shard", "bucket"])
        .select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard")
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def _sql(shards: int = SHARDS) -> str:
    """The same in SQL: 64-bit steps in HUGEINT, the jumps as a recursion, CRC-32 a bit at a time."""
    word = 1 << 64

    # A HUGEINT product of two 64-bit numbers may overflow, so the factor goes in two halves.
    def product(x: str, k: int) -> str:
        hi, lo = k >> 32, k & 0xFFFFFFFF
        return f"((({x} * {hi}::HUGEINT) % {1 << 32}::HUGEINT) * {1 << 32}::HUGEINT + {x} * {lo}::HUGEINT) % {word}::HUGEINT"

    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k0 AS (SELECT doc_id, text, (coalesce(doc_id, -1)::HUGEINT + {word}::HUGEINT + {0x9E3779B97F4A7C15}::HUGEINT) % {word}::HUGEINT AS x FROM d),
k1 AS (SELECT doc_id, text, xor(x, x >> 30) AS x FROM k0),
k2 AS (SELECT doc_id, text, {product("x", 0xBF58476D1CE4E5B9)} AS x FROM k1),
k3 AS (SELECT doc_id, text, xor(x, x >> 27) AS x FROM k2),
k4 AS (SELECT doc_id, text, {product("x", 0x94D049BB133111EB)} AS x FROM k3),
k AS (SELECT doc_id, text, xor(x, x >> 31) AS x FROM k4),
jumps AS (
  SELECT DISTINCT x, x AS s, -1::BIGINT AS b, 0::BIGINT AS j FROM k
  UNION ALL
  SELECT x, n AS s, j AS b, CAST(floor((j + 1) * (2147483648.0::DOUBLE / ((n >> 33)::DOUBLE + 1.0::DOUBLE))) AS BIGINT) AS j
  FROM (SELECT x, j, ({product("s", 2862933555777941757)} + 1) % {word}::HUGEINT AS n FROM jumps WHERE j < {shards + 1})),
placed AS (SELECT x, CAST(max(b) FILTER (b < {shards}) AS INTEGER) AS shard, CAST(max(b) AS INTEGER) AS grown_shard FROM jumps WHERE b >= 0 GROUP BY x),
c AS (
  SELECT doc_id, text, x, CAST(strlen(text) + 1 AS BIGINT) AS size,
    CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: [CAST('0x' || h AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, y: xor(xor(a, y) >> 1, 3988292384 * (xor(a, y) & 1))), 4294967295) AS BIGINT) AS text_crc32
  FROM k)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY CAST(c.x >> 53 AS INTEGER), doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM c JOIN placed ON c.x = placed.x
"""


OP2_SQL = _sql()
