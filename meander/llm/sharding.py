"""Sharding by jump consistent hashing.

A row's key is the first half of the MD5 of its id as text; the jump hash maps the key and a number of shards to a shard
without any table. With one more shard, only the rows that the new one takes change place.

Slots number the rows of a shard from 0 in the order of ranges and, inside a range, of (key, id, checksum, size). The ranges are dealt by
a hash of all of these, so rows of one id, or without an id, spread over them; the ranges' sizes, a small table, give each range its
first slot, so no task sees a whole shard. Rows alike in all of these are one row with a count until the end.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

ROWS_PER_RANGE = 50_000
#: Of ranges in a shard, as a power of two.
MOST_RANGE_BITS = 16


def jump(key: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash (Lamping and Veach): the last place below shards where a pseudo-random walk of the key lands."""
    state = key.astype(np.uint64)
    at, ahead = np.zeros(len(state), np.int64), np.zeros(len(state), np.float64)
    live = np.ones(len(state), bool)
    while live.any():
        at[live] = ahead[live].astype(np.int64)
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        ahead[live] = (at[live] + 1).astype(np.float64) * (float(1 << 31) / ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))
        live = ahead < shards
    return at


def key_hex(id_col: Column) -> Column:
    """16 hexadecimal digits; a null id has the key of the empty text."""
    return F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 16)


def shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return place(F.conv(key, 16, -10).cast("long"))


def with_shards(df: DataFrame, shards: int = 8, id_col: str = "doc_id") -> DataFrame:
    """df with _key, shard and grown_shard (with one shard more); no shuffle.

    Null ids share one key; repeated ids, whatever their texts, share a shard. Columns of df with these three names are replaced, all
    others stay; an empty table gives an empty result.
    """
    keyed = df.withColumn("_key", key_hex(F.col(id_col)))
    return keyed.withColumn("shard", shard_of(F.col("_key"), shards)).withColumn("grown_shard", shard_of(F.col("_key"), shards + 1))


def shard(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for each row of df.

    size: UTF-8 bytes of the text and 1; a null text counts as empty. Null ids share one key, so one shard; rows with the same
    id share a shard, and rows alike in every column take successive slots. Other columns are not read. An empty table gives
    an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    bits = min(MOST_RANGE_BITS, max(0, math.ceil(math.log2(max(1, df.count()) / (shards * ROWS_PER_RANGE)))))
    part = F.pmod(F.xxhash64("id", "text_crc32", "size"), F.lit(1 << bits)).cast("int")
    placed = with_shards(rows.groupBy("id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n")), shards, "id").withColumn("_part", part)
    sizes = placed.groupBy("shard", "_part").agg(F.sum("n").alias("rows"))
    first = sizes.select("shard", "_part", (F.sum("rows").over(W.partitionBy("shard").orderBy("_part")) - F.col("rows")).alias("first"))
    run = W.partitionBy("shard", "_part").orderBy("_key", "id", "text_crc32", "size")
    slotted = placed.withColumn("before", F.sum("n").over(run) - F.col("n")).join(first, ["shard", "_part"])
    chunk = 10_000
    wide = slotted.withColumn("c", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / chunk).cast("int"))))
    each = wide.withColumn("i", F.explode(F.sequence(F.col("c") * F.lit(chunk).cast("long"), F.least(F.col("n"), (F.col("c") + 1) * F.lit(chunk).cast("long")) - 1)))
    return each.select("id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("before") + F.col("i")).cast("long").alias("slot"), "grown_shard")
