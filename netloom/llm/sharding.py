"""Sharding by jump consistent hashing, in SQL expressions alone."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the published algorithm: its linear congruential step, the word size, and the two shifts.
STEP, WORD, HALF, SHIFT = 2862933555777941757, 1 << 64, 1 << 31, 1 << 33


def jump(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of an integer key (null counts as 0).

    The products need 128 bits, so the state is a decimal; each step goes to a larger shard, so `shards` steps do."""
    if shards < 1:
        raise ValueError("shards must be positive")
    word = F.lit(Decimal(WORD)).cast("decimal(20,0)")
    start = F.coalesce(key.cast("bigint"), F.lit(0)).cast("decimal(20,0)")
    state = F.struct(
        F.lit(-1).cast("bigint").alias("b"),
        F.lit(0).cast("bigint").alias("j"),
        F.when(start < 0, start + word).otherwise(start).cast("decimal(38,0)").alias("k"),
    )

    def step(s, _):
        k = ((s["k"].cast("decimal(20,0)") * F.lit(STEP).cast("decimal(19,0)") + F.lit(1)) % word).cast("decimal(38,0)")
        high = F.floor(k / F.lit(SHIFT).cast("decimal(11,0)")).cast("bigint")
        to = ((s["j"] + 1).cast("double") * (F.lit(float(HALF)) / (high + 1).cast("double"))).cast("bigint")
        return F.when(s["j"] < shards, F.struct(s["j"].alias("b"), to.alias("j"), k.alias("k"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), state, step, lambda s: s["b"].cast("int"))


def shard_rows(df: DataFrame, key: str, shards: int, order: list[str] = (), block_rows: int = 50_000) -> DataFrame:
    """df with shard, grown_shard (of one shard more) and slot, which numbers each shard's rows from 0 without gaps.

    Keys alone decide the shard, so equal keys share one and a null key counts as 0. Slots need an order inside a
    shard, but no task sorts a whole shard: rows fall into blocks of about block_rows by a hash of the key, blocks are
    counted, and a row's slot is the rows of the earlier blocks plus its place in its own. Rows that agree in key and
    order get their slots in any order. An empty table stays empty. Columns of df named shard, grown_shard or slot are
    replaced."""
    df = df.drop("shard", "grown_shard", "slot")
    k = F.col(f"`{key}`")
    blocks = max(1, math.ceil(df.select(key).count() / (block_rows * shards)))
    put = lambda d: d.withColumns({"shard": jump(k, shards), "_block": F.pmod(F.xxhash64(k), F.lit(blocks)).cast("int")})
    counts = put(df.select(key)).groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("shard", "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("shard", "_block").orderBy(k, *order))
    out = put(df).withColumn("grown_shard", jump(k, shards + 1)).join(counts, ["shard", "_block"])
    return out.withColumn("slot", F.col("_before") + place - 1).drop("_block", "_before")


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 under the law `key`; a null text counts as empty (8 bytes, CRC 0)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("bigint") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard_rows(rows, "doc_id", 24, ["text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), "grown_shard")
