"""Sharding by jump consistent hashing: DataFrame functions only.

The jump function walks a key's pseudo-random sequence of growing shard numbers; the shard is the last one below the
number of shards. No ring table is kept, and with one shard more a key either stays or goes to the new shard.

Slots number the rows of a shard without a gap, from 0. A shard is no single task's list: its rows are cut into `buckets`
by another hash, counted by bucket, and numbered within the bucket from the sum of the counts before it. What is broadcast
is a count for each shard and bucket, bounded by shards * buckets.

Cases: a null key is hashed as a key of its own. A null text has no bytes: size 1 and the checksum of nothing, 0. Equal keys
share a shard; repeated rows have slots of their own. Columns of the input named as the added ones give way to them; no other
is touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unused

BUCKETS = 2048
_LOW = 0xFFFFFFFF
#: The multiplier of the published jump function's 64-bit linear congruential generator.
_MULTIPLIER = 2862933555777941757


def _long(x: int) -> Column:
    return F.lit(x).cast("bigint")


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) * multiplier + 1 modulo 2^64, in 32-bit limbs: a long product would overflow, which is an error in ANSI mode."""
    m_hi, m_lo = _MULTIPLIER >> 32, _MULTIPLIER & _LOW
    a, b = m_lo >> 16, m_lo & 0xFFFF
    upper = lo * _long(a)  # below 2^48, as are all products here
    low = lo * _long(b) + F.shiftleft(upper.bitwiseAND(_long(0xFFFF)), 16) + _long(1)
    carry = F.shiftright(low, 32) + F.shiftright(upper, 16)
    cross = (hi * _long(b)).bitwiseAND(_long(_LOW)) + F.shiftleft((hi * _long(a)).bitwiseAND(_long(0xFFFF)), 16)
    high = carry + (lo * _long(m_hi)).bitwiseAND(_long(_LOW)) + cross
    return high.bitwiseAND(_long(_LOW)), low.bitwiseAND(_long(_LOW))


def jump(key: Column, *shards: int) -> Column:
    """A struct n<number> of the shards that a 64-bit key has among each of these numbers of shards."""
    most = max(shards)
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(_long(_LOW)).alias("lo"), _long(0).alias("j"), *(_long(0).alias(f"n{n}") for n in shards)
    )

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next(s["hi"], s["lo"])
        # the shard to which j jumps; top 31 bits of the generator are the draw
        to = F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + 1).cast("double"))).cast("bigint")
        jumped = F.struct(hi.alias("hi"), lo.alias("lo"), to.alias("j"), *(F.when(s["j"] < n, s["j"]).otherwise(s[f"n{n}"]).alias(f"n{n}") for n in shards))
        return F.when(s["j"] < most, jumped).otherwise(s)

    # j grows by one at least with each step
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)


def key_of(column: str) -> Column:
    return F.xxhash64(F.lit("shard"), F.col(column))


def assign(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard (its shard if there were one more)."""
    jumped, at, within_bucket, first_slot = unused(docs, "_jump", "_bucket", "_within", "_first")
    bucket = F.pmod(F.xxhash64(F.lit("slot"), F.col(key)), F.lit(buckets)).cast("int")

    def sharded(df: DataFrame) -> DataFrame:
        return df.withColumn(jumped, jump(key_of(key), shards, shards + 1)).withColumns({"shard": F.col(f"{jumped}.n{shards}").cast("int"), at: bucket})

    counted = sharded(docs.select(key)).groupBy("shard", at).agg(F.count("*").alias("_count"))
    before = F.sum("_count").over(Window.partitionBy("shard").orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    first = counted.select("shard", at, F.coalesce(before, _long(0)).alias(first_slot))
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = sharded(docs).withColumns(
        {"size": F.octet_length(raw).cast("bigint") + 1, "text_crc32": F.crc32(raw), "law": F.lit("key"), "grown_shard": F.col(f"{jumped}.n{shards + 1}").cast("int")}
    )
    within = F.row_number().over(Window.partitionBy("shard", at).orderBy(key, "text_crc32", "size")).cast("bigint") - 1
    return rows.withColumn(within_bucket, within).join(F.broadcast(first), ["shard", at]).withColumn("slot", F.col(first_slot) + F.col(within_bucket)).drop(jumped, at, within_bucket, first_slot)
