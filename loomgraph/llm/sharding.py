"""Weighted rendezvous hashing of stable keys over shards, with dense slots inside each shard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sub-buckets that a shard's rows are ranked in, so that no task ranks a whole shard.
SLOT_BUCKETS = 256


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 to len(weights) - 1) that a key falls to.

    Each shard draws -ln(u) / weight for the key, u from a hash of key and shard; the least draw wins, so a shard gets
    rows by its weight and one more shard at the end takes rows only into itself. Weights must be above 0.
    A null key counts as one key of its own.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be above 0")
    draws = []
    for shard, weight in enumerate(weights):
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double")
        u = (bits + F.lit(0.5)) / F.lit(float(2**53))
        draws.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("draw"), F.lit(shard).alias("shard")))
    return F.array_min(F.array(*draws))["shard"] if len(draws) > 1 else F.lit(0)


def assign_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int | Sequence[float] = 24, grown: int | Sequence[float] | None = None) -> DataFrame:
    """Key, size in bytes (of the UTF-8 text plus 8), crc32 of the text, shard, slot in the shard and, if `grown` is given, the shard under that law.

    A null text has size 8 and the crc32 of no bytes. A null key is one key; repeated rows share a shard and take a slot
    each. Slots run gapless from 0 in each shard. Very long texts count by their whole length. An empty table gives no rows;
    other columns are ignored.
    """
    weights = [1.0] * shards if isinstance(shards, int) else list(shards)
    body = F.coalesce(F.col(text), F.lit(""))
    cols = [
        F.col(key).alias("key"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        rendezvous(F.col(key), weights).cast("int").alias("shard"),
        F.pmod(F.xxhash64(F.col(key), F.lit("slot")), F.lit(SLOT_BUCKETS)).cast("int").alias("bucket"),
    ]
    if grown is not None:
        more = [1.0] * grown if isinstance(grown, int) else list(grown)
        cols.append(rendezvous(F.col(key), more).cast("int").alias("grown_shard"))
    rows = docs.select(*cols)
    # Shards times buckets rows at most, whatever the input: safe to broadcast.
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "bucket").orderBy("key", "size", "text_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(within) - 1)
    placed = ranked.join(F.broadcast(offsets), ["shard", "bucket"])
    out = ["key", "size", "text_crc32", "shard", (F.col("before") + F.col("rank")).cast("long").alias("slot")]
    return placed.select(*out, *(["grown_shard"] if grown is not None else []))
