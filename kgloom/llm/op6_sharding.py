"""Sharding by a hierarchical weighted hash tree: region, rack and shard, each drawn by weighted hashing.

A shard of weight w draws -ln(u) / w from the hash u of (key, shard). A rack's draw is the least of its shards', a
region's the least of its racks'; as draws are exponential, that is a weighted draw by the summed weight of what lies below. A key
goes to the child of least draw at each level. The law ties the levels to one another: were their draws apart, a region that wins a
key by a new shard's weight would draw again among its old racks. So a key's shard doesn't depend on how shards are
grouped; the levels say what regions and racks hold together, and where moves can go. If a shard's weight grows, or a shard is added anywhere, only
that shard's draws get less: the ones above it follow, and keys that the grown region, rack and shard win go on to
this shard alone. So for every number of shards, one more takes rows only into itself, and a weight that falls sends away
only rows of its own.

New shards fill new racks and regions in order; the law is ``key``: doc_id and the number of shards decide. Null text has
size 8 and the checksum of no bytes; null keys hash as nulls and share a shard, as the law says; repeated rows get slots of their own; ties of draws
go to the first shard; an empty table gives an empty result. Further columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Tree = list[list[list[tuple[int, float]]]]


def tree(shards: int, per_rack: int = 4, racks: int = 2, weights: dict[int, float] | None = None) -> Tree:
    """regions of ``racks`` racks of ``per_rack`` shards: [[[(shard, weight)]]]; a further region opens when the last is full."""
    flat = [(i, (weights or {}).get(i, 1.0)) for i in range(shards)]
    rack = [flat[i : i + per_rack] for i in range(0, shards, per_rack)]
    return [rack[i : i + racks] for i in range(0, len(rack), racks)]


def draw(key: Column, shard: int, weight: float, seed: int) -> Column:
    """(draw, shard) of one shard; u lies in (0, 1]."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), F.lit(shard)), 11) + 1) / F.lit(float(1 << 53))
    return F.struct((-F.ln(u) / F.lit(float(weight))).alias("draw"), F.lit(shard).alias("shard"))


def shard(key: Column, at: Tree, seed: int = 6) -> Column:
    """The shard of a key: each node hands up the least draw below it, so the root's is that of the shard to which the key descends."""
    least = lambda nodes: F.least(*nodes) if len(nodes) > 1 else nodes[0]
    return least([least([least([draw(key, i, w, seed) for i, w in rack]) for rack in region]) for region in at])["shard"]


def place(docs: DataFrame, shards: int = 24, buckets: int = 1024, seed: int = 6, **how) -> DataFrame:
    """docs (doc_id, text) -> doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Slots count rows inside a shard from 0. They are ranked in two levels, over ``buckets`` by hash of id and text and inside
    each bucket, so that no task holds a shard, nor all rows without an id.
    """
    key = F.col("doc_id").cast("long")
    at = F.pmod(F.xxhash64(key, F.lit(seed + 1), F.crc32(F.coalesce("text", F.lit("")).cast("binary"))), F.lit(buckets)).alias("_bucket")
    put = shard(key, tree(shards, **how), seed).alias("shard")
    count = docs.select(put, at).groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    base = count.select("shard", "_bucket", (F.sum("_n").over(W.partitionBy("shard").orderBy("_bucket")) - F.col("_n")).alias("_base"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), put, at, shard(key, tree(shards + 1, **how), seed).alias("grown_shard"))
    slot = F.row_number().over(W.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "size")) - 1 + F.col("_base")
    return rows.join(base, ["shard", "_bucket"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.cast("long").alias("slot"), "grown_shard")


def query(spark, sf_dir: str) -> DataFrame:
    return place(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return place(docs)
