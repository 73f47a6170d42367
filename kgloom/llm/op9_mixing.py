"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, then seeded block selection.

Only DataFrame operations. Null text counts 0 words and null sources are one source, sorted last. Documents
without words take part with ``taken`` 0; ``whole`` leaves them out, as no target asks for them. Repeated rows are separate stretches of their
source in ``mix``; to ``whole`` equal rows (id, source and text) are one document of their summed size, taken together. Ties
of quotients go to the first source, of draws to the first block. An empty table gives an empty result. Columns other than id, text and source
are left alone. ``blocks`` bounds the tables of blocks and awards, whatever the corpus; what a block is too coarse for is cut or corrected
to the word (``mix``) or to half a document (``whole``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORDS, cut, fresh


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size) -> with rank, weight and target: shares of the total by weight, none above ``most`` times its source.

    Sources in ascending order of cap / weight are capped one after another as long as the rest's equal share
    reaches their cap; this is where resharing the excess again and again ends. One row a source.
    """
    ordered = sizes.withColumn("_s", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_s") - 1) % len(weights) + 1).cast("int"))
    w = ordered.withColumns({"_w": weight.cast("long"), "_cap": F.col("source_size") * most})
    up = W.orderBy(F.col("_cap") / F.col("_w"), "_s")
    before, all_rows = up.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    w = w.withColumn("_total", F.sum("source_size").over(all_rows))
    w = w.withColumns({"_full": F.coalesce(F.sum("_cap").over(before), F.lit(0)), "_left": F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(before), F.lit(0))})
    w = w.withColumn("_capped", (F.col("_total") - F.col("_full")) * F.col("_w") >= F.col("_cap") * F.col("_left"))
    some = lambda c: F.coalesce(F.sum(F.when(F.col("_capped"), F.col(c)).otherwise(0)).over(all_rows), F.lit(0))
    w = w.withColumns({"_full": some("_cap"), "_left": F.sum("_w").over(all_rows) - some("_w")})
    share = (F.col("_total") - F.col("_full")).cast("double") / F.col("_left").cast("double") * F.col("_w").cast("double")
    return w.withColumn("target", F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(share)).select("source", "source_size", "_s", F.col("_w").alias("weight"), "target", F.col("_total").alias("total"))


def quotas(of: DataFrame, blocks: int = 20_000, shards: int = 64, most: int = 3) -> DataFrame:
    """(_s, shard, quota): blocks awarded by the highest quotients target / (2 j + 1), in order of award.

    ``blocks`` is the number of equal-token blocks of the whole mix at most; the candidate quotients are those up to a
    source's exact share plus the most that rounding can add. Shard k gets the awards of its stretch of the
    award order, so that each prefix of shards is itself a Sainte-Lague apportionment.
    """
    of = of.withColumns({"_b": block_words(blocks), "_n": F.count("*").over(W.partitionBy())})
    of = of.withColumn("_h", F.ceil(F.col("total") / F.col("_b"))).where("target > 0")
    share = F.col("target") / F.col("total")
    ask = F.least(most * F.ceil(F.col("source_size") / F.col("_b")), F.ceil(share * F.col("_h")) + F.ceil(share * F.col("_n") / 2) + 2)
    asked = of.select("_s", "target", "_h", F.explode(F.sequence(F.lit(0).cast("long"), ask - 1)).alias("_j"))
    order = W.orderBy((F.col("target") / (2 * F.col("_j") + 1)).desc(), "_s", "_j")
    award = asked.withColumn("_a", F.row_number().over(order)).where("_a <= _h")
    return award.groupBy("_s", F.floor((F.col("_a") - 1) * shards / F.col("_h")).cast("int").alias("shard")).agg(F.count("*").alias("quota"))


def block_words(blocks: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col("total") / blocks)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """docs -> doc_id, source, a hash of the text, and its words."""
    return docs.select("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"), F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"))


def lay(base: DataFrame, weights: tuple[int, ...], most: int, blocks: int, buckets: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """base, as by ``sized`` -> the plan, one row a source, and documents with the place where each starts in its source's seeded order.

    A target is _e whole passes of its source and _rest words. Prefix sums run in two levels, over ``buckets`` of the
    order and inside each, so that no task ever holds a whole source.
    """
    plan = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    plan = plan.withColumns({"_b": block_words(blocks), "_n": F.ceil(F.col("source_size") / block_words(blocks))})
    plan = plan.withColumn("_e", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = cut(plan.withColumn("_rest", F.least(F.round("target") - F.col("_e") * F.col("source_size"), F.col("source_size")).cast("long")))
    order = F.xxhash64("doc_id", "_h", F.lit(seed))
    placed = base.join(plan.select(F.col("source").alias("_src"), "_s", "_b", "_e", "_rest", "source_size", "target"), F.col("source").eqNullSafe(F.col("_src"))).drop("_src")
    placed = placed.withColumns({"_at": order, "_bucket": F.pmod(F.shiftrightunsigned(order, 20), F.lit(buckets))})
    start = placed.groupBy("_s", "_bucket").agg(F.sum("size").alias("_sum"))
    start = start.withColumn("_base", F.sum("_sum").over(W.partitionBy("_s").orderBy("_bucket")) - F.col("_sum")).drop("_sum")
    inside = W.partitionBy("_s", "_bucket").orderBy("_at", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    return plan, placed.join(start, ["_s", "_bucket"]).withColumn("_start", F.col("_base") + F.sum("size").over(inside) - F.col("size"))


def ordered(plan: DataFrame, blocks: int, shards: int, most: int, seed: int) -> DataFrame:
    """(_s, _k, _len, _group, _draw): every source's blocks in the order in which they are taken, by group, draw and number.

    A source's blocks are dealt out to the shards by seed. Of its awards beyond whole passes, each shard takes as many blocks of
    its own, in seeded order: groups 0 to shards - 1. The others follow, as groups beyond, for what rounding or a short shard leaves open.
    """
    upto = W.partitionBy("_s").orderBy("shard")
    quota = quotas(plan, blocks, shards, most).join(plan.select("_s", (F.col("_e") * F.col("_n")).alias("_whole")), "_s").withColumn("_upto", F.sum("quota").over(upto))
    beyond = lambda c: F.greatest(F.lit(0), c - F.col("_whole"))
    quota = quota.select("_s", F.col("shard").alias("_shard"), (beyond(F.col("_upto")) - beyond(F.col("_upto") - F.col("quota"))).alias("_q"))
    block = plan.where("_n > 0").select("_s", "_b", "source_size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_k"))
    draw = F.xxhash64(F.lit(seed), "_s", "_k")
    block = block.withColumns({"_len": F.least(F.col("_b"), F.col("source_size") - F.col("_k") * F.col("_b")), "_draw": draw, "_shard": F.pmod(F.shiftrightunsigned(draw, 20), F.lit(shards)).cast("int")})
    block = block.join(quota, ["_s", "_shard"], "left").withColumn("_i", F.row_number().over(W.partitionBy("_s", "_shard").orderBy("_draw", "_k")))
    group = F.col("_shard") + F.when(F.col("_i") <= F.coalesce("_q", F.lit(0)), 0).otherwise(shards)
    return cut(block.select("_s", "_k", "_len", group.alias("_group"), "_draw"))


def before(block: DataFrame, size: str) -> DataFrame:
    """block (_s, _k, _group, _draw, size) -> with _before, the sum of size of the blocks ahead: inside each group, and over groups."""
    group = block.groupBy("_s", "_group").agg(F.sum(size).alias("_sum"))
    group = group.select("_s", "_group", (F.sum("_sum").over(W.partitionBy("_s").orderBy("_group")) - F.col("_sum")).alias("_base"))
    inside = W.partitionBy("_s", "_group").orderBy("_draw", "_k").rowsBetween(W.unboundedPreceding, 0)
    return block.join(group, ["_s", "_group"]).withColumn("_before", F.col("_base") + F.sum(size).over(inside) - F.col(size))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, blocks: int = 20_000, shards: int = 64, buckets: int = 4096, seed: int = 9) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, size, source, source_size, target, taken.

    Each source's documents lie end to end in a seeded order, cut into equal-token blocks. A source first takes
    every whole pass its target holds, then the blocks that its quotas choose; the last one is cut where the target is reached.
    """
    plan, placed = lay(cut(sized(docs)), weights, most, blocks, buckets, seed)
    block = before(ordered(plan, blocks, shards, most, seed), "_len").join(plan.select("_s", "_b", "_rest"), "_s").where("_before < _rest")
    block = block.select("_s", "_k", (F.col("_k") * F.col("_b")).alias("_from"), F.least(F.col("_len"), F.col("_rest") - F.col("_before")).alias("_take"))
    out = ["doc_id", "size", "source", "source_size", "target", "taken"]
    some, none = placed.where("size > 0"), placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    some = some.withColumn("_k", F.explode(F.sequence(F.floor(F.col("_start") / F.col("_b")), F.floor((F.col("_start") + F.col("size") - 1) / F.col("_b")))))
    shared = F.greatest(F.lit(0), F.least(F.col("_start") + F.col("size"), F.col("_from") + F.col("_take")) - F.greatest("_start", "_from"))
    some = some.join(block, ["_s", "_k"], "left").groupBy("_s", "_start").agg(*(F.first(c).alias(c) for c in out[:-1]), (F.first("_e") * F.first("size") + F.sum(F.when(F.col("_from").isNull(), 0).otherwise(shared))).alias("taken"))
    return some.select(out).unionByName(none.select(out))


def whole(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, blocks: int = 20_000, shards: int = 64, buckets: int = 4096, seed: int = 9) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, source, _h, size, target, times: the mix by whole documents.

    As ``mix``, but a block stands for the documents that start in it: after the whole passes, documents are taken in the order in which their
    blocks are, as long as half of the next still fits. The words miss the target by half a document at most; a source with any target keeps a document.
    """
    base = cut(sized(docs).groupBy("doc_id", "source", "_h").agg(F.sum("size").alias("size")).where("size > 0"))
    plan, placed = lay(base, weights, most, blocks, buckets, seed)
    placed = cut(placed.withColumn("_k", F.floor(F.col("_start") / F.col("_b"))))
    holds = placed.groupBy("_s", "_k").agg(F.sum("size").alias("_words"), F.min("_start").alias("_first"))
    block = before(ordered(plan, blocks, shards, most, seed).join(holds, ["_s", "_k"]), "_words").select("_s", "_k", "_before", "_first")
    at = F.col("_before") + F.col("_start") - F.col("_first")
    more = (2 * at + F.col("size") <= 2 * F.col("_rest")) | (at == 0) & (F.col("_e") == 0) & (F.col("_rest") > 0)
    return placed.join(block, ["_s", "_k"]).select("doc_id", "source", "_h", "size", "target", (F.col("_e") + more.cast("long")).cast("int").alias("times"))


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix by whole documents takes it."""
    i, src, h, times, n = fresh(docs, "_i", "_src", "_hash", "_times", "_n")
    often = cut(whole(docs).where("times > 0").select(F.col("doc_id").alias(i), F.col("source").alias(src), F.col("_h").alias(h), F.col("times").alias(times)))
    text = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    both = docs.join(often, docs["doc_id"].eqNullSafe(often[i]) & docs["source"].eqNullSafe(often[src]) & (text == often[h]))
    return both.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)
