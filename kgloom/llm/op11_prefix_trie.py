"""A trie of conversations over their turns: every prefix that conversations share is a node.

Turns get 64-bit hashes; texts of one hash are compared, and where they differ the hashes are made to. Rolling prefix
fingerprints (polynomials over the turns' hashes, numpy scans over ranges of rows, see ``scan``) group the candidates of a
node by depth and fingerprint. Each group is verified turn by turn against its representative, the smallest member: the
last turn and the fingerprint before it must be the representative's, for all depths, so by induction the whole prefix is.
Members that differ are split off with everything below, and all is verified again.

Rollup: below a shared node only whole groups go apart, so a node's smallest member stays the smallest further down, and
each node lies on the chain of its smallest member. What a subtree holds is the sum, over the chains that run through its
top, of what each chain has from there on. That takes one running sum along each chain and one grouped sum over the rows,
whatever the depth; children roll up to parents by a count.

Conversations without an id don't count; a null role or text is empty. Turns of a conversation with the same number go by
role, then by the MD5 of their text; repeated rows are turns of their own. An empty table has no nodes, not even the root.
Further columns are left alone. Very long texts are only hashed, and compared if another text has their hash. Groups,
chains and conversations of any size are spread over tasks; only the SHA-256 of the ids that end at a node has to run over
them in one go, as the contract says, so that gets them as a few long texts joined in parallel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORDS, cut, few
from .scan import scanned

#: Conversations whose first turns come from the first conversation of as many; and up to one turn less than this.
FAMILY, MOST = 20, 4
#: Nodes of a chain that a running sum takes together.
BLOCK = 1024
KEY = ["depth", "fp"]


def identified(convs: DataFrame, bits: int = 64) -> DataFrame:
    """conv_id, turn, role, digest, h, w of all turns with an id; h is equal for equal (role, text) only. ``bits`` are fewer in tests."""
    mask = F.lit((1 << bits) - 1 if bits < 64 else -1).cast("long")
    turns = convs.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("h", F.xxhash64("role", "text").bitwiseAND(mask))
    for attempt in range(64):
        several = few(cut(turns.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")), 500_000)
        different = turns.join(several, "h", "left_semi").select("h", "role", "text").distinct()
        clash = cut(different.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
        if clash.isEmpty():
            break
        variant = F.row_number().over(W.partitionBy("h").orderBy("role", "text"))
        apart = cut(different.join(clash, "h", "left_semi").withColumn("v", variant).where("v > 1"))
        turns = turns.join(apart, ["h", "role", "text"], "left").withColumn("h", F.when(F.col("v").isNull(), F.col("h")).otherwise(F.xxhash64(F.lit(attempt), "role", "text", "v"))).drop("v")
    return turns.select("conv_id", "turn", "role", F.unhex(F.md5("text")).alias("digest"), "h", F.regexp_count("text", F.lit(WORDS)).cast("long").alias("w"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations in order (conv_id, own, at, h, w), and all conv_ids."""
    placed = scanned(turns, "conv_id", ["turn", "role", "digest"], ["h", "w"])
    borrowed = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST
    convs = placed.where("last").select("conv_id")
    heads = placed.where((F.col("pos") < MOST) & (F.col("conv_id") % FAMILY == 0)).select(F.col("conv_id").alias("base"), F.col("pos").alias("at"), "h", "w")
    shared = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % FAMILY, "n": borrowed}).where("n > 0").join(heads, "base").where("at <= n").select("conv_id", F.lit(0).alias("own"), "at", "h", "w")
    own = placed.where(F.col("pos") > borrowed).select("conv_id", F.lit(1).alias("own"), F.col("pos").alias("at"), "h", "w")
    return shared.unionByName(own), convs


def grouped(members: DataFrame) -> DataFrame:
    """A row for each depth and fingerprint; ``same`` tells whether all members end with one turn after one fingerprint."""
    sums = [F.count("*").alias("n"), F.min("conv_id").alias("rep"), F.min("before").alias("before"), F.min("w").alias("w"), F.count_if(F.col("last")).alias("n_ends"), F.min(F.when(F.col("last"), F.col("conv_id"))).alias("first_end")]
    same = (F.min("h") == F.max("h")) & (F.min("before") == F.max("before"))
    return cut(members.groupBy(*KEY).agg(*sums, same.alias("same")))


def split(members: DataFrame, nodes: DataFrame, attempt: int) -> DataFrame:
    """Members that differ from their group's representative get other fingerprints, there and at all greater depths."""
    wrong = members.join(nodes.where("NOT same").select(*KEY), KEY).select("conv_id", *KEY, "h", "before")
    like = wrong.groupBy(*KEY).agg(F.min_by(F.struct("h", "before"), "conv_id").alias("like"))
    odd = wrong.join(like, KEY).where("h != like.h OR before != like.before")
    salts = odd.groupBy("conv_id").agg(F.collect_list(F.struct("depth", F.xxhash64(F.lit(attempt), *KEY, "h", "before").alias("salt"))).alias("salts"))
    changed = lambda upto: F.aggregate(F.filter("salts", lambda x: x["depth"] <= upto), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x["salt"]))
    by = {c: F.when(F.col("salts").isNull(), F.col(c)).otherwise(F.col(c).bitwiseXOR(changed(upto))) for c, upto in (("fp", F.col("depth")), ("before", F.col("depth") - 1))}
    return cut(members.join(salts, "conv_id", "left").withColumns(by).drop("salts"))


def verified(members: DataFrame, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Members and nodes (groups by depth and fingerprint) in which all members share the whole prefix."""
    if bits < 64:
        mask = F.lit((1 << bits) - 1).cast("long")
        members = members.withColumns({"fp": F.col("fp").bitwiseAND(mask), "before": F.col("before").bitwiseAND(mask)})
    members = cut(members)
    for attempt in range(64):
        nodes = grouped(members)
        if nodes.where("NOT same").isEmpty():
            return members, nodes.drop("same")
        members = split(members, nodes, attempt)
    raise ValueError("prefixes can't be told apart")


def rolled_up(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """depth, fp, saved_tokens, n_leaves of all nodes but the root."""
    own = nodes.where("n > 1").select("rep", *KEY, ((F.col("n") - 1) * F.col("w")).alias("own"), F.expr(f"depth div {BLOCK}").alias("block"))
    later = own.groupBy("rep", "block").agg(F.sum("own").alias("own")).select("rep", "block", F.coalesce(F.sum("own").over(W.partitionBy("rep").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("later"))
    here = F.sum("own").over(W.partitionBy("rep", "block").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0))
    onward = cut(own.withColumn("here", here).join(later, ["rep", "block"]).select("rep", *KEY, (F.col("here") + F.col("later")).alias("saved")))
    leaves = nodes.where("n_ends = n").select("rep", F.lit(None).cast("long").alias("top"), F.lit(0).cast("long").alias("total"), F.lit(1).alias("leaf"))
    chains = onward.groupBy("rep").agg(F.min("depth").alias("top"), F.max("saved").alias("total"), F.lit(0).alias("leaf")).where("total > 0").unionByName(leaves)
    chains = chains.groupBy(F.col("rep").alias("conv_id")).agg(F.max("top").alias("top"), F.max("total").alias("total"), F.max("leaf").alias("leaf"))
    through = members.join(chains, "conv_id").select(*KEY, F.when(F.col("depth") < F.col("top"), F.col("total")).otherwise(0).alias("saved"), "leaf")
    parts = through.unionByName(onward.select(*KEY, "saved", F.lit(0).alias("leaf")))
    return parts.groupBy(*KEY).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))


def joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one node, as comma-joined texts of their ids."""
    for batch in batches:
        if not batch.num_rows:
            continue
        depth, fp, ids = (batch.column(i).to_numpy() for i in range(3))
        start = np.flatnonzero(np.append(True, (depth[1:] != depth[:-1]) | (fp[1:] != fp[:-1])))
        end = np.append(start[1:], len(ids))
        text = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(start, end, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(depth[start]), pa.array(fp[start]), pa.array(ids[start]), pa.array(text, pa.string())], names=["depth", "fp", "at", "ids"])


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's texts, which follow one another, joined by commas."""
    key, sha = None, None
    for batch in batches:
        out = []
        for depth, fp, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
            text = ids.as_buffer()
            if (depth, fp) != key:
                if key is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha = (depth, fp), hashlib.sha256(text)
            else:
                sha.update(b",")
                sha.update(text)
        if out:
            yield digests(out)
    if key is not None:
        yield digests([(*key, sha.hexdigest())])


def digests(rows: list[tuple]) -> pa.RecordBatch:
    depth, fp, sha = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(fp, pa.int64()), pa.array(sha, pa.string())], names=["depth", "fp", "ends_sha256"])


def ends(rows: DataFrame) -> DataFrame:
    """(depth, fp, conv_id) -> depth, fp, ends_sha256 of the ids in ascending order."""
    pieces = rows.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(joined_ids, "depth long, fp long, at long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "at").mapInArrow(digested, "depth long, fp long, ends_sha256 string")


def trie(convs: DataFrame, bits: int = 64, turn_bits: int = 64) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> a row for each node; ``bits`` and ``turn_bits`` of hashes are fewer in tests."""
    turns, ids = rebuilt(identified(convs, turn_bits))
    members = scanned(turns, "conv_id", ["own", "at"], ["h", "w"], fingerprint="h").withColumnRenamed("pos", "depth")
    members, nodes = verified(members, bits)
    root = nodes.agg(F.count_if(F.col("depth") == 1).alias("n_children"), F.count_if(F.col("n_ends") == F.col("n")).alias("n_leaves"), F.coalesce(F.sum((F.col("n") - 1) * F.col("w")), F.lit(0)).alias("saved_tokens"))
    turnless = ids.join(members.where("last"), "conv_id", "left_anti").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("fp"), "conv_id")
    top = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    of_top = F.broadcast(ends(turnless).select("ends_sha256"))  # one row at most
    none = F.sha2(F.lit("").cast("binary"), 256)
    root = top.join(F.broadcast(root), how="cross").join(of_top, how="left").withColumns({"depth": F.lit(0).cast("long"), "parent_conv_id": F.lit(None).cast("long"), "n_leaves": F.greatest("n_leaves", F.lit(1)), "ends_sha256": F.coalesce("ends_sha256", none)})
    many = ends(members.where("last").join(nodes.where("n_ends > 1").select(*KEY), KEY))
    below = nodes.where("depth > 1").groupBy((F.col("depth") - 1).alias("depth"), F.col("before").alias("fp")).agg(F.count("*").alias("n_children"))
    parents = nodes.where("n > n_ends").select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("before"), F.col("rep").alias("parent_conv_id"))
    least = F.broadcast(ids.agg(F.min("conv_id").alias("_least")))
    placed = nodes.join(parents, ["depth", "before"], "left").join(least).withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.col("_least")).otherwise(F.col("parent_conv_id"))).drop("_least")
    out = reduce(lambda a, b: a.join(b, KEY, "left"), (below, rolled_up(members, nodes), many), cut(placed))
    sha = F.coalesce("ends_sha256", F.sha2(F.coalesce(F.col("first_end").cast("string"), F.lit("")).cast("binary"), 256))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = out.select(F.col("rep").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", sha.alias("ends_sha256"))
    return inner.select(*columns).unionByName(root.select(*columns))


def query(spark, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
