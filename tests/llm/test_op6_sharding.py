import math
import struct
import zlib
from collections import Counter

import xxhash

from kgloom.llm import op6_sharding as op


def spark_hash(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64(struct.pack("<q" if v[1] == "long" else "<i", v[0]), seed=h).intdigest()
    return h


def cost(key, shard, weight, seed=6):
    h = spark_hash((key, "long"), (seed, "int"), (shard, "int"))
    return -math.log(((h >> 11) + 1) / float(1 << 53)) / weight, shard


def brute(key, at):
    """Level by level: the child below which the least draw lies."""
    least = lambda node: cost(key, *node) if isinstance(node, tuple) else min(map(least, node))
    while not isinstance(at, tuple):
        at = min(at, key=least)
    return at[0]


def test_against_brute_force(docs_of):
    rows = [(i * 7919, "é" * (i % 5) if i % 7 else None) for i in range(300)]
    text = dict(rows)
    out = op.place(docs_of(rows)).collect()
    for r in out:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert r["shard"] == brute(r["doc_id"], op.tree(24)) and r["grown_shard"] == brute(r["doc_id"], op.tree(25))
        assert r["grown_shard"] in (r["shard"], 24)
    for s, n in Counter(r["shard"] for r in out).items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n))


def test_one_more_shard_takes_rows_only_into_itself(spark):
    """For every number of shards from 1 to 40, and about its share of them."""
    n = 4000
    at = spark.range(n).select(*(op.shard(op.F.col("id"), op.tree(k)).alias(f"s{k}") for k in range(1, 42)))
    moved = at.agg(*(op.F.count_if(op.F.col(f"s{k + 1}") != op.F.col(f"s{k}")).alias(f"m{k}") for k in range(1, 41)), *(op.F.count_if(op.F.col(f"s{k + 1}") == k).alias(f"g{k}") for k in range(1, 41))).first()
    for k in range(1, 41):
        assert moved[f"m{k}"] == moved[f"g{k}"] and abs(moved[f"g{k}"] - n / (k + 1)) < 5 * math.sqrt(n / (k + 1)) + 1


def test_racks_and_regions_draw_by_summed_weight(spark):
    weights = {0: 2.0, 5: 3.0, 9: 0.5}
    got = Counter(r["s"] for r in spark.range(20_000).select(op.shard(op.F.col("id"), op.tree(10, weights=weights)).alias("s")).collect())
    total = sum(weights.get(i, 1.0) for i in range(10))
    for part in (range(0, 4), range(4, 8), range(8, 10), range(0, 8)):
        assert abs(sum(got[i] for i in part) / 20_000 - sum(weights.get(i, 1.0) for i in part) / total) < 0.02


def test_weights_draw_their_share(spark):
    key = spark.range(20_000).select("id", op.shard(op.F.col("id"), op.tree(8, weights={0: 3.0})).alias("s"))
    n = Counter(r["s"] for r in key.collect())
    assert abs(n[0] / 20_000 - 0.3) < 0.02 and abs(n[5] / 20_000 - 0.1) < 0.02


def test_moves_stay_in_subtrees_whose_weight_changes(spark):
    """A heavier shard 9 draws keys into itself; no key moves between others."""
    both = spark.range(5000).select(op.shard(op.F.col("id"), op.tree(24)).alias("a"), op.shard(op.F.col("id"), op.tree(24, weights={9: 4.0})).alias("b")).collect()
    assert all(r["b"] in (r["a"], 9) for r in both) and any(r["a"] != r["b"] for r in both)


def test_empty_repeated_null(docs_of):
    assert op.place(docs_of([])).collect() == []
    out = op.place(docs_of([(1, "a"), (1, "a"), (None, "b"), (None, None)])).collect()
    assert len(out) == 4 and len({(r["shard"], r["slot"]) for r in out}) == 4


def test_ties_nulls_and_long_texts(docs_of):
    """Rows without an id share a shard, but not a bucket; equal rows are ranked one after another."""
    rows = [(None, f"text {i}") for i in range(50)] + [(7, "same")] * 20 + [(8, "long " * 300_000)]
    out = op.place(docs_of(rows), buckets=16).collect()
    assert len({r["shard"] for r in out if r["doc_id"] is None}) == 1 and next(r["size"] for r in out if r["doc_id"] == 8) == 1_500_008
    for s, n in Counter(r["shard"] for r in out).items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n))


def test_stage_places_every_row(spark, docs_of):
    df = docs_of([(i, "a" if i % 2 else None) for i in range(40)])
    out = op.stage(spark, df, "").collect()
    assert sorted(r["doc_id"] for r in out) == list(range(40)) and all(0 <= r["shard"] < 24 for r in out)
