import hashlib
import random
import re
import zlib

import pytest

from kgloom.llm import op11_prefix_trie as op
from kgloom.llm import scan

SCHEMA = "conv_id long, turn long, role string, text string, depth string, fp int, h string, w string, n int, rep string, pos int, own int"
FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "d", 1, "h", "w", 2, "r", 3, 4) for r in rows], SCHEMA).repartition(parts)


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for key, cs in members.items():
        below = [k for k in members if k[: len(key)] == key]
        children = [k for k in below if len(k) == len(key) + 1]
        leaves = [k for k in below if not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in below)]
        saved = sum((len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) for k in below if k)
        ends = ",".join(str(c) for c in sorted(cs) if len(built[c]) == len(key))
        out.append((min(cs), len(key), min(members[key[:-1]]) if key else None, len(cs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[f] for f in FIELDS) for r in df.collect()), key=repr)


def conversations(seed, n, most=6):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        line = [("user", r.choice("ab")), ("assistant", r.choice(["x y", "z"]))] * 4
        for t in range(r.randint(0, most)):
            role, text = line[t % 8] if r.random() < 0.7 else (r.choice(["user", "assistant", None]), r.choice(["q", "", None, "é ü", f"own {c}"]))
            rows.append((c, r.choice([t, t, None, 1]), role, text))
    return rows


@pytest.mark.parametrize("bits,turn_bits", [(64, 64), (3, 64), (64, 2), (2, 3)])
def test_against_brute_force(spark, bits, turn_bits):
    rows = conversations(5, 70)
    assert got(op.trie(frame(spark, rows), bits, turn_bits)) == brute(rows)


def test_nulls_ties_repeats_and_negative_ids(spark):
    rows = [(None, 0, "user", "lost"), (-25, 0, "user", "a"), (-20, None, "user", "b"), (-20, 0, None, None), (-3, 1, "user", "a"), (-3, 1, "user", "a"), (3, 1, "user", "b"), (3, 1, "user", "a"), (0, 0, "system", "s"), (0, None, None, None)]
    assert got(op.trie(frame(spark, rows))) == brute(rows)


def test_empty(spark):
    df = op.trie(frame(spark, []))
    assert df.columns == FIELDS and df.collect() == []


def test_turnless_conversations_end_at_the_root(spark):
    """Ids whose h is over 0, with one turn only and no conversation to borrow from."""
    ids = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4][:3]
    rows = [(c, 0, "user", "x") for c in ids]
    (root,) = got(op.trie(frame(spark, rows)))
    assert root == (ids[0], 0, None, 3, 0, 1, 0, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_copies_of_one_conversation_and_a_long_one(spark):
    """A third of all rows in copies of one conversation, a third in one long conversation, and a very long text."""
    rows = [(c, t, "user", f"turn {t}") for c in range(1000, 1060, 20) for t in range(40)]
    rows += [(7, t, "user", "same") for t in range(300)] + [(8, 0, "user", "w " * 100_000)] + [(c, 0, "user", "y") for c in range(200, 300)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert got(op.trie(frame(spark, rows, 7))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_scan_over_many_ranges(spark, monkeypatch):
    """Places, ends and fingerprints don't depend on where ranges and batches end."""
    r = random.Random(3)
    rows = [(g, i, r.getrandbits(63)) for g, n in (("", 1), ("a", 500), ("b", 1), ("c", 37), ("d", 90)) for i in range(n)]
    monkeypatch.setattr(scan, "powers_up_to", lambda: scan.powers(scan.BASE, 20))
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = scan.scanned(spark.createDataFrame(rows, "g string, i int, h long").repartition(5), "g", ["i"], ["i", "h"], fingerprint="h", previous="g")
        assert df.rdd.getNumPartitions() > 1
        found = {(x["g"], x["i"]): x for x in df.collect()}
    finally:
        for k, v in (("spark.sql.shuffle.partitions", "4"), ("spark.sql.adaptive.enabled", "true"), ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")):
            spark.conf.set(k, v)
    sums = {}
    size = {g: sum(x[0] == g for x in rows) for g, _, _ in rows}
    for g, i, h in rows:
        before = sums.get(g, 0)
        sums[g] = (before + h * pow(scan.BASE, i + 1, 1 << 64)) % (1 << 64)
        x = found[g, i]
        assert (x["pos"], x["last"], x["prev"]) == (i + 1, i + 1 == size[g], g if i else None)
        assert (x["fp"] % (1 << 64), x["before"] % (1 << 64)) == (sums[g], before)
