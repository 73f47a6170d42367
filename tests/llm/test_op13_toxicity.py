import math
import random
import zlib
from pathlib import Path

import numpy as np
import pytest

from kgloom.llm import op13_toxicity as op
from kgloom.llm.common import table

DATA = Path("/root/testdata/sf0.01")


def learnt(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int, quality int, text string, held_out int, score string")


def plain_features(text):
    """A plain reading of the features: names instead of hashes."""
    raw = text.encode().lower() if text.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    words = bytes(b if not op.GAPS[b] else 32 for b in raw).split()
    out = {("w", w) for w in words}
    for name, places in (("2", (0, 1)), ("3", (0, 1, 2)), ("s1", (0, 2)), ("s2", (0, 3))):
        out |= {(name, *(words[i + p] for p in places)) for i in range(len(words) - places[-1])}
    return out


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)


def test_features_are_those_of_a_plain_reading():
    texts = ["", "One", "a B a b, a-b c", "éa x\n\nY é", "", "w " * 9, "the end"]
    found = np.unique(op.keys(*packed(texts)))
    count = np.bincount((found >> np.uint64(op.BITS)).astype(int), minlength=len(texts))
    assert count.tolist() == [len(plain_features(t)) for t in texts]


def test_features_don_t_cross_texts():
    alone = [set((np.unique(op.keys(*packed([t]))) & op.MASK).tolist()) for t in ("a b", "c d e")]
    both = np.unique(op.keys(*packed(["a b", "c d e"])))
    assert [set((both[(both >> np.uint64(op.BITS)) == i] & op.MASK).tolist()) for i in (0, 1)] == alone


def test_ftrl_against_a_plain_reading():
    """Coordinate by coordinate, in the order that the seed gives."""
    r = random.Random(2)
    rows = [np.array(sorted(r.sample(range(30), 6)), np.uint32) for _ in range(120)]
    labels = np.array([float(3 in x or 7 in x) for x in rows])
    weight = np.array([r.choice([0.5, 2.0]) for _ in rows])
    model = op.ftrl(rows, labels, weight, -1.0)
    z, n, bias, bias_n, order = [0.0] * 30, [0.0] * 30, -1.0, 0.0, np.random.default_rng(13)
    w_of = lambda i: 0.0 if abs(z[i]) <= op.L1 else -(z[i] - math.copysign(op.L1, z[i])) / ((op.BETA + math.sqrt(n[i])) / op.ALPHA + op.L2)
    for _ in range(op.EPOCHS):
        for k in order.permutation(len(rows)):
            own = [int(i) for i in rows[k]]
            w = {i: w_of(i) for i in own}
            g = weight[k] * (1 / (1 + math.exp(-(bias + sum(w.values())))) - labels[k])
            for i in own:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / op.ALPHA * w[i]
                n[i] += g * g
            bias_n += g * g
            bias -= op.ALPHA / (op.BETA + math.sqrt(bias_n)) * g
    plain = {i: w_of(i) for i in range(30) if w_of(i)}
    assert dict(zip(model.buckets.tolist(), model.values.tolist(), strict=True)) == pytest.approx(plain, rel=1e-3)
    assert model.bias == pytest.approx(bias, rel=1e-3)
    assert {3, 7} <= {i for i, w in plain.items() if w > 0} and len(plain) < 30


def corpus(n, prose):
    r = random.Random(4)
    rows = []
    for i in range(n):
        text, y = prose.text(r.randint(20, 80)), i % 6 == 0
        if y:
            words = text.split()
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["vile", "rotten", "fool"]))
            text = " ".join(words)
        rows.append((i, text, int(y)))
    return rows


def test_held_out_rows(spark, docs_of, prose):
    """Copies of learnt and of held-out rows, nulls, empty and very long texts; the label of held-out rows has no say."""
    rows = corpus(600, prose)
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    labels = [(i, 1 - y if out(i) else y, 1, "x", 1, "s") for i, _, y in rows] + [(None, 1, 1, "x", 1, "s"), (3, None, 1, "x", 1, "s")]
    more = [(1000, None), (1001, ""), (1002, "..."), (1003, "good words " * 40_000 + "vile rotten fool"), (None, "vile rotten fool")]
    docs = docs_of([(i, t) for i, t, _ in rows] + [(0, rows[0][1])] + more)
    got = op.score(docs, learnt(spark, labels)).collect()
    assert len(got) == 606 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["held_out"] == out(i) for i, _, _ in rows) and not by[None]["held_out"]
    wrong = [i for i, _, y in rows if by[i]["predicted"] != y]
    assert len(wrong) <= 6
    assert by[1000]["score"] == by[1001]["score"] == by[1002]["score"] < 0.5
    assert by[1003]["predicted"] == 1 and by[None]["predicted"] == 1


def test_without_labels_and_without_rows(spark, docs_of):
    docs = docs_of([(1, "a b"), (2, None)])
    assert {r["score"] for r in op.score(docs, learnt(spark, [])).collect()} == {0.0}
    assert {r["predicted"] for r in op.score(docs, learnt(spark, [(1, 1, 1, "", 1, "")])).collect()} == {1}
    assert op.score(docs_of([]), learnt(spark, [(1, 1, 1, "", 1, "")])).collect() == []


def test_repeated_rows_and_labels_are_one_example(spark, docs_of):
    docs = docs_of([(1, "same text")] * 30 + [(2, "other")])
    got = op.sampled(docs, learnt(spark, [(1, 1, 1, "", 1, "")] * 5 + [(1, 0, 1, "", 1, ""), (2, 0, 1, "", 1, "")]))
    assert sorted((t, y) for t, y, _ in got) == [("other", 0), ("same text", 0), ("same text", 1)]


def test_the_sample_is_bounded_and_weighted_back(spark, docs_of, monkeypatch):
    monkeypatch.setattr(op, "ROWS", 40)
    docs = docs_of([(i, f"text {i}") for i in range(2000)])
    got = op.sampled(docs, learnt(spark, [(i, int(i % 10 == 0), 1, "", 1, "") for i in range(2000)]))
    drawn = [sum(y == k for _, y, _ in got) for k in (0, 1)]
    assert drawn == [40, 40]
    share = sum(w for _, y, w in got if y) / sum(w for _, _, w in got)
    assert share == pytest.approx(0.1, abs=0.02)
    monkeypatch.setattr(op, "BYTES", 200)
    assert sum(len(t) for t, _, _ in op.sampled(docs, learnt(spark, [(i, i % 2, 1, "", 1, "") for i in range(2000)]))) <= 400


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_whole_tables(spark):
    """Few weights, nothing clean called toxic, and most toxic documents found."""
    rows = op.query(spark, str(DATA)).join(table(spark, str(DATA), "labels"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == 1 and r["toxic"] == 0 for r in rows) <= 0.02 * len(rows)
    assert sum(r["predicted"] == 1 and r["toxic"] == 1 for r in rows) >= 0.5 * sum(r["toxic"] for r in rows)
