"""Toxicity by logistic regression over hashed word n-grams and skip-grams, learnt by FTRL-proximal.

Words are runs of ASCII letters and digits (A-Z lower-cased) and non-ASCII bytes. Features of a text are the different
words, pairs and triples of neighbours, and pairs of words with one or two others between, hashed into 2 ** ``BITS``
buckets. Each coordinate has a learning rate of its own, and L1 leaves few weights other than zero; those, with their
buckets in order, are all that is broadcast: at most one for each different feature of the sample, in practice some hundreds.

The sample is bounded: at most ``ROWS`` labelled rows of up to ``ROW_BYTES`` each, ``BYTES`` in all, those of least hash
over the whole table. Toxic and other rows are drawn apart (a bound each, so that rare labels are seen however large the
table is); examples are weighted back to the shares that the labels have. Every text is scored whole.

Null texts and texts without a word are scored by the bias alone. Without labels of both kinds nothing can be learnt:
every score is then the share of toxic labels, 0 without any. Rows with a null or unknown label aren't learnt from; a document
with both labels is an example of both, repeated rows and labels are one example, however many; documents without an id are scored, never learnt from. Repeated rows are each scored; an empty table gives an empty
result; further columns are left alone. One pass over the texts, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import CHUNK, Hasher, chunks, cut, few, mix, texts, words

BITS = 24
MASK = np.uint64((1 << BITS) - 1)
#: The sample: rows of each label, bytes of a row, and bytes of all rows of a label at most.
ROWS, ROW_BYTES, BYTES = 8_000, 32_768, 16 << 20
#: FTRL-proximal: rate, its damping, penalties on the sums of weights and of their squares, and passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 4.0, 0.01, 6
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
#: All bytes but word characters.
GAPS = np.ones(256, bool)
GAPS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)]] = False


@dataclass
class Weights:
    buckets: np.ndarray  # sorted
    values: np.ndarray
    bias: float


def keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The features of texts, those that repeat as well, as text << BITS | bucket."""
    start, end, first = words(data, offsets, GAPS)
    h = Hasher(data, lower=True).of(start, end)
    of = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(first))
    found = [key(of, h)]
    # neighbours, triples, and pairs with one or two words between
    for seed, places in enumerate([(0, 1), (0, 1, 2), (0, 2), (0, 3)], 1):
        n = len(h) - places[-1]
        if n <= 0:
            continue
        joint = np.full(n, seed, np.uint64)
        for p in places:
            joint = mix(joint + h[p : n + p])
        inside = of[:n] == of[places[-1] :]
        found.append(key(of[:n][inside], joint[inside]))
    return np.concatenate(found)


def key(of: np.ndarray, h: np.ndarray) -> np.ndarray:
    return of << np.uint64(BITS) | h >> np.uint64(64 - BITS)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, bias: float) -> Weights:
    """rows: each example's buckets; weight: of each example. The bias, feature of every row, starts at the log odds and isn't penalised."""
    z, n = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
    bias_n, order = 0.0, np.random.default_rng(13)
    weights = lambda z, n: np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at = rows[i]
            zi, ni = z[at].astype(float), n[at].astype(float)
            w = weights(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35)))
            g = float(weight[i] * (p - labels[i]))
            up = ni + g * g
            z[at] = zi + g - (np.sqrt(up) - np.sqrt(ni)) / ALPHA * w
            n[at] = up
            bias_n += g * g
            bias -= ALPHA / (BETA + np.sqrt(bias_n)) * g
    some = np.flatnonzero(np.abs(z) > L1)
    return Weights(some.astype(np.uint64), weights(z[some].astype(float), n[some].astype(float)), bias)


def fit(sample: list[tuple[str, int, float]]) -> Weights:
    """sample: (text, label, weight)."""
    labels, weight = np.array([y for _, y, _ in sample], float), np.array([w for _, _, w in sample])
    share = float((labels * weight).sum() / weight.sum()) if len(sample) else 0.0
    if not 0 < share < 1:
        return Weights(np.zeros(0, np.uint64), np.zeros(0), 35.0 if share == 1 else -np.inf)
    raw = [t.encode("utf-8", "surrogatepass") for t, _, _ in sample]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    rows = []
    for a, b in chunks(offsets):
        found = np.unique(keys(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
        at = np.searchsorted(found, np.arange(b - a + 1, dtype=np.uint64) << np.uint64(BITS))
        found = (found & MASK).astype(np.uint32)
        rows += [found[x:y].copy() for x, y in zip(at[:-1], at[1:], strict=True)]
    return ftrl(rows, labels, weight, float(np.log(share / (1 - share))))


class Scorer:
    """The weights with a table of the buckets that have one, so that the others need neither sorting nor search."""

    def __init__(self, model: Weights):
        self.model, self.some = model, np.zeros(1 << BITS, bool)
        self.some[model.buckets] = True

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The score of each text."""
        found = keys(data, offsets)
        found = np.unique(found[self.some[found & MASK]])
        value = self.model.values[np.searchsorted(self.model.buckets, found & MASK)] if len(found) else np.zeros(0)
        total = np.bincount((found >> np.uint64(BITS)).astype(np.int64), value, len(offsets) - 1)
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-(self.model.bias + total)))


def held_out(docs: DataFrame) -> Column:
    """Whether a row is kept from the model: crc32 of its id as text is a multiple of 5."""
    return F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int, float]]:
    """The bounded sample of (text, label, weight): for each label the rows of least hash among about twice as many, up to its bytes."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y"))
    known = known.where(F.crc32(F.col("_id").cast("string").cast("binary")) % 5 != 0)
    # labels are dealt out by a hash of their own, so that only about as many texts as are needed leave the scan
    rank = F.pmod(F.xxhash64("_id", F.lit(13)), F.lit(1_000_003))
    count = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("_y") == 1, min(1.0, (2 * ROWS + 20) / count.get(1, 1))).otherwise(min(1.0, (2 * ROWS + 20) / count.get(0, 1)))
    near = few(cut(known.where(rank < share * 1_000_003)), 5 * ROWS)
    usable = docs.where(F.col("text").isNotNull() & (F.octet_length("text") <= ROW_BYTES)).select(F.col("doc_id").alias("_id"), "text")
    joined = cut(usable.join(near, "_id").dropDuplicates(["_id", "_y", "text"]).withColumn("_r", F.xxhash64("_id", F.xxhash64("text"), F.lit(13))))
    up = W.partitionBy("_y").orderBy("_r", "_id").rowsBetween(W.unboundedPreceding, 0)
    some = joined.withColumns({"_n": F.count("*").over(up), "_bytes": F.sum(F.octet_length("text")).over(up)}).where((F.col("_n") <= ROWS) & (F.col("_bytes") <= BYTES))
    rows = [tuple(x) for x in some.select("text", "_y").orderBy("_y", "_n").collect()]
    drawn = {y: sum(1 for _, z in rows if z == y) for y in (0, 1)}
    real = sum(count.values())
    return [(t, y, count[y] / real / (drawn[y] / len(rows))) for t, y in rows]


def trained(docs: DataFrame, labels: DataFrame):
    """The weights, broadcast as bytes, so that executors needn't have this module."""
    return docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(fit(sampled(docs, labels))))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, toxic) -> doc_id, held_out, score, predicted."""
    weights = trained(docs, labels)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(cloudpickle.loads(weights.value))
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            for a, b in chunks(offsets, CHUNK * 4):
                s = scorer(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                cols = [batch.column("doc_id").slice(a, b - a).cast(pa.int64()), batch.column("held_out").slice(a, b - a), pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", held_out(docs).alias("held_out")).mapInArrow(rows, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return score(read("documents"), read("labels"))
