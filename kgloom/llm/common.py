"""What the operators share: tables cut from their lineage, text buffers, word hashes, connected components."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
#: Text bytes that a numpy step works on at once; a single longer text is taken whole.
CHUNK = 1 << 17
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; one of our own only where that is unset and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="kgloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have."""
    used = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in used:
            n += "_"
        used.add(n.lower())
        out.append(n)
    return out


def few(df: DataFrame, most_rows: int, most_bytes: int = 32 << 20) -> DataFrame:
    """df with a broadcast hint if its rows and the bytes of its texts, both counted, are few enough."""
    text = [F.octet_length(c) for c, t in df.dtypes if t == "string"] + [F.octet_length(F.array_join(c, " ")) for c, t in df.dtypes if t == "array<string>"]
    size = sum((F.coalesce(x, F.lit(0)) for x in text), F.lit(16 * len(df.columns)))
    rows, volume = df.agg(F.count("*"), F.sum(size)).first()
    return F.broadcast(df) if rows <= most_rows and (volume or 0) <= most_bytes else df


def without(docs: DataFrame, gone: DataFrame, *key: Column, most: int = 500_000) -> DataFrame:
    """docs but for the rows whose key (doc_id if not given) is in gone, which has as many columns; a null key stays.

    Up to ``most`` keys, which are counted, are broadcast, so that whole texts aren't shuffled; more are joined by shuffle.
    """
    key = key or (docs["doc_id"],)
    names = fresh(docs, *(f"_gone{i}" for i in range(len(key))))
    gone = few(cut(gone.toDF(*names).distinct()), most)
    on = [k == gone[n] for k, n in zip(key, names, strict=True)]
    return docs.join(gone, on, "left_anti")


_ours: dict[str, set[str]] = {}


def scratch(spark: SparkSession) -> str:
    """A new place in the shared folder, deleted when this application ends."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/kgloom-{uuid.uuid4().hex}"
    if app not in _ours:
        _ours[app] = set()
        atexit.register(sweep, spark, app)
    _ours[app].add(path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table of ours; frames that read it are void then."""
    jvm = SparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration() if spark.sparkContext._jsc else jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)
    for paths in _ours.values():
        paths.discard(path)


def sweep(spark: SparkSession, app: str) -> None:
    """Deletes what an application has written to the shared folder, at its end; nothing can be deleted once the JVM is gone."""
    with contextlib.suppress(Py4JError, ConnectionError, AttributeError):
        for path in sorted(_ours.get(app, ())):
            drop(spark, path)


def cut(df: DataFrame, rebalance: bool = True, free: bool = False) -> DataFrame:
    """df written to the shared folder and read again: the lineage ends there, and any executor can read it.

    Rows are first rebalanced into files of the advisory partition size, so that small tables don't become many
    small files; a large one may go without.

    With ``free``, for what has shuffled whole texts or tokens, the driver then collects its garbage, on which Spark
    deletes the shuffle files of what has ended; it waits for the events of the ended job, which hold on to them.
    """
    spark = df.sparkSession
    path = scratch(spark)
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, "8m")  # Arrow's buffers lie outside the heap, several of a batch's size for each task
    try:
        (df.hint("rebalance") if rebalance else df).write.parquet(path)
    finally:
        spark.conf.set(BATCH_BYTES, before) if before else spark.conf.unset(BATCH_BYTES)
    out = spark.read.schema(df.schema).parquet(path)
    if free:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        for _ in range(2):
            spark.sparkContext._jvm.System.gc()
            time.sleep(0.2)
    return out


def powers(base: int, n: int) -> np.ndarray:
    """base ** i mod 2**64 for i < n, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    size, step = 1, base & MASK
    while size < n:
        m = min(size, n - size)
        out[size : size + m] = out[:m] * np.uint64(step)
        size += m
        step = step * step & MASK
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """64-bit hashes of any slices of a byte buffer, from one prefix sum over it (arithmetic mod 2**64)."""

    BASE = 0x9E3779B97F4A7C55
    INVERSE = pow(BASE, -1, 1 << 64)
    BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _kept: dict[str, np.ndarray] = {}

    @classmethod
    def _powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._kept.get("up", ())) < n:
            cls._kept["up"], cls._kept["down"] = powers(cls.BASE, n), powers(cls.INVERSE, n)
        return cls._kept["up"][:n], cls._kept["down"][:n]

    def __init__(self, data: np.ndarray, lower: bool = False):
        up, self.down = self._powers(len(data) + 1)
        of = self.BYTES
        if lower:
            of = of.copy()
            of[65:91] = of[97:123]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(np.multiply(of[data], up[:-1]), out=self.sums[1:])

    def every(self, width: int) -> np.ndarray:
        """Of all slices of one width, not mixed; the high bits tell most."""
        return (self.sums[width:] - self.sums[:-width]) * self.down[: len(self.sums) - width]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if n and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about size bytes; one row at least."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (bytes other than white space or other gaps, never across texts), and for each text the index of its first word."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~gaps[data]
    first, last = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    edge = edge[inside[edge] & inside[edge + 1]]
    first[edge] = True
    last[edge] = True
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    return start, end, np.searchsorted(start, offsets)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id): connected components of undirected links, each named by its smallest id.

    Alternates large-star and small-star steps; each is a grouped minimum and an equi-join, so no
    neighbourhood is ever gathered in one place. Nodes without links don't appear.
    """
    small, large = F.least(a, b), F.greatest(a, b)
    edges = cut(links.where(F.col(a) != F.col(b)).select(small.alias("v"), large.alias("u")).distinct())

    def settled() -> bool:
        """Every node has one parent, and no parent has one."""
        several = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        return several.unionByName(edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").select("u")).isEmpty()

    while not settled():
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.where("u != m").select("u", F.col("m").alias("v"))).distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = cut(edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
