"""Quality rules with compression bands: zstandard ratios of whole documents and of fixed chunks.

A document is kept if it passes the base rules and both its whole ratio and those of all its chunks lie within the
band for the length: above it text is repetitive, below it incompressible. A band is what two limits leave: fixed ones
(``BANDS``), which hold for any corpus, and ones fitted on all the corpus, which are narrower. Scripts differ in bytes a character, and so in how far their
texts compress: the fixed upper limits grow with the bytes a character, and the fitted ones are of each half octave of lengths and quarter byte a character. They are
the quartiles of the logarithm of the ratio, widened by FENCE times their distance and at least to BELOW under and ABOVE over the median (languages of one script lie closer than that,
noise and copied passages further), over all different texts that pass the base rules; whole texts and chunks apart. A class of fewer than LEAST texts has the fixed limits only,
so a script that is rare in the corpus is judged by those.
Every byte of a text of a chunk or more lies in a chunk: what follows the last full one is a chunk of its own or, if too
short for a band, part of the last full one. Texts under the first length have no band.

Null text counts as empty (no words, so the base rules reject it); repeated rows are each judged, but count once for the limits; an
empty table gives an empty result; further columns are left alone. One pass over the texts; only their measures are
shuffled. The fitted limits are a row for each class, at most 31 lengths times 13 widths, twice, whatever the corpus, so they go through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Hasher, chunks, cut, texts, words

#: From so many bytes on: least and greatest ratio of raw to compressed size for whole documents and shorter chunks.
#: The least ratios lie between those of prose and of base64 in words of 8 to 60 characters (measured at most 1.14 at 320
#: bytes, 1.19 at 448, 1.24 at 640, 1.29 at 1023, 1.33 at 2047, 1.36 at 20,000).
BANDS = ((256, 1.15, 3.5), (320, 1.2, 3.5), (448, 1.25, 3.5), (512, 1.28, 4.0), (768, 1.32, 4.0), (1024, 1.4, 4.5), (2048, 1.5, 4.5), (4096, 1.5, 5.5), (16384, 1.5, 7.0))
#: The band of each full chunk.
CHUNK_BYTES, CHUNK_BAND, LEVEL = 4096, (1.5, 6.0), 3
#: Of fitted limits: times the distance of the quartiles, least distances from the median, and least texts of a class.
FENCE, BELOW, ABOVE, LEAST = 2.5, 0.2, 0.1, 50
#: Logarithms of ratios are counted in steps of this.
STEP = 0.001
MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, in_fixed boolean, ratio double, n_chunks long, n_chunks_out long, size long, chars long, digest long, chunk_sizes array<int>, chunk_chars array<int>, chunk_ratios array<double>"
OUT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "n_chunks", "n_chunks_out")
SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1


def repeated_words(h: np.ndarray, first: np.ndarray, width: int = 5) -> np.ndarray:
    """For each text how many of its words lie in a window of ``width`` words that the text holds twice or more; h: the words' hashes, first: each text's first word."""
    n, docs = len(h), len(first) - 1
    if n < width:
        return np.zeros(docs, np.int64)
    of = np.repeat(np.arange(docs), np.diff(first))
    key = of[: n - width + 1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(width):
        key = key * np.uint64(0xD6E8FEB86659FD93) + h[k : n - width + 1 + k]
    at = np.flatnonzero(of[: n - width + 1] == of[width - 1 :])
    order = at[np.argsort(key[at], kind="stable")]
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, order[twice], 1)
    np.add.at(edge, order[twice] + width, -1)
    return np.add.reduceat(np.append(np.cumsum(edge[:-1]) > 0, False).astype(np.int64), np.minimum(first[:-1], n)) * (np.diff(first) > 0)


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(values)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def spans(size: int) -> list[tuple[int, int]]:
    """Where the chunks of a text lie: end to end over all of it, or none if it is shorter than a chunk."""
    edges = list(range(0, size - CHUNK_BYTES + 1, CHUNK_BYTES))
    if edges:
        last = edges[-1] + CHUNK_BYTES
        edges += [last, size] if size - last >= BANDS[0][0] else [size]
    return list(zip(edges[:-1], edges[1:], strict=True))


def measure(data: np.ndarray, offsets: np.ndarray, squeeze: zstandard.ZstdCompressor) -> tuple[list[np.ndarray], list[list[int]], list[list[int]], list[list[float]]]:
    """Each text's base measures, ratio, characters and digest, and the sizes, characters and ratios of its chunks."""
    start, end, first = words(data, offsets)
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, start, 1)
    np.add.at(inside, end, -1)
    inside = np.cumsum(inside[:-1])
    lead = (data & 0xC0) != 0x80
    upto = np.concatenate(([0], np.cumsum(lead)))
    chars = per_text((inside > 0) & lead, offsets)
    hasher = Hasher(data)
    repeat = repeated_words(hasher.of(start, end), first)
    raw = data.tobytes()
    dup, ratio = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1)
    sizes, points, ratios = [], [], []
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        text = raw[a:b]
        dup[i] = duplicate_lines(text)
        ratio[i] = len(text) / len(squeeze.compress(text)) if text else 0
        at = spans(len(text))
        sizes.append([y - x for x, y in at])
        points.append([int(upto[a + y] - upto[a + x]) for x, y in at])
        ratios.append([(y - x) / len(squeeze.compress(text[x:y])) for x, y in at])
    return [np.diff(first), chars, per_text(SYMBOLS[data], offsets), dup, repeat, ratio, upto[offsets[1:]] - upto[offsets[:-1]], hasher.of(offsets[:-1], offsets[1:]).view(np.int64)], sizes, points, ratios


def fixed(size: int, chars: int, chunk: bool) -> tuple[float, float]:
    """The band of a length that holds for any corpus; the upper limit by bytes a character, as those are alike where letters take several."""
    low, high = CHUNK_BAND if chunk and size >= CHUNK_BYTES else next(((low, high) for least, low, high in reversed(BANDS) if size >= least), (0.0, float("inf")))
    return low, high * size / max(chars, 1)


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=LEVEL)
    names = [f.split()[0] for f in MEASURES.split(", ")]
    for batch in batches:
        data, offsets = texts(batch.column("text"))
        for a, b in chunks(offsets):
            off = offsets[a : b + 1]
            (n_words, chars, symbols, dup, repeat, ratio, points, digest), sizes, chunk_points, ratios = measure(data[off[0] : off[-1]], off - off[0], squeeze)
            failed = (n_words < 10) | (100 * repeat > 20 * n_words)
            size = np.diff(off)
            within = [lo <= r <= hi for n, c, r in zip(size.tolist(), points.tolist(), ratio.tolist(), strict=True) for lo, hi in [fixed(n, c, False)]]
            out = [sum(not lo <= r <= hi for n, c, r in zip(ns, cs, rs, strict=True) for lo, hi in [fixed(n, c, True)]) for ns, cs, rs in zip(sizes, chunk_points, ratios, strict=True)]
            cols = [batch.column("doc_id").slice(a, b - a).cast(pa.int64()), *(pa.array(x.astype(np.int64)) for x in (n_words, chars, symbols, dup, repeat)), pa.array(failed), pa.array(within, pa.bool_()), pa.array(ratio)]
            cols += [pa.array([len(x) for x in sizes], pa.int64()), pa.array(out, pa.int64()), pa.array(size.astype(np.int64)), pa.array(points.astype(np.int64)), pa.array(digest), pa.array(sizes, pa.list_(pa.int32())), pa.array(chunk_points, pa.list_(pa.int32())), pa.array(ratios, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=names)


def class_of(size: Column, chars: Column) -> Column:
    """Half octaves of lengths, times 16, and quarters of a byte a character from 1 on."""
    width = F.least(F.floor(4 * size / F.greatest(chars, F.lit(1))) - 4, F.lit(15))
    return (F.floor(F.log2(size.cast("double")) * 2) * 16 + width).cast("int")


def limits(measured: DataFrame, least: int = LEAST) -> list[tuple[bool, int, float, float]]:
    """(chunk, class, lowest and highest logarithm of the ratio), fitted on all different texts that pass the base rules.

    Ratios are counted by step first, so the quartiles are exact to a step, the same in every run, and no class is gathered.
    """
    one = measured.where(~F.col("base_failed") & (F.col("size") >= BANDS[0][0])).groupBy("size", "digest").agg(F.first("ratio").alias("ratio"), F.first("chars").alias("chars"), F.first("chunk_sizes").alias("_n"), F.first("chunk_chars").alias("_c"), F.first("chunk_ratios").alias("_r"))
    whole = one.select(F.lit(False).alias("chunk"), "size", "chars", "ratio")
    parts = one.select(F.explode(F.arrays_zip("_n", "_c", "_r")).alias("x")).select(F.lit(True).alias("chunk"), F.col("x._n").cast("long").alias("size"), F.col("x._c").cast("long").alias("chars"), F.col("x._r").alias("ratio"))
    step = F.round(F.ln("ratio") / STEP).cast("int")
    count = whole.unionByName(parts).groupBy("chunk", class_of(F.col("size"), F.col("chars")).alias("class"), step.alias("step")).agg(F.count("*").alias("n"))
    of = W.partitionBy("chunk", "class")
    count = count.withColumns({"_upto": F.sum("n").over(of.orderBy("step")), "_all": F.sum("n").over(of)})
    reached = lambda q: F.min(F.when(F.col("_upto") >= q * F.col("_all"), F.col("step"))) * STEP
    fit = count.groupBy("chunk", "class").agg(F.max("_all").alias("_all"), reached(0.25).alias("a"), reached(0.5).alias("m"), reached(0.75).alias("b")).where(F.col("_all") >= least)
    wide = FENCE * (F.col("b") - F.col("a"))
    low, high = F.least(F.col("a") - wide, F.col("m") - BELOW), F.greatest(F.col("b") + wide, F.col("m") + ABOVE)
    return [tuple(r) for r in fit.select("chunk", "class", low, high).orderBy("chunk", "class").collect()]


def outside(ratio: Column, size: Column, chars: Column, chunk: bool, fitted: list[tuple[bool, int, float, float]]) -> Column:
    """Whether a ratio leaves the fitted limits of its length."""
    own = {c: (lo, hi) for k, c, lo, hi in fitted if k == chunk}
    if not own:
        return F.lit(False)
    of = F.create_map(*(x for c, (lo, hi) in own.items() for x in (F.lit(c), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")))))
    at = F.try_element_at(of, class_of(size, chars))
    return F.coalesce((size >= BANDS[0][0]) & ~F.ln(ratio).between(at["lo"] - STEP / 2, at["hi"] + STEP / 2), F.lit(False))


def judge(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs (doc_id, text) -> the base measures, base_failed, kept, and the ratios behind it."""
    measured = cut(docs.select("doc_id", "text").mapInArrow(rows, MEASURES), rebalance=False)
    fitted = limits(measured, least)
    parts = F.arrays_zip(F.col("chunk_sizes").alias("n"), F.col("chunk_chars").alias("c"), F.col("chunk_ratios").alias("r"))
    more = F.size(F.filter(parts, lambda x: outside(x["r"], x["n"], x["c"], True, fitted) & (x["r"] > 0)))
    kept = ~F.col("base_failed") & F.col("in_fixed") & (F.col("n_chunks_out") == 0) & ~outside(F.col("ratio"), F.col("size"), F.col("chars"), False, fitted) & (more == 0)
    return measured.withColumns({"kept": kept, "n_chunks_out": F.greatest("n_chunks_out", more.cast("long"))}).select(*OUT)


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
