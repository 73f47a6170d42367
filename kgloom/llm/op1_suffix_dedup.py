"""Removal of repeated substrings with suffix arrays, spread over a cluster.

Every ``width``-byte string belongs to one anchor: the 24 bytes (``GRAMS``) in it with the least hash, leftmost of equals. Runs
of neighbouring strings with one anchor make a piece of text; equal strings always lie in pieces of equal anchors. So
1. pieces whose anchor occurs once in the corpus are done with;
2. of equal pieces only the first occurrence goes on (the later ones repeat it whole);
3. the different pieces of an anchor meet in one suffix array, two-stage sorted; neighbours whose common prefix
   reaches ``width`` hold the same string, and all but the first occurrence in the corpus are repeats.
An anchor with more different pieces than MAX_PIECES is not gathered: its pieces are dealt out again by longer anchors, of
64 bytes and then of the whole string, and go the same way, so they meet in suffix arrays of their own. Strings of one
anchor of the last kind are equal, which leaves one piece of them.

Null text counts as empty; texts under ``width`` bytes are kept whole, as are rows with null ids, which come neither before nor after
others; rows of one id are one document (first places are shared). Empty tables give empty results; further columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, Hasher, chunks, cut, mix, texts
from .suffix_array import common_prefixes, eights, suffix_array

WIDTH = 100
#: Bytes of anchors; longer ones for the pieces of crowded anchors.
GRAMS = (24, 64, WIDTH)
#: Different pieces of one anchor that one suffix array takes; bytes of text in one array, if anchors leave the choice.
MAX_PIECES, ARRAY_BYTES = 32_768, 2 << 20
PLACE = np.uint64((1 << 24) - 1)
PIECES = "anchor long, piece long, doc long, pos int, len int"
RUNS = "doc long, begin int, end int"


def batch_of(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[f.split()[0] for f in schema.split(", ")])


def pieces(data: np.ndarray, offsets: np.ndarray, gram: int = GRAMS[0]) -> tuple[np.ndarray, ...]:
    """Of some texts: anchor hash, piece hash, first and end byte of each piece (places in data)."""
    n, none = len(data), np.zeros(0, np.int64)
    if n < WIDTH:
        return none, none, none, none
    h = Hasher(data)
    every = h.every(gram)
    least = every & ~PLACE
    least |= np.arange(len(every), dtype=np.uint64)
    size, span = 1, WIDTH - gram + 1
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if span > size:
        least = np.minimum(least[: size - span], least[span - size :])
    anchor = (least & PLACE).view(np.int64)
    fits = np.ones(n + 1, bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):  # strings that would leave their text
        fits[max(a, b - WIDTH + 1) : b] = False
    fits = np.append(fits[: len(anchor)], False)
    new = np.append(True, anchor[1:] != anchor[:-1])
    first = np.flatnonzero(fits[:-1] & (new | ~np.append(False, fits[:-2])))
    last = np.flatnonzero(fits[:-1] & (np.append(new[1:], True) | ~fits[1:]))
    return mix(every[anchor[first]]), h.of(first, last + WIDTH), first, last + WIDTH


def segments(offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first row, end row, first byte, end byte): rows together up to CHUNK bytes; a longer text in overlapping parts of its own."""
    for a, b in chunks(offsets):
        if offsets[b] - offsets[a] <= 8 * CHUNK:
            yield a, b, offsets[a], offsets[b]
        else:
            for at in range(offsets[a], offsets[b] - WIDTH + 1, 4 * CHUNK):
                yield a, b, at, min(offsets[b], at + 4 * CHUNK + WIDTH - 1)


def piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = texts(batch.column("text"))
        ids = batch.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
        for a, b, begin, end in segments(offsets):
            own = np.clip(offsets[a : b + 1], begin, end)
            anchor, piece, first, last = pieces(data[begin:end], own - begin)
            row = a + np.searchsorted(own[1:] - begin, first, "right")
            yield batch_of(PIECES, anchor.view(np.int64), piece.view(np.int64), ids[row].astype(np.int64), (first + begin - offsets[row]).astype(np.int32), (last - first).astype(np.int32))


def flat(column: pa.Array, *fields: str) -> tuple[np.ndarray, ...]:
    """A list<struct> column: offsets, then each field's values; null is an empty list."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
    values = column.flatten()
    return np.concatenate(([0], np.cumsum(size))), *(values.field(f).to_numpy(zero_copy_only=False) for f in fields)


def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted pieces of each document."""
    for batch in batches:
        data, offsets = texts(batch.column("text"))
        at, anchor, pos, size = flat(batch.column("want"), "anchor", "pos", "len")
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        begin = offsets[row] + pos
        end = np.minimum(begin + size, offsets[row + 1])
        ok = np.flatnonzero(end - begin >= WIDTH)
        raw = data.tobytes()
        for part in np.array_split(ok, max(1, len(ok) // 20_000)):
            yield pa.RecordBatch.from_arrays([pa.array(anchor[part]), pa.array(ids[row[part]]), pa.array(pos[part].astype(np.int32)), pa.array([raw[a:b] for a, b in zip(begin[part], end[part], strict=True)], pa.binary())], names=["anchor", "doc", "pos", "bytes"])


def runs_of(flag: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Flagged strings (in order of text, with their places) as covered byte runs."""
    at = np.flatnonzero(flag)
    new = np.append(True, (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]]) | (pos[at[1:]] != pos[at[:-1]] + 1))[: len(at)]
    first, last = at[new], at[np.append(new[1:], True)[: len(at)]]
    return batch_of(RUNS, doc[first], pos[first].astype(np.int32), (pos[last] + WIDTH).astype(np.int32))


def repeats(text: np.ndarray, offsets: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Byte runs of pieces that strings cover which occur earlier in another piece or place."""
    wide = eights(text)
    piece = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.arange(len(text))
    fits = at + WIDTH <= offsets[piece + 1]
    order = suffix_array(text, wide)
    order = order[fits[order]]
    group = np.cumsum(common_prefixes(order, wide, WIDTH) < WIDTH)
    same = np.append(False, group[1:] == group[:-1])[: len(group)]
    some = same.copy()
    some[:-1] |= same[1:]
    order, group = order[some], group[some]
    place = pos[piece].astype(np.int64) + at - offsets[piece]
    by = np.lexsort((place[order], doc[piece[order]], group))
    order, group = order[by], group[by]
    # all but the least place of each group; equal places are one occurrence
    head = np.append(True, group[1:] != group[:-1])[: len(group)]
    least = np.flatnonzero(head)[np.cumsum(head) - 1] if len(group) else np.zeros(0, np.int64)
    later = (doc[piece[order]] != doc[piece[order[least]]]) | (place[order] != place[order[least]])
    flag = np.zeros(len(text), bool)
    flag[order[later]] = True
    return runs_of(flag, doc[piece], place)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's bytes and its n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def sort_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, doc, pos, bytes) sorted by anchor: one suffix array for some ARRAY_BYTES of whole anchors."""

    def done(parts: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(parts)
        text, offsets = flat_bytes(t["bytes"])
        return repeats(text, offsets, t["doc"].to_numpy(), t["pos"].to_numpy())

    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        t = pa.Table.from_batches([batch])
        while len(t):
            if size >= ARRAY_BYTES:  # up to the end of the anchor that is open
                anchors = t["anchor"].to_numpy()
                n = int(np.searchsorted(anchors != held[-1]["anchor"][-1].as_py(), True))
                held.append(t.slice(0, n))
                t = t.slice(n)
                if len(t):
                    yield done(held)
                    held, size = [], 0
                continue
            ends = np.cumsum(pc.binary_length(t["bytes"]).to_numpy())
            n = min(len(t), int(np.searchsorted(ends, ARRAY_BYTES - size)) + 1)
            held.append(t.slice(0, n))
            size += int(ends[n - 1])
            t = t.slice(n)
    if held:
        yield done(held)


def split_rows(batches: Iterator[pa.RecordBatch], gram: int) -> Iterator[pa.RecordBatch]:
    """Pieces (doc, pos, bytes) dealt out by longer anchors."""
    for batch in batches:
        raw, offsets = flat_bytes(batch.column("bytes"))
        doc, pos = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "pos"))
        for a, b in chunks(offsets):
            own = offsets[a : b + 1] - offsets[a]
            anchor, piece, first, last = pieces(raw[offsets[a] : offsets[b]], own, gram)
            row = np.searchsorted(own[1:], first, "right")
            yield batch_of(PIECES, anchor.view(np.int64), piece.view(np.int64), doc[a + row].astype(np.int64), (pos[a + row] + first - own[row]).astype(np.int32), (last - first).astype(np.int32))


def merged(begin: np.ndarray, end: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Maximal runs that sorted or unsorted byte runs cover, inside n bytes."""
    if not len(begin):
        return []
    by = np.argsort(begin, kind="stable")
    begin, end = np.minimum(begin[by], n), np.minimum(np.maximum.accumulate(end[by]), n)
    new = np.append(True, begin[1:] > end[:-1])
    return [(int(a), int(b)) for a, b in zip(begin[new], end[np.append(new[1:], True)], strict=True) if b > a]


def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = texts(batch.column("text"))
        at, begin, end = flat(batch.column("runs"), "begin", "end")
        raw = memoryview(data)
        out = []
        for i in range(batch.num_rows):
            text = raw[offsets[i] : offsets[i + 1]]
            spans = merged(begin[at[i] : at[i + 1]], end[at[i] : at[i + 1]], len(text))
            digest, upto = hashlib.sha256(), 0
            for a, b in spans:
                digest.update(text[upto:a])
                upto = b
            digest.update(text[upto:])
            out.append((len(text), sum(b - a for a, b in spans), len(spans), digest.hexdigest()))
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removals(docs: DataFrame, max_pieces: int = MAX_PIECES) -> DataFrame:
    """docs (doc_id, text) -> (doc, begin, end): byte runs, overlapping in part, that together cover all repeats."""
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    end = lambda c: (F.col(c) + F.col("len")).alias("end")

    def bytes_of(w: DataFrame) -> DataFrame:
        w = w.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("anchor", "pos", "len")).alias("want"))
        return docs.join(w, "doc_id").select("doc_id", "text", "want").mapInArrow(fetch, "anchor long, doc long, pos int, bytes binary")

    every, out = docs.mapInArrow(piece_rows, PIECES), []
    for k in range(len(GRAMS)):
        again = cut(every.groupBy("anchor").agg(F.count("*").alias("_n")).where("_n > 1").select("anchor"), free=True)
        some = cut(every.join(again, "anchor"), rebalance=False, free=True)
        first = some.groupBy("anchor", "piece").agg(F.min(F.struct("doc", "pos")).alias("_first"), F.max("len").alias("len"))
        first = cut(first.select("anchor", "piece", "_first.doc", "_first.pos", "len"), free=True)
        # all but the first of equal pieces; joined by place as well, so that a hot piece lands in no one task
        out.append(some.join(first, ["anchor", "piece", "doc", "pos"], "left_anti").select("doc", F.col("pos").alias("begin"), end("pos")))
        count = first.groupBy("anchor").agg(F.count("*").alias("_n")).where("_n > 1")
        want = first.join(count, "anchor")
        out.append(bytes_of(want.where(F.col("_n") <= max_pieces)).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(sort_suffixes, RUNS))
        crowded = want.where(F.col("_n") > max_pieces)
        if k + 1 == len(GRAMS) or crowded.isEmpty():
            break
        every = cut(bytes_of(crowded).mapInArrow(partial(split_rows, gram=GRAMS[k + 1]), PIECES), rebalance=False, free=True)
    return cut(reduce(DataFrame.unionByName, out), free=True)


def dedup(docs: DataFrame, max_pieces: int = MAX_PIECES) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    runs = removals(docs, max_pieces).groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("begin", "end")).alias("runs"))
    return docs.join(runs, "doc_id", "left").select("doc_id", "text", "runs").mapInArrow(kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
