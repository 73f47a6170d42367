"""Places and polynomial prefix fingerprints of rows within groups of any size.

Rows are dealt out by ranges of (group, order), so that a large group spans many tasks. Each task scans its own rows with
numpy, batch by batch; what a group brings along from the ranges before (its rows and their fingerprint so far, two rows
for each task, which is all the driver gets) is added afterwards. The scanned table is written in between, so that both
steps see the same ranges, whatever is computed again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MASK, cut, fresh, powers

BASE = 0x5851F42D4C957F2D


def kept_back(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch | None]]:
    """Each batch that has rows, with the next one."""
    before = None
    for batch in batches:
        if batch.num_rows:
            if before is not None:
                yield before, batch
            before = batch
    if before is not None:
        yield before, None


def scanned(df: DataFrame, group: str, order: list[str], keep: list[str], fingerprint: str | None = None, previous: str | None = None) -> DataFrame:
    """The columns ``keep`` of df with ``pos`` (place in the group, from 1) and ``last`` (whether the group ends there).

    ``order`` decides within the group, nulls first; rows equal in all of it come in any order. With ``fingerprint``, the
    name of a column of 64-bit hashes h, also ``fp``, the sum of h * BASE ** pos over all rows of the group so far modulo
    2 ** 64, and ``before``, the same without the row itself. With ``previous``, the name of a column of texts, also
    ``prev``, its value in the row before. The group column must not be null.
    """
    names = [group, *(c for c in keep if c != group)]
    (row,) = fresh(df, "_row")
    spread = df.withColumn(row, F.monotonically_increasing_id()).repartitionByRange(group, *order, row).sortWithinPartitions(group, *order, row).select(*names)
    local = cut(spread.mapInArrow(lambda batches: _scan(batches, fingerprint, previous), _schema(spread, fingerprint, previous)), rebalance=False)
    ends = local.where("_edge OR _first AND _k = 1").select("_part", group, "_k", "_edge", "_first", *(["_s"] if fingerprint else []), *([previous] if previous else [])).orderBy("_part", "_k").collect()
    carry, last = _carried(ends, group, fingerprint, previous)
    spark = df.sparkSession
    brought = F.broadcast(spark.createDataFrame(carry, "_part int, _n long, _sum long, _text string"))
    ending = F.broadcast(spark.createDataFrame([(p, True) for p in last], "_part int, _ends boolean"))
    out = local.join(brought, "_part", "left").join(ending, "_part", "left")
    n = F.when(F.col("_first"), F.coalesce("_n", F.lit(0))).otherwise(0)
    columns = [*names, (F.col("_k") + n).alias("pos"), F.when(F.col("_edge"), F.coalesce("_ends", F.lit(False))).otherwise(F.col("_last")).alias("last")]
    if previous:
        columns.append(F.when(F.col("_first") & (F.col("_k") == 1), F.col("_text")).otherwise(F.col("_prev")).alias("prev"))
    if not fingerprint:
        return out.select(*columns)
    out = out.select(*columns, F.col("_s").alias("fp"), n.alias("_n"), F.when(F.col("_first"), F.coalesce("_sum", F.lit(0))).otherwise(0).alias("_sum"))
    done = out.drop("_n", "_sum").withColumn("before", F.lit(0).cast("long"))
    return out.mapInArrow(lambda batches: _shifted(batches, fingerprint), done.schema)


def _schema(df: DataFrame, fingerprint: str | None, previous: str | None) -> str:
    own = [f"`{c}` {t}" for c, t in df.dtypes] + ["_part int", "_k long", "_first boolean", "_last boolean", "_edge boolean"]
    return ", ".join(own + (["_s long"] if fingerprint else []) + (["_prev string"] if previous else []))


def _scan(batches: Iterator[pa.RecordBatch], fingerprint: str | None, previous: str | None) -> Iterator[pa.RecordBatch]:
    """Within a task: place in the group, whether the group is the task's first, whether it ends, whether the task does, and the sum so far."""
    part = TaskContext.get().partitionId()
    group = text = None
    k, s, first = 0, np.uint64(0), True
    for batch, after in kept_back(batches):
        g, n = batch.column(0), batch.num_rows
        new = np.ones(n + 1, bool)
        new[1:n] = pc.not_equal(g.slice(1), g.slice(0, n - 1)).to_numpy(zero_copy_only=False) if n > 1 else False
        new[0] = group is None or g[0].as_py() != group
        new[n] = after is None or after.column(0)[0].as_py() != g[n - 1].as_py()
        start = np.flatnonzero(new[:n])
        of = np.cumsum(new[:n]) - 1  # -1: goes on from the batch before
        at = np.arange(n)
        place = at - np.append(start, 0)[of] + 1 if len(start) else at + 1
        place = np.where(of < 0, at + 1 + k, place)
        firsts = (of < 0) & first | (of == 0) & (group is None)
        cols = [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(place), pa.array(firsts), pa.array(new[1:]), pa.array((at == n - 1) & (after is None))]
        if fingerprint:
            h = batch.column(batch.schema.get_field_index(fingerprint)).to_numpy().view(np.uint64)
            local = np.where(of < 0, at + 1, place)
            term = h * powers(BASE, n + 1)[local]
            sums = np.cumsum(term)
            begin = np.append(start, 0)[of] if len(start) else np.zeros(n, np.int64)
            base = np.where((of < 0) | (begin == 0), np.uint64(0), sums[begin - 1])
            sums = sums - base
            if group is not None and not new[0]:
                up = np.uint64(pow(BASE, k, 1 << 64))
                sums = np.where(of < 0, s + sums * up, sums)
            cols.append(pa.array(sums.view(np.int64)))
            s = sums[-1]
        if previous:
            told = batch.column(batch.schema.get_field_index(previous))
            shifted = pa.concat_arrays([pa.array([text], told.type), told.slice(0, n - 1)])
            cols.append(pc.if_else(pa.array(new[:n]), pa.scalar(None, told.type), shifted).cast(pa.string()))
            text = told[n - 1].as_py()
        k, first, group = int(place[-1]), bool(firsts[-1]), g[n - 1].as_py()
        yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "_part", "_k", "_first", "_last", "_edge", *(["_s"] if fingerprint else []), *(["_prev"] if previous else [])])


def _carried(ends: list, group: str, fingerprint: str | None, previous: str | None) -> tuple[list[tuple], list[int]]:
    """(part, rows, sum, text) of its first group in the parts before, and the parts with whose last row a group ends."""
    carry, last, parts = [], [], {}
    for r in ends:
        parts.setdefault(r["_part"], []).append(r)
    run = None  # group, rows, sum, text, part
    for part in sorted(parts):
        first, end = parts[part][0], parts[part][-1]
        goes_on = run is not None and run[0] == first[group]
        n, s, text = run[1:4] if goes_on else (0, 0, None)
        if goes_on:
            carry.append((part, n, s - (1 << 64) if s >= 1 << 63 else s, text))
        elif run is not None:
            last.append(run[4])
        if not end["_first"]:
            n, s = 0, 0
        own = end["_s"] & MASK if fingerprint else 0
        run = (end[group], n + end["_k"], (s + own * pow(BASE, n, 1 << 64)) & MASK, end[previous] if previous else None, part)
    if run is not None:
        last.append(run[4])
    return carry, last


def _shifted(batches: Iterator[pa.RecordBatch], fingerprint: str) -> Iterator[pa.RecordBatch]:
    """Adds what was brought along to the sums, and the sums without each row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        of = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
        number = lambda c: of[c].to_numpy(zero_copy_only=False)
        n, place = number("_n"), number("pos")
        up = np.ones(batch.num_rows, np.uint64)
        for x in np.unique(n[n > 0]):
            up[n == x] = np.uint64(pow(BASE, int(x), 1 << 64))
        fp = number("_sum").view(np.uint64) + number("fp").view(np.uint64) * up
        near = place < len(powers_up_to())
        step = np.empty(batch.num_rows, np.uint64)
        step[near] = powers_up_to()[place[near]]
        step[~near] = [pow(BASE, int(x), 1 << 64) for x in place[~near]]
        before = fp - number(fingerprint).view(np.uint64) * step
        of["fp"], of["before"] = pa.array(fp.view(np.int64)), pa.array(before.view(np.int64))
        names = [c for c in of if c not in ("_n", "_sum")]
        yield pa.RecordBatch.from_arrays([of[c] for c in names], names=names)


_powers: list[np.ndarray] = []


def powers_up_to(n: int = 1 << 16) -> np.ndarray:
    if not _powers:
        _powers.append(powers(BASE, n))
    return _powers[0]
