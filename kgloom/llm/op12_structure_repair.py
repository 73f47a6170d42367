"""Repair of conversation structure at least cost: faults are counted, and the cheapest edits give turns by user and assistant in alternation.

Rank-compressed dynamic programming. The edits between two rows are one macro edit: a run of inserts, then what happens
to the row. As texts of initials (``D``, ``IIK`` ...) macro edits are a prefix-free code, so audits that have used up the same rows
compare code by code: of all audits up to a row only their order matters, and there is at most one for each state
(nothing yet, after system, user, assistant). A layer therefore keeps, for each state, cost, rank and parent; audits are
reconstructed afterwards along the parents.

Conversations of any size: rows are cut into blocks of ``BLOCK`` places. A block is summed up by cost and order of the best
way from each state to each state, which is all that a layer needs of it, so blocks of blocks are summed up in the same
way until one is left. Then the chosen states go down again, and each block reconstructs its own part. All blocks of a batch
are worked on in lockstep with numpy.

Two inserts between rows suffice: a third gives a state that fewer give, and two change only the state after system.

Null roles and texts, and nulls in the key of the damage, are one space; a null conv_id is a conversation of its own. Rows of one turn go by role, then by the
MD5 of their text, both as damaged; repeated rows are rows. Conversations that lose all rows are returned, with zeros; an empty table gives an
empty result; further columns are left alone. Texts are never cut: they cross the network once to be put in order and once with their edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .scan import kept_back, scanned

#: States by number: before any row, after system, after user, after assistant.
STATES = ("", "s", "u", "a")
#: Costs of edits, and of a truncated row that stays.
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
#: Macro edits in ASCII order.
CODES = sorted(run + edit for run in ("", "I", "II") for edit in "DKR")
#: What a trailing run of inserts needs from each state: to no row at all, or to an assistant's.
TAIL = ("", "II", "I", "")
INF = 1 << 40
#: Rows of a block, or blocks of a block of blocks.
BLOCK = 256
#: Characters of repaired text that are handed on together.
PIECE = 1 << 23
FULL = {"s": "system", "u": "user", "a": "assistant"}


def after(state: int, initial: str) -> int | None:
    """The state once a row with this initial follows, if it may."""
    allowed = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
    return STATES.index(initial) if (STATES[state], initial) in allowed else None


def next_initial(state: int) -> str:
    """What an insert or a changed role becomes there."""
    return "a" if STATES[state] == "u" else "u"


def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each kind of row (initial other, s, u or a, times sound, truncated or to be deleted) cost and code of the best macro edit from state to state."""
    cost, code = np.full((12, 4, 4), INF, np.int64), np.zeros((12, 4, 4), np.int64)
    for kind in range(12):
        initial, fault = STATES[kind // 3], kind % 3
        for i in range(4):
            for c, name in enumerate(CODES):
                state, paid = i, 0
                for _ in name[:-1]:
                    state, paid = after(state, next_initial(state)), paid + INSERT
                if name[-1] == "D":
                    paid += DELETE
                elif fault == 2:
                    continue
                else:
                    state = after(state, next_initial(state) if name[-1] == "R" else initial)
                    paid += (REROLE if name[-1] == "R" else 0) + (TRUNCATED if fault == 1 else 0)
                if state is not None and paid < cost[kind, i, state]:
                    cost[kind, i, state], code[kind, i, state] = paid, c
    return cost, code


COST, CODE = tables()


def lockstep(cost: np.ndarray, order: np.ndarray, start: np.ndarray, length: np.ndarray, begin: np.ndarray | None = None):
    """The layers of all blocks at once.

    cost and order (item, from, to) are of items end to end; block b has length[b] of them from start[b] on. Without
    ``begin``, cost and order (block, from, to) of the best ways through each block from each state; with it (the state that each block begins in),
    the parents (item, to) as well.
    """
    n, lanes = len(start), 4 if begin is None else 1
    by = np.argsort(-length, kind="stable")
    first, size = start[by], length[by]
    total = np.full((n, lanes, 4), INF, np.int64)
    if begin is None:
        total[:, np.arange(4), np.arange(4)] = 0
    else:
        total[np.arange(n), 0, begin[by]] = 0
    rank = np.broadcast_to(np.arange(4), total.shape).copy()
    parent = np.zeros((len(cost), 4), np.int8) if begin is not None else None
    for t in range(int(size.max(initial=0))):
        m = int(np.searchsorted(-size, -t))  # blocks longer than t come first
        item = first[:m] + t
        ways = np.minimum(total[:m, :, :, None] + cost[item][:, None], INF)
        key = (ways << 10) + (rank[:m, :, :, None] << 4) + order[item][:, None]
        best = key.argmin(2)
        key = np.take_along_axis(key, best[:, :, None], 2)[:, :, 0]
        total[:m] = key >> 10
        rank[:m] = (key & 1023).argsort(2, kind="stable").argsort(2, kind="stable")
        if parent is not None:
            parent[item] = best[:, 0]
    back = np.argsort(by)
    return total[back], rank[back], parent


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of whole blocks; the rows are sorted by c and block."""
    kept: list[pa.RecordBatch] = []
    for batch, _ in kept_back(batches):
        key = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        at = len(key) - next((i for i, k in enumerate(reversed(key)) if k != key[-1]), len(key))
        if at == 0 and kept and (kept[-1].column(0)[-1].as_py(), kept[-1].column(1)[-1].as_py()) != key[0]:
            yield merged(kept)
            kept = []
        if at:
            yield merged([*kept, batch.slice(0, at)])
            kept = []
        kept.append(batch.slice(at))
    if kept:
        yield merged(kept)


def merged(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def starts(batch: pa.RecordBatch) -> np.ndarray:
    """Where blocks start."""
    c, b = batch.column(0), batch.column(1).to_numpy()
    new = np.ones(len(b), bool)
    if len(b) > 1:
        new[1:] = pa.compute.not_equal(c.slice(1), c.slice(0, len(b) - 1)).to_numpy(zero_copy_only=False) | (b[1:] != b[:-1])
    return np.flatnonzero(new)


def items(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Cost and order (item, from, to) of rows by kind, or of blocks."""
    names = batch.schema.names
    if "kind" in names:
        kind = batch.column(names.index("kind")).to_numpy()
        return COST[kind], CODE[kind]
    return tuple(batch.column(names.index(x)).flatten().to_numpy().reshape(-1, 4, 4) for x in ("cost", "rank"))


def summed_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """c, block, at, kind or cost and rank -> c, at, cost, rank of blocks."""
    for batch in whole_blocks(batches):
        start = starts(batch)
        cost, rank, _ = lockstep(*items(batch), start, np.diff(np.append(start, batch.num_rows)))
        flat = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, 16 * len(start) + 1, 16, dtype=np.int32)), pa.array(x.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(start)), batch.column(1).take(pa.array(start)), flat(cost), flat(rank)], names=["c", "at", "cost", "rank"])


def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last summary of each conversation -> the state it ends in at least cost, ties by rank, with that cost."""
    for batch in batches:
        cost, rank = items(batch)
        cost = cost[:, 0] + INSERT * np.array([len(x) for x in TAIL])
        end = (cost * 4 + rank[:, 0]).argmin(1)
        n = len(end)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, np.int32)), pa.array(end.astype(np.int32)), pa.array(cost[np.arange(n), end])], names=["c", "block", "begin", "end", "cost"])


def handed_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """c, block, at, items, and the block's states begin and end -> c, at, begin, end of each item, with ``code`` for rows."""
    for batch in whole_blocks(batches):
        names, start = batch.schema.names, starts(batch)
        of = {x: batch.column(names.index(x)).to_numpy() for x in ("begin", "end")}
        cost, order = items(batch)
        size = np.diff(np.append(start, batch.num_rows))
        _, _, parent = lockstep(cost, order, start, size, of["begin"][start])
        begin, end = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        state, by = of["end"][start].astype(np.int64), np.argsort(-size, kind="stable")
        for t in range(int(size.max(initial=0)) - 1, -1, -1):
            blocks = by[: int(np.searchsorted(-size[by], -t))]
            item = start[blocks] + t
            end[item] = state[blocks]
            state[blocks] = begin[item] = parent[item, state[blocks]]
        cols = [batch.column(0), batch.column(names.index("at")), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))]
        if "kind" in names:
            cols.append(pa.array(order[np.arange(len(begin)), begin, end].astype(np.int32)))
        yield pa.RecordBatch.from_arrays(cols, names=["c", "at", "begin", "end", "code"][: len(cols)])


def in_blocks(df: DataFrame) -> DataFrame:
    return df.repartition("c", "block").sortWithinPartitions("c", "block", "at")


def planned(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (c, block, at, kind) -> c, at, begin, end, code of each row, and c, end, cost of each conversation."""
    levels = [rows]
    while True:
        up = cut(in_blocks(levels[-1]).mapInArrow(summed_up, "c string, at long, cost array<long>, rank array<long>"))
        if up.where("at > 0").isEmpty():
            break
        levels.append(up.withColumn("block", F.expr(f"at div {BLOCK}")).select("c", "block", "at", "cost", "rank"))
    done = cut(up.mapInArrow(chosen, "c string, block long, begin int, end int, cost long"))
    states = done.drop("cost")
    for level in reversed(levels):
        more = ", code int" if level is rows else ""
        states = in_blocks(level.join(states, ["c", "block"])).mapInArrow(handed_down, "c string, at long, begin int, end int" + more).withColumnRenamed("at", "at" if more else "block")
    return states, done.select("c", "end", "cost")


def damaged(convs: DataFrame) -> DataFrame:
    """The rows of conversations, damaged by the crc32 of ``conv_id:turn``: c (the id as text, empty for null), turn, role, text."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("f") == 1, "").when(F.col("f") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = convs.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c"), "turn", said("role").alias("role"), said("text").alias("text"), fault.alias("f")).where("f != 0")
    copies = F.explode(F.when(F.col("f") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("c", "turn", F.when(F.col("f") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def judged(rows: DataFrame) -> DataFrame:
    """damaged rows -> in order (c, pos, block, last), with initial, that of the row before, and the first fault of each."""
    blank = ~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumns({"initial": F.substring("role", 1, 1), "blank": blank, "trunc": ~blank & ~F.rlike("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z")), "digest": F.unhex(F.md5("text")), "sha": F.unhex(F.sha2("text", 256))})
    return scanned(rows, "c", ["turn", "role", "digest"], ["turn", "role", "text", "initial", "blank", "trunc", "sha"], previous="initial").withColumn("block", F.expr(f"(pos - 1) div {BLOCK}"))


def fault_of(light: DataFrame) -> DataFrame:
    """light rows (c, pos, role, sha ...) with ``fault``: blank, duplicate, truncated or null; a row is a duplicate if it isn't the first of its role and text."""
    first = light.groupBy("c", "role", "sha").agg(F.min("pos").alias("pos")).select("c", "pos", F.lit(True).alias("first"))
    out = light.join(first, ["c", "pos"], "left")
    return out.withColumn("fault", F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("trunc"), "truncated")).drop("first", "sha", "role")


def kind() -> Column:
    """A row's number in the tables."""
    initial = F.when(F.col("initial") == "s", 1).when(F.col("initial") == "u", 2).when(F.col("initial") == "a", 3).otherwise(0)
    return (3 * initial + F.when(F.col("fault") == "truncated", 1).when(F.col("fault").isNotNull(), 2).otherwise(0)).cast("int")


def lines_of(code: str, begin: int, role: str, text: str) -> list[str]:
    """What a row becomes with the inserts before it."""
    out, state = [], begin
    for _ in code[:-1]:
        out.append(f"{FULL[next_initial(state)]}:")
        state = after(state, next_initial(state))
    if code[-1] == "K":
        out.append(f"{role}:{text}")
    elif code[-1] == "R":
        out.append(f"{FULL[next_initial(state)]}:{text}")
    return out


def tail_lines(end: int) -> list[str]:
    return ["user:", "assistant:"][2 - len(TAIL[end]) :]


class Writer:
    """Repairs the rows of a block one after another; what has been repaired is handed on whenever it is long."""

    def __init__(self, c: str, block: int):
        self.c, self.at, self.audit, self.lines, self.size = c, block * BLOCK, [], [], 0
        self.alone, self.out = block == 0, []

    def row(self, pos: int, role: str, text: str, code: str, begin: int, tail: int | None) -> None:
        new = lines_of(code, begin, role, text) + (tail_lines(tail) if tail is not None else [])
        self.audit.append(code + (TAIL[tail] if tail is not None else ""))
        self.lines += new
        self.size += sum(map(len, new))
        self.whole = tail is not None
        if self.size > PIECE and not self.whole:
            self.alone = False
            self.hand_on()
            self.at = pos

    def hand_on(self) -> None:
        text = "\n".join(self.lines)
        alone = self.alone and self.whole
        sha = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest() if alone else None
        self.out.append((self.c, self.at, "".join(self.audit), sha, None if alone or not self.lines else text))
        self.audit, self.lines, self.size = [], [], 0


def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of blocks, each after its edit -> c, at, audit, and the SHA-256 of a whole conversation in one piece or else the lines of a piece."""
    key, now, edit = None, None, None
    names = ["c", "block", "pos", "role", "text", "code", "begin", "tail"]
    for batch in batches:
        out = []
        for c, block, pos, role, text, code, begin, tail in zip(*(batch.column(batch.schema.get_field_index(x)).to_pylist() for x in names), strict=True):
            if (c, block) != key:
                if now:
                    now.hand_on()
                    out += now.out
                key, now = (c, block), Writer(c, block)
            if code is not None:
                edit = CODES[code], begin, tail
                continue
            now.row(pos, role, text, *edit)
            if now.out:
                yield pieces(now.out)
                now.out = []
        if out:
            yield pieces(out)
    if now:
        now.hand_on()
        yield pieces(now.out)


def pieces(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), *(pa.array(x, pa.string()) for x in cols[2:])], names=["c", "at", "audit", "sha", "lines"])


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of each conversation in order -> its audit and the SHA-256 of its lines; texts go through one by one."""
    key, audit, sha, some = None, [], None, False
    for batch in batches:
        for c, _, own, _, lines in zip(*(batch.column(i) for i in range(5)), strict=True):
            c = c.as_py()
            if c != key:
                if key is not None:
                    yield finished(key, audit, sha)
                key, audit, sha, some = c, [], hashlib.sha256(), False
            audit.append(own.as_py())
            if lines.is_valid:
                if some:
                    sha.update(b"\n")
                sha.update(lines.as_buffer())
                some = True
    if key is not None:
        yield finished(key, audit, sha)


def finished(c: str, audit: list[str], sha) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c], pa.string()), pa.array(["".join(audit)], pa.string()), pa.array([sha.hexdigest()], pa.string())], names=["c", "audit", "sha"])


def rewritten(rows: DataFrame, states: DataFrame, done: DataFrame) -> DataFrame:
    """c, audit and sha of all conversations that have rows."""
    tail = done.select("c", F.col("end").alias("tail"), F.lit(True).alias("last"))
    edits = states.select("c", F.expr(f"(at - 1) div {BLOCK}").alias("block"), F.col("at").alias("pos"), "code", "begin")
    lasts = rows.where("last").select("c", "pos", "last")
    edits = edits.join(lasts.join(tail.drop("last"), "c").select("c", "pos", "tail"), ["c", "pos"], "left")
    none = lambda t: F.lit(None).cast(t)
    texts = rows.select("c", "block", "pos", F.lit(1).alias("what"), "role", "text", none("int").alias("code"), none("int").alias("begin"), none("int").alias("tail"))
    both = texts.unionByName(edits.select("c", "block", "pos", F.lit(0).alias("what"), none("string").alias("role"), none("string").alias("text"), "code", "begin", "tail"))
    blocks = cut(both.repartition("c", "block").sortWithinPartitions("c", "block", "pos", "what").mapInArrow(written, "c string, at long, audit string, sha string, lines string"), rebalance=False)
    long = blocks.where("sha IS NULL").repartition("c").sortWithinPartitions("c", "at").mapInArrow(hashed, "c string, audit string, sha string")
    return blocks.where("sha IS NOT NULL").select("c", "audit", "sha").unionByName(long)


def repair(convs: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> faults, cost, audit and digest of the damaged and repaired conversations."""
    rows = judged(damaged(convs))
    light = cut(fault_of(rows.drop("text")).withColumn("kind", kind()))
    states, done = planned(light.select("c", "block", F.col("pos").alias("at"), "kind"))
    legal = F.concat("prev", "initial").isin("su", "ua", "au")
    counts = light.groupBy("c").agg(*(F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")), F.count_if((F.col("pos") > 1) & ~legal).alias("illegal"))
    turns = light.where("turn IS NOT NULL").groupBy("c", "turn").agg(F.count("*").alias("n")).groupBy("c").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    all_ = convs.select("conv_id").distinct().withColumn("c", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    out = all_.join(turns, "c", "left").join(counts, "c", "left").join(done.select("c", "cost"), "c", "left").join(rewritten(rows, states, done), "c", "left")
    zero = {x: F.coalesce(x, F.lit(0)).cast("long") for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    sha = F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256))
    return out.withColumns(zero).select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), sha.alias("repaired_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
