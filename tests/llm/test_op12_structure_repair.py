import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from kgloom.llm import op12_structure_repair as op

SCHEMA = "conv_id long, turn long, role string, text string, c string, block string, at int, kind string, f int, pos int, cost string, copy int"
FIELDS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
FULL = {"u": "user", "a": "assistant"}


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "c", "b", 1, "k", 2, 3, "c", 4) for r in rows], SCHEMA).repartition(parts)


def damage(rows):
    said = lambda x: " " if x is None else str(x)
    for c, turn, role, text in rows:
        role, text = said(role), said(text)
        f = zlib.crc32(f"{said(c)}:{said(turn)}".encode()) % 20
        if f == 0:
            continue
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        for _ in range(2 if f == 3 else 1):
            yield c, turn, "user" if f == 4 else role, text


def cheapest(rows):
    """(cost, audit, lines) over all edits: rows are (role, text, fault); a plain search that keeps the least of each (row, initials) and compares whole audits."""
    best = {(0, ""): (0, "", ())}
    done = []
    for n in range(len(rows) + 1):
        for _ in range(3):  # inserts
            for (k, s), (cost, audit, lines) in list(best.items()):
                for x in "ua":
                    if k == n and s + x in ("u", "su", "ua", "au"):
                        new = (cost + 2, audit + "I", (*lines, f"{FULL[x]}:"))
                        best[n, x] = min(best.get((n, x), new), new)
        here = {s: v for (k, s), v in best.items() if k == n}
        if n == len(rows):
            done = [v for s, v in here.items() if s in ("", "a")]
            break
        role, text, fault = rows[n]
        best = {}
        for s, (cost, audit, lines) in here.items():
            ways = [(s, 3, "D", ())]
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                ways += [(role[:1], more, "K", (f"{role}:{text}",))] + [(x, 2 + more, "R", (f"{FULL[x]}:{text}",)) for x in "ua"]
            for x, paid, edit, new in ways:
                if edit == "D" or x and s + x in ("s", "u", "su", "ua", "au"):
                    found = (cost + paid, audit + edit, lines + new)
                    best[n + 1, x] = min(best.get((n + 1, x), found), found)
    return min(done)


def brute(rows):
    out = []
    for c in {r[0] for r in rows}:
        own = sorted((r for r in damage(rows) if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        seen, faults = set(), []
        for _, _, role, text in own:
            last = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = {r[1] for r in own} - {None}
        cost, audit, lines = cheapest([(r[2], r[3], f) for r, f in zip(own, faults, strict=True)])
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[f] for f in FIELDS) for r in df.collect()), key=repr)


def conversations(seed, n, most):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randint(1, most)):
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]) if r.random() < 0.5 else ["user", "assistant"][t % 2]
            rows.append((c, r.choice([t, t, t, t + 5, None]), role, r.choice(["Yes.", "No!", "open", " \t", "", None, f"own {c} {t}.", "\x0b.\n"])))
    return rows


def test_against_brute_force(spark):
    rows = conversations(11, 150, 9)
    assert got(op.repair(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("block,piece", [(2, 20), (3, 1 << 20)])
def test_blocks_of_blocks_and_pieces(spark, monkeypatch, block, piece):
    """Conversations over many blocks, summed up level by level, with texts in pieces."""
    monkeypatch.setattr(op, "BLOCK", block)
    monkeypatch.setattr(op, "PIECE", piece)
    rows = conversations(block, 12, 8) + [(100, t, r, x) for t, (r, x) in enumerate(zip(["system", "user", "user", "assistant", "tool"] * 6, ["A.", "b", "C!", "", "D."] * 6, strict=True))]
    assert got(op.repair(frame(spark, rows))) == brute(rows)


def test_tables_against_search():
    """Every kind of row from every state: no longer run of inserts is better."""
    for kind in range(12):
        initial, fault = op.STATES[kind // 3], kind % 3
        for i in range(4):
            best = {}
            for run in range(6):
                state = i
                for _ in range(run):
                    state = op.after(state, op.next_initial(state))
                ways = [("D", state, 3)]
                if fault < 2:
                    ways += [("R", op.after(state, op.next_initial(state)), 2 + fault), ("K", op.after(state, initial), fault)]
                for edit, j, cost in ways:
                    if j is not None:
                        best[j] = min(best.get(j, (99, "")), (2 * run + cost, "I" * run + edit))
            for j in range(4):
                found = (op.COST[kind, i, j], op.CODES[op.CODE[kind, i, j]]) if op.COST[kind, i, j] < op.INF else None
                if j in best and (i != 0 or best[j][1][:2] != "II") or found:
                    assert found == best.get(j)


def test_lockstep_ends_where_a_plain_search_ends():
    r = np.random.default_rng(5)
    kinds = [r.integers(0, 12, n) for n in (0, 1, 5, 9, 30)]
    flat, size = np.concatenate(kinds), np.array([len(k) for k in kinds])
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    cost, rank, _ = op.lockstep(op.COST[flat], op.CODE[flat], start, size)
    for b, own in enumerate(kinds):
        best = {0: (0, "")}
        for k in own:
            new = {}
            for i, (paid, audit) in best.items():
                for j in range(4):
                    if op.COST[k, i, j] < op.INF:
                        way = (paid + op.COST[k, i, j], audit + op.CODES[op.CODE[k, i, j]])
                        new[j] = min(new.get(j, way), way)
            best = new
        assert {j: c[0] for j, c in best.items()} == {j: cost[b, 0, j] for j in best}
        assert sorted(best, key=lambda j: best[j][1]) == sorted(best, key=lambda j: rank[b, 0, j])


def test_whole_blocks_over_batches():
    rows = [("a", b, i) for b in range(3) for i in range(b + 2)] + [("b", 0, i) for i in range(7)] + [("c", 0, 0)]
    for step in range(1, 18):
        batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[i : i + step], strict=True)], names=["c", "block", "at"]) for i in range(0, len(rows), step)]
        out = [[tuple(x.values()) for x in b.to_pylist()] for b in op.whole_blocks(iter(batches))]
        assert [x for b in out for x in b] == rows
        keys = [{x[:2] for x in b} for b in out]
        assert all(not a & b for a, b in itertools.combinations(keys, 2))


def test_nulls_empty_and_lost_conversations(spark):
    lost = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(lost, 0, "user", "Gone."), (None, None, None, None), (None, 1, "user", "Who?"), (500, None, "user", "A."), (500, None, "user", "A."), (501, 0, "assistant", "é" * 300_000 + "."), (501, 1, "user", "!")]
    assert got(op.repair(frame(spark, rows))) == brute(rows)
    assert (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got(op.repair(frame(spark, rows)))
    empty = op.repair(frame(spark, []))
    assert empty.columns == FIELDS and empty.collect() == []
